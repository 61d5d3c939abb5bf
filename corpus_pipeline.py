"""The corpus pipeline: quality filter, near-duplicate removal, secret redaction, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of documents, extra columns included. Nulls in any column,
empty texts, repeated rows and empty tables pass through as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm import bpe, mixing, quality, queries, secrets, simhash
from tellurion.session import discard, only_keeping, saved, ship_package

#: Near duplicates: five-word shingles, each once, on 6 x 64 bits. Texts that resemble each other by 0.8
#: differ in 0.151 of the bits on average, 58 of 384; the radius lies 2.5 standard deviations
#: above that, and what lies within it is held against the texts.
WIDTH, WORDS, LEAST = 5, 6, 0.8
DIFFERING, RADIUS = 0.151, 76


def _row(docs: DataFrame) -> DataFrame:
    """Each row whole in `row`, beside new columns whose names then cannot clash with its own."""
    return docs.select(F.struct("*").alias("row"))


def _back(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    return rows.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from all labels but those held out."""
    ship_package(spark)
    model = quality.train(docs.select("doc_id", "text"), queries.training_labels(spark, sf_dir))
    rows = _row(docs).withColumn("score", quality.score(F.col("row.text"), model))
    return _back(rows.filter(quality.accepted(F.col("score"))), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: least doc_id, none last, then least hash of the text.

    Two documents are near duplicates if their sets of shingles resemble each other by LEAST
    or more. A document is a doc_id with a text: rows that share a doc_id but not the text are
    documents of their own, and of rows that share both one stays. Documents without words
    are kept as they are.
    """
    ship_package(spark)
    key = ["none", "doc", "mark"]
    rows = _row(docs).withColumns({"none": F.col("row.doc_id").isNull(), "doc": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(0)), "mark": F.xxhash64("row.text")})
    wordy = mixing.size_in_words(F.col("row.text")) > 0
    texts = rows.filter(wordy).select(F.struct(*key).alias("id"), F.col("row.text").alias("text"))
    prints = saved(texts.select("id", simhash.fingerprint(F.col("text"), WIDTH, WORDS, distinct=True).alias("fp"), "id.mark"), "prints")
    bands = lambda n: simhash.lsh_bands(WORDS, DIFFERING, n)
    check = lambda edges: simhash.resembling(edges, prints, texts, WIDTH, LEAST)
    sketched = lambda fps: simhash.sketches(fps, prints, texts, WIDTH)
    groups = simhash.near_duplicates(prints, RADIUS, bands, check=check, sketched=sketched, least=LEAST)
    first = saved(groups.filter("id = component").select("id.*").distinct(), "kept")
    # One row of each document before the join: equal rows meet within their tasks first.
    plain = [F.col("row")[f.name] for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
    one = rows.filter(wordy).groupBy(*key).agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return _back(one.join(first, key).select("row").union(rows.filter(~wordy).select("row")), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced by their kind; n_chars follows the new text."""
    ship_package(spark)
    rows = secrets.scan_versions(_row(docs).withColumn("text", F.col("row.text")), secrets.new_ledger(spark), keep=["row"])
    hit = F.size("found") > 0
    clean = rows.withColumn("text", F.when(hit, secrets.redact(F.col("row.text"), F.col("found"))).otherwise(F.col("row.text")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return _back(clean, docs, **changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each epoch, none for those it leaves out.

    Documents without words take no part of any budget and stay as they are.
    """
    slim = saved(queries.slim_documents(docs), "slim")
    plan = mixing.plan(slim)
    rows = _row(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), mixing.size_in_words(F.col("row.text")).alias("size"), mixing.plain_share(F.col("row.text")).alias("quality"))
    times = F.when(F.col("size") > 0, F.col("times")).otherwise(1)
    taken = plan.times(rows).withColumn("times", times).filter("times > 0")
    return _back(taken.withColumn("epoch", F.explode(F.sequence(F.lit(1), "times"))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row doc_id, source, its number of tokens, its ids, and a digest of the bytes they decode to."""
    ship_package(spark)
    files = queries.bpe_files()
    ids = bpe.encode(F.col("text"), *files)
    coded = docs.select("doc_id", "source", ids.alias("ids"), bpe.decode(ids, *files).alias("decoded"))
    return coded.select("doc_id", "source", bpe.token_count(F.col("ids")).alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("byte-level bpe", encode),
]

#: The classifier, SimHash and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with only_keeping(kept):  # a stage's own tables go when its result is stored
            kept.append(saved(stage(spark, docs, sf_dir), "stage"))
        discard(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
