"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm import bpe, fingerprint, html_extract, media, mixing, quality, secrets, simhash, suffix, url_filter
from tellurion.session import saved, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = html_extract.extract(pages, F.col("html"), url_filter.host_and_path(F.col("url"))[0])
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def slim_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", mixing.size_in_words(F.col("text")).alias("size"), mixing.plain_share(F.col("text")).alias("quality"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = saved(slim_documents(table(spark, sf_dir, "documents")), "slim")
    return mixing.mix(slim).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op2_mixing"] = mixing.ORACLE


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_versions(table(spark, sf_dir, "documents"), secrets.new_ledger(spark), keep=["doc_id"])
    return found.select("doc_id", *secrets.digests(F.col("found")))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, training_labels(spark, sf_dir))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", quality.accepted(F.col("score")).cast("int"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = saved(docs.select(F.col("doc_id").alias("id"), simhash.fingerprint(F.col("text"), width=4).alias("fp")), "prints")
    return simhash.near_duplicates(rows, radius=4).select(F.col("id").alias("doc_id"), F.col("fp").alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("row.page_id", "host", "path", "rule", "verdict")


ORACLES["op6_urls"] = url_filter.ORACLE


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bpe_files()
    ids = bpe.encode(F.col("text"), *files)
    coded = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"), bpe.decode(ids, *files).alias("decoded"))
    return coded.select("doc_id", bpe.token_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that shares 50 words or more with another."""
    found = suffix.repeats(table(spark, sf_dir, "documents"))
    words = F.aggregate("spans", F.lit(0), lambda n, s: n + s.end - s.start)
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.start, s.end)), ",")
    return found.select("doc_id", F.size("spans").alias("n_spans"), words.cast("long").alias("repeated_words"), listed.alias("spans"))


@query
def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_next(table(spark, sf_dir, "documents"))


@query
def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = media.to_png(F.col("text"))
    stored = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), image.alias("image"), media.from_png(image).alias("back"))
    payload = F.col("back.payload")
    return stored.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"), F.octet_length("image").cast("long").alias("media_bytes"),
        F.sha2("image", 256).alias("media_sha256"), F.lower(F.hex("back.hash")).alias("feature"),
    )
