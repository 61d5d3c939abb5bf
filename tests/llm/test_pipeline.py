"""Each stage of the pipeline on its own input against brute force."""

import itertools
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from tellurion.llm import bpe, queries, secrets, simhash
from tellurion.session import saved


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_keep_columns_and_oddities(spark, sf_dir, odd, empty):
    for table in (odd, empty):
        now = table
        for name, stage in pipeline.STAGES[:-1]:
            out = saved(stage(spark, now, sf_dir), "stage")
            assert out.columns == odd.columns, name
            now = out
        pipeline.encode(spark, now, sf_dir).count()
    assert empty.count() == 0


def test_classifier_drops_what_it_rejects(spark, sf_dir, docs):
    kept = {r.doc_id for r in pipeline.keep_good(spark, docs, sf_dir).select("doc_id").collect()}
    scored = queries.QUERIES["op4_quality"](spark, sf_dir).collect()
    assert kept == {r.doc_id for r in scored if r.predicted == 1}


def test_one_document_of_each_group_stays(spark, sf_dir, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    shingles = {i: set(simhash.shingle_hashes(t, pipeline.WIDTH).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}
    ids = sorted(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(shingles[a] & shingles[b]) >= pipeline.LEAST * len(shingles[a] | shingles[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert left == {find(i) for i in ids}


def least_of_groups(texts):
    """Least ids of the components of all pairs whose shingle sets resemble each other by LEAST."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if simhash.resemblance(texts[a], texts[b], pipeline.WIDTH) >= pipeline.LEAST:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {find(i) for i in texts}


def left_of(spark, sf_dir, texts):
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, table, sf_dir).collect())


def test_near_copies_with_a_recurring_passage(spark, sf_dir):
    texts = {}
    for k in range(40):
        words = [f"a{k}w{i}" for i in range(100)]
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(words + words[k % 60 : k % 60 + 40] * 10)
    want = sorted(least_of_groups(texts))
    assert want == list(range(0, 80, 2))
    assert left_of(spark, sf_dir, texts) == want


def test_a_dominant_run_does_not_merge_documents(spark, sf_dir):
    texts = {k: " ".join(["same"] * 300 + [f"b{k}w{i}" for i in range(60)]) for k in range(20)} | {20: "line of six words said often " * 400 + "end", 21: "line of six words said often " * 400 + "and what no other text has at its end"}
    assert left_of(spark, sf_dir, texts) == sorted(least_of_groups(texts)) == list(range(22))


def test_documents_are_ids_with_texts(spark, sf_dir):
    """Different texts of one id are documents of their own; rows that repeat are one; rows without an id come last."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(7, a), (7, b), (3, a), (7, a), (None, b + " more"), (None, c), (None, c), (5, None), (5, ""), (None, " ")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash"))
    left = pipeline.drop_near_duplicates(spark, table, sf_dir).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == sorted([("3", a), ("7", b), ("None", c), ("5", ""), ("5", ""), ("None", " ")])


def test_secrets_are_redacted_and_nothing_else(spark, sf_dir, docs):
    out = {r.doc_id: r for r in pipeline.redact_secrets(spark, docs, sf_dir).collect()}
    for r in docs.collect():
        spans = [(a, b, rule.kind) for rule in secrets.RULES for a, b in rule.spans(r.text)]
        assert out[r.doc_id].text == secrets.redacted(r.text, spans)
        assert out[r.doc_id].n_chars == (len(out[r.doc_id].text) if spans else r.n_chars)


def test_mix_repeats_documents(spark, sf_dir, docs):
    times = Counter(r.doc_id for r in pipeline.mix_sources(spark, docs, sf_dir).select("doc_id").collect())
    for r in queries.QUERIES["op2_mixing"](spark, sf_dir).collect():
        assert times[r.doc_id] == (r.taken // r.size if r.size else 1)


def test_encoding(spark, sf_dir, docs):
    own = bpe.encoding(*queries.bpe_files())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pipeline.encode(spark, docs, sf_dir).filter(F.col("doc_id") % 5 == 0).collect():
        assert r.n_tokens == len(own.encode_ordinary(texts[r.doc_id]))


def test_run(spark, sf_dir):
    assert set(pipeline.run(spark, sf_dir).columns) == {"doc_id", "source", "n_tokens", "ids", "decoded_sha256"}
