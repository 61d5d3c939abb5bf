"""BPE, media, secrets and fingerprints against plain Python."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tellurion.llm import bpe, fingerprint, media, queries, secrets


def reference_encoding():
    return bpe.encoding(*queries.bpe_files())


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 12\n\t'sé😀.,  x"), max_size=400), st.integers(1, 40))
def test_cut_texts_encode_alike(text, size):
    ids = bpe.encode_text(text, *queries.bpe_files(), long_text=size)
    assert ids == reference_encoding().encode_ordinary(text)
    assert reference_encoding().decode_bytes(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["   ", "\n\n", "a", "é ", "1", " ", "\u3000", "\xa0", "\x1c", "\t"]), max_size=20).map("".join))
def test_blank_runs_cut_by_the_pattern(text):
    kept, bpe.BLANK_RUN = bpe.BLANK_RUN, re.compile(f"[{bpe.WHITE}]{{2,}}")
    try:
        assert bpe.encode_text(text, *queries.bpe_files(), long_text=1) == reference_encoding().encode_ordinary(text)
    finally:
        bpe.BLANK_RUN = kept


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "a\n" + "\n" * 1_000_000 + " y z", "x" + "\t " * 600_000, "b" * 300_000])
def test_very_long_runs_come_back(text):
    ids = bpe.encode_text(text, *queries.bpe_files())
    assert reference_encoding().decode_bytes(ids) == text.encode()


def test_bpe_query_columns(spark, sf_dir):
    own, texts = reference_encoding(), {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_on_odd_rows(spark, odd, empty):
    files = queries.bpe_files()
    ids = bpe.encode(F.col("text"), *files)
    rows = odd.select("text", ids.alias("ids"), bpe.decode(ids, *files).alias("back"), bpe.id_array(ids).alias("array"), bpe.token_count(ids).alias("n")).collect()
    for r in rows:
        want = reference_encoding().encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want == list(r.array) and r.n == len(want)
        assert bytes(r.back) == (r.text or "").encode()
    assert empty.select(ids.alias("ids")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700))
def test_png_round_trip(data):
    payload = media.pad(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data)
    assert media.read_png(media.write_png(payload)).tobytes() == payload


def test_png_filters_and_checksums():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (6, 64), dtype=np.uint8)
    lines = np.zeros((6, 65), np.uint8)
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
        lines[y, 0] = kind
        for x in range(64):
            left, up, corner = (int(rows[y, x - 1]) if x else 0), (int(rows[y - 1, x]) if y else 0), (int(rows[y - 1, x - 1]) if x and y else 0)
            p = left + up - corner
            best = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
            guess = (0, left, up, (left + up) // 2, best)[kind]
            lines[y, x + 1] = (int(rows[y, x]) - guess) & 255
    assert (media.unfilter(lines) == rows).all()
    image = media.write_png(rows.tobytes())
    for spoiled in (image[:50] + bytes([image[50] ^ 1]) + image[51:], image[:-5], b"GIF" + image):
        with pytest.raises((ValueError, zlib.error)):
            media.read_png(spoiled)


def test_media_on_odd_rows(odd):
    image = media.to_png(F.col("text"))
    for r in odd.select("text", media.from_png(image).alias("b")).collect():
        data = (r.text or "").encode()
        assert bytes(r.b.payload) == (data + bytes(-len(data) % 64) or bytes(64)) and len(r.b.hash) == 8
    same = media.cosine_hash(np.arange(640, dtype=np.uint8).reshape(10, 64))
    assert same == media.cosine_hash(np.arange(640, dtype=np.uint8).reshape(10, 64))


def plain_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, b, k in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["secret", "TOKEN", "api_key", "apikey", "=", ": ", '"', "'", " ", "AKIA", "ABCDEF012345", "0af1" * 4, "0af1" * 8, "abcdefgh", "x", "ſecret", "é"]), max_size=14).map("".join))
def test_base_rules(text):
    found = [(r.kind, a, b) for r in secrets.BASE for a, b in r.spans(text)]
    assert sorted(found) == sorted(plain_spans(text))


def test_ledger_scans_each_pair_once(spark, odd, empty):
    ledger = secrets.new_ledger(spark)
    rows = secrets.scan_versions(odd, ledger).select("doc_id", "text", *secrets.digests(F.col("found"))).collect()
    assert len(rows) == odd.count()
    for r in rows:
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(r.text or ""))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans == listed
    once = ledger.read().count()
    assert once == ledger.read().select("blob", "rule", "rule_version").distinct().count()
    secrets.scan_versions(odd, ledger).count()
    assert ledger.read().count() == once
    newer = (*secrets.BASE, secrets.Rule("pem", 2, "x{50,}"))
    more = secrets.scan_versions(odd, ledger, newer).filter("doc_id = 7").first()
    assert ledger.read().count() == once + odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert [(s.kind, s.start, s.end) for s in more.found] == [("pem", 0, 60_000)]
    assert secrets.scan_versions(empty, secrets.new_ledger(spark)).count() == 0


@pytest.mark.parametrize("text", ["eyJ" * 200_000, "-----BEGIN A" * 60_000, "token" + " " * 500_000, "token " * 100_000, "AKIA" * 150_000, "eyJaaaaaaaaaaaaa." * 40_000, "-----BEGIN PRIVATE KEY-----AAAAAAAAAAAAAAAAAAA" * 10_000])
def test_no_rule_is_slow_on_hostile_texts(text):
    began = time.process_time()
    for rule in secrets.RULES:
        rule.spans(text)
    assert time.process_time() - began < 5


def test_secrets_query_columns(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_secrets"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in found) for x in ("assign", "access", "hex")]


def test_redaction():
    assert secrets.redacted("a secret=12345678 b", [(2, 17, "assign")]) == "a [assign] b"
    assert secrets.redacted("abcdef", [(0, 3, "x"), (2, 5, "y")]) == "[x]f" and secrets.redacted(None, []) is None


words = st.lists(st.sampled_from("a b cc d e f".split()), max_size=120).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(words, words, st.integers(1, 3))
def test_sketches(a, b, times):
    x, y = fingerprint.sketch_text(a, k=32), fingerprint.sketch_text(b, k=32)
    sa, sb = (set(fingerprint.shingles(fingerprint.words_of(t)).tolist()) for t in (a, b))
    assert x.tolist() == sorted(sa)[:32]
    assert fingerprint.merge(x, y, 32).tolist() == sorted(sa | sb)[:32]
    if len(sa | sb) <= 32:
        assert fingerprint.resemblance(x, y, 32) == (len(sa & sb) / len(sa | sb) if sa | sb else 1.0)
        assert fingerprint.containment(x, y, 32) == (len(sa & sb) / len(sa) if sa else 1.0)
    assert (fingerprint.load(fingerprint.dump(x)) == x).all() and 0 <= fingerprint.resemblance(x, y, 32) <= 1


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abé 😀\n"), max_size=900), st.text(st.sampled_from("abé 😀\n"), max_size=900))
def test_edited_sketch(text, other):
    own, theirs = (fingerprint.shingles(fingerprint.words_of(t)) for t in (text, other))
    edited, got = fingerprint.edited_sketch(text, own, other, theirs)
    half = len(text) // 2
    assert edited == text[: len(text) - half] + other[:half]
    assert got.tolist() == fingerprint.sketch_text(edited).tolist()


def test_long_estimates():
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 20_000)]
    a, b = fingerprint.sketch_text(" ".join(base)), fingerprint.sketch_text(" ".join(base[:10_000] + [f"v{i}" for i in range(10_000)]))
    assert abs(fingerprint.resemblance(a, b) - 1 / 3) < 0.15 and abs(fingerprint.containment(a, b) - 0.5) < 0.2
    assert abs(fingerprint.distinct(a) / 20_000 - 1) < 0.3


def test_neighbours_over_many_parts(spark, odd, empty):
    texts = {i: f"text {i} " * (i % 7) for i in range(0, 900, 3)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    dealt = fingerprint.neighbours(df, row_bytes=1000, part_bytes=20_000)
    by_part = {}
    for r in dealt.collect():
        by_part.setdefault(r.part, []).append((r.doc_id, r["last"]))
    assert len(by_part) == 15
    follows = {a: b for rows in by_part.values() for (a, _), (b, _) in zip(rows, rows[1:], strict=False)}
    ids = sorted(texts, reverse=True)
    assert follows == dict(zip(ids, ids[1:] + ids[:1], strict=True))
    rows = fingerprint.against_next(odd).collect()
    assert len(rows) == odd.count() and fingerprint.against_next(empty).count() == 0
    one = fingerprint.against_next(odd.filter("doc_id = 9")).first()
    assert one.near_next == 1.0
    same = [r.fingerprint for r in rows if r.doc_id in (5, 6)]
    assert same[0] == same[1]


def test_hot_ids_are_split(spark):
    """An id, or no id, with a large part of all rows lies in several parts, and neighbours stay neighbours."""
    rows = [(i, f"text {i}") for i in range(200)] + [(77, f"hot {i}") for i in range(300)] + [(None, f"none {i}") for i in range(300)] + [(199, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    by_part = {}
    for r in fingerprint.neighbours(df, row_bytes=1000, part_bytes=40_000).collect():
        by_part.setdefault(r.part, []).append((r.doc_id, r.text, r["last"]))
    of = lambda i: sum(any(x[0] == i and not x[2] for x in rows) for rows in by_part.values())
    assert of(77) >= 5 and of(None) >= 5
    follows = {}
    for rows_of in by_part.values():
        for (a, t, _), (b, u, _) in zip(rows_of, rows_of[1:], strict=False):
            follows[a, t] = (b, u)
    assert set(follows) == set(rows) and sorted(map(str, follows.values())) == sorted(map(str, rows))
    assert all(b is None or a is None or b <= a or (a == 0) for (a, _), (b, _) in follows.items())
    assert {b for (a, _), (b, _) in follows.items() if a is None} == {None, 199} and sum(a is None and b == 199 for (a, _), (b, _) in follows.items()) == 1


def test_fingerprint_query_against_plain_python(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op9_fingerprint"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (i, text), (_, other) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own, there, theirs = (fingerprint.sketch_text(t) for t in (text, edited, other))
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprint.dump(own) and r.edited_fingerprint == fingerprint.dump(there)
        assert r.near_edited == fingerprint.resemblance(own, there) and r.near_next == fingerprint.resemblance(own, theirs)


def test_media_query_against_plain_python(spark, sf_dir, empty):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_media"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64) or bytes(64)
        image = media.write_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(payload), len(image))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(image).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert empty.select(media.to_png(F.col("text")).alias("i")).count() == 0


def test_merged_parts(spark):
    df = spark.createDataFrame([("k", "a b c d e f"), ("k", "c d e f g h"), ("j", "")], "key string, text string")
    parts = df.select("key", fingerprint.sketch(F.col("text")).alias("s"))
    got = {r.key: fingerprint.load(r.s).tolist() for r in fingerprint.merged(parts, ["key"], "s").collect()}
    want = fingerprint.merge(fingerprint.sketch_text("a b c d e f"), fingerprint.sketch_text("c d e f g h"))
    assert got == {"k": want.tolist(), "j": []}
    both = parts.alias("a").crossJoin(parts.alias("b")).select(fingerprint.estimates(F.col("a.s"), F.col("b.s")).alias("e")).collect()
    assert {round(r.e.resemblance, 3) for r in both} >= {0.0, 1.0}
