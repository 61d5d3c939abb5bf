"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least distinct 48-bit hashes of a text's shingles (five words, A-Z
lower-cased; fewer words make one shingle, no words none). Sketches of parts merge into
that of the whole, and two sketches estimate resemblance, containment and the number of
distinct shingles; below k distinct shingles the estimates are exact. Texts without words
have the empty sketch: two of those resemble each other by 1, one of them and another
text by 0. Equal texts have equal sketches.

As a string a sketch is the base64 of its sorted 6-byte hashes, least first.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.session import saved

WIDTH, K = 5, 128
TOP = 1 << 48
MOST_PARTS = 100_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Hashes of words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_words = WordHashes()


def words_of(text: str) -> np.ndarray:
    split = text.encode().lower().split()
    return np.fromiter(map(_words.__getitem__, split), np.uint64, len(split))


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """48-bit hashes of all shingles, in order."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        total = total * _A + words[i : i + n]
    total ^= total >> np.uint64(31)
    total *= _B
    total ^= total >> np.uint64(29)
    return total >> np.uint64(16)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct values, sorted."""
    if len(hashes) > 8 * k:
        cut = hashes
        for take in (4 * k, len(hashes)):  # repeats may leave fewer than k
            cut = np.unique(np.partition(hashes, take - 1)[:take] if take < len(hashes) else hashes)
            if len(cut) >= k:
                break
        return cut[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def _joint(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the union's sketch, which values are in a and in b. A sketch shorter than k is its whole set."""
    union = merge(a, b, k)
    return union, np.isin(union, a, assume_unique=True), np.isin(union, b, assume_unique=True)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    union, in_a, in_b = _joint(a, b, k)
    return float((in_a & in_b).mean()) if len(union) else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b has; 1 if a has none."""
    union, in_a, in_b = _joint(a, b, k)
    return float((in_a & in_b).sum() / in_a.sum()) if in_a.any() else float(not len(a))


def distinct(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) / (int(a[k - 1]) + 1) * TOP


def dump(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def load(text: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text or ""), np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(raw), 2), np.uint8), raw]).view(">u8").ravel().astype(np.uint64)


def sketch_text(text: str | None, width: int = WIDTH, k: int = K) -> np.ndarray:
    return bottom(shingles(words_of(text or ""), width), k)


def sketch(text: Column, width: int = WIDTH, k: int = K) -> Column:
    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([dump(sketch_text(t, width, k)) for t in texts], dtype=object)

    return made(text)


def estimates(a: Column, b: Column, k: int = K) -> Column:
    """Struct of resemblance, containment of a in b, and both numbers of distinct shingles, for two columns of sketches."""

    @F.pandas_udf("resemblance double, containment double, distinct_a double, distinct_b double")
    def found(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        pairs = [(load(s), load(t)) for s, t in zip(x, y, strict=True)]
        return pd.DataFrame([(resemblance(s, t, k), containment(s, t, k), distinct(s, k), distinct(t, k)) for s, t in pairs], columns=["resemblance", "containment", "distinct_a", "distinct_b"])

    return found(a, b)


def merged(rows: DataFrame, key: list[str], part: str, k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts, merged before and after the shuffle."""

    def fold(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *at, s in batch[[*key, part]].itertuples(index=False):
                at = tuple(at)
                held[at] = merge(held[at], load(s), k) if at in held else load(s)
            if len(held) > 10_000:
                yield pd.DataFrame([(*at, dump(s)) for at, s in held.items()], columns=[*key, part])
                held = {}
        yield pd.DataFrame([(*at, dump(s)) for at, s in held.items()], columns=[*key, part])

    narrow = rows.select(*key, part)
    # After the first fold a key has at most one sketch for each task.
    return narrow.mapInPandas(fold, narrow.schema).groupBy(*key).applyInPandas(lambda group: next(fold(iter([group]))), narrow.schema)


def ranges(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted quantiles of the ids as different cuts; for each bucket between them its first part and its parts for the cut id alone; the number of these parts.

    Parts are numbered by descending ids, nulls last. An id that is several quantiles has that
    many parts, by the hash of the text.
    """
    different, times = np.unique(cuts, return_counts=True)
    alone = np.concatenate(([0], np.where(times > 1, times, 0)))  # bucket i begins with cut i - 1
    width = 1 + alone
    first = np.cumsum(width[::-1])[::-1] - width
    return different, first, alone, int(width.sum())


def neighbours(docs: DataFrame, row_bytes: int = 4000, part_bytes: int = 8_000_000) -> DataFrame:
    """docs(doc_id, text) dealt out in ranges of descending doc_id: (part, place, doc_id, text, last).

    Each part ends with a copy (`last`) of the first document of the part after it, or of the
    first of all, so that within a part every document meets its successor. Ranges come from
    quantiles of the ids; rows of one id are ordered by the hash of their text, and an id, or the
    null ids, which come last, with more rows than a part is split by it.
    """
    total, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts = max(1, min(MOST_PARTS, total * row_bytes // part_bytes))
    shares = [i / parts for i in range(1, parts)]
    found = docs.filter("doc_id is not null").approxQuantile("doc_id", shares, 0.1 / parts) if shares else []
    cuts, first, alone, null_part = ranges(np.array(found, np.float64))
    null_parts = max(1, -(-nulls * parts // max(total, 1)))

    @F.pandas_udf("int")
    def place(ids: pd.Series, marks: pd.Series) -> pd.Series:
        none = ids.isna().to_numpy()
        value = ids.astype("float64").to_numpy()
        share = marks.to_numpy(np.int64) / 2.0**64 + 0.5  # grows with the mark
        at = np.searchsorted(cuts, np.where(none, -np.inf, value), side="right")
        cut_id = (at > 0) & (np.append(cuts, np.nan)[at - 1] == value) & (alone[at] > 0)
        own = first[at] + np.where(cut_id, 1 + np.minimum((share * alone[at]).astype(np.int64), np.maximum(alone[at] - 1, 0)), 0)
        of_null = null_part + np.minimum((share * null_parts).astype(np.int64), null_parts - 1)
        return pd.Series(np.where(none, of_null, own), dtype="int32")

    mark = F.xxhash64("text")
    order = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("down"), mark.alias("mark"))
    rows = docs.select("doc_id", "text", place("doc_id", mark).alias("part"), order.alias("order"))
    firsts = rows.groupBy("part").agg(F.min("order").alias("first"))
    of = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    follow = saved(firsts.select("first", of.alias("of")), "firsts")  # a row for each part, some MOST_PARTS at most
    copies = rows.join(F.broadcast(follow), F.col("order") == F.col("first")).dropDuplicates(["of"])
    every = rows.withColumn("last", F.lit(False)).union(copies.select("doc_id", "text", F.col("of").alias("part"), "order", F.lit(True)))
    # A task for each part: hashed numbers of parts would put several into one task and leave others empty.
    return every.repartitionById(null_part + null_parts, "part").sortWithinPartitions("part", "last", "order").select("part", "doc_id", "text", "last")


def against_next(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """docs(doc_id, text) -> for each row its sketch, that of its edited text, and how near they and the next document's are.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or
    all) of the document that follows by descending doc_id; the first one follows the last.
    """

    def compare(batches):
        held: tuple | None = None
        for batch in batches:
            out = []
            for doc_id, text, last in zip(batch.doc_id, batch.text, batch["last"], strict=True):
                text = text or ""
                own = shingles(words_of(text), width)
                now = (doc_id, text, own, bottom(own, k))
                if held is not None:
                    edited, there = edited_sketch(held[1], held[2], text, own, width, k)
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((held[0], len(held[1]), digest, dump(held[3]), dump(there), resemblance(held[3], there, k), resemblance(held[3], now[3], k)))
                held = None if last else now
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInPandas(compare, kinds)


def edited_sketch(text: str, own: np.ndarray, other: str, other_own: np.ndarray, width: int = WIDTH, k: int = K) -> tuple[str, np.ndarray]:
    """The edited text of text and the other, and its sketch; own and other_own are their shingles.

    Shingles that lie whole in either kept part are taken over, those at the seam and at the
    cut end are hashed anew.
    """
    half = len(text) // 2
    head, tail = text[: len(text) - half], other[:half]
    edited = head + tail
    before, after = len(head.encode().split()) - 1, len(tail.encode().split()) - 1
    if before < 2 * width or after < 2 * width:
        return edited, bottom(shingles(words_of(edited), width), k)
    seam = shingles(words_of(_last_words(head, width) + _first_words(tail, width)), width)
    end = other_own[-1:] if len(tail) == len(other) else shingles(words_of(_last_words(tail, width)), width)
    return edited, bottom(np.concatenate([own[: before - width + 1], seam, other_own[1 : after - width + 1], end]), k)


def _last_words(text: str, n: int) -> str:
    """From the start of the n-th last word on."""
    take = 32 * n
    while True:
        stretch = text[-take:]
        starts = [m.start() for m in WORD.finditer(stretch)]
        if len(starts) > n or take >= len(text):
            return stretch[starts[-n] :]
        take *= 2


def _first_words(text: str, n: int) -> str:
    """Up to the end of the n-th word."""
    take = 32 * n
    while True:
        ends = [m.end() for m in WORD.finditer(text[:take])]
        if len(ends) > n or take >= len(text):
            return text[: ends[n - 1]]
        take *= 2
