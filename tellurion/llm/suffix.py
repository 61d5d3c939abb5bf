"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are retained where a content-selected minimiser starts: of the word k-grams in
each stretch of `least` words the one with the least hash, the leftmost of equals. Equal
stretches select equal places, so two documents that share `least` words or more share a
retained suffix inside the passage. A suffix has an extent, the words of the stretches that
selected it: its left context, up to the suffix, and its right context, from there on.

Suffixes whose first k words occur in one document only are dropped. Of the others, equal
extents in two documents repeat as a whole. The rest, one suffix for each different extent,
are sorted by their right contexts over all machines, and neighbours are compared: their
common prefixes bound the intervals of the array whose suffixes share b words. Within such
an interval matches are extended left: its suffixes sorted by their left contexts, read
backwards, neighbours that share the `least` - b words before them repeat a stretch. Doing so
for every b finds every repeated stretch (the one neighbour with the longest match to the
right need not be the one whose matches to both sides add up to `least`). An interval that
reaches the end of a task's range of the array may go on in the next one, so a frequent
beginning need not fit one task: the stretches of those intervals meet by their hashes.

The result is exact, up to 64-bit hashes of words and runs: a word is covered if it lies in
`least` consecutive words that occur in two documents. Words are runs without blanks, A-Z
lower-cased. Rows of one doc_id are one document, so what they share among themselves does
not count; each of its different texts has a row of its own in the result. Rows without a
doc_id are told apart by their text. Null and short texts have no passages, documents
without repeats have no row, and columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.llm.fingerprint import words_of
from tellurion.session import saved

LEAST, GRAM = 50, 24
#: Suffixes, of some 600 bytes each, that a task sorts and compares.
PART_ROWS = 20_000
_P = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words, built from runs of powers of two."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out, at, power, step = np.zeros(count, np.uint64), 0, words, 1
    while True:
        if n & step:
            out = out * np.uint64(pow(_P, step, _M + 1)) + power[at : at + count]
            at += step
        if step * 2 > n:
            break
        power = power[: len(power) - step] * np.uint64(pow(_P, step, _M + 1)) + power[step:]
        step *= 2
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def suffixes(words: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Retained places, the hashes of their k-grams, and the first and last stretch that selects each."""
    stretches = len(words) - least + 1
    if stretches <= 0:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    grams = run_hashes(words, gram)
    chosen = np.lib.stride_tricks.sliding_window_view(grams, least - gram + 1).argmin(axis=1) + np.arange(stretches)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    places = chosen[first]
    return places, grams[places], first, np.append(first[1:], stretches) - 1


def extents(words: np.ndarray, first: np.ndarray, last: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Hashes of the words from the first stretch's start to the last one's end."""
    stretches = run_hashes(words, least)
    return mixed(stretches[first] * np.uint64(3) + mixed(stretches[last]) + (last - first).astype(np.uint64))


def _matrix(contexts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of contexts as a table, which of its cells are filled, and the contexts' lengths."""
    length = np.fromiter(map(len, contexts), np.int64, len(contexts)) // 8
    filled = np.arange(width) < length[:, None]
    out = np.zeros(filled.shape, np.uint64)
    out[filled] = np.frombuffer(b"".join(contexts), ">u8")
    return out, filled, length


def _common(table: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """How many words each row shares with the one before it, from the second row on."""
    same = (table[1:] == table[:-1]) & filled[1:] & filled[:-1]
    return np.where(same.all(axis=1), table.shape[1], same.argmin(axis=1)) if same.shape[1] else np.zeros(len(same), np.int64)


def compare(rows: pd.DataFrame, least: int = LEAST, gram: int = GRAM) -> pd.DataFrame:
    """A range of the sorted suffixes(gram, extent, a, b, left, right) -> (gram, extent, i, stretch, a, b).

    a and b are the least and greatest document that an extent occurs in. Where stretch is null,
    stretch i of the extent repeats; elsewhere that also depends on other ranges, and stretch is its hash.
    """
    m = len(rows)
    right, in_right, n_right = _matrix(rows.right.tolist(), least)
    left, in_left, n_left = _matrix(rows.left.tolist(), least - gram)
    first, last, key = rows.a.to_numpy(), rows.b.to_numpy(), rows.gram.to_numpy()
    common = np.where(key[1:] == key[:-1], _common(right, in_right), 0)
    lefts = rows.left.tolist()
    by_left = np.array(sorted(range(m), key=lefts.__getitem__))
    common_left = _common(left[by_left], in_left[by_left])
    rank = np.empty(m, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for b in range(gram, least + 1):
        a = least - b
        interval = np.concatenate(([0], np.cumsum(common < b)))
        rank[by_left] = np.concatenate(([0], np.cumsum(common_left < a)))
        have = np.flatnonzero((n_right >= b) & (n_left >= a))
        if not len(have):
            continue
        code = interval[have] * m + rank[have]
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) > 0)))
        sizes = np.diff(np.append(starts, len(have)))
        low, high = np.minimum.reduceat(first[have[order]], starts), np.maximum.reduceat(last[have[order]], starts)
        again = np.empty(len(have), bool)
        again[order] = np.repeat(low != high, sizes)
        alone = first[have] == last[have]
        going_on = (interval[have] == 0) | (interval[have] == interval[-1])
        found = np.flatnonzero(again & alone | going_on)
        out.append((have[found], n_left[have[found]] - a, again[found] & alone[found] & ~going_on[found]))
    if not out:
        return pd.DataFrame({"gram": [], "extent": [], "i": [], "stretch": [], "a": [], "b": []})
    at, i, sure = (np.concatenate(x) for x in zip(*out, strict=True))
    hashes: dict[int, np.ndarray] = {}
    stretch: list[int | None] = [None] * len(at)
    for n in np.flatnonzero(~sure).tolist():
        row = int(at[n])
        if row not in hashes:
            hashes[row] = run_hashes(np.concatenate([left[row, : n_left[row]][::-1], right[row, : n_right[row]]]), least).view(np.int64)
        stretch[n] = int(hashes[row][i[n]])
    return pd.DataFrame({"gram": key[at], "extent": rows.extent.to_numpy()[at], "i": i.astype(np.int32), "stretch": pd.array(stretch, "Int64"), "a": first[at], "b": last[at]})


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, part_rows: int = PART_ROWS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, spans): array of (start, end) in words, ends exclusive, merged and in order."""

    def retained(batches):
        for batch in batches:
            parts = []
            for key, none, mark, text in zip(batch.key, batch.none, batch.mark, batch.text, strict=True):
                words = words_of(text)
                _, own, first, last = suffixes(words, least, gram)
                if len(own):
                    parts.append((own, extents(words, first, last, least), first, last - first + 1, np.full(len(own), key), np.full(len(own), none), np.full(len(own), mark)))
            own, extent, start, n, key, none, mark = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64),) * 7
            yield pd.DataFrame({"gram": own.view(np.int64), "extent": extent.view(np.int64), "start": start.astype(np.int32), "n": n.astype(np.int32), "key": key.astype(np.int64), "none": none.astype(bool), "mark": mark.astype(np.int64)})

    def contexts(batches):
        seen = None
        for batch in batches:
            out = []
            for key, mark, text, wanted in zip(batch.key, batch.mark, batch.text, batch.wanted, strict=True):
                if (key, mark) == seen:  # repeated rows
                    continue
                seen = (key, mark)
                words = words_of(text)
                at, _, first, last = suffixes(words, least, gram)
                big = words.astype(">u8")
                for w in wanted:
                    i = int(np.searchsorted(first, w["start"]))
                    out.append((w["gram"], w["extent"], key, w["b"], big[first[i] : at[i]][::-1].tobytes(), big[at[i] : last[i] + least].tobytes()))
            yield pd.DataFrame(out, columns=["gram", "extent", "a", "b", "left", "right"])

    def ranges(batches):
        held = [b for b in batches if len(b)]
        if held:
            yield compare(pd.concat(held, ignore_index=True), least, gram)

    text = F.coalesce("text", F.lit(""))
    doc_id, mark = F.col("doc_id").cast("long"), F.xxhash64(text)
    texts = docs.select(F.coalesce(doc_id, mark).alias("key"), doc_id.isNull().alias("none"), mark.alias("mark"), text.alias("text"))
    sparse = saved(texts.mapInPandas(retained, "gram long, extent long, start int, n int, key long, none boolean, mark long"), "suffixes")
    # Both sides of the joins below are stored tables, not sums over the same shuffle: then Spark can split a gram
    # or an extent that a large part of all documents has.
    shared = saved(sparse.groupBy("gram").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a != b").select("gram"), "shared")
    near = saved(sparse.join(shared, "gram", "left_semi"), "near")
    one = F.min(F.struct("key", "none", "mark", "start")).alias("one")
    each = saved(near.groupBy("gram", "extent").agg(one, F.max("key").alias("b"), F.max("n").alias("n")).withColumn("alone", F.col("one.key") == F.col("b")), "extents")
    differ = saved(each.groupBy("gram").agg(F.count("*").alias("m"), F.max(F.col("alone").cast("int")).alias("alone")).filter("m > 1 and alone = 1").select("gram"), "differ")

    apart = each.join(differ, "gram", "left_semi").select("one.key", "one.none", "one.mark", F.struct("gram", "extent", "b", "one.start").alias("w"))
    wanted = saved(apart.groupBy("key", "none", "mark").agg(F.collect_list("w").alias("wanted")), "wanted")
    around = texts.join(wanted, ["key", "none", "mark"]).select("key", "mark", "text", "wanted")
    array = saved(around.mapInPandas(contexts, "gram long, extent long, a long, b long, left binary, right binary"), "contexts")
    dealt = array.repartitionByRange(max(1, array.count() // part_rows), "gram", "right", "left").sortWithinPartitions("gram", "right", "left")
    found = saved(dealt.mapInPandas(ranges, "gram long, extent long, i int, stretch long, a long, b long"), "found")
    going_on = found.filter("stretch is not null")
    again = saved(going_on.groupBy("stretch").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a != b").select("stretch"), "again")
    hits = found.filter("stretch is null").select("gram", "extent", "i").union(going_on.filter("a = b").join(again, "stretch", "left_semi").select("gram", "extent", "i"))

    run = lambda i, n: F.struct(i.cast("int").alias("at"), n.cast("int").alias("n"))
    part = hits.groupBy("gram", "extent").agg(F.collect_set(run(F.col("i"), F.lit(1))).alias("runs"))
    whole = each.filter("not alone").select("gram", "extent", F.array(run(F.lit(0), F.col("n"))).alias("runs"))
    repeated = saved(whole.union(part), "repeated")
    placed = near.select("gram", "extent", "start", "key", "none", "mark").join(repeated, ["gram", "extent"])
    runs = placed.select("key", "none", "mark", F.transform("runs", lambda r: run(F.col("start") + r.at, r.n)).alias("runs"))
    covered = runs.groupBy("key", "none", "mark").agg(F.flatten(F.collect_set("runs")).alias("runs"))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(lists: pd.Series) -> pd.Series:
        return pd.Series([merged_spans([(r["at"], r["n"]) for r in x], least) for x in lists], dtype=object)

    return covered.select(F.when(~F.col("none"), F.col("key")).alias("doc_id"), spans("runs").alias("spans"))


def merged_spans(runs: list[tuple[int, int]], least: int = LEAST) -> list[dict]:
    """Runs (first start, number) of repeated stretches as spans; spans that overlap or touch are one."""
    out: list[dict] = []
    for at, n in sorted(runs):
        if out and at <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], at + n - 1 + least)
        else:
            out.append({"start": int(at), "end": int(at + n - 1 + least)})
    return out


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text without the words of spans, and without the blanks after them."""
    from tellurion.llm.fingerprint import WORD

    if text is None or not spans:
        return text
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for a, b in sorted(spans):
        out.append(text[done : at[a]])
        done = at[b]
    return "".join([*out, text[done:]])
