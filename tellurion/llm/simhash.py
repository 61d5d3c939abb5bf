"""SimHash near-duplicates, searched with BK-trees over shards of the fingerprints.

A fingerprint has 64 bits for each of its words; a bit is 1 if it is set in more than half
of the shingle hashes, repeats included, or in distinct mode in more than half of the
distinct ones. Only the latter measures the resemblance of shingle sets. Texts of fewer words than a shingle have one
shingle, their whole word sequence; texts without words (null and empty ones too) have the
fingerprint zero and are linked like any other.

Search: a shard holds the fingerprints that agree in one band of bits. With exact_bands()
two fingerprints within the radius share at least one shard whatever they are, so no link
is lost. Each shard is a BK-tree, built in the task that the shuffle brings it to: children
are keyed by their integer Hamming distance to the parent, and a query follows only the
edges within the radius of its own distance. A shard of more than `shard_rows` is split into
parts, and each pair of parts is a tree of its own; one of more than radius + 1 parts is first
dealt out once more, by blocks of its remaining bits, of which two fingerprints within the
radius agree in one. Nothing is dropped. Of all its pairs
within the radius a tree gives the edges of a minimum spanning forest: they link the same
fingerprints, and a later check of texts meets the nearest pairs.

For radii that no exact bands cover, lsh_bands() draws bands by a stated recall, longer and
more of them as the number of fingerprints grows, so shards stay small. resembling() then
holds the texts behind each edge against a least resemblance of their shingle sets. Where
edges fail that check, the forest may have passed over a link that would not: the groups at
their ends are searched again, in each shard each group for its nearest pairs with its nearest
other groups. Fingerprints with a pair that was left out are searched again for more pairs each
time, until none is left out. Pairs whose sketches show that their texts cannot resemble each
other enough are not given to the check; a sketch never rules out a pair that would pass.

Trees are not broadcast: together they hold the fingerprints of all documents, which the
driver must never hold.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.llm.components import connected_components
from tellurion.session import saved

#: Odd multipliers that derive further words of a fingerprint from the first hash.
MIX = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
SHARD_ROWS = 2048
#: In the first further search of a shard, a group's nearest other groups, and its pairs with each; each later one takes MORE times as many.
NEAREST, MORE = 2, 4
#: Counts in a sketch; see sketch_text().
BUCKETS = 256
#: Bands as lists of masks, one mask for each word of a fingerprint.
Bands = list[tuple[int, ...]]
#: Up to so many ends of edges (some 150 bytes each) are broadcast to the texts; beyond that both sides are shuffled.
BROADCAST_ENDS = 100_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64, seed 42, of each shingle of a text, A-Z lower-cased, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1))
    return np.array([digest(whole[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n, words): the hash itself, then words derived from it."""
    if words == 1:
        return hashes[:, None]
    x = hashes[:, None] * np.array(MIX[:words], np.uint64)
    rest = x[:, 1:]
    rest ^= rest >> np.uint64(32)
    rest *= np.uint64(0xD6E8FEB86659FD93)
    rest ^= rest >> np.uint64(29)
    return x


def fingerprint_text(text: str | None, width: int, words: int = 1, distinct: bool = False) -> str:
    """16 lowercase hex digits for each word; distinct: a repeated shingle counts once."""
    hashes = shingle_hashes(text, width)
    if distinct:
        hashes = np.unique(hashes)
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 4096):
        part = mixed(hashes[at : at + 4096], words)
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")
    return bits.astype(">u8").tobytes().hex()


def fingerprint(text: Column, width: int = 5, words: int = 1, distinct: bool = False) -> Column:
    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_text(t, width, words, distinct) for t in texts], dtype=object)

    return prints(text)


def exact_bands(radius: int, count: int) -> Bands:
    """Bands of which any two 64-bit values within the radius share one.

    The 64 bits fall into radius + k blocks; two values differ in at most radius of them, so
    some k blocks agree. k grows with the number of fingerprints and keeps shards small.
    """
    for k in (1, 2, 3, 4):
        blocks = radius + k
        if 64 * k // blocks >= math.log2(max(count, 2)) - 6:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [(sum(c),) for c in combinations(masks, k)]


def lsh_bands(words: int, differing: float, count: int, recall: float = 0.97) -> Bands:
    """Bands of which two values share one with the recall, if each bit differs with chance `differing`.

    A band has 13 bits up to 2 ** 24 fingerprints, and one more for each doubling beyond. Bands
    are cut from shuffled orders of all bits, so those of one order do not overlap.
    """
    bits = max(13, math.ceil(math.log2(max(count, 2))) - 11)
    wanted, total = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing) ** bits)), 64 * words
    if wanted * bits > total:  # bands overlap: the recall is that over all numbers of differing bits, each by its chance
        chance = np.ones(1)
        for _ in range(total):
            chance = np.append(chance * (1 - differing), 0) + np.append(0, chance * differing)
        k = np.arange(total - bits + 1)
        agree = np.prod([(total - k - i) / (total - i) for i in range(bits)], axis=0)
        while chance[k] @ (1 - (1 - agree) ** wanted) < recall:
            wanted += max(1, wanted // 50)
    draw, out = np.random.default_rng(11), []
    while len(out) < wanted:
        order = draw.permutation(total).tolist()
        for at in range(0, total - bits + 1, bits):
            out.append(tuple(sum(1 << (x % 64) for x in order[at : at + bits] if x // 64 == w) for w in range(words)))
    return out[:wanted]


def finer_bands(band: tuple[int, ...], radius: int) -> Bands:
    """The band with each of radius + 1 blocks of the other bits: two values that agree in the band and lie within the radius agree in one of these."""
    words = len(band)
    others = [x for x in range(64 * words) if not band[x // 64] >> (x % 64) & 1]
    out = []
    for i in range(radius + 1):
        block = others[len(others) * i // (radius + 1) : len(others) * (i + 1) // (radius + 1)]
        out.append(tuple(band[w] | sum(1 << (x % 64) for x in block if x // 64 == w) for w in range(words)))
    return out


class BKTree:
    """Nodes are [value, {distance: child}]."""

    def __init__(self):
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, value) of all that lie within the radius."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            v, children = stack.pop()
            d = (v ^ value).bit_count()
            if d <= radius:
                found.append((d, v))
            if children:
                if len(children) <= 2 * radius:
                    stack += [c for k, c in children.items() if -radius <= k - d <= radius]
                else:
                    stack += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A minimum spanning forest of all pairs within the radius; of equal distances the lesser values first."""
    values = sorted(set(values))
    place = {v: i for i, v in enumerate(values)}
    tree, packed = BKTree(), array("q")
    for i, v in enumerate(values):
        packed.extend([d << 48 | place[near] << 24 | i for d, near in tree.within(v, radius)])
        tree.add(v)
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    edges = []
    for x in np.sort(np.frombuffer(packed, np.int64)).tolist():
        a, b = x >> 24 & 0xFFFFFF, x & 0xFFFFFF
        i, j = root(a), root(b)
        if i != j:
            parent[max(i, j)] = min(i, j)
            edges.append((values[a], values[b]))
            if len(edges) == len(values) - 1:
                break
    return edges


def _few(pairs: list[tuple], most: int) -> list[tuple]:
    """Of pairs (distance, value, near value, near group), `most` for each of the `most` nearest groups."""
    kept: dict = {}
    for p in sorted(pairs):
        if (own := kept.get(p[3])) is None:
            if len(kept) < most:
                kept[p[3]] = [p]
        elif len(own) < most:
            own.append(p)
    return [p for own in kept.values() for p in own]


class Sketches:
    """Which values' texts may resemble each other by `least`, as far as their sketches tell; sketches may be null or empty."""

    def __init__(self, values: list[int], sketches: list[bytes | None], least: float):
        self.place, self.least = {v: i for i, v in enumerate(values)}, least
        self.known = np.array([bool(s) for s in sketches], bool)
        self.counts = np.frombuffer(b"".join(s or bytes(BUCKETS) for s in sketches), np.uint8).reshape(len(values), BUCKETS)
        self.sizes = self.counts.sum(axis=1, dtype=np.int64)

    def possible(self, value: int, others: list[int]) -> np.ndarray:
        """True for those others of which at most so many shingles can be shared that the resemblance may be `least` or more."""
        i, at = self.place[value], np.array([self.place[w] for w in others], np.int64)
        if not self.known[i]:
            return np.ones(len(at), bool)
        both = np.minimum(self.counts[at], self.counts[i]).sum(axis=1, dtype=np.int64)
        either = self.sizes[at] + self.sizes[i] - both
        return ~self.known[at] | (either == 0) | (both / np.maximum(either, 1) >= self.least)


def nearest(values: list[int], groups: list, radius: int, most: int, sketches: Sketches | None = None, cut: set[int] | None = None) -> list[tuple[int, int]]:
    """For each group its nearest pair within the radius with each of its `most` nearest other groups, and up to `most` - 1 more with each; pairs in order, once.

    Pairs that the sketches rule out do not count. `cut` takes the values with a pair that is left out by `most`.
    """
    of = dict(zip(values, groups, strict=True))
    tree, near, pairs_of = BKTree(), {}, {}
    for v in of:
        tree.add(v)
    for v, own in of.items():
        found = [(d, v, w, of[w]) for d, w in tree.within(v, radius) if of[w] != own]
        if sketches and found:
            found = [p for p, may in zip(found, sketches.possible(v, [p[2] for p in found]).tolist(), strict=True) if may]
        pairs_of[v] = len(found)
        near.setdefault(own, []).extend(_few(found, most))
    taken = sorted({(min(v, w), max(v, w)) for pairs in near.values() for _, v, w, _ in _few(pairs, most)})
    if cut is not None:
        given = Counter(v for pair in taken for v in pair)
        cut.update(v for v, n in pairs_of.items() if n > given[v])
    return taken


def links(prints: DataFrame, bands: Bands, radius: int, shard_rows: int = SHARD_ROWS, most: int | None = None, least: float = 0.0) -> DataFrame:
    """prints(fp string, group string, sketch binary), distinct -> edges (u, v) of fingerprints within the radius that share a shard.

    They are those of spanning forests, for which fp is enough, or with `most` each group's
    nearest ones to its nearest groups, without those that the sketches (null: unknown) rule out
    for `least`. A row (u, null) then says that pairs of u were left out by `most`.
    """
    words, masks = len(bands[0]), np.array(bands, np.uint64)
    finer = np.array([finer_bands(b, radius) for b in bands], np.uint64)

    def edges_of(held: list[int], groups: list, sketches: list) -> list[tuple[int, int | None]]:
        if len(held) < 2:
            return []
        if most is None:
            return forest(held, radius)
        cut: set[int] = set()
        return nearest(held, groups, radius, most, Sketches(held, sketches, least), cut) + [(v, None) for v in sorted(cut)]

    def keyed(values: pd.Series, masks: np.ndarray) -> pd.Series:
        """For each value a key for each mask; masks: (bands, words), or those of each value."""
        got = np.frombuffer(bytes.fromhex("".join(v[: 16 * words] for v in values)), ">u8").astype(np.uint64).reshape(len(values), 1, words)
        key = got[..., 0] & masks[..., 0]
        for w in range(1, words):
            key = key * np.uint64(MIX[1]) + (got[..., w] & masks[..., w])
        return pd.Series(list(key.view(np.int64)), dtype=object)

    @F.pandas_udf("array<bigint>")
    def keys(values: pd.Series) -> pd.Series:
        return keyed(values, masks)

    @F.pandas_udf("array<bigint>")
    def finer_keys(values: pd.Series, band: pd.Series) -> pd.Series:
        return keyed(values, finer[band.to_numpy()])

    def trees(batches):
        held: list[int] = []
        groups: list = []
        sketches: list = []
        held_key = None
        for batch in batches:
            group = list(zip(batch.band, batch.key, batch.i, batch.j, strict=True))
            values, of, sketch = batch.fp.tolist(), batch["group"].tolist(), batch.sketch.tolist()
            out: list[tuple[int, int | None]] = []
            start = 0
            for at in range(1, len(group) + 1):
                if at == len(group) or group[at] != group[start]:
                    if group[start] != held_key:
                        out += edges_of(held, groups, sketches)
                        held, groups, sketches, held_key = [], [], [], group[start]
                    held += [int.from_bytes(v) for v in values[start:at]]
                    groups += of[start:at]
                    sketches += sketch[start:at]
                    start = at
            yield named(out)
        yield named(edges_of(held, groups, sketches))

    def named(edges: list[tuple[int, int | None]]) -> pd.DataFrame:
        wide = f"0{16 * words}x"
        return pd.DataFrame([(format(a, wide), None if b is None else format(b, wide)) for a, b in edges], columns=["u", "v"], dtype=object)

    carried = [F.lit(None).cast(kind).alias(c) if most is None else F.col(c) for c, kind in (("group", "string"), ("sketch", "binary"))]
    rows = prints.select("fp", *carried, F.posexplode(keys("fp")).alias("band", "key"))
    parts = F.ceil(F.col("count") / shard_rows).cast("int")

    def counted(rows: DataFrame) -> tuple[DataFrame, int]:
        """rows with the parts of their shards, and how many the largest has."""
        large = saved(rows.groupBy("band", "key").count().filter(F.col("count") > shard_rows).select("band", "key", parts.alias("parts")), "shards")
        most_parts = large.agg(F.max("parts")).first()[0]
        if most_parts is None:
            return rows.withColumn("parts", F.lit(1)), 1
        return rows.join(large, ["band", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))), most_parts

    whole, most_parts = counted(rows)
    if most_parts > radius + 1:
        hot = saved(whole.filter(F.col("parts") > radius + 1).drop("parts"), "hot")
        again = hot.select("fp", "group", "sketch", "band", F.posexplode(finer_keys("fp", "band")).alias("block", "key"))
        again = again.select("fp", "group", "sketch", (len(bands) + F.col("band") * (radius + 1) + F.col("block")).alias("band"), "key")
        whole = whole.filter(F.col("parts") <= radius + 1).unionByName(counted(again)[0])
    part = F.pmod(F.xxhash64("fp"), "parts").cast("int")
    mate = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.array(part))))
    placed = whole.withColumn("mate", mate).select("band", "key", F.least(part, "mate").alias("i"), F.greatest(part, "mate").alias("j"), F.unhex("fp").alias("fp"), "group", "sketch")
    dealt = placed.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    return dealt.mapInPandas(trees, "u string, v string").distinct()


def resemblance(a: str | None, b: str | None, width: int) -> float:
    """Shared over all distinct shingles of two texts; 1 if neither has any."""
    x, y = np.unique(shingle_hashes(a, width)), np.unique(shingle_hashes(b, width))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def sketch_text(text: str | None, width: int) -> bytes:
    """How many distinct shingles fall into each of BUCKETS buckets, a byte each; empty if one has more than 255.

    Two texts share at most the sum of the lesser counts, so sketches bound the resemblance from above.
    """
    counts = np.bincount((np.unique(shingle_hashes(text, width)) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.uint8).tobytes() if counts.max() <= 255 else b""


def standing(prints: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """prints(fp), distinct -> (fp, text), stored: the text that stands for all of a fingerprint.

    rows(id, fp, mark) says by id and hash of the text where a fingerprint occurs; of equal
    fingerprints one text stands for all, so they must be of distinct shingles: with repeats one
    shingle may outvote the rest. texts(id, text) has all texts; null texts are left out.
    """
    least_row = rows.groupBy("fp").agg(F.min(F.struct("id", "mark")).alias("one"))  # before the join, which then meets each fingerprint once
    one = saved(least_row.join(prints, "fp").select("fp", "one.id", "one.mark"), "ends")
    side = F.broadcast(one) if one.count() <= BROADCAST_ENDS else one
    named = texts.select("id", "text", F.xxhash64("text").alias("mark")).join(side, ["id", "mark"])
    return saved(named.groupBy("fp").agg(F.first("text").alias("text")), "texts")


def sketches(prints: DataFrame, rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """prints(fp), distinct -> (fp, sketch) of the texts that resembling() goes by, stored."""

    @F.pandas_udf("binary")
    def sketch(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch_text(t, width) for t in texts], dtype=object)

    return saved(standing(prints, rows, texts).select("fp", sketch("text").alias("sketch")), "sketches")


def resembling(edges: DataFrame, rows: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Those edges(u, v) whose texts, as standing() has them, resemble each other by `least` or more."""
    found = standing(edges.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), rows, texts)

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([resemblance(x, y, width) for x, y in zip(a, b, strict=True)], dtype="float64")

    first, second = (found.select(F.col("fp").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv")
    return edges.join(first, "u").join(second, "v").filter(alike("text_u", "text_v") >= least).select("u", "v")


def regrouped(named: DataFrame, edges: DataFrame) -> DataFrame:
    """named(group, ...) with each group replaced by the least one that edges(u, v) of groups lead to; stored, so that Spark can split a group that many belong to."""
    member = saved(connected_components(edges), "members")
    return saved(named.join(member, named.group == member.node, "left").withColumn("group", F.coalesce("root", "group")).drop("node", "root"), "named")


def checked_groups(named: DataFrame, edges: DataFrame, check: Callable[[DataFrame], DataFrame], bands: Bands, radius: int, shard_rows: int, sketched: Callable[[DataFrame], DataFrame] | None, least: float) -> DataFrame:
    """regrouped() by the edges of fingerprints that pass the check; groups at failed ones are searched again until no pair between two groups is left unchecked.

    A true link that a forest passed over has a path beside it, which leaves the groups of both
    its ends by failed edges between groups. Failed edges inside a group hide nothing. A further
    search gives a group's nearest pairs and names the fingerprints of which it left pairs out;
    the next one takes these only, with more pairs for each group, as both ends of a pair that
    was left out are among them. It ends when none was, so no pair goes unchecked for being far.
    """

    def between(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """pairs(u, v) of fingerprints as pairs of their groups."""
        u, v = (of.select(F.col("fp").alias(x), F.col("group").alias(f"group_{x}")) for x in "uv")
        return pairs.join(u, "u").join(v, "v").select(F.col("group_u").alias("u"), F.col("group_v").alias("v"))

    passed, tried, most = saved(check(edges), "passed"), edges, NEAREST
    named = regrouped(named, between(passed, named))
    failed = between(edges.join(passed, ["u", "v"], "left_anti"), named).filter("u != v").select(F.explode(F.array("u", "v")).alias("group"))
    failed = saved(failed.distinct(), "failed")  # stored, so that Spark can split the join of a group that many belong to
    again = saved(named.join(failed, "group", "left_semi").select("fp", "group"), "again")
    if again.isEmpty():
        return named
    sketch = sketched(again.select("fp")) if sketched else again.select("fp", F.lit(None).cast("binary").alias("sketch"))
    while not again.isEmpty():
        shard = shard_rows if most == NEAREST else -(-shard_rows // 4)  # the more pairs a tree may give, the fewer fingerprints it holds
        found = saved(links(again.join(sketch, "fp", "left"), bands, radius, shard, most, least), "links")
        edges = saved(found.filter("v IS NOT NULL").join(tried, ["u", "v"], "left_anti"), "untried")
        passed, tried, most = saved(check(edges), "passed"), tried.union(edges), most * MORE
        if not passed.isEmpty():
            named = regrouped(named, between(passed, again))
        cut = found.filter("v IS NULL").select(F.col("u").alias("fp"))
        again = saved(named.join(cut, "fp", "left_semi").select("fp", "group"), "again")
    return named


def near_duplicates(rows: DataFrame, radius: int, bands: Callable[[int], Bands] | None = None, shard_rows: int = SHARD_ROWS, check: Callable[[DataFrame], DataFrame] | None = None, sketched: Callable[[DataFrame], DataFrame] | None = None, least: float = 0.0) -> DataFrame:
    """rows(id, fp) -> (id, fp, component): the least id of all rows reachable over links within the radius.

    bands gives the bands for a number of fingerprints; None: exact_bands() for 64-bit ones.
    check drops edges (u, v), stored ones, before they count as links; sketched gives (fp, sketch)
    for fingerprints, by which pairs that are sure to fall short of a resemblance of `least`, and
    so to fail the check, need not be held against it. Ids may repeat; null ids
    keep their row and never are a least id unless a component has no other.
    """
    prints = saved(rows.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    count = prints.count()
    drawn = bands(count) if bands else exact_bands(radius, count)
    edges = links(prints.select("fp"), drawn, radius, shard_rows)
    alone = prints.withColumn("group", F.col("fp"))
    named = checked_groups(alone, saved(edges, "links"), check, drawn, radius, shard_rows, sketched, least) if check else regrouped(alone, edges)
    first = saved(named.groupBy("group").agg(F.min("least").alias("component")), "least")
    of = named.join(first, "group").select("fp", "component")
    return rows.join(of, "fp").select("id", "fp", "component")
