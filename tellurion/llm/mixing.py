"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only.

A document's key is exponential, divided by its quality weight: -ln(u) / quality, with u
from a hash of its id and the seed, so reruns agree. Sources share a budget by weight; a
target stops at a multiple of its source's size and the excess goes to the others by
weight. A source first gives whole epochs of all its documents; the rest of its target is
filled with documents in the order of their keys, the document that crosses the target
being taken if that comes nearer to it.

The running sum over a source is built from sums over ranges of the key, so no source, hot
or not, has to fit one task: there are about sqrt(rows) ranges of about sqrt(rows) rows.
The choice then is one cut (key, id, size) for each source. Rows that agree in these count as
copies: they are summed before any row is placed, and where the target falls among the copies
at the cut, some of them are taken and others not, as many as come nearest to the target.

Null sources are a source of their own, the last. Null texts, or texts without words, have
size 0 and take nothing. Null ids share one random draw, so those of one size are copies. A quality that is null, NaN or not
above 0 counts as the least one, 1e-6. Empty tables give empty tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.session import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
RANGE_ROWS = 2000
#: The table of sources is broadcast up to so many rows, of some hundred bytes each; beyond that it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_share(text: Column) -> Column:
    """A quality weight from the share of marks that prose does not use."""
    marks = F.length(text) - F.length(F.translate(text, "*#$%&|!", ""))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * marks / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def draw_key(doc_id: Column, quality: Column, seed: str) -> Column:
    unit = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")
    sound = F.when(quality.isNull() | F.isnan(quality) | (quality < 1e-6), F.lit(1e-6)).otherwise(quality)
    return -F.log((unit + 1) / F.lit(float(2**52 + 2))) / sound


@dataclass
class Plan:
    """sources: source, source_size, target, epochs and cut (key, id, size, room, copies), a row for each source; tied: some cut takes part of its copies."""

    sources: DataFrame
    count: int
    seed: str
    tied: bool = False

    def times(self, rows: DataFrame) -> DataFrame:
        """rows(source, doc_id, size, quality, ...) with source_size, target and times, how often each is taken whole."""
        side = F.broadcast(self.sources) if self.count <= BROADCAST_SOURCES else self.sources
        side = side.withColumnRenamed("source", "_of")
        joined = rows.join(side, F.col("source").eqNullSafe(F.col("_of")), "left")
        mark = F.struct(draw_key(F.col("doc_id"), F.col("quality"), self.seed).alias("key"), F.col("doc_id").alias("id"), F.col("size").alias("size"))
        cut = F.struct(F.col("cut.key").alias("key"), F.col("cut.id").alias("id"), F.col("cut.size").alias("size"))
        sized = F.col("cut").isNotNull() & (F.col("size") > 0)
        extra = F.coalesce((mark <= cut) & sized, F.lit(False)).cast("int")
        if self.tied:
            copy = F.coalesce((mark <= cut) & ~(mark < cut) & sized & (F.col("cut.room") < F.col("cut.copies")), F.lit(False))
            out = joined.filter(~copy).withColumn("_extra", extra).unionByName(self._dealt(joined.filter(copy)))
        else:
            out = joined.withColumn("_extra", extra)
        return out.withColumn("times", (F.col("epochs") + F.col("_extra")).cast("int")).drop("_of", "epochs", "cut", "_extra")

    @staticmethod
    def _dealt(copies: DataFrame) -> DataFrame:
        """The first `room` of each source's copies, counted over the tasks that found them; stored first, so that the count stands."""
        kept = saved(copies.withColumn("_task", F.spark_partition_id()), "copies")
        sums = kept.groupBy("source", "_task").count()
        before = F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sums.select(F.col("source").alias("_from"), F.col("_task").alias("_at"), before.alias("_before"))
        ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "_task").orderBy(F.lit(0))))
        placed = ranked.join(starts, F.col("source").eqNullSafe(F.col("_from")) & (F.col("_task") == F.col("_at")))
        return placed.withColumn("_extra", (F.col("_before") + F.col("_rank") <= F.col("cut.room")).cast("int")).drop("_task", "_from", "_at", "_before", "_rank")


def targets(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """slim(source, size) -> (source, rows, source_size, target): one row for each source.

    With sources sorted by the multiple of the weight at which they reach their limit, the
    common multiple is the largest of (budget - limits before) / weights from here on.
    """
    each = slim.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = each.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    here_on = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    multiple = (F.lit(share) * F.sum("source_size").over(everything) - before) / here_on
    level = weighed.withColumn("multiple", multiple).withColumn("multiple", F.max("multiple").over(everything))
    return level.select("source", "rows", "source_size", F.least("limit", F.col("weight") * F.col("multiple")).alias("target"))


def plan(slim: DataFrame, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, range_rows: int = RANGE_ROWS) -> Plan:
    """slim(doc_id, source, size, quality): the table to mix, without its texts; it is read more than once, so pass a stored one."""
    sources = saved(targets(slim, weights, share, most), "targets")
    count, rows = sources.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    per_range = max(range_rows, math.isqrt(rows))
    epochs = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("int")
    ready = sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    side = ready.select(F.col("source").alias("_of"), "rest", F.ceil(F.col("rows") / per_range).alias("ranges"))
    side = F.broadcast(side) if count <= BROADCAST_SOURCES else side
    keyed = slim.filter("size > 0").select("source", "doc_id", "size", draw_key(F.col("doc_id"), F.col("quality"), seed).alias("key"))
    keyed = keyed.groupBy("source", "doc_id", "size", "key").agg(F.count("*").alias("copies"))
    placed = keyed.join(side, F.col("source").eqNullSafe(F.col("_of"))).filter("rest > 0").drop("_of")
    placed = placed.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")))
    words = F.sum(F.col("size") * F.col("copies"))
    sums = placed.groupBy("source", "range").agg(words.alias("inside"))
    before = F.sum("inside").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col("source").alias("_of"), F.col("range").alias("_range"), F.coalesce(before, F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("before", F.coalesce(words.over(inside), F.lit(0)))
    at = summed.join(starts, F.col("source").eqNullSafe(F.col("_of")) & (F.col("range") == F.col("_range")))
    room = F.floor((2 * (F.col("rest") - F.col("start") - F.col("before")) + F.col("size")) / (2 * F.col("size")))
    taken = at.withColumn("room", F.least(room, F.col("copies"))).filter("room > 0")
    cuts = taken.groupBy("source").agg(F.max(F.struct("key", F.col("doc_id").alias("id"), "size", "room", "copies")).alias("cut")).withColumnRenamed("source", "_of")
    done = saved(ready.join(cuts, F.col("source").eqNullSafe(F.col("_of")), "left").select("source", "source_size", "target", "epochs", "cut"), "cuts")
    return Plan(done, count, seed, not done.filter("cut.room < cut.copies").isEmpty())


def mix(slim: DataFrame, **settings) -> DataFrame:
    """slim with source_size, target, times and taken, in words."""
    return plan(slim, **settings).times(slim).withColumn("taken", F.col("times").cast("long") * F.col("size"))


ORACLE = r"""
WITH slim AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    coalesce(1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * (length(text) - length(translate(text, '*#$%&|!', ''))) / greatest(length(text), 1)), 1.0::DOUBLE) AS quality
  FROM documents),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 13) AS BIGINT) + 1) / 4503599627370498.0::DOUBLE) / greatest(quality, 1e-6) AS key
  FROM slim),
each AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS lim FROM each),
level AS (
  SELECT *, max(multiple) OVER () AS top FROM (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS multiple FROM weighed)),
ready AS (
  SELECT source, source_size, least(lim, weight * top) AS target, CASE WHEN source_size > 0 THEN floor(least(lim, weight * top) / source_size)::INT ELSE 0 END AS epochs FROM level),
summed AS (
  SELECT k.doc_id, k.size, r.source_size, r.target, r.epochs, r.target - r.epochs * r.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN ready r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
