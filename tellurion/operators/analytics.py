"""Canned analytics over the signals."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellurion.functions import severity as sev
from tellurion.functions.text import lower_hex, session_and_frame
from tellurion.functions.time import bucket


def log_volume(logs: DataFrame, step: int) -> DataFrame:
    """Entries by time bucket and severity number."""
    return logs.groupBy(bucket(F.col("ts_unix_nano"), step).alias("bucket"), "severity").agg(F.count("*").alias("n"))


def severity_volume(logs: DataFrame, step: int) -> DataFrame:
    """Entries by bucket with a column for each severity class, zero where a bucket has none; only buckets with data appear."""
    named = logs.select(bucket(F.col("ts_unix_nano"), step).alias("bucket"), sev.severity_class(F.col("severity")).alias("class"))
    columns = {n: "unknown" if n == sev.UNKNOWN else n.lower() for n in sev.ORDER}
    return named.groupBy("bucket").agg(*(F.count_if(F.col("class") == n).alias(c) for n, c in columns.items()))


def stacked_volume(logs: DataFrame, step: int) -> DataFrame:
    """Per bucket the running sum of entries over severity classes from least to most severe, gaps filled."""
    counts = logs.groupBy(bucket(F.col("ts_unix_nano"), step).alias("bucket"), sev.severity_class(F.col("severity")).alias("class")).agg(F.count("*").alias("n"))
    held = counts.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("held"))
    bands = held.select("bucket", "held", F.posexplode(F.array(*map(F.lit, sev.ORDER))).alias("rank", "class"))
    filled = bands.select("bucket", "rank", "class", F.coalesce(F.col("held")[F.col("class")], F.lit(0)).alias("n"))
    order = Window.partitionBy("bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("top", F.sum("n").over(order))


def label_value_counts(logs: DataFrame, name: str) -> DataFrame:
    """Entries for each value of a label; entries without it are left out."""
    counts = logs.groupBy(F.col("labels")[name].alias("v")).agg(F.count("*").alias("c"))
    return counts.filter("v is not null").orderBy(F.desc("c"), "v")


def listed_values(values: DataFrame, counts: DataFrame) -> DataFrame:
    """Discovered values in order, with their counts where those are known."""
    return values.join(counts, values.label_value == counts.v, "left").select("label_value", "c").orderBy("label_value")


def trace_summary(spans: DataFrame, limit: int | None = 5000) -> DataFrame:
    """Start, end, duration and spans of each trace, slowest first."""
    each = spans.groupBy(lower_hex(F.col("trace_id")).alias("trace_id")).agg(F.min("start_unix_nano").alias("start_ns"), F.max("end_unix_nano").alias("end_ns"), F.count("*").alias("spans"))
    each = each.withColumn("dur_ns", F.col("end_ns") - F.col("start_ns"))
    return each if limit is None else each.orderBy(F.desc("dur_ns"), "trace_id").limit(limit)


def densest_trace(spans: DataFrame) -> DataFrame:
    return spans.groupBy(lower_hex(F.col("trace_id")).alias("tid")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tid").limit(1)


def frame_stats(durations: DataFrame, column: str = "dur_ns", *by: str) -> DataFrame:
    """Count, least, nearest-rank median and 99th percentile, and most.

    Null durations count in no figure. Without groups the ranks are exact and found by narrowing histograms, so that no task holds
    all durations. With groups each group's distinct durations meet in one task, and beyond
    2 ** 53 ns (104 days) its ranks are rounded, as they go through doubles.
    """
    d = F.col(column)
    if not by:
        return _ranked(durations.select(d.cast("long").alias("d")).filter("d is not null"), {"median": (1, 2), "p99": (99, 100)})
    rank = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").cast("long").alias(n) for p, n in ((0.5, "median"), (0.99, "p99"))]
    return durations.filter(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(d).alias("least"), *rank, F.max(d).alias("most"))


#: Bins of a histogram that narrows a rank down; the driver reads so many rows at most.
BINS = 4096


def _ranked(values: DataFrame, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """One row of n, least, each share's value and most. A round counts the values in equal bins of the ranges that still hold a rank; the bins shrink by BINS each time, to single values."""
    from tellurion.session import discard, saved

    spark = values.sparkSession
    values = saved(values, "values")
    n, least, most = values.agg(F.count("*"), F.min("d"), F.max("d")).first()
    found: dict[str, int | None] = dict.fromkeys(shares)
    # Each open rank: the range that holds it, and its place among the range's values.
    todo = {name: (least, most, -(-n * up // down)) for name, (up, down) in shares.items()} if n else {}
    while todo:
        for low, high in {(a, b) for a, b, _ in todo.values()}:
            width = -(-(high - low + 1) // BINS)
            bin_of = F.expr(f"cast((d - {low}L) div {width}L as int)")
            counts = sorted((r.b, r.n) for r in values.filter(F.col("d").between(low, high)).groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect())
            for name, (_, _, rank) in [(k, t) for k, t in todo.items() if t[:2] == (low, high)]:
                for b, held in counts:
                    if rank <= held:
                        break
                    rank -= held
                start = low + b * width
                if width == 1:
                    found[name] = start
                    del todo[name]
                else:
                    todo[name] = (start, min(start + width - 1, high), rank)
    discard(values)
    return spark.createDataFrame([(n, least, *found.values(), most)], f"n long, least long, {', '.join(f'{k} long' for k in found)}, most long")


def frames(spans: DataFrame) -> DataFrame:
    """Traces whose id is a session and a frame number."""
    session, number = session_and_frame(F.col("trace_id"))
    return spans.groupBy(session.alias("session"), number.alias("frame")).agg((F.max("end_unix_nano") - F.min("start_unix_nano")).alias("dur_ns"), F.count("*").alias("spans"))


def frames_filter(rows: DataFrame, needle: str = "", by: str = "duration", limit: int = 2000) -> DataFrame:
    kept = rows.filter(F.col("frame").cast("string").contains(needle) | F.col("session").contains(needle.lower())) if needle else rows
    order = (F.desc("dur_ns"), "session", "frame") if by == "duration" else ("frame", "session")
    return kept.orderBy(*order).limit(limit)


def share_of_slowest(rows: DataFrame, column: str = "dur_ns") -> DataFrame:
    """A duration as a share of the slowest one, which counts as 1 at least; the slowest is found first, not by a window over all rows."""
    top = rows.agg(F.greatest(F.max(column), F.lit(1)).alias("_top"))
    return rows.crossJoin(F.broadcast(top)).withColumn("share", F.col(column) / F.col("_top")).drop("_top")


def roots(spans: DataFrame) -> DataFrame:
    """Spans without a parent in their trace: null, absent and self-referring parents."""
    # A key that is null meets none, so spans without a parent stay in the same anti-join as orphans.
    keyed = spans.withColumn("_parent", F.when(F.col("parent_span_id") != F.col("span_id"), F.col("parent_span_id")))
    known = spans.select("trace_id", F.col("span_id").alias("_parent"))
    return keyed.join(known, ["trace_id", "_parent"], "left_anti").select(*spans.columns)


def span_tree(spans: DataFrame) -> DataFrame:
    """spans with depth and place, their position in pre-order within the trace.

    Siblings are ordered by start and span id. Spans that no root reaches (cycles) are left
    out. One level is one join on (trace, parent), down to the deepest span.
    """
    from tellurion.session import saved

    slim = spans.select("trace_id", "span_id", "parent_span_id", "start_unix_nano")
    slim = saved(slim, "spans")
    key = F.struct(F.col("start_unix_nano").alias("start"), F.col("span_id").alias("id"))
    level = saved(roots(slim).select("trace_id", "span_id", F.lit(0).alias("depth"), F.array(key).alias("path")), "level")
    out = level
    for depth in itertools.count(1):
        up = level.select("trace_id", F.col("span_id").alias("parent_span_id"), "path")
        down = slim.filter("parent_span_id != span_id").join(up, ["trace_id", "parent_span_id"])
        level = saved(down.select("trace_id", "span_id", F.lit(depth).alias("depth"), F.concat("path", F.array(key)).alias("path")), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    placed = out.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy("path")))
    return spans.join(placed.select("trace_id", "span_id", "depth", "place"), ["trace_id", "span_id"])


def span_layout(spans: DataFrame) -> DataFrame:
    """Left edge and width of each span as shares of its trace's window; a window of no width gives 0 and 1."""
    trace = Window.partitionBy("trace_id")
    low, high = F.min("start_unix_nano").over(trace), F.max("end_unix_nano").over(trace)
    wide = spans.withColumn("low", low).withColumn("span", high - low)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    left = F.when(F.col("span") > 0, clamp((F.col("start_unix_nano") - F.col("low")) / F.col("span"))).otherwise(0.0)
    width = F.when(F.col("span") > 0, clamp((F.col("end_unix_nano") - F.col("start_unix_nano")) / F.col("span"))).otherwise(1.0)
    return wide.withColumn("left", left).withColumn("width", width).drop("low", "span")


def root_service(spans: DataFrame) -> DataFrame:
    """Service of the first root of each trace."""
    first = F.min_by("service_name", F.struct("start_unix_nano", "span_id"))
    return roots(spans).groupBy("trace_id").agg(first.alias("service"))


def single_trace(spans: DataFrame) -> DataFrame:
    """The one trace id of a result, null if it holds several or none."""
    return spans.agg(F.when(F.min("trace_id") == F.max("trace_id"), lower_hex(F.min("trace_id"))).alias("trace_id"))


def rate(series: DataFrame, key: str = "series_fingerprint") -> DataFrame:
    """Increase per second of each counter between samples; after a reset the new value is the increase."""
    order = Window.partitionBy(key).orderBy("ts_unix_nano")
    before, then = F.lag("value").over(order), F.lag("ts_unix_nano").over(order)
    rise = F.when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return series.withColumn("rate", F.when(F.col("ts_unix_nano") > then, rise / ((F.col("ts_unix_nano") - then) / 1e9))).filter("rate is not null")
