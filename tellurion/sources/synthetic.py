"""Made-up rows of all four signals: what row i holds follows from i and a seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.functions.labels import fingerprint
from tellurion.functions.time import SECOND
from tellurion.sources.signals import NONE, complete_spans, pairs, span_id, trace_id

SERVICES = ("api", "worker", "gateway", "billing", "search")
LEVELS = (1, 5, 9, 9, 9, 9, 13, 17, 21)


def _draw(seed: int, what: str, below: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(what)), F.lit(below))


def _pick(of: tuple, draw: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, of)), draw.cast("int") + 1)


def _rows(spark: SparkSession, n: int, step: int, start: int) -> DataFrame:
    return spark.range(n).withColumn("ts_unix_nano", F.lit(start) + F.col("id") * step)


def metrics(spark: SparkSession, n: int, series: int = 1000, seed: int = 0, start: int = 0, step: int = SECOND) -> DataFrame:
    """n samples dealt to so many series in turn; a series' value never falls."""
    at = F.col("id") % series
    labels = pairs(__name__=F.lit("requests_total"), service=_pick(SERVICES, at % len(SERVICES)), instance=at.cast("string"))
    rows = _rows(spark, n, step, start).select("ts_unix_nano", ((F.col("id") / series).cast("long") * 10 + _draw(seed, "value", 10)).cast("double").alias("value"), labels.alias("labels"))
    return rows.select(fingerprint(F.col("labels")).alias("series_fingerprint"), "ts_unix_nano", "value", "labels")


def logs(spark: SparkSession, n: int, seed: int = 0, start: int = 0, step: int = SECOND) -> DataFrame:
    labels = pairs(service=_pick(SERVICES, _draw(seed, "service", len(SERVICES))), env=_pick(("prod", "stage"), _draw(seed, "env", 2)))
    body = F.concat(F.lit("request "), F.col("id"), F.lit(" took "), _draw(seed, "ms", 2000), F.lit(" ms"))
    rows = _rows(spark, n, step, start).select("ts_unix_nano", _pick(LEVELS, _draw(seed, "level", len(LEVELS))).cast("short").alias("severity"), body.alias("body"), F.expr(NONE).alias("attributes"), labels.alias("labels"))
    return rows.select(fingerprint(F.col("labels")).alias("stream_fingerprint"), "ts_unix_nano", "severity", "body", "attributes", "labels")


def traces(spark: SparkSession, n: int, spans: int = 8, seed: int = 0, start: int = 0, step: int = SECOND) -> DataFrame:
    """n spans, so many to a trace; each but the first has an earlier one of its trace as parent."""
    place = F.col("id") % spans
    trace = ((F.col("id") - place) / spans).cast("long")
    name = lambda i: F.concat_ws("/", F.lit(seed), trace, i)
    parent = F.pmod(_draw(seed, "parent", 1 << 31), F.greatest(place, F.lit(1)))
    rows = _rows(spark, n, step, start).select(
        trace_id(trace).alias("trace_id"), span_id(name(place)).alias("span_id"), F.when(place > 0, span_id(name(parent))).alias("parent_span_id"),
        _pick(SERVICES, _draw(seed, "service", len(SERVICES))).alias("service_name"), _pick(("prod", "stage"), trace % 2).alias("deployment_environment"),
        F.concat(F.lit("step "), place).alias("name"), F.when(place == 0, 2).otherwise(3).cast("short").alias("kind"), F.col("ts_unix_nano").alias("start_unix_nano"),
        (F.col("ts_unix_nano") + _draw(seed, "dur", SECOND)).alias("end_unix_nano"), F.when(_draw(seed, "status", 50) == 0, 2).otherwise(1).cast("short").alias("status_code"),
    )
    return complete_spans(rows)


def profiles(spark: SparkSession, n: int, seed: int = 0, start: int = 0, step: int = SECOND) -> DataFrame:
    labels = pairs(service=_pick(SERVICES, _draw(seed, "service", len(SERVICES))))
    data = F.unhex(F.repeat(F.hex(F.xxhash64("id", F.lit(seed))), 16))
    return _rows(spark, n, step, start).select("ts_unix_nano", F.lit(SECOND).alias("duration_nano"), labels.alias("labels"), F.lit(1).cast("short").alias("format"), data.alias("data"))
