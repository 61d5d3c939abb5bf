"""Container log lines: parsing, joining of partial lines, labels and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.functions.labels import EMPTY, fingerprint, matches, merged, once, rekeyed
from tellurion.functions.time import rfc3339_nanos

LINE = r"(?s)^(\S+) (stdout|stderr) ([FP])(?::\S*)? (.*)$"
POD = r"([^/_]+)_([^/_]+)_([^/]+)/([^/]+)/\d+\.log[^/]*$"


def parse_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """lines with ts_unix_nano, stream, tag and msg; lines that do not parse are left out."""
    part = lambda i: F.regexp_extract(text, LINE, i)
    rows = lines.filter(F.col(text).rlike(LINE)).select("*", rfc3339_nanos(part(1)).alias("ts_unix_nano"), part(2).alias("stream"), part(3).alias("tag"), part(4).alias("msg"))
    return rows.filter("ts_unix_nano is not null")


def join_partials(rows: DataFrame, file: str, order: str) -> DataFrame:
    """Runs of P lines joined with the F line that ends them, for each file and stream.

    The entry has the F line's time; a run that no F line ends gives nothing. A run is closed
    over the lines of one file and stream, which is one container's log.
    """
    by = Window.partitionBy(file, "stream").orderBy(order)
    ended = F.sum(F.when(F.col("tag") == "F", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("run", F.coalesce(ended, F.lit(0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("msg").alias("m")))), lambda p: p.m)
    joined = runs.groupBy(file, "stream", "run").agg(F.max(F.when(F.col("tag") == "F", F.col("ts_unix_nano"))).alias("ts_unix_nano"), F.array_join(parts, "").alias("body"))
    severity = F.when(F.col("stream") == "stderr", 17).otherwise(9).cast("short")
    return joined.filter("ts_unix_nano is not null").select(file, "stream", "ts_unix_nano", severity.alias("severity"), "body")


def pod_of(path: Column) -> Column:
    """Struct of namespace, pod, uid and container from a log file's path; null if it is none."""
    names = ("namespace", "pod", "uid", "container")
    return F.when(path.rlike(POD), F.struct(*(F.regexp_extract(path, POD, i + 1).alias(n) for i, n in enumerate(names))))


def scalar_fields(body: Column) -> Column:
    """Map of the top-level scalars of a JSON body; other bodies give an empty map."""
    return F.map_filter(_fields(body), lambda k, v: v.isNotNull() & ~v.rlike(r"^[\[{]"))


def all_fields(body: Column) -> Column:
    """Map of the top-level fields of a JSON body, nested values as JSON, nulls left out."""
    return F.map_filter(_fields(body), lambda k, v: v.isNotNull())


def _fields(body: Column) -> Column:
    parsed = F.from_json(F.when(F.trim(body).startswith("{"), body), "map<string,string>")
    return rekeyed(F.coalesce(parsed, F.expr(EMPTY)), lambda k, v: k)  # a body may name a field twice


def message(body: Column, field: str) -> Column:
    """A field of a JSON body in its place if that is a string, else the body."""
    found = F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant")
    return once(found, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(body))


def stream_labels(pod_labels: Column, core: Column, fields: Column, label_map: dict[str, str], json_labels: list[str], static: dict[str, str]) -> Column:
    """Labels in order of rank: k8s_<pod label>, renamed pod labels, JSON labels, static ones, core keys; later ones win."""
    k8s = F.transform_keys(pod_labels, lambda k, v: F.concat(F.lit("k8s_"), k))
    constant = lambda d: F.create_map(*(F.lit(x) for p in d.items() for x in p)) if d else F.expr(EMPTY)
    renames = constant(label_map)
    renamed = rekeyed(F.map_filter(pod_labels, lambda k, v: F.map_contains_key(renames, k)), lambda k, v: renames[k])
    picked = F.map_filter(fields, lambda k, v: k.isin(*json_labels)) if json_labels else F.expr(EMPTY)
    return F.map_filter(merged(k8s, renamed, picked, constant(static), core), lambda k, v: v.isNotNull())


def keep(rows: DataFrame, matchers: list[str], labels: str = "labels") -> DataFrame:
    """Rows whose labels pass every matcher; absent labels count as empty here."""
    return rows.filter(matches(F.col(labels), matchers))


def selected(objects: DataFrame, selector: dict[str, str], labels: str = "labels") -> DataFrame:
    """Objects whose labels contain the selector's pairs."""
    out = objects
    for k, v in selector.items():
        out = out.filter(F.col(labels)[k] == v)
    return out


def as_logs(rows: DataFrame) -> DataFrame:
    """rows(ts_unix_nano, severity, body, attributes, labels) with their stream fingerprint first."""
    return rows.select(fingerprint(F.col("labels")).alias("stream_fingerprint"), "ts_unix_nano", "severity", "body", "attributes", "labels")
