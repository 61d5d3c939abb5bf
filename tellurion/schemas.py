"""Schemas of the four signals, of block sidecars and of the catalog.

Unsigned 64-bit values are stored as signed longs of the same bits; times are nanoseconds
since the epoch in longs and never pass through microsecond timestamps.
"""

from __future__ import annotations

from pyspark.sql import types as T

SIGNALS = ("metrics", "logs", "traces", "profiles")
STRINGS = T.MapType(T.StringType(), T.StringType(), True)


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


METRICS = _s(("series_fingerprint", T.LongType(), False), ("ts_unix_nano", T.LongType(), False), ("value", T.DoubleType(), False))
LOGS = _s(
    ("stream_fingerprint", T.LongType(), False), ("ts_unix_nano", T.LongType(), False), ("severity", T.ShortType(), False),
    ("body", T.StringType(), False), ("attributes", STRINGS, False),
)
EVENT = _s(("ts_unix_nano", T.LongType(), False), ("name", T.StringType(), False), ("attributes", STRINGS, False))
LINK = _s(("trace_id", T.BinaryType(), False), ("span_id", T.BinaryType(), False), ("attributes", STRINGS, False))
TRACES = _s(
    ("trace_id", T.BinaryType(), False), ("span_id", T.BinaryType(), False), ("parent_span_id", T.BinaryType(), True),
    ("resource_labels", STRINGS, False), ("service_name", T.StringType(), True), ("service_namespace", T.StringType(), True),
    ("deployment_environment", T.StringType(), True), ("scope_name", T.StringType(), False), ("scope_version", T.StringType(), False),
    ("name", T.StringType(), False), ("kind", T.ShortType(), False), ("start_unix_nano", T.LongType(), False),
    ("end_unix_nano", T.LongType(), False), ("status_code", T.ShortType(), False), ("status_message", T.StringType(), False),
    ("attributes", STRINGS, False), ("events", T.ArrayType(EVENT), False), ("links", T.ArrayType(LINK), False),
)
PROFILES = _s(
    ("ts_unix_nano", T.LongType(), False), ("duration_nano", T.LongType(), False), ("labels", STRINGS, False),
    ("format", T.ShortType(), False), ("data", T.BinaryType(), False),
)
TABLES = {"metrics": METRICS, "logs": LOGS, "traces": TRACES, "profiles": PROFILES}
#: Columns by which a block is sorted, and the one that holds its time.
SORT = {"metrics": ("series_fingerprint", "ts_unix_nano"), "logs": ("stream_fingerprint", "ts_unix_nano"), "traces": ("trace_id", "start_unix_nano"), "profiles": ("ts_unix_nano",)}
TIME = {"metrics": "ts_unix_nano", "logs": "ts_unix_nano", "traces": "start_unix_nano", "profiles": "ts_unix_nano"}
KEY = {"metrics": "series_fingerprint", "logs": "stream_fingerprint"}

DIMENSION = _s(("fingerprint", T.LongType(), False), ("labels", STRINGS, False), ("metric_type", T.ShortType(), True))
POSTINGS = _s(("block", T.StringType(), False), ("label_name", T.StringType(), False), ("label_value", T.StringType(), False), ("fingerprints", T.ArrayType(T.LongType()), False))
BLOCKS = _s(
    ("block", T.StringType(), False), ("signal", T.StringType(), False), ("path", T.StringType(), False), ("bucket", T.StringType(), False),
    ("date", T.StringType(), False), ("level", T.IntegerType(), False), ("ts_min", T.LongType(), False), ("ts_max", T.LongType(), False),
    ("row_count", T.LongType(), False), ("size_bytes", T.LongType(), False), ("writer", T.StringType(), True), ("shard", T.IntegerType(), True),
    ("segment", T.LongType(), True), ("schema_version", T.IntegerType(), False),
)
#: One row for each thing that happened to a block; the live set is folded from these.
CATALOG_EVENTS = T.StructType([T.StructField("event", T.StringType(), False), T.StructField("at", T.LongType(), False), *[T.StructField(f.name, f.dataType, True) for f in BLOCKS]])

COUNTER, GAUGE, HISTOGRAM, SUMMARY = 1, 2, 3, 4
