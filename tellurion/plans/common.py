"""What the telemetry queries share: the tables as SQL, times, stores of blocks and the stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.functions import labels as L
from tellurion.functions.time import SECOND, floor_div
from tellurion.session import scratch_dir
from tellurion.sources import blocks, signals
from tellurion.sources.catalog import Catalog

STEP = 6 * 3600 * SECOND
DAY = 86400 * SECOND
#: 2024-01-05 to 2024-01-12, in nanoseconds.
START, END = 1704412800 * SECOND, 1705017600 * SECOND

LOGS = """
logs AS (SELECT event_id, epoch_us(ts) * 1000 AS ts_unix_nano, event_type, CAST(user_id % 8 AS VARCHAR) AS shard, user_id, value,
  CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9 WHEN 'click' THEN 9 ELSE 5 END AS severity,
  'event ' || event_id || ' user ' || user_id || ' value ' || CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR) || ' ' || props AS body,
  json_extract_string(props, '$.k') AS k,
  md5('event_type' || chr(0) || event_type || chr(0) || 'shard' || chr(0) || CAST(user_id % 8 AS VARCHAR) || chr(0)) AS stream
FROM events)"""
SPANS = """
spans AS (
  SELECT lpad(lower(hex(o_orderkey)), 32, '0') AS trace_id, substr(md5('order ' || o_orderkey), 1, 16) AS span_id, NULL AS parent_span_id,
    o_orderpriority AS service_name, o_orderstatus AS deployment_environment, 'order' AS name, epoch_us(o_orderdate) * 1000 AS start_ns, epoch_us(o_orderdate) * 1000 + 1000000000 AS end_ns, 1 AS status_code
  FROM orders UNION ALL
  SELECT lpad(lower(hex(l_orderkey)), 32, '0'),
    substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(trunc(l_extendedprice * 100) AS BIGINT), CAST(trunc(l_discount * 100) AS INT), CAST(trunc(l_tax * 100) AS INT))), 1, 16),
    substr(md5('order ' || l_orderkey), 1, 16), 'supplier-' || (l_suppkey % 10), l_linestatus, 'line', epoch_us(l_shipdate) * 1000, epoch_us(l_shipdate) * 1000 + CAST(l_quantity AS BIGINT) * 1000000000,
    CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END
  FROM lineitem)"""
CLASS = "CASE WHEN severity >= 21 THEN 'FATAL' WHEN severity >= 17 THEN 'ERROR' WHEN severity >= 13 THEN 'WARN' WHEN severity >= 9 THEN 'INFO' WHEN severity >= 5 THEN 'DEBUG' WHEN severity >= 1 THEN 'TRACE' ELSE '—' END"


def empty_store(spark: SparkSession) -> tuple[Catalog, str]:
    root = f"{scratch_dir(spark)}/tellurion-{uuid.uuid4().hex}/store"
    return Catalog(spark, f"{root}/_catalog"), root


def publish_rows(catalog: Catalog, root: str, signal: str, rows: DataFrame, dimension: DataFrame | None = None, segment: int = 0) -> None:
    made = blocks.write_block(root, signal, rows, dimension, segment=segment)
    if made is not None:
        catalog.insert(made)


def log_store(spark: SparkSession, sf_dir: str, parts: int = 3) -> tuple[Catalog, str]:
    """Log blocks of the events by remainder of their time, in a new store."""
    catalog, root = empty_store(spark)
    rows = signals.logs(spark, sf_dir)
    for i in range(parts):
        part = rows.filter(F.pmod(floor_div(F.col("ts_unix_nano"), 1000), F.lit(parts)) == i)
        publish_rows(catalog, root, "logs", part, signals.dimension(part, "stream_fingerprint"), i)
    return catalog, root


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = signals.read(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    kinds = signals.pairs(event_type=F.col("event_type"), shard=signals.shard())
    return raw.select(L.fingerprint(kinds).alias("stream_fingerprint"), ns.alias("ts_unix_nano"), F.when(F.col("event_type") == "error", 17).otherwise(9).cast("short").alias("severity"), F.concat(F.lit("event "), F.col("event_id")).alias("body"), F.expr(signals.NONE).alias("attributes"), kinds.alias("labels"))
