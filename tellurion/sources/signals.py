"""Views that turn plain tables into the four signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.functions.labels import fingerprint
from tellurion.functions.time import SECOND, to_nanos

NONE = "cast(map() as map<string,string>)"
NO_EVENTS = "cast(array() as array<struct<ts_unix_nano:bigint,name:string,attributes:map<string,string>>>)"
NO_LINKS = "cast(array() as array<struct<trace_id:binary,span_id:binary,attributes:map<string,string>>>)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(**columns: Column) -> Column:
    return F.create_map(*(x for k, v in columns.items() for x in (F.lit(k), v)))


def shard() -> Column:
    return (F.col("user_id") % 8).cast("string")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs from events: a stream for each event type and shard."""
    e = read(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", 17).when(F.col("event_type") == "purchase", 13).when(F.col("event_type").isin("signup", "click"), 9).otherwise(5)
    body = F.concat(F.lit("event "), F.col("event_id"), F.lit(" user "), F.col("user_id"), F.lit(" value "), F.col("value").cast("decimal(18,4)").cast("string"), F.lit(" "), F.col("props"))
    rows = e.select(
        to_nanos(F.col("ts")).alias("ts_unix_nano"), severity.cast("short").alias("severity"), body.alias("body"),
        pairs(user_id=F.col("user_id").cast("string"), k=F.get_json_object("props", "$.k")).alias("attributes"),
        pairs(event_type=F.col("event_type"), shard=shard()).alias("labels"),
    )
    return rows.select(fingerprint(F.col("labels")).alias("stream_fingerprint"), "ts_unix_nano", "severity", "body", "attributes", "labels")


def text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs from documents, one second apart by id."""
    d = read(spark, sf_dir, "documents")
    rows = d.select((F.col("doc_id") * SECOND).alias("ts_unix_nano"), F.lit(9).cast("short").alias("severity"), F.col("text").alias("body"), F.expr(NONE).alias("attributes"), pairs(lang=F.col("lang"), source=F.col("source")).alias("labels"), "doc_id")
    return rows.select(fingerprint(F.col("labels")).alias("stream_fingerprint"), "ts_unix_nano", "severity", "body", "attributes", "labels", "doc_id")


def chat_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    rows = c.select(((F.col("conv_id") * 1000 + F.col("turn")) * SECOND).alias("ts_unix_nano"), F.lit(9).cast("short").alias("severity"), F.col("text").alias("body"), F.expr(NONE).alias("attributes"), pairs(role=F.col("role")).alias("labels"))
    return rows.select(fingerprint(F.col("labels")).alias("stream_fingerprint"), "ts_unix_nano", "severity", "body", "attributes", "labels")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics from events, with their labels: fingerprint, time, value, labels."""
    e = read(spark, sf_dir, "events")
    rows = e.select(to_nanos(F.col("ts")).alias("ts_unix_nano"), "value", pairs(__name__=F.lit("event_value"), event_type=F.col("event_type"), shard=shard()).alias("labels"))
    return rows.select(fingerprint(F.col("labels")).alias("series_fingerprint"), "ts_unix_nano", "value", "labels")


def line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    labels = pairs(__name__=F.lit("line_price"), returnflag=F.col("l_returnflag"), linestatus=F.col("l_linestatus"), supp=F.col("l_suppkey").cast("string"))
    rows = line.select(to_nanos(F.col("l_shipdate")).alias("ts_unix_nano"), F.col("l_extendedprice").alias("value"), labels.alias("labels"))
    return rows.select(fingerprint(F.col("labels")).alias("series_fingerprint"), "ts_unix_nano", "value", "labels")


def dimension(labelled: DataFrame, key: str, metric_type: int | None = None) -> DataFrame:
    """One row for each fingerprint of a labelled signal."""
    one = labelled.groupBy(F.col(key).alias("fingerprint")).agg(F.any_value("labels").alias("labels"))
    return one.withColumn("metric_type", F.lit(metric_type).cast("short"))


def trace_id(key: Column) -> Column:
    return F.unhex(F.lpad(F.lower(F.hex(key)), 32, "0"))


def span_id(text: Column) -> Column:
    return F.unhex(F.substring(F.md5(text), 1, 16))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces: an order is the root span, its lines are the children."""
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    start = to_nanos(F.col("o_orderdate"))
    root_id = span_id(F.concat(F.lit("order "), F.col("o_orderkey")))
    roots = o.select(
        trace_id(F.col("o_orderkey")).alias("trace_id"), root_id.alias("span_id"), F.lit(None).cast("binary").alias("parent_span_id"),
        F.col("o_orderpriority").alias("service_name"), F.col("o_orderstatus").alias("deployment_environment"), F.lit("order").alias("name"),
        F.lit(2).cast("short").alias("kind"), start.alias("start_unix_nano"), (start + SECOND).alias("end_unix_nano"), F.lit(1).cast("short").alias("status_code"),
    )
    begin = to_nanos(F.col("l_shipdate"))
    row = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), (F.col("l_extendedprice") * 100).cast("long"), (F.col("l_discount") * 100).cast("int"), (F.col("l_tax") * 100).cast("int"))
    children = line.select(
        trace_id(F.col("l_orderkey")).alias("trace_id"), span_id(row).alias("span_id"), span_id(F.concat(F.lit("order "), F.col("l_orderkey"))).alias("parent_span_id"),
        F.concat(F.lit("supplier-"), F.col("l_suppkey") % 10).alias("service_name"), F.col("l_linestatus").alias("deployment_environment"), F.lit("line").alias("name"),
        F.lit(3).cast("short").alias("kind"), begin.alias("start_unix_nano"), (begin + F.col("l_quantity").cast("long") * SECOND).alias("end_unix_nano"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).cast("short").alias("status_code"),
    )
    return complete_spans(roots.unionByName(children))


def complete_spans(part: DataFrame) -> DataFrame:
    """Spans with the remaining columns of the traces schema."""
    return part.select(
        "trace_id", "span_id", "parent_span_id", pairs(**{"service.name": F.col("service_name"), "deployment.environment": F.col("deployment_environment")}).alias("resource_labels"),
        "service_name", F.lit(None).cast("string").alias("service_namespace"), "deployment_environment", F.lit("").alias("scope_name"), F.lit("").alias("scope_version"), "name",
        "kind", "start_unix_nano", "end_unix_nano", "status_code", F.lit("").alias("status_message"), F.expr(NONE).alias("attributes"), F.expr(NO_EVENTS).alias("events"), F.expr(NO_LINKS).alias("links"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    return p.select((F.col("page_id") * SECOND).alias("ts_unix_nano"), F.lit(SECOND).alias("duration_nano"), pairs(host=host).alias("labels"), F.lit(1).cast("short").alias("format"), F.encode("html", "UTF-8").alias("data"))
