"""Nested trace exports and profile uploads as signal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.functions.labels import EMPTY, merged, once
from tellurion.functions.text import lower_hex

#: One attribute value: at most one of the fields is set. Nested values come as JSON text made by list_text and pairs_text.
ANY_VALUE = "struct<string_value:string,int_value:bigint,double_value:double,bool_value:boolean,bytes_value:binary,array_value:array<string>,kv_value:array<struct<key:string,value:string>>>"
ATTRIBUTES = f"array<struct<key:string,value:{ANY_VALUE}>>"
SPAN = (
    "struct<trace_id:binary,span_id:binary,parent_span_id:binary,name:string,kind:int,start_unix_nano:bigint,end_unix_nano:bigint,status_code:int,status_message:string,"
    f"attributes:{ATTRIBUTES},events:array<struct<ts_unix_nano:bigint,name:string,attributes:{ATTRIBUTES}>>,links:array<struct<trace_id:binary,span_id:binary,attributes:{ATTRIBUTES}>>>"
)
REQUEST = f"resource_spans array<struct<resource:{ATTRIBUTES},scopes:array<struct<name:string,version:string,spans:array<{SPAN}>>>>>"


def value_text(v: Column) -> Column:
    """A value as text: bytes in hex, arrays as [a,b], key-value lists as {k=v}, nothing as the empty text."""
    pairs = F.transform(v.kv_value, lambda p: F.concat(p.key, F.lit("="), F.coalesce(p.value, F.lit(""))))
    return F.coalesce(
        v.string_value, v.int_value.cast("string"), v.double_value.cast("string"), v.bool_value.cast("string"), lower_hex(v.bytes_value),
        F.concat(F.lit("["), F.array_join(v.array_value, ","), F.lit("]")), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), F.lit(""),
    )


def attribute_map(attributes: Column) -> Column:
    """The last of repeated keys wins."""
    entries = F.transform(attributes, lambda a: F.struct(a.key.alias("key"), value_text(a.value).alias("value")))
    last = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later.key == e.key))
    differ = lambda all_: F.size(F.array_distinct(F.transform(all_, lambda e: e.key))) == F.size(all_)
    return F.coalesce(once(entries, lambda all_: F.map_from_entries(F.when(differ(all_), all_).otherwise(last(all_)))), F.expr(EMPTY))


def promoted(resource: Column) -> list[Column]:
    return [
        resource["service.name"].alias("service_name"), resource["service.namespace"].alias("service_namespace"),
        F.coalesce(resource["deployment.environment"], resource["deployment.environment.name"]).alias("deployment_environment"),
    ]


def flatten_spans(requests: DataFrame) -> DataFrame:
    """requests(resource_spans) -> rows of the traces schema."""
    r = requests.select(F.explode("resource_spans").alias("r")).select(attribute_map(F.col("r.resource")).alias("resource_labels"), F.explode("r.scopes").alias("sc"))
    s = r.select("resource_labels", F.coalesce("sc.name", F.lit("")).alias("scope_name"), F.coalesce("sc.version", F.lit("")).alias("scope_version"), F.explode("sc.spans").alias("s"))
    parent = F.when(F.octet_length("s.parent_span_id") > 0, F.col("s.parent_span_id"))
    events = F.transform("s.events", lambda e: F.struct(e.ts_unix_nano.alias("ts_unix_nano"), F.coalesce(e["name"], F.lit("")).alias("name"), attribute_map(e.attributes).alias("attributes")))
    links = F.transform("s.links", lambda e: F.struct(e.trace_id.alias("trace_id"), e.span_id.alias("span_id"), attribute_map(e.attributes).alias("attributes")))
    none = "cast(array() as array<struct<%s>>)"
    return s.select(
        "s.trace_id", "s.span_id", parent.alias("parent_span_id"), "resource_labels", *promoted(F.col("resource_labels")), "scope_name", "scope_version",
        F.coalesce("s.name", F.lit("")).alias("name"), F.coalesce("s.kind", F.lit(0)).cast("short").alias("kind"), "s.start_unix_nano", "s.end_unix_nano",
        F.coalesce("s.status_code", F.lit(0)).cast("short").alias("status_code"), F.coalesce("s.status_message", F.lit("")).alias("status_message"), attribute_map(F.col("s.attributes")).alias("attributes"),
        F.coalesce(events, F.expr(none % "ts_unix_nano:bigint,name:string,attributes:map<string,string>")).alias("events"),
        F.coalesce(links, F.expr(none % "trace_id:binary,span_id:binary,attributes:map<string,string>")).alias("links"),
    )


def profile_rows(uploads: DataFrame) -> DataFrame:
    """uploads(from_s, until_s, name, spy_name, sample_rate, data) -> rows of the profiles schema.

    name is app{k=v,...}; durations never fall below zero.
    """
    inner = F.regexp_extract("name", r"\{(.*)\}\s*$", 1)
    pairs = F.transform(F.split(F.regexp_replace(inner, r"\s+", ""), ","), lambda t: F.split(t, "=", 2))
    names = F.transform(pairs, lambda p: p[0])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p[0]))
    tags = F.map_from_entries(F.transform(last, lambda p: F.struct(p[0].alias("key"), F.try_element_at(p, F.lit(2)).alias("value"))))
    app = F.trim(F.regexp_extract("name", r"^([^{]*)", 1))
    more = F.map_filter(F.create_map(F.lit("service.name"), app, F.lit("spy_name"), F.col("spy_name"), F.lit("sample_rate"), F.col("sample_rate").cast("string")), lambda k, v: v.isNotNull() & (v != ""))
    return uploads.select(
        (F.col("from_s") * 1_000_000_000).alias("ts_unix_nano"), (F.greatest(F.col("until_s") - F.col("from_s"), F.lit(0)) * 1_000_000_000).alias("duration_nano"),
        merged(F.map_filter(tags, lambda k, v: (k != "") & v.isNotNull() & ~k.isin("service.name", "spy_name", "sample_rate")), more).alias("labels"), F.lit(1).cast("short").alias("format"), "data",
    )
