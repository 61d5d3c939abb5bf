"""Signal rows in the shapes other stores take, quarantine of bad input, and fan-out to several sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.functions.labels import merged, rekeyed, sanitize_key
from tellurion.functions.time import to_timestamp

ROUTES = ("service.name", "service", "app", "k8s_app")


def push_entries(logs: DataFrame) -> DataFrame:
    """Label-indexed push: sanitised labels as sorted JSON, time as text, line, and metadata with the severity if it is not 0."""
    clean = rekeyed(F.col("labels"), lambda k, v: sanitize_key(k))
    level = F.when(F.col("severity") != 0, F.create_map(F.lit("severity"), F.col("severity").cast("string"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    meta = merged(rekeyed(F.col("attributes"), lambda k, v: sanitize_key(k)), level)
    as_json = lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    return logs.select(as_json(clean).alias("stream"), F.col("ts_unix_nano").cast("string").alias("ts"), F.col("body").alias("line"), as_json(meta).alias("metadata"))


def index_name(labels: Column, prefix: str) -> Column:
    """<prefix>-<service> by the first route label, else general; lower case, other characters as -."""
    service = F.coalesce(*(F.nullif(labels[k], F.lit("")) for k in ROUTES), F.lit("general"))
    return F.concat(F.lit(f"{prefix}-"), F.regexp_replace(F.lower(service), "[^a-z0-9_.-]", "-"))


def iso_millis(ns: Column) -> Column:
    return F.concat(F.date_format(to_timestamp(ns), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def bulk_documents(logs: DataFrame, prefix: str = "logs") -> DataFrame:
    """One document for each entry with the index it goes to."""
    doc = F.struct(iso_millis(F.col("ts_unix_nano")).alias("@timestamp"), F.col("body").alias("message"), "severity", "labels", "attributes")
    return logs.select(index_name(F.col("labels"), prefix).alias("index"), F.to_json(doc).alias("document"))


def validated(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(sound, quarantined) rows; a quarantined row names the first rule it breaks. A rule that is null is broken."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules.items()):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    marked = rows.withColumn("_reason", reason)
    return marked.filter("_reason is null").drop("_reason"), marked.filter("_reason is not null").withColumnRenamed("_reason", "reason")


def fan_out(sinks: dict[str, tuple[frozenset[str], Callable[[DataFrame], None]]], counts: dict[str, list[int]]) -> Callable[[str, DataFrame], None]:
    """A function that offers each batch of a signal to every sink that takes it; a failing sink drops and counts, the others go on."""

    def offer(signal: str, batch: DataFrame) -> None:
        for name, (mask, write) in sinks.items():
            if signal in mask:
                accepted, dropped = counts.setdefault(name, [0, 0])
                try:
                    write(batch)
                    counts[name] = [accepted + 1, dropped]
                except Exception:
                    counts[name] = [accepted, dropped + 1]

    return offer
