"""Prometheus text exposition, scrapes, and remote write in both directions."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion import schemas
from tellurion.functions.labels import fingerprint, merged, once, rekeyed
from tellurion.functions.time import floor_div

NAME = re.compile(r"[a-zA-Z_:][a-zA-Z0-9_:]*")
PAIR = re.compile(r'\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"\s*(,|(?=\}))')
REST = re.compile(r"\s+(\S+)(?:\s+([+-]?\d+))?\s*$|^\s*(\S+)(?:\s+([+-]?\d+))?\s*$")
KINDS = {"counter": schemas.COUNTER, "gauge": schemas.GAUGE, "histogram": schemas.HISTOGRAM, "summary": schemas.SUMMARY}
ESCAPES = {"n": "\n", '"': '"', "\\": "\\"}


def number(text: str) -> float:
    """A number as the format spells it: decimal, exponent, +Inf, -Inf, NaN."""
    plain = text.lower().lstrip("+-")
    if plain in ("inf", "infinity"):
        return -math.inf if text[0] == "-" else math.inf
    if plain == "nan":
        return math.nan
    if "_" in text:
        raise ValueError(text)
    return float.fromhex(text) if plain.startswith("0x") else float(text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), text)


def parse_line(line: str) -> tuple[str, dict[str, str], float, int | None] | None:
    """(name, labels, value, milliseconds or None); None for comments and blanks; ValueError for anything else."""
    line = line.strip()
    if not line or line[0] == "#":
        return None
    m = NAME.match(line)
    if m is None:
        raise ValueError("no metric name")
    name, at, labels = m[0], m.end(), {}
    if line[at : at + 1] == "{":
        at += 1
        while not re.compile(r"\s*\}").match(line, at):
            p = PAIR.match(line, at)
            if p is None:
                raise ValueError("bad labels")
            labels[p[1]] = unescape(p[2])
            at = p.end()
        at = line.index("}", at) + 1
    rest = line[at:].split()
    if not 1 <= len(rest) <= 2:
        raise ValueError("no value")
    return name, labels, number(rest[0]), int(rest[1]) if len(rest) == 2 else None


def parse_exposition(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines with name, labels, value, ts_ms, type_name, type and error, the last telling lines that were skipped.

    All columns of lines come along. TYPE lines give type_name and type; other comments and
    blanks give no row. Nulls count as blanks.
    """
    others = [f for f in lines.schema if f.name not in ("name", "labels", "sample", "ts_ms", "type_name", "type", "error")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "name string, labels map<string,string>, sample double, ts_ms long, type_name string, type short, error string"])

    def parse(batches):
        for batch in batches:
            keep, out = [], []
            for i, line in enumerate(batch[text]):
                line = line or ""
                typed = re.match(r"\s*#\s*TYPE\s+(\S+)\s+(\S+)", line)
                if typed:
                    out.append((None, None, None, None, typed[1], KINDS.get(typed[2], 0), None))
                else:
                    try:
                        found = parse_line(line)
                    except ValueError as e:
                        out.append((None, None, None, None, None, None, str(e)))
                    else:
                        if found is None:
                            continue
                        out.append((found[0], found[1], found[2], found[3], None, None, None))
                keep.append(i)
            head = batch[[f.name for f in others]].iloc[keep].reset_index(drop=True)
            tail = pd.DataFrame(out, columns=["name", "labels", "sample", "ts_ms", "type_name", "type", "error"])
            yield pd.concat([head, tail.astype({"ts_ms": "Int64", "type": "Int16"})], axis=1)

    return lines.mapInPandas(parse, schema)


def resolve_types(samples: DataFrame, types: DataFrame) -> DataFrame:
    """samples(name, ...) with metric_type: by name, else by the base name of a histogram's or summary's series. types(type_name, type)."""
    held = types.groupBy("type_name").agg(F.max("type").alias("type"))
    base = F.regexp_replace("name", "_(bucket|sum|count)$", "")
    bucket = F.col("name").endswith("_bucket")
    own = held.select(F.col("type_name").alias("name"), F.col("type").alias("_own"))
    of_base = held.filter(F.col("type").isin(schemas.HISTOGRAM, schemas.SUMMARY)).select(F.col("type_name").alias("_base"), F.col("type").alias("_of_base"))
    joined = samples.withColumn("_base", base).join(own, "name", "left").join(of_base, "_base", "left")
    fits = (F.col("_base") != F.col("name")) & ~(bucket & (F.col("_of_base") == schemas.SUMMARY))
    return joined.withColumn("metric_type", F.coalesce("_own", F.when(fits, F.col("_of_base")), F.lit(0)).cast("short")).drop("_base", "_own", "_of_base")


def relabel(labels: Column, renames: dict[str, str]) -> Column:
    """Exposed keys renamed; a rename onto a present key wins."""
    if not renames:
        return labels
    table = F.create_map(*(F.lit(x) for pair in renames.items() for x in pair))

    def renamed(own: Column) -> Column:
        moved = F.map_filter(own, lambda k, v: F.map_contains_key(table, k))
        return merged(F.map_filter(own, lambda k, v: ~F.map_contains_key(table, k)), rekeyed(moved, lambda k, v: table[k]))

    return once(labels, renamed)


def with_target(name: Column, labels: Column, target: Column) -> Column:
    """An exposed series under its target: target labels win, what they would hide is kept as exported_<key>."""

    def under(own: Column) -> Column:
        exported = rekeyed(labels, lambda k, v: F.when(F.map_contains_key(own, k), F.concat(F.lit("exported_"), k)).otherwise(k))
        return merged(exported, own, F.create_map(F.lit("__name__"), name))

    return once(target, under)


def scrape_series(samples: DataFrame, scraped_ns: Column) -> DataFrame:
    """samples(name, labels, target, sample, ts_ms) -> metrics rows with labels; samples without a time get the scrape's."""
    all_labels = with_target(F.col("name"), F.col("labels"), F.col("target"))
    ts = F.coalesce(F.col("ts_ms") * 1_000_000, scraped_ns)
    rows = samples.select(all_labels.alias("labels"), ts.alias("ts_unix_nano"), F.col("sample").alias("value"))
    return rows.select(fingerprint(F.col("labels")).alias("series_fingerprint"), "ts_unix_nano", "value", "labels")


def scrape_health(targets: DataFrame) -> DataFrame:
    """up and scrape_duration_seconds for each target(target map, ok, seconds, scraped_ns), failed ones too."""
    pair = F.array(F.struct(F.lit("up").alias("n"), F.col("ok").cast("double").alias("v")), F.struct(F.lit("scrape_duration_seconds").alias("n"), F.col("seconds").cast("double").alias("v")))
    rows = targets.select("target", "scraped_ns", F.explode(pair).alias("p"))
    rows = rows.select(merged(F.col("target"), F.create_map(F.lit("__name__"), F.col("p.n"))).alias("labels"), F.col("scraped_ns").alias("ts_unix_nano"), F.col("p.v").alias("value"))
    return rows.select(fingerprint(F.col("labels")).alias("series_fingerprint"), "ts_unix_nano", "value", "labels")


def remote_write_in(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(series array<struct<labels map, samples array<struct<ts_ms, value>>>>) -> (metrics, dimension).

    Series without labels or samples are dropped, as are times not after the epoch; types are unknown.
    """
    series = requests.select(F.explode("series").alias("s")).select(F.col("s.labels").alias("labels"), F.col("s.samples").alias("samples"))
    sound = series.filter((F.size("labels") > 0) & (F.size("samples") > 0)).withColumn("series_fingerprint", fingerprint(F.col("labels")))
    rows = sound.select("series_fingerprint", F.explode("samples").alias("x")).select("series_fingerprint", (F.col("x.ts_ms") * 1_000_000).alias("ts_unix_nano"), F.col("x.value").alias("value")).filter("ts_unix_nano > 0")
    dimension = sound.groupBy(F.col("series_fingerprint").alias("fingerprint")).agg(F.any_value("labels").alias("labels")).withColumn("metric_type", F.lit(0).cast("short"))
    return rows, dimension


def remote_write_out(metrics: DataFrame, dimension: DataFrame) -> DataFrame:
    """One row for each series with its samples by time; samples whose series is unknown are dropped."""
    named = metrics.join(dimension.select(F.col("fingerprint").alias("series_fingerprint"), "labels"), "series_fingerprint")
    sample = F.struct(floor_div(F.col("ts_unix_nano"), 1_000_000).alias("ts_ms"), "value")
    return named.groupBy("series_fingerprint").agg(F.any_value("labels").alias("labels"), F.array_sort(F.collect_list(sample)).alias("samples"))
