"""Text helpers and functions that other engines have under names Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSI = r"\x1B\[[0-?]*[ -/]*[@-~]|\x1B\][^\x07\x1B]*(?:\x07|\x1B\\)|\x1B[@-Z\\-_]"


def strip_ansi(body: Column) -> Column:
    """Without escape codes, and without control characters but tab and newline."""
    return F.regexp_replace(F.regexp_replace(body, ANSI, ""), r"[\x00-\x08\x0B-\x1F\x7F]", "")


def lower_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def session_and_frame(trace_id: Column) -> tuple[Column, Column]:
    """A 16-byte trace id as the hex of its first half and the number in its second."""
    return lower_hex(F.substring(trace_id, 1, 8)), F.conv(F.hex(F.substring(trace_id, 9, 8)), 16, 10).cast("decimal(20,0)")


def duration_text(ns: Column) -> Column:
    """A span in its largest fitting unit; negative ones count as 0."""
    ns = F.greatest(ns, F.lit(0))
    return (
        F.when(ns < 1000, F.concat(ns.cast("string"), F.lit("ns")))
        .when(ns < 1_000_000, F.format_string("%.1fµs", ns / 1e3))
        .when(ns < 1_000_000_000, F.format_string("%.2fms", ns / 1e6))
        .otherwise(F.format_string("%.2fs", ns / 1e9))
    )


def service_hue(name: Column) -> Column:
    """A colour angle, 0 to 359: the 31-hash of the UTF-16 units, wrapped to 32 bits."""
    digits = F.hex(F.encode(name, "UTF-16BE"))
    units = F.transform(F.when(F.length(name) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(4))).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substr(digits, i, F.lit(4)), 16, 10).cast("long"))
    whole = F.aggregate(units, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))
    return F.pmod(F.when(whole >= 1 << 31, whole - (1 << 32)).otherwise(whole), F.lit(360)).cast("int")


def gcd(a: Column, b: Column, rounds: int = 92) -> Column:
    """Euclid's steps for longs; 92 suffice."""
    start = F.struct(F.abs(a).alias("x"), F.abs(b).alias("y"))
    step = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: F.when(s.y == 0, s).otherwise(F.struct(s.y.alias("x"), (s.x % F.when(s.y != 0, s.y)).alias("y"))))
    return step.x


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0)).otherwise(F.abs((a - a % F.when(g != 0, g)) / F.when(g != 0, g)).cast("long") * F.abs(b))


def iszero(x: Column) -> Column:
    return x == 0


#: Spellings of other engines -> ours, for the SQL entry point.
SPELLINGS = {
    "ends_with": "endswith", "starts_with": "startswith", "strpos": "instr", "substr_index": "substring_index", "array_has": "array_contains",
    "array_has_any": "arrays_overlap", "array_to_string": "array_join", "array_length": "size", "cardinality": "size", "make_array": "array",
    "array_concat": "concat", "list_extract": "element_at", "approx_distinct": "approx_count_distinct", "approx_percentile_cont": "percentile_approx",
    "approx_median": "median", "to_char": "date_format", "to_unixtime": "unix_timestamp", "to_timestamp_micros": "timestamp_micros",
    "to_timestamp_millis": "timestamp_millis", "to_timestamp_seconds": "timestamp_seconds", "string_agg": "listagg", "generate_series": "sequence", "make_map": "map", "unnest": "explode",
}
