"""Nanosecond times: buckets, step choice, dates and RFC 3339."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
#: Steps of a histogram in seconds, 1 s to 1 d.
LADDER = (1, 5, 10, 15, 30, 60, 300, 600, 900, 1800, 3600, 10800, 21600, 43200, 86400)


def to_nanos(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000)


def floor_div(ns: Column, unit: int) -> Column:
    """Whole units below a time; exact, as the rounding of a double division is below half a unit."""
    return F.round((ns - F.pmod(ns, F.lit(unit))) / unit).cast("long")


def bucket(ns: Column, step: int) -> Column:
    """Start of the epoch-aligned bucket, also for times before the epoch."""
    return ns - F.pmod(ns, F.lit(step))


def to_timestamp(ns: Column) -> Column:
    return F.timestamp_micros(floor_div(ns, 1000))


def choose_step(start: int, end: int, most: int = 120) -> int:
    """The least step of the ladder that needs at most so many buckets, in nanoseconds; empty windows get 1 s, long ones the last step."""
    span = (end - start) / SECOND
    if span <= 0:
        return SECOND
    return next((s for s in LADDER if span / s <= most), LADDER[-1]) * SECOND


def step_of(span: Column, most: int = 120) -> Column:
    """choose_step for a column of spans in nanoseconds; a null span counts as empty. Spans may be decimals, as two longs may lie further apart than a long holds."""
    fits = F.filter(F.array(*(F.lit(s * SECOND) for s in LADDER)), lambda s: span <= s * most)
    wide = F.when(F.size(fits) > 0, F.element_at(fits, 1)).otherwise(LADDER[-1] * SECOND)
    return F.when(span > 0, wide).otherwise(SECOND)


def snap(now: int, step: int) -> int:
    return now // step * step


def quick_range(now: int, span: int) -> tuple[int, int]:
    """The window of a span that ends at the last whole step, so that requests within one step are equal."""
    end = snap(now, choose_step(0, span))
    return end - span, end


def time_text(ns: Column) -> Column:
    """Struct of the time of day and the whole time, both to the millisecond, in the session's zone."""
    at = to_timestamp(ns)
    return F.struct(F.date_format(at, "HH:mm:ss.SSS").alias("short"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("full"))


def utc_date(ns: Column) -> Column:
    return F.date_format(F.timestamp_seconds(floor_div(ns, SECOND)), "yyyy-MM-dd")


def rfc3339_nanos(text: Column) -> Column:
    """Nanoseconds of an RFC 3339 time, with up to nine digits of fraction; null if it isn't one."""
    pattern = r"^(\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d)(?:\.(\d{1,9})\d*)?([Zz]|[+-]\d\d:\d\d)$"
    zone = F.upper(F.regexp_extract(text, pattern, 3))
    whole = F.try_to_timestamp(F.concat(F.regexp_replace(F.upper(F.regexp_extract(text, pattern, 1)), "T", " "), zone), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    fraction = F.rpad(F.regexp_extract(text, pattern, 2), 9, "0").cast("long")
    return F.when(text.rlike(pattern), F.unix_seconds(whole) * SECOND + fraction)
