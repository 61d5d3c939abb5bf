"""Names and ranks of severities, span kinds and statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ((21, "FATAL"), (17, "ERROR"), (13, "WARN"), (9, "INFO"), (5, "DEBUG"), (1, "TRACE"))
UNKNOWN = "—"
#: From least to most severe.
ORDER = (UNKNOWN, *(name for _, name in reversed(CLASSES)))
#: Names by number.
KINDS = ("UNSPEC", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
STATUSES = ("", "OK", "ERROR")


def severity_class(number: Column) -> Column:
    out = F.lit(UNKNOWN)
    for least, name in reversed(CLASSES):
        out = F.when(number >= least, name).otherwise(out)
    return out


def rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), name) - 1


def _named(number: Column, names: tuple[str, ...], other: Column) -> Column:
    return F.when((number >= 0) & (number < len(names)), F.element_at(F.array(*map(F.lit, names)), number.cast("int") + 1)).otherwise(other)


def kind_name(kind: Column) -> Column:
    return _named(kind, KINDS, F.concat(F.lit("KIND_"), kind.cast("string")))


def status_name(code: Column) -> Column:
    return _named(code, STATUSES, F.lit(""))
