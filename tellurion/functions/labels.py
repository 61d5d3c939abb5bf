"""Label sets: canonical form, fingerprints, and the matcher language."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "cast(map() as map<string,string>)"


def once(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often use() names it; a lambda would work it out again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rekeyed(labels: Column, key) -> Column:
    """The map with key(k, v) for each key; of keys that meet the last one stays, whatever the session does about repeated keys."""
    pairs = F.transform(F.map_entries(labels), lambda e: F.struct(key(e.key, e.value).alias("key"), e.value.alias("value")))
    return once(pairs, lambda all_: F.map_from_entries(F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later.key == e.key))))


def merged(*maps: Column) -> Column:
    """One map of several; of equal keys the last map's stays, whatever the session does about repeated keys."""
    return reduce(lambda old, new: once(new, lambda n: F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(n, k)), n)), maps)


def canonical(labels: Column) -> Column:
    """Pairs sorted by key, each as key NUL value NUL; null maps and values count as empty."""
    entries = F.array_sort(F.map_entries(F.coalesce(labels, F.expr(EMPTY))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit("\0"), F.coalesce(e.value, F.lit("")), F.lit("\0"))), "")


def fingerprint(labels: Column) -> Column:
    """64-bit hash of the canonical form, a signed long."""
    return F.xxhash64(canonical(labels))


def digest(labels: Column) -> Column:
    """md5 of the canonical form, which other engines can compute too."""
    return F.md5(canonical(labels))


def sorted_json(labels: Column) -> Column:
    """The map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


class MatcherError(ValueError):
    pass


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str
    value: str

    def column(self, labels: Column) -> Column:
        """Absent labels count as empty; regular expressions match the whole value."""
        have = F.coalesce(labels[self.name], F.lit(""))
        if self.op in ("=", "!="):
            same = have == self.value
        else:
            same = have.rlike(rf"\A(?:{self.value})\z")
        return ~same if self.op[0] == "!" else same


def parse_matcher(text: str) -> Matcher:
    at = re.search(r"[=!]", text)
    if at is None:
        raise MatcherError(f"no operator in {text!r}")
    name, rest = text[: at.start()].strip(), text[at.start() :]
    op = next((o for o in ("=~", "!~", "!=", "=") if rest.startswith(o)), None)
    if op is None:
        raise MatcherError(f"a bare ! in {text!r}")
    if not name:
        raise MatcherError(f"no label name in {text!r}")
    value = rest[len(op) :].strip()
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1]
    if op in ("=~", "!~"):
        try:
            re.compile(value)
        except re.error as e:
            raise MatcherError(f"bad expression in {text!r}: {e}") from e
    return Matcher(name, op, value)


def matches(labels: Column, matchers: list[str]) -> Column:
    """All matchers hold; an empty list always does."""
    out = F.lit(True)
    for m in matchers:
        out = out & parse_matcher(m).column(labels)
    return out


def equality(matchers: list[str]) -> list[Matcher]:
    """Matchers of a stored-data query, which are equalities only."""
    parsed = [parse_matcher(m) for m in matchers]
    for m in parsed:
        if m.op != "=":
            raise MatcherError(f"only equality reaches stored blocks, not {m.name}{m.op}{m.value}")
    return parsed


#: Labels that identify a row, in order.
PRIMARY = ("container", "pod", "namespace", "node", "service", "k8s_app.kubernetes.io/name", "k8s_app.kubernetes.io/instance", "k8s_app.kubernetes.io/component")


def primary_labels(labels: Column, keys: tuple[str, ...] = PRIMARY, most: int = 4) -> Column:
    """The labels of well-known keys, else the first four by key."""
    known = F.map_filter(labels, lambda k, v: k.isin(*keys))
    first = F.map_from_entries(F.slice(F.array_sort(F.map_entries(labels)), 1, most))
    return F.when(F.size(known) > 0, known).otherwise(first)


def free_text(needle: str, *texts: Column, maps: tuple[Column, ...] = ()) -> Column:
    """Lower-case substring over texts and the keys and values of maps; an empty needle matches all."""
    if not needle:
        return F.lit(True)
    low = needle.lower()
    out = F.lit(False)
    for t in texts:
        out = out | F.coalesce(F.lower(t).contains(low), F.lit(False))
    for m in maps:
        out = out | F.coalesce(F.exists(F.map_entries(m), lambda e: F.lower(e.key).contains(low) | F.coalesce(F.lower(e.value).contains(low), F.lit(False))), F.lit(False))
    return out


def sanitize_key(key: Column, allow: str = "a-zA-Z0-9_") -> Column:
    """Characters outside the allowed class become _, and a leading digit gets one before it."""
    clean = F.regexp_replace(key, f"[^{allow}]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)
