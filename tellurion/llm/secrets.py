"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a table
of (blob, rule, rule_version, spans): a blob is scanned for a rule only where the ledger
lacks that pair, and what the ledger holds is joined back to all paths, so that copies and
old versions cost nothing more. The ledger folder is append-only Parquet; a batch that is
repeated after a failure may add equal rows, which readers merge.

Null texts count as empty. Empty texts, empty tables, repeated rows and extra columns are
fine: each input row comes back once with its own spans. Spans are code points with an
exclusive end. No rule takes more than time in proportion to a text's length, whatever the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.session import saved, scratch_dir

SPANS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    flags: int = 0
    #: The group that must have least characters, and how many; matches that fail are dropped after matching.
    group: int = 0
    least: int = 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in _compiled(self).finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


_cache: dict[tuple, re.Pattern] = {}


def _compiled(rule: Rule) -> re.Pattern:
    key = (rule.pattern, rule.flags)
    if key not in _cache:
        _cache[key] = re.compile(rule.pattern, rule.flags)
    return _cache[key]


BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, 2, 8),
    # Runs are maximal, so asking for the least length in the pattern drops the same matches.
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
#: Found besides the base kinds.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]*PRIVATE KEY-----"),
    # It starts where a run of its characters starts; without that bound each eyJ in a long run would be tried to the run's end.
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("hub", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = (*BASE, *ADDED)


def joined(kinds: list[str], spans: list[tuple[int, str, int]]) -> str:
    """kind:start:end by start, then by the order of kinds."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], order[s[1]], s[2])))


def scan_blobs(unseen: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """unseen(blob, text, missing array<string>) -> (blob, rule, rule_version, spans): one row for each pair scanned."""
    by_key = {f"{r.kind}@{r.version}": r for r in rules}

    def scan(batches):
        for batch in batches:
            out: list[tuple] = []
            for blob, text, missing in zip(batch.blob, batch.text, batch.missing, strict=True):
                for key in missing:
                    rule = by_key[key]
                    out.append((blob, rule.kind, rule.version, [{"start": a, "end": b} for a, b in rule.spans(text)]))
            yield pd.DataFrame(out, columns=["blob", "rule", "rule_version", "spans"])

    return unseen.select("blob", "text", "missing").mapInPandas(scan, f"blob binary, rule string, rule_version int, spans {SPANS}")


class Ledger:
    """The folder of scanned pairs."""

    SCHEMA = f"blob binary, rule string, rule_version int, spans {SPANS}"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def update(self, blobs: DataFrame, rules: tuple[Rule, ...]) -> None:
        """Scan what the ledger lacks of blobs(blob, text), one row for each content, and append it."""
        wanted = [f"{r.kind}@{r.version}" for r in rules]
        known = self.read()
        if known.isEmpty():
            unseen = blobs.withColumn("missing", F.array(*map(F.lit, wanted)))
        else:
            seen = known.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "rule_version")).alias("seen"))
            unseen = blobs.join(seen, "blob", "left").withColumn("missing", F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("seen", F.array().cast("array<string>"))))
            unseen = unseen.filter(F.size("missing") > 0)
        scan_blobs(unseen, rules).write.mode("append").parquet(self.path)


def scan_versions(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of versions (all if None) and `found`: array of (kind, start, end) of all rules, in no set order.

    A column of versions that is called found is replaced.
    versions holds every historical version of every path, one row for each. The texts are
    shuffled once, after exact copies within a task have met.
    """
    row = versions.select(F.struct(*(keep or versions.columns)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row = row.withColumn("blob", F.unhex(F.sha2("text", 256)))
    ledger.update(row.groupBy("blob").agg(F.first("text").alias("text")), rules)
    current = F.concat_ws("@", "rule", "rule_version").isin([f"{r.kind}@{r.version}" for r in rules])
    found = (
        ledger.read().filter(current & (F.size("spans") > 0)).dropDuplicates(["blob", "rule"])
        .select("blob", F.transform("spans", lambda s: F.struct(F.col("rule").alias("kind"), s.start.alias("start"), s.end.alias("end"))).alias("spans"))
        .groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("found"))
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    back = row.drop("text").join(found, "blob", "left")
    return back.select(*(F.col("row")[c].alias(c) for c in (keep or versions.columns) if c != "found"), F.coalesce("found", none).alias("found"))


def new_ledger(spark) -> Ledger:
    import uuid

    return Ledger(spark, f"{scratch_dir(spark)}/tellurion-{uuid.uuid4().hex}/ledger")


def redact(text, found):
    """Column: text with each found span replaced by its kind in brackets; overlapping spans are one, named by the first."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, [(int(s["start"]), int(s["end"]), s["kind"]) for s in f]) for t, f in zip(texts, spans, strict=True)], dtype=object)

    return cut(text, found)


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if text is None or not spans:
        return text
    merged: list[list] = []
    for a, b, kind in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    out, at = [], 0
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def digests(found) -> list:
    """Columns n_<base kind>, base_sha256 and spans of an array of found spans."""
    names, all_kinds = [r.kind for r in BASE], [r.kind for r in RULES]

    def listed(wanted: list[str]):
        ranked = F.transform(F.filter(found, lambda s: s.kind.isin(wanted)), lambda s: F.struct(s.start.alias("a"), F.array_position(F.array(*map(F.lit, all_kinds)), s.kind).alias("o"), s.end.alias("b"), s.kind.alias("k")))
        return F.array_join(F.transform(F.array_sort(ranked), lambda s: F.concat_ws(":", s.k, s.a, s.b)), ",")

    def count(kind: str):
        return F.size(F.filter(found, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in names]
    return [*counts, F.sha2(listed(names), 256).alias("base_sha256"), listed(all_kinds).alias("spans")]
