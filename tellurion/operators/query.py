"""Queries over one signal: candidate blocks, then labels, then substring filters, then SQL.

Everything before the scan happens on sidecars: the catalog prunes by time, postings by
label, blooms by substring. What is left is one Parquet scan that Catalyst optimises.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion import schemas
from tellurion.functions.labels import EMPTY, MatcherError, equality
from tellurion.operators.cache import ResultCache, SidecarCache, request_key
from tellurion.sources import blocks, bloom, postings
from tellurion.sources.catalog import Catalog, candidates

PROMOTED = {"service.name": "service_name", "service.namespace": "service_namespace", "deployment.environment": "deployment_environment", "deployment.environment.name": "deployment_environment"}
DEFAULT_LIMIT = 1000
#: Up to so many resolved series are broadcast to the scan (16 bytes each); beyond that they are joined by shuffle.
BROADCAST_SERIES = 1_000_000
#: Up to so many label sets are broadcast for the labels column.
BROADCAST_LABELS = 100_000


class QueryError(Exception):
    """code: 1 bad request, 2 parse, 3 plan, 4 resources, 5 live data refused, 6 internal."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class QuerySpec:
    signal: str | None = None
    matchers: tuple[str, ...] = ()
    start: int | None = None
    end: int | None = None
    sql: str | None = None
    limit: int | None = DEFAULT_LIMIT
    trace_id: str | None = None
    body_contains: str | None = None
    live: bool = False
    #: False leaves the labels column of logs out, and with it the join that makes it.
    labels: bool = True


@dataclass
class Stats:
    """What pruning did."""

    candidates: int = 0
    after_bloom: int = 0
    after_postings: int = 0
    #: Bytes of the blocks that were left to read, and rows of the result once it is fetched.
    block_bytes: int = 0
    rows: int | None = None
    #: Whether the result came from the cache.
    cached: bool = False
    #: What the scans did, by name: files, bytes and rows read.
    scan: dict[str, int] = field(default_factory=dict)


def out_of_memory(error: PySparkException) -> bool:
    return error.getCondition() == "UNABLE_TO_ACQUIRE_MEMORY" or "OutOfMemoryError" in str(error)


def parse_trace_id(text: str) -> bytes:
    digits = text[2:] if text[:2] in ("0x", "0X") else text
    if not re.fullmatch(r"[0-9a-fA-F]{32}", digits):
        raise QueryError(1, "a trace id has 32 hex digits")
    return bytes.fromhex(digits)


def infer_signal(spec: QuerySpec) -> str:
    asked = {s for s, on in (("traces", spec.trace_id is not None), ("logs", spec.body_contains is not None)) if on}
    if len(asked) > 1:
        raise QueryError(1, "a trace id and a substring exclude each other")
    implied = next(iter(asked), None)
    if spec.signal is None:
        return implied or "metrics"
    if spec.signal not in schemas.SIGNALS:
        raise QueryError(1, f"unknown signal {spec.signal}")
    if implied and implied != spec.signal:
        raise QueryError(1, f"{spec.signal} cannot be searched that way")
    return spec.signal


def in_window(rows: DataFrame, signal: str, start: int | None, end: int | None) -> DataFrame:
    """Inclusive at both ends; spans count by their start."""
    time = F.col(schemas.TIME[signal])
    if start is not None:
        rows = rows.filter(time >= start)
    return rows.filter(time <= end) if end is not None else rows


def match_traces(rows: DataFrame, matchers: tuple[str, ...] | list[str]) -> DataFrame:
    for m in equality(list(matchers)):
        if m.name not in PROMOTED:
            raise QueryError(1, f"traces match on {', '.join(PROMOTED)} only, not {m.name}")
        rows = rows.filter(F.col(PROMOTED[m.name]) == m.value)
    return rows


def with_series(rows: DataFrame, key: str, wanted: DataFrame, series: int | None = None) -> DataFrame:
    """Rows of the wanted fingerprints, with their bounds as a filter that reaches the scan's statistics."""
    n, low, high = wanted.agg(F.count("*"), F.min("fingerprint"), F.max("fingerprint")).first()
    if not n:
        return rows.limit(0)
    kept = rows.filter(F.col(key).between(low, high))
    side = wanted.select(F.col("fingerprint").alias(key))
    return kept.join(F.broadcast(side) if n <= BROADCAST_SERIES else side, key, "left_semi")


def enrich(logs: DataFrame, dimension: DataFrame, count: int | None = None) -> DataFrame:
    """Logs with their labels last; unknown streams get an empty map."""
    side = dimension.select(F.col("fingerprint").alias("stream_fingerprint"), "labels")
    side = F.broadcast(side) if count is not None and count <= BROADCAST_LABELS else side
    joined = logs.join(side, "stream_fingerprint", "left")
    return joined.select(*logs.columns, F.coalesce("labels", F.expr(EMPTY)).alias("labels"))


def one_bucket(found: list) -> None:
    buckets = {r.bucket for r in found}
    if len(buckets) > 1:
        raise QueryError(1, f"blocks of several buckets in one query: {', '.join(sorted(buckets))}")


#: Nodes of a parsed plan that are no query, besides all commands.
WRITES = ("InsertInto", "ParsedStatement", "OverwriteBy", "OverwritePartitions", "AppendData", "CompoundBody", "SingleStatement")


def check_sql(sql: str, spark: SparkSession | None = None) -> str:
    """Queries only: no definitions, changes or session commands. The parsed plan decides, wherever in it they stand."""
    spark = spark or SparkSession.active()
    bare = sql.strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(bare)
    except ParseException as e:
        raise QueryError(2, str(e)) from e
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    todo = [plan]
    if plan.getClass().getSimpleName() == "ExplainCommand":
        todo = [plan.logicalPlan()]
    while todo:
        node = todo.pop()
        if command.isInstance(node) or any(w in node.getClass().getSimpleName() for w in WRITES):
            raise QueryError(3, "only queries are accepted")
        inner = node.children()
        todo += [inner.apply(i) for i in range(inner.size())]
    return bare


def scan_metrics(rows: DataFrame) -> dict[str, int]:
    """Files, bytes and rows that the file scans of a frame read, summed, once its result was computed."""
    out: dict[str, int] = {}
    todo = [rows._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            for key in ("numFiles", "filesSize", "numOutputRows"):
                if node.metrics().contains(key):
                    out[key] = out.get(key, 0) + node.metrics().apply(key).value()
        inner = node.children()
        todo += [inner.apply(i) for i in range(inner.size())]
    return out


class Engine:
    """Queries over the blocks of one catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog, cache: ResultCache | None = None, live: Callable[[QuerySpec], DataFrame] | None = None, sidecars: SidecarCache | None = None):
        self.spark, self.catalog, self.cache, self.live, self.sidecars = spark, catalog, cache, live, sidecars
        self.stats = Stats()

    def _sidecar(self, kind: str, found: list, schema) -> DataFrame:
        paths = [b.path for b in found]
        read = lambda: blocks.read_sidecar(self.spark, kind, paths, schema)
        if self.sidecars is None or not found:
            return read()
        return self.sidecars.get((kind, frozenset(b.block for b in found)), read, lambda: sum(blocks.folder_size(self.spark, f"{p}.{kind}") for p in paths))

    def candidates(self, spec: QuerySpec) -> list:
        """Catalog rows of the blocks to read, pruned by time, substring and labels in this order."""
        signal = infer_signal(spec)
        found = candidates(self.catalog.live(signal), spec.start, spec.end).collect()
        one_bucket(found)
        self.stats = Stats(candidates=len(found))
        if signal == "logs" and spec.body_contains and found:
            sidecar = self._sidecar("bloom", found, "block string, bloom binary")
            out = {r.block for r in sidecar.filter(~bloom.may_hold(F.col("bloom"), spec.body_contains)).select("block").collect()}
            found = [b for b in found if b.block not in out]
        self.stats.after_bloom = len(found)
        return found

    def _series(self, signal: str, found: list, spec: QuerySpec) -> tuple[list, DataFrame | None]:
        matchers = equality(list(spec.matchers))
        if not matchers or not found:
            return found, None
        index = self._sidecar("postings", found, schemas.POSTINGS)
        wanted = postings.resolve(index, matchers, "block")
        keep = {r.block for r in wanted.select("block").distinct().collect()}
        found = [b for b in found if b.block in keep]
        return found, wanted.select("fingerprint").distinct()

    def frame(self, spec: QuerySpec) -> DataFrame:
        """The signal's rows for a spec, without SQL or limit."""
        signal = infer_signal(spec)
        try:
            found = self.candidates(spec)
            if signal in ("metrics", "logs"):
                found, wanted = self._series(signal, found, spec)
                self.stats.after_postings = len(found)
                self.stats.block_bytes = sum(b.size_bytes for b in found)
                rows = in_window(blocks.read_blocks(self.spark, signal, [b.path for b in found]), signal, spec.start, spec.end)
                if wanted is not None and found:
                    rows = with_series(rows, schemas.KEY[signal], wanted)
                if signal == "logs":
                    if spec.body_contains:
                        rows = rows.filter(F.col("body").contains(spec.body_contains))
                    if spec.labels:
                        side = blocks.read_sidecar(self.spark, "series", [b.path for b in found], "block string, fingerprint bigint, labels map<string,string>, metric_type smallint")
                        rows = enrich(rows, side.groupBy("fingerprint").agg(F.any_value("labels").alias("labels")))
                return rows
            self.stats.after_postings, self.stats.block_bytes = len(found), sum(b.size_bytes for b in found)
            rows = in_window(blocks.read_blocks(self.spark, signal, [b.path for b in found]), signal, spec.start, spec.end)
            if signal == "profiles":
                if spec.matchers:
                    raise QueryError(1, "profiles take no matchers")
                return rows
            rows = match_traces(rows, spec.matchers)
            if spec.trace_id is not None:
                rows = rows.filter(F.col("trace_id") == F.lit(parse_trace_id(spec.trace_id)))
            return rows
        except MatcherError as e:
            raise QueryError(1, str(e)) from e

    def run(self, spec: QuerySpec) -> DataFrame:
        """The result of a spec: its SQL over a view named like the signal, or its first rows."""
        signal = infer_signal(spec)
        rows = self.frame(spec)
        if spec.live:
            if self.live is None:
                raise QueryError(5, "live data is not available here")
            rows = rows.unionByName(self.live(spec), allowMissingColumns=True)
        if spec.sql is None:
            return rows.limit(spec.limit) if spec.limit is not None else rows
        rows.createOrReplaceTempView(signal)
        try:
            return self.spark.sql(check_sql(spec.sql, self.spark))
        except ParseException as e:
            raise QueryError(2, str(e)) from e
        except AnalysisException as e:
            raise QueryError(3, str(e)) from e

    def fetch(self, spec: QuerySpec):
        """The result as an Arrow table, from the cache where it has one. A block that vanished is forgotten and the query planned once more."""
        for attempt in (1, 2):
            key = None
            if self.cache is not None and not spec.live:
                key = request_key(spec, [b.block for b in self.candidates(spec)])
                if (hit := self.cache.get(key)) is not None:
                    self.stats.rows, self.stats.cached = hit.num_rows, True
                    return hit
            try:
                rows = self.run(spec)
                table = rows.toArrow()
                self.stats.rows, self.stats.scan = table.num_rows, scan_metrics(rows)
            except QueryError:
                raise
            except PySparkException as e:
                if attempt == 1 and self.evict_missing(spec):
                    continue
                raise QueryError(3 if isinstance(e, AnalysisException) else 4 if out_of_memory(e) else 6, str(e)[:2000]) from e
            if key is not None:
                self.cache.put(key, table)
            return table
        raise QueryError(6, "blocks keep vanishing")

    def batches(self, spec: QuerySpec, rows: int = 65_536) -> Iterator:
        """The result as Arrow batches, one partition of it at the driver at a time."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        frame = self.run(spec)
        schema = to_arrow_schema(frame.schema)
        held: list[dict] = []
        for r in frame.toLocalIterator():
            held.append(r.asDict(recursive=True))
            if len(held) == rows:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    def explain(self, spec: QuerySpec, mode: str = "formatted") -> str:
        """The plan of a request as text; nothing is run but the pruning."""
        return self.spark._jvm.PythonSQLUtils.explainString(self.run(spec)._jdf.queryExecution(), mode)

    def evict_missing(self, spec: QuerySpec) -> int:
        """Mark candidate blocks deleted whose files are gone; how many."""
        signal = infer_signal(spec)
        gone = [b for b in self.candidates(spec) if not self.catalog._exists(f"{b.path}.{signal}")]
        if gone:
            self.catalog.mark_deleted(self.spark.createDataFrame([(b.block,) for b in gone], "block string"))
        return len(gone)

    def label_names(self, signal: str, start: int | None = None, end: int | None = None) -> DataFrame:
        if signal == "traces":
            return self.spark.createDataFrame([(n,) for n in sorted(PROMOTED)[:3]], "label_name string")
        if signal == "profiles":
            return self.spark.createDataFrame([], "label_name string")
        return self._cached_pairs(signal, start, end).select("label_name").distinct().orderBy("label_name")

    def label_values(self, signal: str, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
        if signal == "traces":
            found = candidates(self.catalog.live(signal), start, end).collect()
            return promoted_values(blocks.read_blocks(self.spark, signal, [b.path for b in found]), name)
        if signal == "profiles":
            return self.spark.createDataFrame([], "label_value string")
        return self._cached_pairs(signal, start, end).filter(F.col("label_name") == name).select("label_value").distinct().orderBy("label_value")

    def warm_labels(self, signal: str, start: int | None = None, end: int | None = None) -> int:
        """Read the postings of blocks whose labels are not in the catalog's cache, and keep them there; how many blocks those were."""
        found = candidates(self.catalog.live(signal), start, end)
        cold = found.join(self.catalog.warmed(), "block", "left_anti").collect()
        if cold:
            pairs = blocks.read_sidecar(self.spark, "postings", [b.path for b in cold], schemas.POSTINGS)
            self.catalog.cache_labels(self.spark.createDataFrame([(b.block,) for b in cold], "block string"), pairs)
        return len(cold)

    def _cached_pairs(self, signal: str, start: int | None, end: int | None) -> DataFrame:
        self.warm_labels(signal, start, end)
        return self.catalog.label_pairs(candidates(self.catalog.live(signal), start, end).select("block"))


def promoted_values(spans: DataFrame, name: str) -> DataFrame:
    """Distinct non-empty values of a promoted trace label, in order."""
    if name not in PROMOTED:
        return spans.select(F.lit("").alias("label_value")).limit(0)
    value = F.col(PROMOTED[name])
    return spans.select(value.alias("label_value")).filter("label_value is not null and label_value <> ''").distinct().orderBy("label_value")


# One-shot requests for each signal.


def metrics_query(spark: SparkSession, catalog: Catalog, matchers: tuple[str, ...] = (), start: int | None = None, end: int | None = None) -> DataFrame:
    return Engine(spark, catalog).frame(QuerySpec("metrics", tuple(matchers), start, end))


def logs_query(spark: SparkSession, catalog: Catalog, matchers: tuple[str, ...] = (), start: int | None = None, end: int | None = None, contains: str | None = None) -> DataFrame:
    return Engine(spark, catalog).frame(QuerySpec("logs", tuple(matchers), start, end, body_contains=contains))


def traces_query(spark: SparkSession, catalog: Catalog, matchers: tuple[str, ...] = (), start: int | None = None, end: int | None = None, trace_id: str | None = None) -> DataFrame:
    return Engine(spark, catalog).frame(QuerySpec("traces", tuple(matchers), start, end, trace_id=trace_id))


def profiles_query(spark: SparkSession, catalog: Catalog, start: int | None = None, end: int | None = None) -> DataFrame:
    return Engine(spark, catalog).frame(QuerySpec("profiles", (), start, end))
