"""Queries through the engine and the catalog over stored blocks, and the small rules of display."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.functions import labels as L
from tellurion.functions.severity import kind_name, status_name
from tellurion.functions.text import duration_text, service_hue
from tellurion.functions.time import LADDER, SECOND, quick_range, step_of, time_text
from tellurion.operators import maintain
from tellurion.operators import query as Q
from tellurion.operators.cache import ResultCache
from tellurion.plans.common import DAY, END, LOGS, SPANS, empty_store, event_stream, log_store, publish_rows
from tellurion.plans.registry import query
from tellurion.session import scratch_dir, ship_package
from tellurion.sources import blocks, container_logs, signals
from tellurion.sources.catalog import Catalog
from tellurion.streaming import ingest

EPOCH = 1704067200 * SECOND


def _metric_store(spark: SparkSession, sf_dir: str):
    """Metric blocks of the events: one for clicks, one for the rest, the counter type known to the first only."""
    catalog, root = empty_store(spark)
    rows = signals.event_series(spark, sf_dir)
    clicks = F.col("labels")["event_type"] == "click"
    for i, (part, kind) in enumerate(((rows.filter(clicks), 1), (rows.filter(~clicks), None))):
        publish_rows(catalog, root, "metrics", part, signals.dimension(part, "series_fingerprint", kind), i)
    return catalog, root


MATCHES = {"all": ((), "true"), "one": (("event_type=click",), "event_type = 'click'"), "both": (("event_type=click", "shard=3"), "event_type = 'click' AND shard = '3'"), "none": (("nope=x",), "false"), "absent": (("nope=",), "false"), "half": (("event_type=click", "nope=x"), "false")}


@query(f"WITH {LOGS} " + " UNION ALL ".join(f"SELECT '{k}' AS matchers, count(*) AS n, coalesce(CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT), 0) AS total FROM logs WHERE {sql}" for k, (_, sql) in MATCHES.items()))
def engine_matchers_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No matcher, one, two, one without a posting, an empty value, and a pair of which one has no posting."""
    engine = Q.Engine(spark, _metric_store(spark, sf_dir)[0])
    out = None
    for name, (matchers, _) in MATCHES.items():
        rows = engine.frame(Q.QuerySpec("metrics", matchers))
        one = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.round(F.col("value") * 100).cast("long")), F.lit(0)).cast("long").alias("total")).select(F.lit(name).alias("matchers"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {LOGS} SELECT 'block' AS kind, 'e' AS block, count(DISTINCT event_type || shard) AS series FROM logs WHERE event_type = 'click' UNION ALL SELECT 'block', 'r', count(DISTINCT event_type || shard) FROM logs WHERE event_type <> 'click'")
def all_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of each block by its sidecar, those without labels included."""
    catalog, _ = _metric_store(spark, sf_dir)
    side = blocks.all_fingerprints(spark, [r.path for r in catalog.live("metrics").collect()])
    first = catalog.live().filter("segment = 0").select("block")
    named = side.join(F.broadcast(first.withColumn("name", F.lit("e"))), "block", "left")
    return named.select(F.lit("block").alias("kind"), F.coalesce("name", F.lit("r")).alias("block"), F.size("fingerprints").cast("long").alias("series"))


@query(f"WITH {LOGS} SELECT CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS metric_type, count(DISTINCT event_type || shard) AS series FROM logs GROUP BY 1")
def series_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a merge a series has the first type that any block knew."""
    catalog, root = _metric_store(spark, sf_dir)
    maintain.compact(catalog, root, fanout=1)
    side = blocks.read_sidecar(spark, "series", [r.path for r in catalog.live().collect()], "block string, fingerprint bigint, labels map<string,string>, metric_type smallint")
    return side.groupBy(F.coalesce(F.col("metric_type").cast("int"), F.lit(0)).alias("metric_type")).agg(F.count_distinct("fingerprint").alias("series"))


@query(f"WITH {LOGS} SELECT label_name, label_value FROM (SELECT DISTINCT 'event_type' AS label_name, event_type AS label_value FROM logs UNION SELECT DISTINCT 'shard', shard FROM logs)")
def label_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label pairs of warmed blocks, without a look at their postings; the second warming finds nothing cold."""
    ship_package(spark)
    catalog, root = log_store(spark, sf_dir)
    engine = Q.Engine(spark, catalog)
    if engine.warm_labels("logs") != 3 or engine.warm_labels("logs") != 0:
        raise ValueError("blocks stay cold")
    gone = catalog.live().limit(1).select("block")
    kept = catalog.label_pairs(catalog.live("logs").select("block"))
    if catalog.label_pairs(gone).isEmpty():
        raise ValueError("a block without cached labels")
    return kept.select("label_name", "label_value").distinct()


@query(f"WITH {LOGS}, b AS (SELECT ts_unix_nano // 1000 % 3 AS part, max(ts_unix_nano) AS top FROM logs GROUP BY 1) SELECT 0 AS dry, count(*) FILTER (top < {END}) AS would, 3 - count(*) FILTER (top < {END}) AS left_over FROM b")
def retain_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run names the blocks and deletes none; the real one deletes those."""
    ship_package(spark)
    catalog, _ = log_store(spark, sf_dir)
    named = maintain.retain(catalog, END + DAY, DAY)
    dry = 3 - catalog.live().count()
    gone = maintain.retain(catalog, END + DAY, DAY, dry_run=False)
    if sorted(named) != sorted(gone):
        raise ValueError("the dry run named other blocks")
    return catalog.live().agg(F.lit(dry).alias("dry"), F.lit(len(gone)).cast("long").alias("would"), F.count("*").alias("left_over"))


@query(f"WITH {LOGS} SELECT 'logs' AS signal, CAST(3 AS BIGINT) AS blocks, count(*) AS rows, min(ts_unix_nano) AS ts_min, max(ts_unix_nano) AS ts_max FROM logs")
def catalog_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    catalog, _ = log_store(spark, sf_dir)
    return catalog.totals().select("signal", "blocks", "rows", "ts_min", "ts_max")


@query(f"WITH {LOGS} SELECT CAST(3 AS BIGINT) AS first, CAST(1 AS BIGINT) AS second, CAST(0 AS BIGINT) AS third, 2 * count(*) AS rows FROM logs")
def catalog_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog that polls a bucket: all blocks, then the one that came since, then none."""
    ship_package(spark)
    own, root = log_store(spark, sf_dir)
    other = Catalog(spark, f"{root}-polled")
    first = other.poll(root)
    rows = signals.logs(spark, sf_dir)
    publish_rows(own, root, "logs", rows, signals.dimension(rows, "stream_fingerprint"), 9)
    second, third = other.poll(root), other.poll(root)
    return other.live("logs").agg(F.sum("row_count").alias("rows")).select(*(F.lit(n).cast("long").alias(c) for c, n in (("first", first), ("second", second), ("third", third))), "rows")


@query("SELECT CAST(0 AS BIGINT) AS unsorted, count(*) AS rows FROM events")
def block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a stored block that come before a lesser one in file order."""
    ship_package(spark)
    catalog, _ = log_store(spark, sf_dir, 1)
    rows = blocks.read_blocks(spark, "logs", [r.path for r in catalog.live().collect()])
    keys = rows.select(F.struct("stream_fingerprint", "ts_unix_nano").alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"))
    before = keys.select("file", (F.col("i") + 1).alias("i"), F.col("key").alias("before"))
    return keys.join(before, ["file", "i"], "left").agg(F.count_if(F.col("before") > F.col("key")).alias("unsorted"), F.count("*").alias("rows"))


@query(f"WITH {LOGS} SELECT least(count(*), 1000) AS capped, count(*) AS counted FROM logs")
def default_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row cap holds without SQL only."""
    ship_package(spark)
    engine = Q.Engine(spark, log_store(spark, sf_dir, 2)[0], ResultCache())
    capped = engine.fetch(Q.QuerySpec("logs")).num_rows
    return engine.run(Q.QuerySpec("logs", limit=7, sql="SELECT count(*) AS counted FROM logs")).select(F.lit(capped).cast("long").alias("capped"), "counted")


@query(f"WITH {LOGS} SELECT event_type, count(*) AS n, CAST(1 AS BIGINT) AS hits, CAST(2 AS BIGINT) AS misses FROM logs WHERE shard = '1' GROUP BY 1")
def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated request comes from the cache until a block is added."""
    ship_package(spark)
    catalog, root = log_store(spark, sf_dir, 1)
    engine = Q.Engine(spark, catalog, ResultCache())
    spec = Q.QuerySpec("logs", ("shard=1",), sql="SELECT labels['event_type'] AS event_type, count(*) AS n FROM logs GROUP BY 1")
    one, two = engine.fetch(spec), engine.fetch(spec)
    rows = signals.logs(spark, sf_dir).filter("labels['shard'] = '2'")
    publish_rows(catalog, root, "logs", rows, signals.dimension(rows, "stream_fingerprint"), 7)
    if not one.equals(two) or engine.fetch(spec).num_rows != one.num_rows:
        raise ValueError("the cache changed a result")
    return spark.createDataFrame(one).select("event_type", "n", F.lit(engine.cache.hits).cast("long").alias("hits"), F.lit(engine.cache.misses).cast("long").alias("misses"))


@query(f"WITH {LOGS} SELECT CAST(severity AS SMALLINT) AS severity, body FROM logs WHERE shard = '2' AND ts_unix_nano > {EPOCH} + 15 * {DAY} AND contains(body, '7')")
def live_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live table's rows of a request: an absent label passes as empty, the ring keeps what is young enough."""
    root = f"{scratch_dir(spark)}/tellurion-{uuid.uuid4().hex}/live"
    rows = signals.logs(spark, sf_dir)
    table = ingest.LiveTable(spark, root, rows.schema, max_age_s=60, max_bytes=1 << 40)
    half = F.col("ts_unix_nano") % 2_000_000 < 1_000_000
    table.add(rows, 0, now=0)
    table.add(rows.filter(half), 1, now=100)
    table.add(rows.filter(~half), 2, now=110)
    return ingest.snapshot(table.read(), ["shard=2", "nope="], EPOCH + 15 * DAY + 1, 0, "7").select("severity", "body")


@query(f"WITH {LOGS} SELECT shard, count(*) AS n FROM logs GROUP BY 1")
def stream_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream dealt to shards by session, each with a block builder of its own; one close by rows, the rest by age."""
    ship_package(spark)
    catalog, root = empty_store(spark)
    builders = [ingest.BlockBuilder(catalog, root, "logs", "w", s, max_rows=100) for s in range(ingest.SHARDS)]
    ingest.run_once(event_stream(spark, sf_dir).withColumn("session", F.col("labels")["shard"].cast("long")), ingest.sharded(builders, "session"), f"{root}/checkpoint")
    for b in builders:
        b.flush_if_aged(0)
    return Q.Engine(spark, catalog).frame(Q.QuerySpec("logs")).groupBy(F.col("labels")["shard"].alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS pod, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def pod_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pods by the paths of their log files; a path of another form is none."""
    e = signals.read(spark, sf_dir, "events")
    path = F.concat(F.lit("/var/log/pods/ns_"), F.when(F.col("event_id") % 5 != 0, F.concat("user_id", F.lit("_u-1"))).otherwise("user_id"), F.lit("/main/0.log"))
    pod = e.select(container_logs.pod_of(path).alias("pod")).filter("pod.namespace = 'ns' and pod.uid = 'u-1' and pod.container = 'main'")
    return pod.groupBy(F.col("pod.pod").cast("long").alias("pod")).agg(F.count("*").alias("n"))


_LADDER = ", ".join(map(str, LADDER))


@query(f"SELECT event_id, coalesce(list_min(list_filter([{_LADDER}], lambda s: span / s <= 120)), {LADDER[-1]}) AS step FROM (SELECT event_id, (event_id % 7) * event_id * 1009 AS span FROM events) WHERE span > 0 UNION ALL SELECT event_id, 1 FROM events WHERE (event_id % 7) * event_id = 0")
def step_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in nanoseconds as decimals: from 293 years on a long does not hold them."""
    seconds = (F.col("event_id") % 7) * F.col("event_id") * 1009
    span = seconds.cast("decimal(19,0)") * F.lit(SECOND).cast("decimal(10,0)")
    return signals.read(spark, sf_dir, "events").select("event_id", (step_of(span) / SECOND).cast("int").alias("step"))


@query(f"WITH w AS (SELECT max(epoch_us(ts)) * 1000 // {600 * SECOND} * {600 * SECOND} AS b FROM events) SELECT b - {DAY} // 2 AS a, b, count(*) AS n FROM w JOIN events ON epoch_us(ts) * 1000 BETWEEN b - {DAY} // 2 AND b GROUP BY b")
def quick_range_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the last half day, its end snapped to the step of that span, 10 minutes."""
    rows = signals.logs(spark, sf_dir)
    a, b = quick_range(rows.agg(F.max("ts_unix_nano")).first()[0], DAY // 2)
    return Q.in_window(rows, "logs", a, b).agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count("*").alias("n"))


@query(f"WITH {SPANS} SELECT CASE name WHEN 'order' THEN 'SERVER' ELSE 'CLIENT' END AS kind, CASE status_code WHEN 2 THEN 'ERROR' ELSE 'OK' END AS status, count(*) AS n FROM spans GROUP BY ALL UNION ALL SELECT 'KIND_9', '', count(*) FROM region")
def kind_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = signals.spans(spark, sf_dir).select("kind", "status_code")
    odd = signals.read(spark, sf_dir, "region").select(F.lit(9).cast("short").alias("kind"), F.lit(0).cast("short").alias("status_code"))
    return known.unionByName(odd).groupBy(kind_name(F.col("kind")).alias("kind"), status_name(F.col("status_code")).alias("status")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT l_linenumber, 'supplier é' || l_suppkey AS name FROM lineitem), u AS (SELECT name, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM h)
SELECT CAST(((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 360 + 360) % 360 AS INT) AS hue, count(*) AS n FROM u GROUP BY 1""")
def service_hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("supplier é"), "l_suppkey")
    return signals.read(spark, sf_dir, "lineitem").groupBy(service_hue(name).alias("hue")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 1000 - 20 WHEN 1 THEN (event_id * 10 + 1) % 1000000 WHEN 2 THEN (event_id * 999910 + 1) % 1000000000 ELSE event_id * 333333330 + 1 END AS ns FROM events)
SELECT event_id, CASE WHEN ns < 1000 THEN greatest(ns, 0) || 'ns' WHEN ns < 1000000 THEN printf('%.1fµs', ns / 1e3) WHEN ns < 1000000000 THEN printf('%.2fms', ns / 1e6) ELSE printf('%.2fs', ns / 1e9) END AS text FROM d""")
def duration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    ns = F.when(i % 4 == 0, i % 1000 - 20).when(i % 4 == 1, (i * 10 + 1) % 1_000_000).when(i % 4 == 2, (i * 999_910 + 1) % 1_000_000_000).otherwise(i * 333_333_330 + 1)
    return signals.read(spark, sf_dir, "events").select("event_id", duration_text(ns).alias("text"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S.%g') AS short, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS whole FROM events")
def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = time_text(F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    return signals.read(spark, sf_dir, "events").select("event_id", text["short"].alias("short"), text["full"].alias("whole"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'pod=' || event_type ELSE 'a=' || event_type || ',b=1,c=2,d=' || (user_id % 8) END AS shown FROM events")
def primary_label_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A well-known label where there is one, else the first four by key."""
    known = signals.pairs(pod=F.col("event_type"), z=F.lit("9"))
    other = signals.pairs(e=F.lit("3"), d=signals.shard(), c=F.lit("2"), b=F.lit("1"), a=F.col("event_type"))
    picked = F.map_entries(L.primary_labels(F.when(F.col("event_id") % 2 == 0, known).otherwise(other)))
    shown = F.array_join(F.transform(F.array_sort(picked), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return signals.read(spark, sf_dir, "events").select("event_id", shown.alias("shown"))


@query(f"WITH {LOGS} SELECT CAST(ts_unix_nano // {300 * SECOND} * {300 * SECOND} AS BIGINT) AS bucket, count(*) AS n FROM logs GROUP BY 1")
def interval_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of an INTERVAL in seconds, as the volume statement has them."""
    signals.read(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql("SELECT unix_micros(CAST(w.start AS TIMESTAMP)) * 1000 AS bucket, n FROM (SELECT window(CAST(ts AS TIMESTAMP), '300 seconds') AS w, count(*) AS n FROM events WHERE ts >= TIMESTAMP '1970-01-01' + INTERVAL '300 seconds' GROUP BY 1)")
