"""Queries over the signals made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion import schemas
from tellurion.functions import labels as L
from tellurion.functions.severity import severity_class
from tellurion.functions.text import lower_hex, strip_ansi
from tellurion.functions.time import SECOND, bucket, floor_div, utc_date
from tellurion.operators import analytics, maintain
from tellurion.operators import query as Q
from tellurion.plans.common import CLASS, DAY, END, LOGS, SPANS, START, STEP, empty_store, event_stream, log_store, publish_rows
from tellurion.plans.registry import query
from tellurion.session import saved, scratch_dir, ship_package
from tellurion.sources import blocks, bloom, postings, signals
from tellurion.sources.catalog import Catalog, candidates, created_blocks, live_blocks
from tellurion.streaming import ingest


@query(f"WITH {LOGS} SELECT ts_unix_nano // {STEP} * {STEP} AS bucket, CAST(severity AS SMALLINT) AS severity, count(*) AS n FROM logs GROUP BY ALL")
def log_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.log_volume(signals.logs(spark, sf_dir), STEP)


@query("SELECT epoch_us(ts) * 1000 AS ts_unix_nano, value FROM events WHERE event_type = 'click' AND user_id % 8 = 3")
def metrics_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.event_series(spark, sf_dir)
    index = postings.build_postings(signals.dimension(rows, "series_fingerprint"))
    wanted = postings.resolve(index, L.equality(["event_type=click", 'shard="3"']))
    return Q.with_series(rows, "series_fingerprint", wanted).select("ts_unix_nano", "value")


@query(f"WITH {LOGS} SELECT ts_unix_nano, CAST(severity AS SMALLINT) AS severity, body FROM logs WHERE event_type = 'error' AND ts_unix_nano BETWEEN {START} AND {END}")
def logs_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.logs(spark, sf_dir)
    index = postings.build_postings(signals.dimension(rows, "stream_fingerprint"))
    wanted = postings.resolve(index, L.equality(["event_type=error"]))
    return Q.in_window(Q.with_series(rows, "stream_fingerprint", wanted), "logs", START, END).select("ts_unix_nano", "severity", "body")


@query("SELECT doc_id, lang FROM documents WHERE contains(text, 'token')")
def logs_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.text_logs(spark, sf_dir).filter(F.col("body").contains("token")).select("doc_id", F.col("labels")["lang"].alias("lang"))


@query(f"WITH {LOGS} SELECT event_type, shard, count(*) AS n FROM logs WHERE regexp_full_match(event_type, 'error|purch.*') AND shard <> '3' GROUP BY ALL")
def logs_filter_dsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.logs(spark, sf_dir)
    kept = rows.filter(L.matches(F.col("labels"), ['event_type=~"error|purch.*"', "shard!=3", "absent=", 'other!~".+"']))
    return kept.groupBy(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["shard"].alias("shard")).agg(F.count("*").alias("n"))


@query(f"WITH {SPANS} SELECT span_id, name, start_ns FROM spans WHERE trace_id = '00000000000000000000000000000005'")
def trace_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = Q.parse_trace_id("0x00000000000000000000000000000005")
    rows = signals.spans(spark, sf_dir).filter(F.col("trace_id") == F.lit(wanted))
    return rows.select(lower_hex(F.col("span_id")).alias("span_id"), "name", F.col("start_unix_nano").alias("start_ns"))


@query(f"WITH {SPANS} SELECT status_code, count(*) AS n, CAST(sum(end_ns - start_ns) AS BIGINT) AS busy_ns FROM spans WHERE service_name = 'supplier-3' AND deployment_environment = 'F' GROUP BY status_code")
def traces_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.match_traces(signals.spans(spark, sf_dir), ["service.name=supplier-3", "deployment.environment=F"])
    return rows.groupBy(F.col("status_code").cast("int").alias("status_code")).agg(F.count("*").alias("n"), F.sum(F.col("end_unix_nano") - F.col("start_unix_nano")).alias("busy_ns"))


@query("SELECT page_id * 1000000000 AS ts_unix_nano, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, octet_length(encode(html)) AS bytes FROM pages WHERE page_id BETWEEN 10 AND 60")
def profiles_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.in_window(signals.profiles(spark, sf_dir), "profiles", 10 * SECOND, 60 * SECOND)
    return rows.select("ts_unix_nano", F.col("labels")["host"].alias("host"), F.octet_length("data").cast("long").alias("bytes"))


@query("SELECT count(*) AS n FROM events WHERE 1 = 0")
def empty_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.read_blocks(spark, "metrics", []).agg(F.count("*").alias("n"))


@query(f"WITH {LOGS} SELECT event_type AS v, count(*) AS c FROM logs GROUP BY 1 ORDER BY c DESC, v")
def label_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.label_value_counts(signals.logs(spark, sf_dir), "event_type")


@query(f"WITH {LOGS}, c AS (SELECT event_type AS v, count(*) AS c FROM logs WHERE shard = '1' GROUP BY 1) SELECT DISTINCT l.event_type AS label_value, c.c FROM logs l LEFT JOIN c ON c.v = l.event_type")
def label_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.logs(spark, sf_dir)
    index = postings.build_postings(signals.dimension(rows, "stream_fingerprint"))
    return analytics.listed_values(postings.label_values(index, "event_type"), analytics.label_value_counts(rows.filter(F.col("labels")["shard"] == "1"), "event_type"))


SUMMARY = f"WITH {SPANS}, t AS (SELECT trace_id, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS spans, max(end_ns) - min(start_ns) AS dur_ns FROM spans GROUP BY trace_id)"


@query(f"{SUMMARY} SELECT * FROM t ORDER BY dur_ns DESC, trace_id LIMIT 5000")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trace_summary(signals.spans(spark, sf_dir))


@query(f"{SUMMARY} SELECT count(*) AS n, min(dur_ns) AS least, quantile_disc(dur_ns, 0.5) AS median, quantile_disc(dur_ns, 0.99) AS p99, max(dur_ns) AS most FROM t")
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.frame_stats(analytics.trace_summary(signals.spans(spark, sf_dir), None))


@query(f"""WITH {SPANS}, k AS (SELECT DISTINCT trace_id, span_id, parent_span_id, start_ns FROM spans)
SELECT trace_id, span_id, CASE WHEN parent_span_id IS NULL THEN 0 ELSE 1 END AS depth,
  CASE WHEN parent_span_id IS NULL THEN 1 ELSE 1 + row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY start_ns, span_id) END AS place
FROM k""")
def span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and pre-order place of every span; equal spans count once."""
    rows = signals.spans(spark, sf_dir).dropDuplicates(["trace_id", "span_id"])
    tree = analytics.span_tree(rows)
    return tree.select(lower_hex(F.col("trace_id")).alias("trace_id"), lower_hex(F.col("span_id")).alias("span_id"), "depth", F.col("place").cast("long").alias("place"))


@query(f"""WITH {SPANS}, w AS (SELECT *, min(start_ns) OVER (PARTITION BY trace_id) AS low, max(end_ns) OVER (PARTITION BY trace_id) AS high FROM spans)
SELECT service_name, count(*) AS n, CAST(sum(CAST(round((start_ns - low) / (high - low)::DOUBLE * 1000000) AS BIGINT)) AS BIGINT) AS lefts, CAST(sum(CAST(round((end_ns - start_ns) / (high - low)::DOUBLE * 1000000) AS BIGINT)) AS BIGINT) AS widths FROM w GROUP BY 1""")
def span_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = analytics.span_layout(signals.spans(spark, sf_dir))
    millionths = lambda c: F.sum(F.round(F.col(c) * 1_000_000).cast("long"))
    return laid.groupBy("service_name").agg(F.count("*").alias("n"), millionths("left").alias("lefts"), millionths("width").alias("widths"))


@query(f"WITH {SPANS} SELECT trace_id, service_name AS service FROM spans WHERE parent_span_id IS NULL")
def root_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.root_service(signals.spans(spark, sf_dir)).select(lower_hex(F.col("trace_id")).alias("trace_id"), "service")


@query(f"""WITH {LOGS} SELECT ts_unix_nano // {STEP} * {STEP} AS bucket, {", ".join(f"count(*) FILTER ({CLASS} = '{c}') AS {n}" for c, n in (("—", "unknown"), ("TRACE", "trace"), ("DEBUG", "debug"), ("INFO", "info"), ("WARN", "warn"), ("ERROR", "error"), ("FATAL", "fatal")))} FROM logs GROUP BY 1""")
def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.severity_volume(signals.logs(spark, sf_dir), STEP)


@query(f"""WITH {LOGS}, c AS (SELECT ts_unix_nano // {DAY} * {DAY} AS bucket, {CLASS} AS class FROM logs),
bands AS (SELECT * FROM (VALUES (0, '—'), (1, 'TRACE'), (2, 'DEBUG'), (3, 'INFO'), (4, 'WARN'), (5, 'ERROR'), (6, 'FATAL')) v(rank, class)),
f AS (SELECT b.bucket, v.rank, v.class, count(c.class) AS n FROM (SELECT DISTINCT bucket FROM c) b CROSS JOIN bands v LEFT JOIN c ON c.bucket = b.bucket AND c.class = v.class GROUP BY ALL)
SELECT bucket, rank, class, n, CAST(sum(n) OVER (PARTITION BY bucket ORDER BY rank) AS BIGINT) AS top FROM f""")
def stacked_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.stacked_volume(signals.logs(spark, sf_dir), DAY)


FRAMES = f"WITH {SPANS}, f AS (SELECT substr(trace_id, 1, 16) AS session, ('0x' || substr(trace_id, 17, 16))::BIGINT AS frame, max(end_ns) - min(start_ns) AS dur_ns, count(*) AS spans FROM spans GROUP BY ALL)"


@query(f"{FRAMES} SELECT * FROM f WHERE contains(CAST(frame AS VARCHAR), '77') ORDER BY dur_ns DESC, session, frame LIMIT 2000")
def frames_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.frames(signals.spans(spark, sf_dir)).withColumn("frame", F.col("frame").cast("long"))
    return analytics.frames_filter(rows, "77")


@query(f"{FRAMES} SELECT frame, round(dur_ns / greatest(max(dur_ns) OVER (), 1)::DOUBLE, 9) AS share FROM f")
def frame_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.frames(signals.spans(spark, sf_dir))
    return analytics.share_of_slowest(rows).select(F.col("frame").cast("long").alias("frame"), F.round("share", 9).alias("share"))


@query(f"WITH {SPANS} SELECT trace_id AS tid, count(*) AS n FROM spans GROUP BY 1 ORDER BY n DESC, tid LIMIT 1")
def densest_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.densest_trace(signals.spans(spark, sf_dir))


@query(f"WITH {SPANS} SELECT CASE WHEN min(trace_id) = max(trace_id) THEN min(trace_id) END AS trace_id FROM spans WHERE trace_id = '0000000000000000000000000000000a'")
def single_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.single_trace(signals.spans(spark, sf_dir).filter(F.col("trace_id") == F.lit(Q.parse_trace_id("0" * 31 + "a"))))


STREAMS = f"WITH {LOGS}, pairs AS (SELECT DISTINCT 'event_type' AS label_name, event_type AS label_value, stream FROM logs UNION SELECT DISTINCT 'shard', shard, stream FROM logs)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the log streams whose fingerprints are digests, so that DuckDB can follow."""
    one = signals.logs(spark, sf_dir).groupBy(L.digest(F.col("labels")).alias("fingerprint")).agg(F.any_value("labels").alias("labels"))
    return postings.build_postings(one)


@query(f"{STREAMS} SELECT label_name, label_value, count(*) AS n, md5(string_agg(stream, ',' ORDER BY stream)) AS streams FROM pairs GROUP BY ALL")
def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("label_name", "label_value", F.size("fingerprints").cast("long").alias("n"), F.md5(F.array_join("fingerprints", ",")).alias("streams"))


@query(f"{STREAMS} SELECT label_name, label_value, count(*) AS n FROM pairs GROUP BY ALL")
def postings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    merged = postings.merge_postings(index.filter("label_name = 'shard'"), index)
    return merged.select("label_name", "label_value", F.size("fingerprints").cast("long").alias("n"))


@query(f"{STREAMS} SELECT DISTINCT stream FROM logs WHERE event_type = 'view' AND shard = '5'")
def postings_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.resolve(_index(spark, sf_dir), L.equality(["event_type=view", "shard=5"])).select(F.col("fingerprint").alias("stream"))


@query(f"{STREAMS} SELECT stream, string_agg(label_name || '=' || label_value, ';' ORDER BY label_name) AS labels FROM pairs GROUP BY stream")
def postings_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postings.invert(_index(spark, sf_dir))
    return rows.select(F.col("fingerprint").alias("stream"), F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e.key, F.lit("="), e.value)), ";").alias("labels"))


@query(f"{STREAMS} SELECT DISTINCT label_name FROM pairs")
def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.label_names(_index(spark, sf_dir))


@query(f"{STREAMS} SELECT DISTINCT label_value FROM pairs WHERE label_name = 'event_type'")
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.label_values(_index(spark, sf_dir), "event_type")


@query(f"WITH {SPANS} SELECT DISTINCT service_name AS label_value FROM spans WHERE service_name IS NOT NULL AND service_name <> ''")
def trace_label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.promoted_values(signals.spans(spark, sf_dir), "service.name")


@query(f"""WITH {LOGS} SELECT '{{"event_type":"' || event_type || '","shard":"' || shard || '"}}' AS labels, count(*) AS n, max(severity)::SMALLINT AS worst FROM logs GROUP BY ALL""")
def fp_labels_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.logs(spark, sf_dir)
    joined = Q.enrich(rows.drop("labels"), signals.dimension(rows, "stream_fingerprint"))
    return joined.groupBy(L.sorted_json(F.col("labels")).alias("labels")).agg(F.count("*").alias("n"), F.max("severity").alias("worst"))


@query(f"{STREAMS} SELECT label_name, count(DISTINCT label_value) AS n_values FROM pairs GROUP BY 1 ORDER BY n_values DESC, label_name LIMIT 5")
def cardinality_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.top_names_by_values(_index(spark, sf_dir), 5)


@query(f"{STREAMS} SELECT label_value, count(*) AS n_series FROM pairs WHERE label_name = 'event_type' GROUP BY 1 ORDER BY n_series DESC, label_value LIMIT 3")
def cardinality_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.top_values_by_series(_index(spark, sf_dir), "event_type", 3)


@query("SELECT true AS near")
def cardinality_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketches' count of suppliers' series is within a tenth of the exact one."""
    keys = signals.line_series(spark, sf_dir).select("series_fingerprint")
    exact, sketch = F.count_distinct("series_fingerprint"), F.hll_sketch_estimate(F.hll_sketch_agg("series_fingerprint"))
    both = keys.agg(exact.alias("e"), sketch.alias("s"), F.approx_count_distinct("series_fingerprint", 0.02).alias("a"))
    return both.select(((F.abs(F.col("s") - F.col("e")) <= 0.1 * F.col("e")) & (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e"))).alias("near"))


@query("""WITH s AS (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem) SELECT least(count(*), 100) AS accepted, greatest(count(*) - 100, 0) AS refused FROM s""")
def cardinality_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = signals.dimension(signals.line_series(spark, sf_dir), "series_fingerprint")
    return postings.capped(one, 100).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


@query("""WITH o AS (SELECT l_suppkey AS supp, epoch_us(l_shipdate) * 1000 AS t, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY ALL),
d AS (SELECT supp, v, t, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM o WINDOW w AS (PARTITION BY supp ORDER BY t))
SELECT supp, count(*) AS n, round(sum(CASE WHEN v >= pv THEN v - pv ELSE v END / ((t - pt) / 1e9::DOUBLE)) * 1e6, 3) AS rate FROM d WHERE t > pt GROUP BY supp""")
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = signals.read(spark, sf_dir, "lineitem")
    rows = line.groupBy(F.col("l_suppkey").alias("supp"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts_unix_nano")).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    return analytics.rate(rows, "supp").groupBy("supp").agg(F.count("*").alias("n"), F.round(F.sum("rate") * 1e6, 3).alias("rate"))


@query(f"WITH {LOGS} SELECT event_id FROM logs WHERE contains(lower(body), 'user 77 ') OR lower(event_type) LIKE '%purch%' OR contains(lower(shard), 'user 77 ')")
def ui_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.logs(spark, sf_dir).filter(L.free_text("PURCH", F.col("body"), maps=(F.col("labels"), F.col("attributes"))) | L.free_text("user 77 ", F.col("body")))
    return rows.select(F.regexp_extract("body", r"^event (\d+)", 1).cast("long").alias("event_id"))


@query("SELECT event_id, 'warn ' || event_type || chr(9) || 'x' AS body FROM events")
def ansi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    painted = F.concat(F.lit("\x1b[31mwarn\x1b[0m "), F.col("event_type"), F.lit("\t\x07x\x1b[1;32m"))
    return signals.read(spark, sf_dir, "events").select("event_id", strip_ansi(painted).alias("body"))


# Blocks, catalog and maintenance, on a catalog of one block for each day of events.

CATALOG = f"""
days AS (SELECT strftime(ts, '%Y-%m-%d') AS date, min(epoch_us(ts) * 1000) AS ts_min, max(epoch_us(ts) * 1000) AS ts_max, count(*) AS row_count, day(min(ts)) AS d FROM events GROUP BY 1),
live AS (SELECT 'b' || date AS block, date, CAST(d % 4 AS INT) AS level, ts_min, ts_max, row_count, row_count * 100 AS size_bytes, d FROM days WHERE d % 5 <> 0 AND d % 7 <> 0),
span AS (SELECT {START} AS a, {END} AS b)"""


def _catalog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    days = signals.read(spark, sf_dir, "events").groupBy(utc_date(ns).alias("date")).agg(F.min(ns).alias("ts_min"), F.max(ns).alias("ts_max"), F.count("*").alias("row_count"))
    d = F.day("date")
    made = {
        "event": F.lit("created"), "at": F.lit(1).cast("long"), "block": F.concat(F.lit("b"), "date"), "signal": F.lit("logs"), "path": F.concat(F.lit("logs/"), "date"), "bucket": F.lit("one"), "date": F.col("date"), "level": d % 4,
        "ts_min": F.col("ts_min"), "ts_max": F.col("ts_max"), "row_count": F.col("row_count"), "size_bytes": F.col("row_count") * 100, "writer": F.lit("w"), "shard": F.lit(0), "segment": d.cast("long"), "schema_version": F.lit(1),
    }
    created = days.select(*(v.alias(k) for k, v in made.items()))
    again = created.filter("level = 1").withColumn("at", F.lit(2).cast("long")).withColumn("level", F.lit(9))
    gone = lambda kind, n: created.filter(F.day("date") % n == 0).withColumn("event", F.lit(kind)).withColumn("at", F.lit(3).cast("long"))
    return created.union(again).union(gone("superseded", 5)).union(gone("deleted", 7)).select(*schemas.CATALOG_EVENTS.names)


@query(f"WITH {CATALOG} SELECT block, level, row_count FROM live")
def catalog_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_blocks(_catalog_events(spark, sf_dir), "logs").select("block", "level", "row_count")


@query(f"WITH {CATALOG} SELECT count(*) AS n FROM days")
def catalog_block_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return created_blocks(_catalog_events(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(f"WITH {CATALOG} SELECT block, ts_min, ts_max FROM live, span WHERE ts_max >= a AND ts_min <= b")
def catalog_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(live_blocks(_catalog_events(spark, sf_dir)), START, END).select("block", "ts_min", "ts_max")


@query(f"WITH {CATALOG} SELECT 'w' AS writer, 0 AS shard, CAST(max(d) AS BIGINT) AS high FROM days")
def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return created_blocks(_catalog_events(spark, sf_dir)).groupBy("writer", "shard").agg(F.max("segment").alias("high"))


@query(f"WITH {CATALOG}, r AS (SELECT *, count(*) OVER (PARTITION BY level) AS n, row_number() OVER (PARTITION BY level ORDER BY size_bytes, block) AS place FROM (SELECT * REPLACE (substr(date, 1, 7) AS date) FROM live) WHERE level < 3) SELECT block, level, CAST(place AS INT) AS place FROM r WHERE n >= 3 AND place <= 3")
def compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = live_blocks(_catalog_events(spark, sf_dir)).withColumn("date", F.substring("date", 1, 7))
    return maintain.plan_merges(month, fanout=3).select("block", "level", "place")


@query(f"WITH {CATALOG} SELECT block, ts_max FROM live, span WHERE ts_max < b")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.plan_reaping(live_blocks(_catalog_events(spark, sf_dir)), END + 30 * DAY, 30 * DAY, {"metrics": 1}).select("block", "ts_max")


@query(f"WITH {CATALOG} SELECT 'logs' AS signal, count(*) AS blocks, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM live, span WHERE ts_max < b")
def retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.reaping_report(maintain.plan_reaping(live_blocks(_catalog_events(spark, sf_dir)), END + 2 * DAY, None, {"logs": 2 * DAY}))


@query(f"WITH {LOGS} SELECT event_type, count(*) AS n FROM logs WHERE shard = '2' GROUP BY 1")
def compaction_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    catalog, root = log_store(spark, sf_dir)
    maintain.compact(catalog, root, fanout=3)
    rows = Q.Engine(spark, catalog).frame(Q.QuerySpec("logs", ("shard=2",)))
    return rows.groupBy(F.col("labels")["event_type"].alias("event_type")).agg(F.count("*").alias("n"))


@query(f"WITH {LOGS} SELECT ts_unix_nano, body FROM logs WHERE contains(body, 'user 7 ')")
def grep_bloom_equals_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    catalog, _ = log_store(spark, sf_dir)
    return Q.Engine(spark, catalog).frame(Q.QuerySpec("logs", body_contains="user 7 ", labels=False)).select("ts_unix_nano", "body")


@query("SELECT lang, count(*) FILTER (contains(text, 'Released under')) AS hits, bool_or(contains(text, 'Released under')) AS may FROM documents GROUP BY lang")
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language's bodies as one block; where the needle is in them the filter says so, and its false positives are few."""
    ship_package(spark)
    rows = signals.text_logs(spark, sf_dir).select(F.col("labels")["lang"].alias("block"), "body")
    hits = rows.groupBy(F.col("block").alias("lang")).agg(F.count_if(F.col("body").contains("Released under")).alias("hits"))
    return hits.join(bloom.build_blooms(rows, 1e-6).select(F.col("block").alias("lang"), bloom.may_hold(F.col("bloom"), "Released under").alias("may")), "lang")


@query(f"WITH {LOGS} SELECT count(*) AS row_count, min(ts_unix_nano) AS ts_min, max(ts_unix_nano) AS ts_max FROM logs")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    catalog, _ = log_store(spark, sf_dir, 1)
    files = blocks.block_stats(blocks.read_blocks(spark, "logs", [r.path for r in catalog.live().collect()]), "ts_unix_nano")
    return files.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"))


@query(f"WITH {LOGS} SELECT severity::SMALLINT AS severity, count(*) AS n FROM logs WHERE ts_unix_nano < {START} AND event_type = 'error' GROUP BY 1")
def engine_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    catalog, _ = log_store(spark, sf_dir, 2)
    sql = "SELECT severity, count(*) AS n FROM logs WHERE labels['event_type'] = 'error' GROUP BY severity"
    return Q.Engine(spark, catalog).run(Q.QuerySpec("logs", end=START - 1, sql=sql))


@query("SELECT epoch_us(ts) * 1000 AS ts_unix_nano, value FROM events WHERE event_type = 'click' AND user_id % 8 = 3")
def stored_metrics_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metrics_match over stored blocks, of which one is told apart by its postings."""
    ship_package(spark)
    catalog, root = empty_store(spark)
    rows = signals.event_series(spark, sf_dir)
    for i, part in enumerate((rows.filter("labels['event_type'] != 'click'"), rows.filter("labels['event_type'] = 'click'"))):
        publish_rows(catalog, root, "metrics", part, signals.dimension(part, "series_fingerprint"), i)
    return Q.Engine(spark, catalog).frame(Q.QuerySpec("metrics", ("event_type=click", "shard=3"))).select("ts_unix_nano", "value")


@query(f"WITH {LOGS} SELECT ts_unix_nano, body FROM logs WHERE event_type = 'error' AND ts_unix_nano BETWEEN {START} AND {END}")
def stored_logs_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks before, in and after the window; both bounds are inclusive."""
    ship_package(spark)
    catalog, _ = log_store(spark, sf_dir)
    return Q.Engine(spark, catalog).frame(Q.QuerySpec("logs", ("event_type=error",), START, END, labels=False)).select("ts_unix_nano", "body")


@query(f"WITH {SPANS} SELECT span_id, service_name, start_ns FROM spans WHERE trace_id = lpad('1f', 32, '0')")
def stored_trace_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, root = empty_store(spark)
    publish_rows(catalog, root, "traces", signals.spans(spark, sf_dir))
    rows = Q.Engine(spark, catalog).frame(Q.QuerySpec("traces", trace_id="1f".zfill(32)))
    return rows.select(lower_hex(F.col("span_id")).alias("span_id"), "service_name", F.col("start_unix_nano").alias("start_ns"))


@query(f"SELECT page_id * {SECOND} AS ts_unix_nano, md5(html) AS data FROM pages WHERE page_id BETWEEN 20 AND 90")
def stored_profiles_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, root = empty_store(spark)
    publish_rows(catalog, root, "profiles", signals.profiles(spark, sf_dir))
    rows = Q.Engine(spark, catalog).frame(Q.QuerySpec("profiles", start=20 * SECOND, end=90 * SECOND))
    return rows.select("ts_unix_nano", F.md5("data").alias("data"))


@query(f"WITH {LOGS} SELECT CAST(3 AS BIGINT) AS found, CAST(0 AS BIGINT) AS again, count(*) AS row_count FROM logs")
def catalog_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new catalog finds the blocks of a bucket by their meta files, and none of them twice."""
    ship_package(spark)
    _, root = log_store(spark, sf_dir)
    other = Catalog(spark, f"{root}-rebuilt")
    found, again = (other.reconcile(root).count() for _ in range(2))
    return other.live("logs").agg(F.sum("row_count").alias("row_count")).select(F.lit(found).cast("long").alias("found"), F.lit(again).cast("long").alias("again"), "row_count")


# Streams.


@query(f"WITH {LOGS} SELECT event_type, count(*) AS n FROM logs GROUP BY 1")
def live_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments 0 to 4 of writer a are stored, 3 to 9 still live; writer b (segments from 10) has no mark at all."""
    segment = F.pmod(floor_div(F.col("ts_unix_nano"), SECOND), F.lit(20))
    rows = signals.logs(spark, sf_dir).select("ts_unix_nano", "severity", "body", "labels", segment.cast("long").alias("segment"), F.when(segment < 10, "a").otherwise("b").alias("writer"), F.lit(0).alias("shard"))
    marks = spark.createDataFrame([("a", "logs", 0, 4)], "writer string, signal string, shard int, high long")
    history = rows.filter("segment <= 4").drop("segment", "writer", "shard")
    both = ingest.merged(history, rows.filter("segment >= 3"), marks)
    return both.groupBy(F.col("labels")["event_type"].alias("event_type")).agg(F.count("*").alias("n"))


@query(f"WITH {LOGS} SELECT event_type, CAST(CASE WHEN event_type = 'error' THEN 17 ELSE 9 END AS SMALLINT) AS severity, count(*) AS n FROM logs GROUP BY ALL")
def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into blocks, then the same stream once more; the second run publishes nothing new."""
    ship_package(spark)
    root = f"{scratch_dir(spark)}/tellurion-{uuid.uuid4().hex}/store"
    catalog = Catalog(spark, f"{root}/_catalog")
    publish = ingest.to_blocks(catalog, root, "logs", "w")
    for run in ("one", "two"):
        ingest.run_once(event_stream(spark, sf_dir), publish, f"{root}/checkpoint-{run}")
    rows = Q.Engine(spark, catalog).frame(Q.QuerySpec("logs"))
    return rows.groupBy(F.col("labels")["event_type"].alias("event_type"), "severity").agg(F.count("*").alias("n"))


@query(f"WITH {LOGS} SELECT count(*) AS kept FROM logs WHERE event_type = 'signup' AND shard <> '0'")
def tail_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{scratch_dir(spark)}/tellurion-{uuid.uuid4().hex}/tail"
    tail = ingest.Tail(capacity=100)
    tail.subscribe("t", ["event_type=signup", "shard!=0"])
    ingest.run_once(event_stream(spark, sf_dir), tail.offer, root)
    return spark.createDataFrame([(len(tail.take("t")) + tail.dropped("t"),)], "kept long")


@query(f"WITH {LOGS} SELECT ts_unix_nano // {DAY} * {DAY} AS day, CAST(CASE WHEN event_type = 'error' THEN 17 ELSE 9 END AS SMALLINT) AS severity, count(*) AS n FROM logs GROUP BY ALL")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day windows over event time, run to the end of the stream in complete mode."""
    root = f"{scratch_dir(spark)}/tellurion-{uuid.uuid4().hex}/windows"
    windows = ingest.event_windows(event_stream(spark, sf_dir), "10 minutes", "1 day")
    out: dict[int, DataFrame] = {}
    query = windows.writeStream.outputMode("complete").foreachBatch(lambda b, i: out.__setitem__(i, saved(b, "windows"))).option("checkpointLocation", root).trigger(availableNow=True).start()
    query.awaitTermination()
    return out[max(out)].select((F.unix_micros("window.start") * 1000).alias("day"), "severity", "n")


@query("""WITH o AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOURS AS pause FROM events), s AS (SELECT user_id, CAST(sum(CASE WHEN pause THEN 1 ELSE 0 END) AS BIGINT) AS last FROM o GROUP BY 1)
SELECT user_id, last + 1 AS sessions FROM s""")
def log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.read(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_unix_nano"))
    return ingest.session_ids(rows, "user_id", STEP).groupBy("user_id").agg((F.max("session") + 1).alias("sessions"))


@query(f"WITH {LOGS} SELECT {CLASS} AS class, count(*) AS n FROM logs GROUP BY 1")
def severity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.logs(spark, sf_dir).groupBy(severity_class(F.col("severity")).alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {SPANS}, e AS (SELECT trace_id, start_ns // {DAY} * {DAY} AS day, count(*) AS n FROM spans WHERE status_code = 2 GROUP BY ALL) SELECT day, count(*) AS traces, CAST(sum(n) AS BIGINT) AS spans FROM e GROUP BY day")
def error_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed spans and the traces they are in, by day."""
    rows = signals.spans(spark, sf_dir).filter("status_code = 2").groupBy("trace_id", bucket(F.col("start_unix_nano"), DAY).alias("day")).agg(F.count("*").alias("n"))
    return rows.groupBy("day").agg(F.count("*").alias("traces"), F.sum("n").alias("spans"))
