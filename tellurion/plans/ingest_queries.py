"""Queries over the ingest transforms, on inputs written out of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurion.functions.time import floor_div, rfc3339_nanos
from tellurion.plans.registry import query
from tellurion.session import ship_package
from tellurion.sources import container_logs, exports, promtext, signals, tracing
from tellurion.sources.signals import pairs, read

MILLIS = 1_700_000_000_000


def _exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as exposition lines with comments, types, escapes, special numbers and bad lines among them."""
    e = read(spark, sf_dir, "events")
    quoted = F.concat(F.lit('a\\"b\\\\c\\nd}'), F.col("event_type"))
    number = F.when(F.col("event_id") % 50 == 1, "+Inf").when(F.col("event_id") % 50 == 2, "1.5e-3").otherwise((F.col("value") * 100).cast("long").cast("string"))
    good = F.concat(F.lit('req_total{kind="'), quoted, F.lit('", shard="'), (F.col("user_id") % 8).cast("string"), F.lit('"} '), number, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), (F.lit(MILLIS) + F.col("event_id")).cast("string"))).otherwise(""))
    line = F.when(F.col("event_id") % 97 == 0, "# HELP req_total requests").when(F.col("event_id") % 89 == 0, 'broken{a="1" 5').otherwise(good)
    return e.select("event_id", line.alias("value"))


@query(f"""WITH s AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'comment' WHEN event_id % 89 = 0 THEN 'bad' ELSE 'good' END AS state FROM events)
SELECT event_type, CASE WHEN event_id % 50 = 1 THEN 'inf' WHEN event_id % 50 = 2 THEN 'small' ELSE 'plain' END AS sort, count(*) AS n,
  CAST(sum(CASE WHEN event_id % 50 IN (1, 2) THEN 0 ELSE CAST(trunc(value * 100) AS BIGINT) END) AS BIGINT) AS total, CAST(sum(CASE WHEN event_id % 2 = 0 THEN event_id + {MILLIS} ELSE 0 END) AS BIGINT) AS times
FROM s WHERE state = 'good' GROUP BY ALL""")
def prom_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = promtext.parse_exposition(_exposition(spark, sf_dir)).filter("error is null and type is null")
    v = F.col("sample")
    sort = F.when(v == float("inf"), "inf").when((F.col("event_id") % 50 == 2) & (v == 0.0015), "small").otherwise("plain")
    kind = F.regexp_extract(F.col("labels")["kind"], '(?s)^a"b\\\\c\nd\\}(.*)$', 1)
    return rows.groupBy(kind.alias("event_type"), sort.alias("sort")).agg(F.count("*").alias("n"), F.sum(F.when(sort == "plain", v).otherwise(0)).cast("long").alias("total"), F.sum(F.coalesce("ts_ms", F.lit(0))).alias("times"))


@query("SELECT count(*) FILTER (event_id % 97 <> 0 AND event_id % 89 = 0) AS skipped FROM events")
def prom_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return promtext.parse_exposition(_exposition(spark, sf_dir)).agg(F.count_if(F.col("error").isNotNull()).alias("skipped"))


@query("SELECT * FROM (VALUES ('lat_bucket', 3), ('lat_sum', 3), ('lat_count', 3), ('size_sum', 4), ('size_count', 4), ('size_bucket', 0), ('size', 4), ('up', 2), ('other_sum', 0)) t(name, metric_type)")
def prom_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    names = ["lat_bucket", "lat_sum", "lat_count", "size_sum", "size_count", "size_bucket", "size", "up", "other_sum"]
    lines = spark.createDataFrame([(f"# TYPE {t}",) for t in ("lat histogram", "size summary", "up gauge", "other counter")] + [(f"{n} 1",) for n in names], "value string")
    rows = promtext.parse_exposition(lines)
    typed = promtext.resolve_types(rows.filter("name is not null").select("name"), rows.filter("type is not null").select("type_name", "type"))
    return typed.select("name", F.col("metric_type").cast("int").alias("metric_type"))


@query("""SELECT event_type AS exported_job, CAST(user_id % 8 AS VARCHAR) AS part, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS at_scrape FROM events GROUP BY ALL""")
def scrape_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard is renamed to part; job collides with the target's and is kept as exported_job."""
    raw = pairs(job=F.col("event_type"), shard=signals.shard())
    ts = F.when(F.col("event_id") % 3 != 0, F.col("event_id") + MILLIS)
    rows = read(spark, sf_dir, "events").select(F.lit("m").alias("name"), promtext.relabel(raw, {"shard": "part"}).alias("labels"), pairs(job=F.lit("node"), instance=F.lit("a:1")).alias("target"), F.col("value").alias("sample"), ts.alias("ts_ms"))
    out = promtext.scrape_series(rows, F.lit(7))
    label = F.col("labels")
    return out.filter((label["job"] == "node") & (label["__name__"] == "m")).groupBy(label["exported_job"].alias("exported_job"), label["part"].alias("part")).agg(F.count("*").alias("n"), F.count_if(F.col("ts_unix_nano") == 7).alias("at_scrape"))


@query("SELECT s_suppkey AS target, m AS name, CASE WHEN m = 'up' THEN (s_suppkey % 3 <> 0)::INT::DOUBLE ELSE s_suppkey / 4.0::DOUBLE END AS value FROM supplier, (VALUES ('up'), ('scrape_duration_seconds')) v(m)")
def scrape_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read(spark, sf_dir, "supplier").select(pairs(t=F.col("s_suppkey").cast("string")).alias("target"), (F.col("s_suppkey") % 3 != 0).alias("ok"), (F.col("s_suppkey") / 4).alias("seconds"), F.lit(1).cast("long").alias("scraped_ns"))
    return promtext.scrape_health(targets).select(F.col("labels")["t"].cast("long").alias("target"), F.col("labels")["__name__"].alias("name"), "value")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each user with a series for each event type; user 1 sends a series without labels."""
    e = read(spark, sf_dir, "events")
    sample = F.struct((F.when(F.col("event_id") % 10 == 0, 0).otherwise(F.col("event_id") + MILLIS)).alias("ts_ms"), "value")
    series = e.groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list(sample)).alias("samples"))
    labels = F.when(F.col("user_id") == 1, F.expr(signals.NONE)).otherwise(pairs(__name__=F.lit("e"), kind=F.col("event_type"), user=F.col("user_id").cast("string")))
    return series.groupBy("user_id").agg(F.collect_list(F.struct(labels.alias("labels"), "samples")).alias("series"))


@query(f"SELECT event_type AS kind, count(*) AS n, CAST(sum(event_id + {MILLIS}) AS BIGINT) AS ms FROM events WHERE user_id <> 1 AND event_id % 10 <> 0 GROUP BY 1")
def remote_write_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dimension = promtext.remote_write_in(_requests(spark, sf_dir))
    named = rows.join(dimension.withColumnRenamed("fingerprint", "series_fingerprint"), "series_fingerprint")
    return named.groupBy(F.col("labels")["kind"].alias("kind")).agg(F.count("*").alias("n"), F.sum(floor_div(F.col("ts_unix_nano"), 1_000_000)).alias("ms"))


@query("""WITH k AS (SELECT event_type, user_id % 8 AS shard, count(*) AS n, min(epoch_us(ts) // 1000) AS first FROM events WHERE event_type <> 'view' GROUP BY ALL) SELECT event_type, CAST(shard AS VARCHAR) AS shard, n, first FROM k""")
def remote_write_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.event_series(spark, sf_dir)
    dimension = signals.dimension(rows, "series_fingerprint").filter(F.col("labels")["event_type"] != "view")
    out = promtext.remote_write_out(rows.drop("labels"), dimension)
    return out.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["shard"].alias("shard"), F.size("samples").cast("long").alias("n"), F.col("samples")[0].ts_ms.alias("first"))


def _value(**kind) -> F.Column:
    fields = [("string_value", "string"), ("int_value", "bigint"), ("double_value", "double"), ("bool_value", "boolean"), ("bytes_value", "binary"), ("array_value", "array<string>"), ("kv_value", "array<struct<key:string,value:string>>")]
    return F.struct(*(kind.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))


def _attributes(**values) -> F.Column:
    return F.array(*(F.struct(F.lit(k.replace("__", ".")).alias("key"), v.alias("value")) for k, v in values.items()))


#: Rows from which the requests of an export are made; a request has at most so many spans, however many there are of its resource.
EXPORT = 4096


def _trace_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trace requests: of each run of EXPORT rows one for each resource. Narrow rows are gathered, spans are made of them afterwards."""
    narrow = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("supplier"), "l_linestatus", F.floor(F.monotonically_increasing_id() / EXPORT).alias("run"), F.struct(signals.trace_id(F.col("l_orderkey")).alias("trace"), signals.span_id(F.col("l_linenumber").cast("string")).alias("id"), "l_linenumber", "l_returnflag").alias("line"))
    status = F.col("l_linestatus")

    def span(line: F.Column) -> F.Column:
        trace, number = line.trace, line.l_linenumber.cast("string")
        attributes = _attributes(
            flags=_value(array_value=F.array(line.l_returnflag, F.lit("x"))), pair=_value(kv_value=F.array(F.struct(F.lit("n").alias("key"), number.alias("value")))), raw=_value(bytes_value=F.encode(status, "UTF-8")), none=_value(),
        )
        return F.struct(
            trace.alias("trace_id"), line.id.alias("span_id"), F.when(line.l_linenumber == 1, F.encode(F.lit(""), "UTF-8")).otherwise(signals.span_id(F.lit("1"))).alias("parent_span_id"), F.lit("line").alias("name"), F.lit(2).alias("kind"),
            F.lit(1).cast("long").alias("start_unix_nano"), F.lit(2).cast("long").alias("end_unix_nano"), F.lit(1).alias("status_code"), F.lit("").alias("status_message"), attributes.alias("attributes"),
            F.array(F.struct(F.lit(1).cast("long").alias("ts_unix_nano"), F.concat(F.lit("at "), number).alias("name"), _attributes(k=_value(int_value=F.lit(5))).alias("attributes"))).alias("events"),
            F.array(F.struct(trace.alias("trace_id"), line.id.alias("span_id"), _attributes().cast(tracing.ATTRIBUTES).alias("attributes"))).alias("links"),
        )

    resource = _attributes(service__name=_value(string_value=F.concat(F.lit("supplier-"), F.col("supplier"))), deployment__environment__name=_value(string_value=status))
    gathered = narrow.groupBy("supplier", "l_linestatus", "run").agg(F.collect_list("line").alias("lines"))
    scope = F.struct(F.lit("lib").alias("name"), F.lit("1").alias("version"), F.transform("lines", span).alias("spans"))
    return gathered.select(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopes"))).alias("resource_spans"))


@query("""SELECT lpad(lower(hex(l_orderkey)), 32, '0') AS trace_id, 'supplier-' || (l_suppkey % 10) AS service_name, l_linestatus AS deployment_environment, (l_linenumber = 1) AS is_root,
  '[' || l_returnflag || ',x]' AS flags, '{n=' || l_linenumber || '}' AS pair, lower(hex(encode(l_linestatus))) AS raw, 1 AS events, 'at ' || l_linenumber AS event FROM lineitem""")
def otlp_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracing.flatten_spans(_trace_requests(spark, sf_dir))
    a = F.col("attributes")
    return out.filter(a["none"] == "").select(
        F.lower(F.hex("trace_id")).alias("trace_id"), "service_name", "deployment_environment", F.col("parent_span_id").isNull().alias("is_root"), a["flags"].alias("flags"), a["pair"].alias("pair"), a["raw"].alias("raw"),
        F.size("events").alias("events"), F.col("events")[0]["name"].alias("event"),
    )


@query("""SELECT page_id, page_id * 1000000000 AS ts_unix_nano, greatest(page_id % 7 - 2, 0) * 1000000000 AS duration_nano, 'app' || (page_id % 3) AS service, 'eu' AS region, CASE WHEN page_id % 2 = 0 THEN 'py' END AS spy FROM pages""")
def pyroscope_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    name = F.concat(F.lit("app"), F.col("page_id") % 3, F.lit("{region=eu,page="), F.col("page_id"), F.lit("}"))
    uploads = p.select(F.col("page_id").alias("from_s"), (F.col("page_id") + F.col("page_id") % 7 - 2).alias("until_s"), name.alias("name"), F.when(F.col("page_id") % 2 == 0, "py").alias("spy_name"), F.lit(100).alias("sample_rate"), F.encode("html", "UTF-8").alias("data"))
    rows, label = tracing.profile_rows(uploads), F.col("labels")
    return rows.filter(label["sample_rate"] == "100").select(label["page"].cast("long").alias("page_id"), "ts_unix_nano", "duration_nano", label["service.name"].alias("service"), label["region"].alias("region"), label["spy_name"].alias("spy"))


def _container_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as container log lines of a file for each user; every third line ends an entry."""
    e = read(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("123Z"))
    line = F.concat(stamp, F.lit(" "), F.when(F.col("user_id") % 2 == 0, "stdout").otherwise("stderr"), F.lit(" "), F.when(place % 3 == 0, "F").otherwise("P"), F.lit(" <"), F.col("event_id"), F.lit("> "))
    bad = F.when(place % 10 == 4, "not a line").otherwise(line)
    path = F.concat(F.lit("/var/log/pods/shop_api-"), F.col("user_id"), F.lit("_u1/main/0.log"))
    return e.select("user_id", path.alias("path"), place.alias("place"), bad.alias("value"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events), g AS (SELECT *, (place - 1) // 3 AS run FROM p)
SELECT 'api-' || user_id AS pod, CAST(CASE WHEN user_id % 2 = 0 THEN 9 ELSE 17 END AS SMALLINT) AS severity, max(epoch_us(ts)) FILTER (place % 3 = 0) * 1000 + 123 AS ts_unix_nano,
  coalesce(string_agg('<' || event_id || '> ', '' ORDER BY place) FILTER (place % 10 <> 4), '') AS body
FROM (SELECT g.*, sum(CASE WHEN place % 3 = 0 AND place % 10 <> 4 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM g)
GROUP BY user_id, coalesce(r, 0) HAVING count(*) FILTER (place % 3 = 0 AND place % 10 <> 4) > 0""")
def cri_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = container_logs.parse_lines(_container_lines(spark, sf_dir))
    rows = container_logs.join_partials(lines, "path", "place")
    return rows.select(container_logs.pod_of(F.col("path"))["pod"].alias("pod"), "severity", "ts_unix_nano", "body")


@query("""SELECT app, namespace, k8s_app, env, CASE WHEN event_id % 3 = 1 THEN 'hello' ELSE body END AS body, fields, count(*) AS n FROM (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'old' END AS app, 'shop' AS namespace, 'old' AS k8s_app, 'prod' AS env,
    '{"app":' || CASE WHEN event_id % 2 = 0 THEN '"' || event_type || '"' ELSE '["q"]' END || ',"nul":null,"namespace":"bad","msg":' || CASE WHEN event_id % 3 = 1 THEN '"hello"' ELSE '5' END || '}' AS body,
    'app,msg,namespace' AS fields FROM events) GROUP BY ALL""")
def json_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise('["q"]')
    msg = F.when(F.col("event_id") % 3 == 1, '"hello"').otherwise("5")
    body = F.concat(F.lit('{"app":'), app, F.lit(',"nul":null,"namespace":"bad","msg":'), msg, F.lit("}"))
    rows = read(spark, sf_dir, "events").select(body.alias("body"))
    labels = container_logs.stream_labels(pairs(app=F.lit("old")), pairs(namespace=F.lit("shop")), container_logs.scalar_fields(F.col("body")), {"app": "app"}, ["app", "namespace"], {"env": "prod"})
    out = rows.select(labels.alias("l"), container_logs.message(F.col("body"), "msg").alias("body"), F.array_join(F.array_sort(F.map_keys(container_logs.all_fields(F.col("body")))), ",").alias("fields"))
    return out.groupBy(F.col("l")["app"].alias("app"), F.col("l")["namespace"].alias("namespace"), F.col("l")["k8s_app"].alias("k8s_app"), F.col("l")["env"].alias("env"), "body", "fields").agg(F.count("*").alias("n"))


@query("""SELECT event_type, CAST(user_id % 8 AS VARCHAR) AS shard, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND user_id % 8 <> 2 GROUP BY ALL""")
def keep_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = container_logs.keep(signals.logs(spark, sf_dir), ["event_type=~click|view", "shard!=2"])
    return rows.groupBy(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["shard"].alias("shard")).agg(F.count("*").alias("n"))


@query("""SELECT '{"event_type":"' || event_type || '","shard":"' || (user_id % 8) || '"}' AS stream, CAST(epoch_us(ts) * 1000 AS VARCHAR) AS ts, '{"k":"' || json_extract_string(props, '$.k') || '","severity":"' || CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9 WHEN 'click' THEN 9 ELSE 5 END || '","user_id":"' || user_id || '"}' AS metadata FROM events""")
def loki_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.push_entries(signals.logs(spark, sf_dir)).select("stream", "ts", "metadata")


@query("""SELECT 'logs-' || CASE WHEN user_id % 3 = 0 THEN 'my-' || event_type WHEN user_id % 3 = 1 THEN event_type ELSE 'general' END AS "index", strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS at, event_type AS message FROM events""")
def opensearch_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    labels = F.when(F.col("user_id") % 3 == 0, pairs(**{"service.name": F.concat(F.lit("My "), F.col("event_type")), "app": F.lit("z")})).when(F.col("user_id") % 3 == 1, pairs(app=F.col("event_type"))).otherwise(pairs(other=F.lit("q")))
    rows = e.select((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_unix_nano"), F.lit(9).cast("short").alias("severity"), F.col("event_type").alias("body"), F.expr(signals.NONE).alias("attributes"), labels.alias("labels"))
    out = exports.bulk_documents(rows)
    return out.select("index", F.get_json_object("document", "$['@timestamp']").alias("at"), F.get_json_object("document", "$.message").alias("message"))


@query("SELECT CASE WHEN value < 5 THEN 'small' WHEN event_type = 'view' THEN 'kind' ELSE 'none' END AS reason, count(*) AS n FROM events GROUP BY 1")
def ingest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound, bad = exports.validated(read(spark, sf_dir, "events"), {"small": F.col("value") >= 5, "kind": F.col("event_type") != "view"})
    return sound.agg(F.lit("none").alias("reason"), F.count("*").alias("n")).union(bad.groupBy("reason").agg(F.count("*").alias("n"))).filter("n > 0")


@query("SELECT event_id, epoch_us(ts) * 1000 + 789 AS ns FROM events")
def rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789+02:00"))
    return read(spark, sf_dir, "events").select("event_id", rfc3339_nanos(text).alias("ns"))

