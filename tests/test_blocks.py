import uuid

import pytest
from pyspark.sql import functions as F

from tellurion import schemas
from tellurion.functions.labels import fingerprint
from tellurion.operators import maintain
from tellurion.operators.cache import ResultCache, request_key
from tellurion.operators.query import Engine, QueryError, QuerySpec, check_sql, infer_signal
from tellurion.session import scratch_dir
from tellurion.sources import blocks, bloom
from tellurion.sources.catalog import Catalog
from tellurion.sources.signals import dimension
from tellurion.streaming import ingest


def store(spark):
    root = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    return Catalog(spark, f"{root}/_catalog"), root


def metric_rows(spark, series):
    """100 samples for each (labels, start)."""
    rows = [(dict(labels), start + i, float(i)) for labels, start in series for i in range(100)]
    df = spark.createDataFrame(rows, "labels map<string,string>, ts_unix_nano long, value double")
    return df.withColumn("series_fingerprint", fingerprint(F.col("labels")))


def log_rows(spark, streams):
    rows = [(dict(labels), start + i, severity, f"row {i} fp={mark}", {"trace_id": f"t{i:06d}", "status": "ok"}) for labels, severity, start, mark in streams for i in range(100)]
    df = spark.createDataFrame(rows, "labels map<string,string>, ts_unix_nano long, severity short, body string, attributes map<string,string>")
    return df.withColumn("stream_fingerprint", fingerprint(F.col("labels")))


@pytest.fixture(scope="module")
def metrics(spark):
    catalog, root = store(spark)
    a = metric_rows(spark, [({"__name__": "foo", "env": "prod"}, 1_000_000), ({"__name__": "foo", "env": "stage"}, 1_000_100), ({"__name__": "bar", "env": "prod"}, 1_000_200)])
    b = metric_rows(spark, [({"__name__": "baz", "env": "prod"}, 2_000_000), ({"__name__": "foo", "env": "prod", "n": "2"}, 2_000_100)])
    for i, rows in enumerate((a, b)):
        catalog.insert(blocks.write_block(root, "metrics", rows, dimension(rows, "series_fingerprint"), segment=i))
    return Engine(spark, catalog)


@pytest.mark.parametrize("matchers,want,scanned", [(("__name__=foo",), 300, 2), (("env=prod",), 400, 2), (("__name__=foo", "env=stage"), 100, 1), (("nonexistent=x",), 0, 0), (("env=",), 0, 0), ((), 500, 2)])
def test_metrics(metrics, matchers, want, scanned):
    assert metrics.frame(QuerySpec("metrics", matchers)).count() == want
    assert metrics.stats.after_postings == scanned


def test_metrics_window(metrics):
    spec = QuerySpec("metrics", ("env=prod",), 2_000_050, 2_000_150)
    assert metrics.frame(spec).count() == 101
    assert metrics.stats.candidates == 1


@pytest.fixture(scope="module")
def logs(spark):
    catalog, root = store(spark)
    deep = {"service": "worker", "env": "prod", "k8s_app.kubernetes.io/name": "w"}
    a = log_rows(spark, [({"service": "api", "env": "prod"}, 9, 1_000_000, "0xa001"), ({"service": "db", "env": "prod"}, 6, 1_000_100, "0xa002"), ({"service": "cache", "env": "stage"}, 3, 1_000_200, "0xa003")])
    b = log_rows(spark, [({"service": "api", "env": "prod"}, 9, 2_000_000, "0xb001"), (deep, 6, 2_000_100, "0xb002")])
    for i, rows in enumerate((a, b)):
        catalog.insert(blocks.write_block(root, "logs", rows, dimension(rows, "stream_fingerprint"), segment=i))
    return Engine(spark, catalog, ResultCache())


@pytest.mark.parametrize("matchers,want", [(("service=api",), 200), (("env=prod",), 400), (("nope=1",), 0), ((), 500)])
def test_logs(logs, matchers, want):
    assert logs.frame(QuerySpec("logs", matchers)).count() == want


def test_logs_substring(logs):
    assert logs.frame(QuerySpec("logs", body_contains="0xa001")).count() == 100
    assert logs.stats.after_bloom == 1
    assert logs.frame(QuerySpec("logs", body_contains="zzz-nonexistent-token")).count() == 0
    assert logs.stats.after_bloom == 0


def test_labels_column(logs):
    rows = logs.frame(QuerySpec("logs", ("service=worker",))).collect()
    assert len(rows) == 100 and all(r.labels == {"service": "worker", "env": "prod", "k8s_app.kubernetes.io/name": "w"} for r in rows)
    assert "labels" not in logs.frame(QuerySpec("logs", labels=False)).columns


def test_sql_cache_and_errors(logs):
    spec = QuerySpec("logs", ("env=prod",), sql="SELECT labels['service'] AS s, count(*) AS n FROM logs GROUP BY 1 ORDER BY 1")
    assert logs.fetch(spec).to_pylist() == logs.fetch(spec).to_pylist() == [{"s": "api", "n": 200}, {"s": "db", "n": 100}, {"s": "worker", "n": 100}]
    assert logs.cache.hits == 1
    for sql, code in (("SELEC 1", 2), ("SELECT (1", 2), ("SELECT nope FROM logs", 3), ("DROP TABLE logs", 3), ("INSERT INTO logs SELECT 1", 3)):
        with pytest.raises(QueryError) as e:
            logs.run(QuerySpec("logs", sql=sql))
        assert e.value.code == code, sql
    with pytest.raises(QueryError) as e:
        logs.run(QuerySpec("logs", live=True))
    assert e.value.code == 5
    for sql in ("-- x\nWITH a AS (SELECT 1) SELECT * FROM a;", "EXPLAIN SELECT 1", "FROM logs SELECT body", "VALUES (1)", "SELECT '-- INSERT INTO t' AS s", "(SELECT 1) UNION ALL SELECT 2"):
        assert check_sql(sql)
    for sql in ("WITH q AS (SELECT 1) INSERT INTO t SELECT * FROM q", "FROM x INSERT OVERWRITE TABLE y SELECT *", "FROM x INSERT INTO a SELECT * INSERT INTO b SELECT *", "EXPLAIN INSERT INTO t SELECT 1", "MERGE INTO a USING b ON a.x = b.x WHEN MATCHED THEN DELETE", "SET x = 1", "CACHE TABLE logs", "CREATE TABLE t AS SELECT 1", "SHOW TABLES"):
        with pytest.raises(QueryError) as e:
            check_sql(sql)
        assert e.value.code == 3, sql


def test_limit_only_without_sql(logs):
    assert logs.run(QuerySpec("logs", limit=7)).count() == 7
    assert logs.run(QuerySpec("logs", limit=7, sql="SELECT * FROM logs")).count() == 500


def test_signal_inference():
    assert infer_signal(QuerySpec(trace_id="0" * 32)) == "traces" and infer_signal(QuerySpec(body_contains="x")) == "logs"
    for bad in (QuerySpec("metrics", body_contains="x"), QuerySpec(trace_id="0" * 32, body_contains="x"), QuerySpec("nope")):
        with pytest.raises(QueryError):
            infer_signal(bad)


def test_discovery_equals_distinct(logs, metrics):
    assert [r[0] for r in logs.label_values("logs", "service").collect()] == ["api", "cache", "db", "worker"]
    assert [r[0] for r in metrics.label_names("metrics").collect()] == ["__name__", "env", "n"]
    assert logs.label_values("logs", "service", 2_000_000, 3_000_000).count() == 2
    assert logs.label_names("profiles").count() == 0 and logs.label_names("traces").count() == 3


def test_compaction_keeps_results(spark):
    catalog, root = store(spark)
    for i, (service, env) in enumerate((("api", "prod"), ("db", "prod"), ("api", "stage"))):
        rows = log_rows(spark, [({"service": service, "env": env}, 9, 1_000_000 + 1000 * i, service)]).limit(50)
        catalog.insert(blocks.write_block(root, "logs", rows, dimension(rows, "stream_fingerprint"), segment=i))
    engine = Engine(spark, catalog)
    with pytest.raises(maintain.Fenced):
        maintain.compact(catalog, root, fanout=3, fence=lambda: False)
    assert catalog.live().count() == 3
    assert len(maintain.compact(catalog, root, fanout=3)) == 1
    live = catalog.live().collect()
    assert [(b.level, b.row_count) for b in live] == [(1, 150)]
    assert engine.frame(QuerySpec("logs", ("service=api",))).count() == 100
    assert engine.frame(QuerySpec("logs", body_contains="api")).count() == 100
    assert catalog.watermarks().first().high == 2 and live[0].segment is None
    assert not maintain.compact(catalog, root, fanout=3)


def test_merge_plan(spark):
    rows = [("a", 100, 0), ("b", 10, 0), ("c", 50, 0), ("d", 20, 0), ("e", 1, 3), ("f", 1, 3)]
    live = spark.createDataFrame([(b, "logs", "2024-01-01", level, size) for b, size, level in rows], "block string, signal string, date string, level int, size_bytes long")
    assert sorted(r.block for r in maintain.plan_merges(live, 2).collect()) == ["b", "d"]
    assert maintain.plan_merges(live, 2, signal="metrics").count() == 0


def test_retention(spark):
    day = 86400 * 10**9
    now = 1000 * day
    live = spark.createDataFrame([("old", "logs", now - 90 * day), ("new", "logs", now - day // 24), ("metric", "metrics", now - 200 * day), ("edge", "logs", now - 7 * day)], "block string, signal string, ts_max long")
    live = live.withColumn("date", F.lit("d")).withColumn("size_bytes", F.lit(5))
    names = lambda *a: [r.block for r in maintain.plan_reaping(live, now, *a).collect()]
    assert names(None, {"logs": 7 * day}) == ["old"]
    assert names(7 * day, {"metrics": 2**62}) == ["old"]
    assert names(2**63 - 1, None) == [] and names(None, None) == []


def test_reap_and_missing_blocks(spark):
    catalog, root = store(spark)
    for i in range(2):
        rows = log_rows(spark, [({"service": "api"}, 9, 10 + 10**9 * i, "x")])
        catalog.insert(blocks.write_block(root, "logs", rows, dimension(rows, "stream_fingerprint"), segment=i))
    assert len(maintain.retain(catalog, 10**9, 1000)) == 1 and catalog.live().count() == 2
    maintain.retain(catalog, 10**9, 1000, dry_run=False)
    assert catalog.live().count() == 1
    engine = Engine(spark, catalog)
    blocks.delete_block(spark, catalog.live().first().path)
    assert engine.fetch(QuerySpec("logs", labels=False)).num_rows == 0
    assert catalog.live().count() == 0


def test_catalog_rules(spark):
    catalog, root = store(spark)
    assert catalog.live().count() == 0
    rows = metric_rows(spark, [({"a": "1"}, 5)])
    made = blocks.write_block(root, "metrics", rows, dimension(rows, "series_fingerprint"), segment=3)
    catalog.insert(made)
    catalog.insert(made)
    assert catalog.live("metrics").count() == 1 and catalog.live("logs").count() == 0
    catalog.save_snapshot(f"{root}/snap")
    other = Catalog(spark, f"{root}/_other")
    other.restore_snapshot(f"{root}/snap")
    assert other.live().count() == 1
    third = Catalog(spark, f"{root}/_third")
    spark.createDataFrame([("bad",)], "nope string").coalesce(1).write.text(f"{root}/junk.meta.json.d")
    catalog.set_cursor("p", "1"), catalog.set_cursor("p", "0")
    assert catalog.cursors().first().position == "1" and third.live().count() == 0
    assert blocks.write_block(root, "metrics", rows.limit(0)) is None


def test_a_large_block_is_many_files_in_order(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MAX_ROWS", 100)
    monkeypatch.setattr(blocks, "MAX_BYTES", 4000)
    _, root = store(spark)
    made = blocks.write_block(root, "metrics", metric_rows(spark, [({"i": str(i)}, 10 * i) for i in range(5)])).first()
    key, file = F.struct("series_fingerprint", "ts_unix_nano"), F.col("_metadata.file_path")
    bounds = sorted((tuple(r.a), tuple(r.b)) for r in blocks.read_blocks(spark, "metrics", [made.path]).groupBy(file).agg(F.min(key).alias("a"), F.max(key).alias("b")).collect())
    assert made.row_count == 500 and len(bounds) > 2 and all(x[1] < y[0] for x, y in zip(bounds, bounds[1:]))
    # Profiles are dealt by bytes, also those of one time.
    rows = spark.range(60).select(F.lit(7).cast("long").alias("ts_unix_nano"), F.lit(1).cast("long").alias("duration_nano"), F.expr("cast(map() as map<string,string>)").alias("labels"), F.lit(1).cast("short").alias("format"), F.encode(F.rpad(F.col("id").cast("string"), 1000, "x"), "UTF-8").alias("data"))
    made = blocks.write_block(root, "profiles", rows).first()
    stored = blocks.read_blocks(spark, "profiles", [made.path])
    counts = [r[1] for r in stored.groupBy(file).count().collect()]
    assert sum(counts) == made.row_count == stored.select("data").distinct().count() == 60 and len(counts) > 5 and max(counts) < 30
    assert blocks.write_block(root, "metrics", metric_rows(spark, [({}, 0)]).withColumn("value", F.rand(1))).first().row_count == 100  # rows that differ each time are kept meanwhile


def test_blooms_of_partitions_without_rows(spark):
    rows = spark.createDataFrame([("a", "needle one"), ("a", "ab"), ("a", "cd"), ("b", None)], "block string, body string").repartition(9)
    assert bloom.build_blooms(rows.filter("block = 'none'")).count() == 0
    blobs = {r.block: bytes(r.bloom) for r in bloom.build_blooms(rows, 1e-6).collect()}
    assert set(blobs) == {"a", "b"} and bloom.may_contain(blobs["a"], "needle") and not bloom.may_contain(blobs["a"], "abcd") and not bloom.may_contain(blobs["b"], "needle")


def test_bloom_never_misses():
    import numpy as np

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdef é"), 40)) for _ in range(60)]
    grams = np.unique(np.concatenate([bloom.trigrams(t.encode()) for t in texts]))
    blob = bloom.build(grams)
    assert all(bloom.may_contain(blob, t[i : i + 6]) for t in texts for i in range(0, 30, 7))
    assert bloom.may_contain(blob, "xy") and not bloom.may_contain(blob, "zzz-nonexistent-token")
    assert bloom.geometry(0) == (1, 1) and bloom.geometry(10, 0.9) == bloom.geometry(10, 0.5)


def test_block_is_sorted_and_keeps_nested_values(spark):
    from tellurion.plans.telemetry import signals

    _, root = store(spark)
    rows = signals.spans(spark, "/root/testdata/sf0.001").limit(50)
    meta = blocks.write_block(root, "traces", rows).first()
    back = blocks.read_blocks(spark, "traces", [meta.path])
    assert back.schema.names == schemas.TRACES.names
    keys = [(bytes(r.trace_id), r.start_unix_nano) for r in back.collect()]
    assert keys == sorted(keys) and len(keys) == 50
    assert blocks.should_close(1_000_000, 0) and blocks.should_close(0, 128 << 20) and not blocks.should_close(1, 1)
    assert (blocks.zstd_level(True, 2), blocks.zstd_level(False, 0.9), blocks.zstd_level(False, 0.1)) == (3, 1, 3)


def test_cache_budget():
    class Table:
        nbytes = 40

    cache = ResultCache(100, 50)
    for k in "abc":
        assert cache.put(k, Table())
    assert cache.get("a") is None and cache.get("c") is not None and len(cache) == 2
    Table.nbytes = 60
    assert not cache.put("d", Table())
    assert request_key(QuerySpec("logs"), ["a", "b"]) == request_key(QuerySpec("logs"), ["b", "a"]) != request_key(QuerySpec("logs"), ["a"])


@pytest.mark.parametrize("segment,high,durable", [(0, None, False), (7, None, False), (0, 0, True), (1, 0, False), (0, 5, True), (5, 5, True), (6, 5, False)])
def test_watermark(spark, segment, high, durable):
    live = spark.createDataFrame([("w", 0, segment, 1)], "writer string, shard int, segment long, x int")
    marks = spark.createDataFrame([("w", "logs", 0, high)] if high is not None else [], "writer string, signal string, shard int, high long")
    assert (ingest.not_stored(live, marks, "logs").count() == 0) == durable


def test_live_table_evicts(spark):
    _, root = store(spark)
    rows = log_rows(spark, [({"a": "1"}, 9, 5, "x")])
    table = ingest.LiveTable(spark, f"{root}/live", rows.schema, max_age_s=10)
    table.add(rows, 0, now=0)
    table.add(rows, 1, now=8)
    assert table.read().count() == 200
    assert ingest.snapshot(table.read(), ["a=1", "b="], start=50, contains="row 9").count() == 20
    table.add(rows, 2, now=12)
    assert sorted(r.segment for r in table.read().select("segment").distinct().collect()) == [1, 2]
    table.max_bytes = 1
    table.evict(12)
    assert table.read().count() == 0
