import time

import pytest
from pyspark.sql import functions as F
from test_blocks import log_rows, metric_rows, store

from tellurion.functions.severity import kind_name
from tellurion.functions.text import duration_text, service_hue
from tellurion.functions.time import SECOND, quick_range, time_text
from tellurion.operators import maintain
from tellurion.operators import query as Q
from tellurion.operators.cache import SidecarCache
from tellurion.operators.lease import Leases
from tellurion.sources import blocks, synthetic
from tellurion.sources.catalog import Catalog
from tellurion.sources.signals import dimension
from tellurion.streaming import ingest


def publish(catalog, root, rows, segment, signal="logs"):
    key = {"logs": "stream_fingerprint", "metrics": "series_fingerprint"}[signal]
    made = blocks.write_block(root, signal, rows, dimension(rows, key), segment=segment)
    catalog.insert(made)
    return made.first().block


def test_one_holder(spark):
    _, root = store(spark)
    one, two = (Leases(spark, f"{root}/leases", 1.5) for _ in range(2))
    a = one.try_acquire("logs/2024-01-01/0")
    assert a() and two.try_acquire("logs/2024-01-01/0") is None
    other = two.try_acquire("retention")
    assert other() and other.term == 0
    time.sleep(2)
    assert a() and two.try_acquire("logs/2024-01-01/0") is None  # renewed meanwhile
    a.release()
    assert not a()
    b = two.try_acquire("logs/2024-01-01/0")
    assert b() and b.term == 1 and one.try_acquire("logs/2024-01-01/0") is None
    b._done.set()  # a holder that died
    time.sleep(2)
    assert not b()
    c = one.try_acquire("logs/2024-01-01/0")
    assert c() and c.term == 2 and not b.renew()
    c.release(), other.release()


def test_compaction_under_leases(spark):
    catalog, root = store(spark)
    for i in range(3):
        publish(catalog, root, log_rows(spark, [({"service": "api"}, 9, 10**6 + 1000 * i, str(i))]), i)
    leases = Leases(spark, f"{root}/leases", 60)
    held = leases.try_acquire("logs/1970-01-01/0")
    assert maintain.compact(catalog, root, fanout=3, leases=leases) == [] and catalog.live().count() == 3
    held.release()
    assert len(maintain.compact(catalog, root, fanout=3, leases=leases)) == 1
    assert [(b.level, b.row_count) for b in catalog.live().collect()] == [(1, 300)]
    again = leases.try_acquire("logs/1970-01-01/0")
    assert again() and not leases.try_acquire("logs/1970-01-01/0")
    again.release()


def test_labels_stay_cached_until_a_block_is_deleted(spark):
    catalog, root = store(spark)
    a = publish(catalog, root, log_rows(spark, [({"service": "api"}, 9, 10, "x")]), 0)
    publish(catalog, root, log_rows(spark, [({}, 9, 10, "y")]), 1)
    engine = Q.Engine(spark, catalog)
    assert [r[0] for r in engine.label_names("logs").collect()] == ["service"]
    assert catalog.warmed().count() == 2 and engine.warm_labels("logs") == 0
    publish(catalog, root, log_rows(spark, [({"env": "prod"}, 9, 10, "z")]), 2)
    assert [r[0] for r in engine.label_names("logs").collect()] == ["env", "service"]
    catalog.mark_deleted(spark.createDataFrame([(a,)], "block string"))
    assert [r[0] for r in engine.label_names("logs").collect()] == ["env"] and catalog.warmed().count() == 2


def test_appends_beside_each_other(spark):
    from concurrent.futures import ThreadPoolExecutor

    catalog, root = store(spark)
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: publish(catalog, root, metric_rows(spark, [({"i": str(i)}, 10 * i)]), i, "metrics"), range(6)))
    assert catalog.live().count() == 6 and catalog.watermarks().first().high == 5
    assert [tuple(r)[:3] for r in catalog.totals().collect()] == [("metrics", 6, 600)]


def test_poll_passes_over_bad_files(spark):
    catalog, root = store(spark)
    other = Catalog(spark, f"{root}-other")
    publish(catalog, root, log_rows(spark, [({"service": "api"}, 9, 10, "x")]), 0)
    spark.createDataFrame([("{not json",)], "value string").coalesce(1).write.text(f"{root}/logs/bad.meta")
    assert other.poll(root) == 1 and other.poll(root) == 0
    assert other.live().count() == 1 and other.reconcile(root).count() == 0


def test_stats_explain_batches_and_sidecar_cache(spark):
    catalog, root = store(spark)
    for i in range(2):
        publish(catalog, root, log_rows(spark, [({"service": "api" if i else "db"}, 9, 10**9 * i, f"mark{i}")]), i)
    engine = Q.Engine(spark, catalog, sidecars=SidecarCache())
    spec = Q.QuerySpec("logs", ("service=api",), labels=False)
    for _ in range(2):
        assert engine.fetch(spec).num_rows == 100
    assert engine.sidecars.hits == 1 and engine.sidecars.size > 0
    s = engine.stats
    assert (s.candidates, s.after_postings, s.rows, s.cached) == (2, 1, 100, False)
    assert s.scan["numOutputRows"] == 100 and s.scan["numFiles"] >= 1 and s.block_bytes > 0
    assert "Scan parquet" in engine.explain(spec)
    found = list(engine.batches(Q.QuerySpec("logs", limit=None), rows=64))
    assert sum(b.num_rows for b in found) == 200 and max(b.num_rows for b in found) <= 64
    assert Q.logs_query(spark, catalog, ("service=db",)).count() == 100 and Q.metrics_query(spark, catalog).count() == 0
    assert Q.traces_query(spark, catalog).count() == 0 and Q.profiles_query(spark, catalog).count() == 0
    small = SidecarCache(10)
    assert Q.Engine(spark, catalog, sidecars=small).frame(spec).count() == 100 and small.size == 0


def test_builder_closes_by_rows_and_age(spark):
    catalog, root = store(spark)
    rows = log_rows(spark, [({"service": "api"}, 9, 10, "x")])
    b = ingest.BlockBuilder(catalog, root, "logs", "w", max_rows=250)
    assert not b.add(rows, 0, now=100) and not b.add(rows, 1, now=101) and catalog.live().count() == 0
    b.add(rows, 1, now=102)  # a repeated batch replaces itself
    assert b.add(rows, 2, now=103)
    assert [(r.row_count, r.segment) for r in catalog.live().collect()] == [(300, 2)]
    assert not b.add(rows, 2, now=104) and b.counters["repeated"] == 1
    b.add(rows, 3, now=105)
    assert not b.flush_if_aged(60, now=150)
    again = ingest.BlockBuilder(catalog, root, "logs", "w", max_rows=250)  # after a restart
    assert again.high == 2 and list(again.open) == [3]
    assert again.flush_if_aged(0, now=time.time() + 1) and not again.flush_if_aged(0)
    assert catalog.live().agg(F.sum("row_count")).first()[0] == 400 and catalog.watermarks().first().high == 3


def test_made_up_rows(spark):
    for make, key in ((synthetic.metrics, "series_fingerprint"), (synthetic.logs, "stream_fingerprint"), (synthetic.traces, "trace_id"), (synthetic.profiles, "ts_unix_nano")):
        rows, again, other = (sorted(r[0] for r in make(spark, 240, seed=s).select(F.to_json(F.struct("*"))).collect()) for s in (1, 1, 2))
        assert len(rows) == 240 and rows == again != other
        assert make(spark, 240).filter(F.col(key).isNull()).count() == 0
    spans = synthetic.traces(spark, 240)
    known = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    assert spans.filter("parent_span_id is not null").join(known, ["trace_id", "parent_span_id"], "left_anti").count() == 0
    assert spans.filter("parent_span_id is null").count() == 30 and spans.select("span_id").distinct().count() == 240
    catalog, root = store(spark)
    publish(catalog, root, synthetic.metrics(spark, 100, 10), 0, "metrics")
    assert Q.metrics_query(spark, catalog, ("service=api",)).count() == 20


def test_texts(spark):
    r = spark.sql("select 1250000L a, -5L b, 'ab' c, '' d, 9S e, 1704067200123456789L f").select(
        duration_text(F.col("a")).alias("a"), duration_text(F.col("b")).alias("b"), service_hue(F.col("c")).alias("c"), service_hue(F.col("d")).alias("d"), kind_name(F.col("e")).alias("e"), time_text(F.col("f")).alias("f")
    ).first()
    assert tuple(r)[:5] == ("1.25ms", "0ns", (97 * 31 + 98) % 360, 0, "KIND_9")
    assert r.f.short == "00:00:00.123" and r.f.full.startswith("2024-01-01T00:00:00.123")
    assert quick_range(1000 * SECOND + 1, 600 * SECOND) == (400 * SECOND, 1000 * SECOND)


def test_memory_errors():
    class Error(Q.PySparkException):
        def __init__(self, text, condition=None):
            super().__init__(text)
            self.at = condition

        def getCondition(self):
            return self.at

    assert Q.out_of_memory(Error("java.lang.OutOfMemoryError: heap")) and Q.out_of_memory(Error("x", "UNABLE_TO_ACQUIRE_MEMORY"))
    assert not Q.out_of_memory(Error("a memory of better days"))


@pytest.mark.parametrize("files", [1, 5])
def test_bounded_stream(spark, sf_dir, files):
    from tellurion.sources import signals

    reader = spark.readStream.schema(signals.read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet")
    seen = []
    catalog, root = store(spark)
    ingest.run_once(ingest.bounded(reader, sf_dir, files), lambda b, i: seen.append(b.count()), f"{root}/c{files}")
    assert sum(seen) == signals.read(spark, sf_dir, "events").count()


def test_ranks_by_histograms(spark):
    import random

    from tellurion.operators.analytics import frame_stats

    draw = random.Random(3)
    wide = [draw.randrange(-(2**62), 2**62) for _ in range(999)] + [-(2**62), 2**62 - 1]
    skewed = [5] * 500 + [6] * 490 + [2**60 + i for i in range(10)]
    for values in (wide, skewed, [7], [1, 1, 2], list(range(10_000))):
        r = frame_stats(spark.createDataFrame([(v,) for v in values] + [(None,)], "dur_ns long")).first()
        s = sorted(values)
        assert tuple(r) == (len(s), s[0], s[-(-len(s) // 2) - 1], s[-(-len(s) * 99 // 100) - 1], s[-1])
    assert tuple(frame_stats(spark.createDataFrame([], "dur_ns long")).first()) == (0, None, None, None, None)


def test_sliced_postings(spark):
    from tellurion.functions.labels import equality
    from tellurion.sources import postings

    side = spark.createDataFrame([(i, {"env": "prod", "i": str(i % 3)}) for i in range(-50, 50)], "fingerprint long, labels map<string,string>")
    whole, cut = (postings.build_postings(side, slices=s) for s in (1, 7))
    assert whole.count() == 4 and cut.filter("label_name = 'env'").count() == 7
    for m in (["env=prod"], ["env=prod", "i=1"], ["i=9"], []):
        one, two = (sorted(r[0] for r in postings.resolve(p, equality(m)).select("fingerprint").collect()) for p in (whole, cut))
        assert one == two
    assert sorted(postings.merge_postings(cut, whole).collect()) == sorted(whole.collect())
    assert postings.top_names_by_values(cut, 2).collect() == postings.top_names_by_values(whole, 2).collect()
    assert postings.top_values_by_series(cut, "i", 3).collect() == postings.top_values_by_series(whole, "i", 3).collect()
    assert postings.invert(cut).count() == 100


def test_cardinality_limit(spark):
    from tellurion.sources import postings

    rows = [(i * 7919 % 1009 - 500, {"__name__": n} if n else {}) for i in range(200) for n in ("a", "b" if i < 3 else "a", None)]
    side = spark.createDataFrame(rows, "fingerprint long, labels map<string,string>")
    want = {n: set(sorted({f for f, m in rows if m.get("__name__") == n})[:5]) for n in ("a", "b", None)}
    got = postings.capped(side, 5).collect()
    assert len(got) == len(rows)
    assert all(r.accepted == (r.fingerprint in want[r.labels.get("__name__")]) for r in got)


def test_steps_of_spans_beyond_a_long(spark, tmp_path):
    from compare import assert_equal, connection

    from tellurion.plans import registry

    ids = [0, 1, 7, 10**6, 1_523_445, 5_999_999, 6 * 10**7 + 5, 4 * 10**11 + 1]
    spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for name in set("region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations".split()):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    assert_equal(spark, connection(str(tmp_path)), str(tmp_path), registry.QUERIES["step_ladder"], registry.ORACLES["step_ladder"])


def test_no_buffers_for_each_distinct_value(spark, sf_dir):
    from tellurion.plans import registry

    assert "count(distinct" not in registry.QUERIES["sql_approximate"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_maps_are_worked_out_once(spark):
    from tellurion.functions.labels import merged, rekeyed
    from tellurion.sources import container_logs, promtext

    own = F.create_map(F.lit("MARK"), F.col("x"))
    for made in (rekeyed(own, lambda k, v: F.upper(k)), merged(F.create_map(F.lit("a"), F.col("x")), own, F.create_map(F.lit("b"), F.col("x"))), promtext.relabel(own, {"z": "n"}), promtext.with_target(F.col("x"), F.create_map(F.lit("t"), F.col("x")), own), container_logs.message(F.concat(F.lit("MARK"), "x"), "msg")):
        text = spark.sql("select 'y' as x").select(made.alias("r"))._jdf.queryExecution().analyzed().toString()
        assert text.count("MARK") <= 2
    row = spark.sql("select 'y' as x").select(promtext.relabel(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("c"), F.lit("3")), {"a": "b", "z": "c"}).alias("r"), promtext.with_target(F.lit("m"), F.create_map(F.lit("job"), F.lit("1"), F.lit("exported_job"), F.lit("2")), F.create_map(F.lit("job"), F.lit("t"))).alias("t")).first()
    assert row.r == {"b": "1", "c": "3"} and row.t == {"exported_job": "2", "job": "t", "__name__": "m"}
    found = spark.createDataFrame([('{"msg":"a"}',), ('{"msg":5}',), ('{"msg":null}',), ("{}",), ("no",), (None,)], "body string").select(container_logs.message(F.col("body"), "msg")).collect()
    assert [r[0] for r in found] == ["a", '{"msg":5}', '{"msg":null}', "{}", "no", None]
