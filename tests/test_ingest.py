import math

import pytest
from pyspark.sql import functions as F

from tellurion.operators import analytics
from tellurion.sources import container_logs, exports, promtext


def test_lines():
    assert promtext.parse_line('a_total{x="1",y="q\\"\\\\\\n}"} 5 1700') == ("a_total", {"x": "1", "y": 'q"\\\n}'}, 5.0, 1700)
    assert promtext.parse_line("g 1.5e-3") == ("g", {}, 0.0015, None)
    assert promtext.parse_line("# HELP x") is None and promtext.parse_line("  ") is None
    assert [promtext.number(x) for x in ("1e9", "+Inf", "-Inf", "-3.25")] == [1e9, math.inf, -math.inf, -3.25] and math.isnan(promtext.number("NaN"))
    for bad in ("{a=1}", 'x{a="1" 2', "x", "x 1 2 3", "x y"):
        with pytest.raises(ValueError):
            promtext.parse_line(bad)


def test_nulls_and_empty_input(spark):
    lines = spark.createDataFrame([(None,), ("",), ("x 1",)], "value string")
    assert promtext.parse_exposition(lines).count() == 1
    assert promtext.parse_exposition(lines.limit(0)).count() == 0


def test_trailing_partial_is_not_emitted(spark):
    text = ["2024-01-01T00:00:00.5Z stdout P a", "2024-01-01T00:00:01Z stderr F err", "2024-01-01T00:00:02.25Z stdout F b", "junk", "2024-01-01T00:00:03Z stdout P c"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "path string, i int, value string")
    rows = container_logs.join_partials(container_logs.parse_lines(lines), "path", "i").orderBy("ts_unix_nano").collect()
    assert [(r.body, r.severity, r.ts_unix_nano) for r in rows] == [("err", 17, 1704067201 * 10**9), ("ab", 9, 1704067202250000000)]


def test_json_fields(spark):
    df = spark.createDataFrame([('{"num":42,"flag":true,"nul":null,"nested":{"a":1}}',), ("plain",), (None,)], "b string")
    rows = df.select(container_logs.scalar_fields(F.col("b")).alias("s"), container_logs.all_fields(F.col("b")).alias("a"), container_logs.message(F.col("b"), "num").alias("m")).collect()
    assert rows[0].s == {"num": "42", "flag": "true"} and rows[0].a == {"num": "42", "flag": "true", "nested": '{"a":1}'}
    assert rows[0].m.startswith("{") and rows[1].s == {} and rows[1].m == "plain" and rows[2].a == {}


def test_fan_out():
    counts, got = {}, []

    def fails(batch):
        raise RuntimeError("full")

    offer = exports.fan_out({"a": (frozenset({"logs"}), got.append), "b": (frozenset({"logs", "metrics"}), fails)}, counts)
    offer("logs", 1), offer("metrics", 2)
    assert got == [1] and counts == {"a": [1, 0], "b": [0, 2]}


def spans(spark, rows):
    df = spark.createDataFrame(rows, "t string, s string, p string, start long, stop long")
    enc = lambda c: F.encode(F.col(c), "UTF-8")
    return df.select(enc("t").alias("trace_id"), enc("s").alias("span_id"), enc("p").alias("parent_span_id"), F.col("start").alias("start_unix_nano"), F.col("stop").alias("end_unix_nano"), F.col("s").alias("service_name"))


def test_span_tree(spark):
    rows = [("t", "r", None, 0, 9), ("t", "b", "r", 2, 3), ("t", "a", "r", 1, 4), ("t", "aa", "a", 1, 2), ("t", "orphan", "gone", 5, 6), ("t", "c1", "c2", 1, 2), ("t", "c2", "c1", 1, 2)]
    tree = analytics.span_tree(spans(spark, rows)).orderBy("place").collect()
    assert [(bytes(r.span_id).decode(), r.depth) for r in tree] == [("r", 0), ("a", 1), ("aa", 2), ("b", 1), ("orphan", 0)]
    assert analytics.root_service(spans(spark, rows)).first().service == "r"


def test_layout_of_an_empty_window(spark):
    r = analytics.span_layout(spans(spark, [("t", "x", None, 5, 5)])).first()
    assert (r.left, r.width) == (0.0, 1.0)


def test_maps_merge_under_any_policy(spark):
    """Later maps win and keys that meet keep the last value, though the session forbids repeated keys."""
    from pyspark.sql import functions as F

    from tellurion.functions.labels import merged, rekeyed
    from tellurion.sources.container_logs import all_fields

    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == "EXCEPTION"
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}, {"a.b": "x", "a_b": "y", "c": None}, '{"k": "1", "k": "2", "n": {"m": 1}, "z": null}')], "x map<string,string>, y map<string,string>, z map<string,string>, body string")
    r = df.select(merged(F.col("x"), F.col("y")).alias("m"), rekeyed(F.col("z"), lambda k, v: F.regexp_replace(k, r"\.", "_")).alias("r"), merged(all_fields(F.col("body")), F.col("y")).alias("f")).first()
    assert r.m == {"a": "1", "b": "3"} and r.r == {"a_b": "y", "c": None} and r.f == {"k": "2", "n": '{"m":1}', "b": "3"}


def test_deep_trees_keep_every_span(spark):
    rows = [(b"t" * 16, i.to_bytes(8, "big"), (i - 1).to_bytes(8, "big") if i else None, i) for i in range(80)]
    deep = spark.createDataFrame(rows, "trace_id binary, span_id binary, parent_span_id binary, start_unix_nano long")
    assert sorted(r.depth for r in analytics.span_tree(deep).collect()) == list(range(80))


def test_trace_requests_are_bounded(spark, sf_dir, monkeypatch):
    from tellurion.plans import ingest_queries

    monkeypatch.setattr(ingest_queries, "EXPORT", 64)
    spans = ingest_queries._trace_requests(spark, sf_dir).selectExpr("size(resource_spans[0].scopes[0].spans) as n")
    most, total = spans.selectExpr("max(n)", "sum(n)").first()
    assert most <= 64 and total == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
