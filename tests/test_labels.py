import pytest
from pyspark.sql import functions as F

from tellurion.functions import labels as L
from tellurion.functions import time as T

SETS = [{"namespace": "prod", "container": "api-1"}, {"namespace": "staging"}, {"k8s_app": "x"}, {"namespace": "prod\n"}, {}]


def kept(spark, *matchers):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SETS)], "i int, labels map<string,string>")
    return [r.i for r in df.filter(L.matches(F.col("labels"), list(matchers))).orderBy("i").collect()]


@pytest.mark.parametrize(
    "matchers,want",
    [
        ((), [0, 1, 2, 3, 4]), (('namespace=~"prod|staging"',), [0, 1]), (("namespace=prod", 'container=~"api.*"'), [0]), (("namespace!=prod",), [1, 2, 3, 4]),
        (("namespace=prod",), [0]), (('k8s_app=~".+"',), [2]), (("namespace=",), [2, 4]), (('namespace!~"pro.*"',), [1, 2, 3, 4]),
    ],
)
def test_matchers(spark, matchers, want):
    assert kept(spark, *matchers) == want


@pytest.mark.parametrize("text", ["namespace", "=value", "a!b", "a=~("])
def test_bad_matchers(text):
    with pytest.raises(L.MatcherError):
        L.parse_matcher(text)


def test_stored_data_takes_equalities_only():
    assert L.equality(["a=b"])[0].value == "b"
    with pytest.raises(L.MatcherError):
        L.equality(["a!=b"])


def test_fingerprint_ignores_order(spark):
    df = spark.sql("select map('a','1','b','2') x, map('b','2','a','1') y, map('a','1b','','2') z")
    r = df.select(*(L.fingerprint(F.col(c)).alias(c) for c in "xyz")).first()
    assert r.x == r.y != r.z


def test_primary_labels_and_keys(spark):
    df = spark.sql("select map('service','s','z','1') a, map('e','5','d','4','c','3','b','2','a','1') b, '9a.b/c' k")
    r = df.select(L.primary_labels(F.col("a")).alias("a"), L.primary_labels(F.col("b")).alias("b"), L.sanitize_key(F.col("k")).alias("k")).first()
    assert r.a == {"service": "s"} and sorted(r.b) == ["a", "b", "c", "d"] and r.k == "_9a_b_c"


def test_steps():
    s = T.SECOND
    assert T.choose_step(0, 120 * s) == s and T.choose_step(0, 121 * s) == 5 * s
    assert T.choose_step(5, 5) == s and T.choose_step(0, 10**6 * 86400 * s) == 86400 * s
    assert T.snap(17, 5) == 15


def test_times(spark):
    df = spark.createDataFrame([(-1,), (1_704_067_798_778_549_123,)], "ns long")
    rows = df.select(T.bucket(F.col("ns"), 10).alias("b"), T.utc_date(F.col("ns")).alias("d"), T.floor_div(F.col("ns"), 1000).alias("q")).collect()
    assert [tuple(r) for r in rows] == [(-10, "1969-12-31", -1), (1_704_067_798_778_549_120, "2024-01-01", 1_704_067_798_778_549)]
    text = spark.createDataFrame([("2024-01-02T03:04:05.123456789Z",), ("2024-01-02T03:04:05+01:00",), ("no",), (None,)], "t string")
    assert [r[0] for r in text.select(T.rfc3339_nanos(F.col("t"))).collect()] == [1704164645123456789, 1704161045000000000, None, None]
