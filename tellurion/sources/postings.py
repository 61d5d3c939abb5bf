"""The inverted label index: (label name, label value) -> sorted distinct fingerprints.

A list may be cut into slices by a hash of the fingerprint, a row each, so that a label on every
series is neither one task's work nor one row. What reads an index takes lists whole or sliced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellurion.functions.labels import Matcher

#: Parts in which the series of one metric name are ranked before its limit is drawn.
SALTS = 64


def _lists(rows: DataFrame, slices: int, *by: str) -> DataFrame:
    part = [F.pmod(F.xxhash64("fingerprint"), F.lit(slices)).alias("_slice")] if slices > 1 else []
    return rows.groupBy(*by, "label_name", "label_value", *part).agg(F.array_sort(F.collect_set("fingerprint")).alias("fingerprints")).drop("_slice")


def build_postings(dimension: DataFrame, *by: str, slices: int = 1) -> DataFrame:
    """dimension(fingerprint, labels, *by) -> (*by, label_name, label_value, fingerprints)."""
    return _lists(dimension.select(*by, "fingerprint", F.explode("labels").alias("label_name", "label_value")), slices, *by)


def merge_postings(*parts: DataFrame, slices: int = 1) -> DataFrame:
    """The union of indexes, each list sorted and distinct again."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return _lists(every.select("label_name", "label_value", F.explode("fingerprints").alias("fingerprint")), slices)


def resolve(postings: DataFrame, matchers: list[Matcher], *by: str) -> DataFrame:
    """Fingerprints (with their *by columns) that carry every matcher's pair.

    A matcher without a posting leaves nothing, also for an empty value: absent labels have no posting.
    """
    wanted = {(m.name, m.value) for m in matchers}
    if not wanted:
        return postings.select(*by, F.explode("fingerprints").alias("fingerprint")).distinct()
    any_of = F.lit(False)
    for name, value in sorted(wanted):
        any_of = any_of | ((F.col("label_name") == name) & (F.col("label_value") == value))
    hits = postings.filter(any_of).select(*by, "label_name", "label_value", F.explode("fingerprints").alias("fingerprint"))
    return hits.groupBy(*by, "fingerprint").agg(F.count_distinct("label_name", "label_value").alias("n")).filter(F.col("n") == len(wanted)).drop("n")


def invert(postings: DataFrame) -> DataFrame:
    """(fingerprint, labels): the dimension back from its index."""
    rows = postings.select("label_name", "label_value", F.explode("fingerprints").alias("fingerprint"))
    pairs = F.array_sort(F.array_distinct(F.collect_list(F.struct("label_name", "label_value"))))
    return rows.groupBy("fingerprint").agg(F.map_from_entries(pairs).alias("labels"))


def label_names(postings: DataFrame) -> DataFrame:
    return postings.select("label_name").distinct().orderBy("label_name")


def label_values(postings: DataFrame, name: str) -> DataFrame:
    return postings.filter(F.col("label_name") == name).select("label_value").distinct().orderBy("label_value")


def top_names_by_values(postings: DataFrame, k: int) -> DataFrame:
    """Label names with the most distinct values, from the index alone."""
    return postings.groupBy("label_name").agg(F.count_distinct("label_value").alias("n_values")).orderBy(F.desc("n_values"), "label_name").limit(k)


def top_values_by_series(postings: DataFrame, name: str, k: int) -> DataFrame:
    """Values of one label with the most series; an index of several blocks may hold a series more than once."""
    rows = postings.filter(F.col("label_name") == name).select("label_value", F.explode("fingerprints").alias("f"))
    return rows.groupBy("label_value").agg(F.count_distinct("f").alias("n_series")).orderBy(F.desc("n_series"), "label_value").limit(k)


def capped(dimension: DataFrame, most: int) -> DataFrame:
    """Series within a cardinality limit for each metric name: the first by fingerprint, the rest refused.

    A name's last accepted fingerprint is found among the first of each of SALTS parts, so that
    no task ranks all series of a name; the series are then held against it.
    """
    name = F.col("labels")["__name__"]
    keys = dimension.select(name.alias("_name"), F.col("fingerprint").alias("_last")).distinct()
    part = Window.partitionBy("_name", F.pmod("_last", F.lit(SALTS))).orderBy("_last")
    first = keys.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= most)
    last = first.withColumn("_n", F.row_number().over(Window.partitionBy("_name").orderBy("_last"))).filter(F.col("_n") == most).drop("_n")
    joined = dimension.join(last, name.eqNullSafe(F.col("_name")), "left")
    return joined.withColumn("accepted", F.coalesce(F.col("fingerprint") <= F.col("_last"), F.lit(True))).drop("_name", "_last")
