"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.session import discard, saved


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of any orderable type -> (node, root), root being the least node that can be reached.

    Nodes without a link to another are left out; null ends, loops and repeated edges are
    ignored. Each step keeps at most one edge for each former one, in a table in the shared
    folder, so lineage stays short and lost executors cost one step. The least neighbours are
    stored too: both sides of each join are then tables, and Spark can split a node that has a
    large part of all edges. The driver sees a count and a checksum only.
    """
    pair = F.when(F.col("u") > F.col("v"), F.struct("u", "v")).otherwise(F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    now = saved(edges.filter("u != v").select(pair.alias("e")).select("e.u", "e.v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = saved(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        discard(least)
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        then = saved(small.filter("u != v").distinct(), "edges")
        before, mark = mark, _mark(then)
        for done in (now, large, least):
            discard(done)
        now = then
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
