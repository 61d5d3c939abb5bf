"""Compaction and retention of blocks."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellurion import schemas
from tellurion.operators.lease import Lease, Leases
from tellurion.sources import blocks
from tellurion.sources.catalog import Catalog

FANOUT, MAX_LEVEL = 8, 3
Fence = Callable[[], bool]


class Fenced(RuntimeError):
    """The lease was lost; nothing further may be written."""


def _hold(fence: Fence | None) -> None:
    if fence is not None and not fence():
        raise Fenced("the lease is gone")


def plan_merges(live: DataFrame, fanout: int = FANOUT, max_level: int = MAX_LEVEL, signal: str | None = None) -> DataFrame:
    """Blocks to merge: of each (signal, date, level) below the top level with enough blocks, the fanout smallest."""
    rows = live.filter(F.col("level") < max_level)
    rows = rows.filter(F.col("signal") == signal) if signal else rows
    group = Window.partitionBy("signal", "date", "level")
    ranked = rows.withColumn("n", F.count("*").over(group)).withColumn("place", F.row_number().over(group.orderBy("size_bytes", "block")))
    return ranked.filter((F.col("n") >= fanout) & (F.col("place") <= fanout)).drop("n")


def merge_blocks(catalog: Catalog, root: str, group: list, fence: Fence | None = None, parts: int | None = None) -> DataFrame | None:
    """One block of the next level from the rows of all, its sidecars rebuilt; it carries no watermark."""
    spark, signal = catalog.spark, group[0].signal
    bases = [b.path for b in group]
    rows = blocks.read_blocks(spark, signal, bases)
    side = None
    if signal in schemas.KEY:
        series = blocks.read_sidecar(spark, "series", bases, "block string, fingerprint bigint, labels map<string,string>, metric_type smallint")
        order = F.create_map(*(x for i, b in enumerate(group) for x in (F.lit(b.block), F.lit(i))))
        first = F.min_by("metric_type", F.when(F.col("metric_type").isNotNull(), order[F.col("block")]))
        side = series.groupBy("fingerprint").agg(F.min_by("labels", order[F.col("block")]).alias("labels"), first.alias("metric_type"))
    _hold(fence)
    return blocks.write_block(root, signal, rows, side, writer="compactor", level=group[0].level + 1, parts=parts)


def compact(catalog: Catalog, root: str, fanout: int = FANOUT, grace: float = 0, fence: Fence | None = None, leases: Leases | None = None, parallel: int = 4) -> list[tuple[list[str], str]]:
    """Merge every planned group: write, publish, supersede, wait once for all, delete. Lost leases leave the inputs as they were.

    Groups are merged beside each other. With leases each group is merged by one holder only,
    and a group that another process merged in the meantime is passed over.
    """
    plan: dict[tuple, list] = {}
    for r in plan_merges(catalog.live(), fanout).collect():
        plan.setdefault((r.signal, r.date, r.level), []).append(r)
    guards: list[Lease] = []

    def merge(group: list) -> tuple[list, str, Fence | None] | None:
        guard = fence
        if leases is not None:
            held = leases.try_acquire("/".join((group[0].signal, group[0].date, str(group[0].level))))
            if held is None:
                return None
            guards.append(held)
            guard = (lambda: held() and fence()) if fence is not None else held
            names = [b.block for b in group]
            if catalog.live(group[0].signal).filter(F.col("block").isin(names)).count() < len(names):
                return None
        group.sort(key=lambda b: (b.ts_min, b.block))
        _hold(guard)
        made = merge_blocks(catalog, root, group, guard)
        _hold(guard)
        if made is not None:
            catalog.insert(made)
        catalog.mark_superseded(catalog.spark.createDataFrame([(b.block,) for b in group], "block string"))
        return group, made.first().block if made is not None else "", guard

    try:
        with ThreadPoolExecutor(parallel) as pool:
            merged = [m for m in pool.map(merge, plan.values()) if m is not None]
        if merged:
            time.sleep(grace)
        for group, _, guard in merged:
            _hold(guard)
            for b in group:
                blocks.delete_block(catalog.spark, b.path)
            catalog.mark_deleted(catalog.spark.createDataFrame([(b.block,) for b in group], "block string"))
    finally:
        for held in guards:
            held.release()
    return [([b.block for b in group], name) for group, name, _ in merged]


def plan_reaping(live: DataFrame, now: int, default_ttl: int | None, overrides: dict[str, int] | None = None) -> DataFrame:
    """Blocks wholly older than their signal's time to live; without one a block stays. The cut itself is kept."""
    ttl = F.lit(default_ttl).cast("long")
    for signal, own in (overrides or {}).items():
        ttl = F.when(F.col("signal") == signal, F.lit(own).cast("long")).otherwise(ttl)
    # Subtraction saturates: a time to live beyond the epoch reaps nothing.
    cut = F.greatest(F.lit(now).cast("decimal(38,0)") - ttl.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return live.filter(ttl.isNotNull() & (F.col("ts_max").cast("decimal(38,0)") < cut)).orderBy("signal", "date", "block")


def reaping_report(reaped: DataFrame) -> DataFrame:
    return reaped.groupBy("signal").agg(F.count("*").alias("blocks"), F.sum("size_bytes").alias("bytes"))


def retain(catalog: Catalog, now: int, default_ttl: int | None, overrides: dict[str, int] | None = None, dry_run: bool = True, grace: float = 0, fence: Fence | None = None) -> list[str]:
    """The blocks reaped, or that would be."""
    found = plan_reaping(catalog.live(), now, default_ttl, overrides).collect()
    if dry_run or not found:
        return [b.block for b in found]
    _hold(fence)
    catalog.mark_deleted(catalog.spark.createDataFrame([(b.block,) for b in found], "block string"))
    time.sleep(grace)
    _hold(fence)
    for b in found:
        blocks.delete_block(catalog.spark, b.path)
    return [b.block for b in found]
