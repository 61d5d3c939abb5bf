"""The block catalog: an append-only log of events, folded to the live set when read.

Tables under one root: events/ (created, superseded, deleted) and cursors/. High-water marks of
ingest segments are a fold of the created events, superseded and deleted blocks included, so
they never fall; compacted blocks carry none. Replayed events change nothing.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurion import schemas

CURSORS = "peer string, position string"
LABELS = "block string, label_name string, label_value string"
SNAPSHOT_VERSION = 1


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _table(self, name: str, schema) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame) -> None:
        """One file in a folder of its own, so that writers beside each other never share a folder for their uncommitted files."""
        rows.coalesce(1).write.parquet(f"{self.root}/{name}/{uuid.uuid4().hex}")

    def events(self) -> DataFrame:
        return self._table("events", schemas.CATALOG_EVENTS)

    def insert(self, blocks: DataFrame) -> None:
        """Publish blocks. One append makes a block and its high-water mark known together: marks are read from the events."""
        self._event("created", blocks)

    def _event(self, kind: str, blocks: DataFrame) -> None:
        rows = blocks
        for f in schemas.BLOCKS:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        self._append("events", rows.select(F.lit(kind).alias("event"), F.lit(time.time_ns()).alias("at"), *schemas.BLOCKS.names))

    def mark_superseded(self, blocks: DataFrame) -> None:
        self._event("superseded", blocks.select("block"))

    def mark_deleted(self, blocks: DataFrame) -> None:
        self._event("deleted", blocks.select("block"))

    def live(self, signal: str | None = None) -> DataFrame:
        return live_blocks(self.events(), signal)

    def blocks(self) -> DataFrame:
        """Every block ever created, superseded ones too."""
        return created_blocks(self.events())

    def watermarks(self) -> DataFrame:
        return marks(self.events())

    def totals(self) -> DataFrame:
        """Live blocks, rows, bytes and time bounds of each signal."""
        live = self.live().groupBy("signal")
        return live.agg(F.count("*").alias("blocks"), F.sum("row_count").alias("rows"), F.sum("size_bytes").alias("bytes"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max")).orderBy("signal")

    def cache_labels(self, blocks: DataFrame, pairs: DataFrame) -> None:
        """Keep blocks' distinct label pairs and mark the blocks warm, also those without labels; one append, which may be repeated."""
        marks = blocks.select("block", F.lit(None).cast("string").alias("label_name"), F.lit(None).cast("string").alias("label_value"))
        self._append("labels", pairs.select("block", "label_name", "label_value").distinct().unionByName(marks))

    def _labels(self) -> DataFrame:
        """Cached pairs and marks of blocks that are not deleted."""
        gone = self.events().filter("event = 'deleted'").select("block").distinct()
        return self._table("labels", LABELS).join(gone, "block", "left_anti")

    def warmed(self) -> DataFrame:
        return self._labels().filter("label_name is null").select("block").distinct()

    def label_pairs(self, blocks: DataFrame) -> DataFrame:
        """Distinct cached (label_name, label_value) of the given blocks."""
        return self._labels().filter("label_name is not null").join(blocks, "block", "left_semi").select("label_name", "label_value").distinct()

    def set_cursor(self, peer: str, position: str) -> None:
        self._append("cursors", self.spark.createDataFrame([(peer, position)], CURSORS))

    def cursors(self) -> DataFrame:
        return self._table("cursors", CURSORS).groupBy("peer").agg(F.max("position").alias("position"))

    def save_snapshot(self, path: str) -> None:
        self.events().withColumn("version", F.lit(SNAPSHOT_VERSION)).coalesce(1).write.mode("overwrite").parquet(path)

    def restore_snapshot(self, path: str) -> None:
        rows = self.spark.read.parquet(path)
        if rows.filter(F.col("version") != SNAPSHOT_VERSION).limit(1).count():
            raise ValueError("the snapshot has another version")
        self._append("events", rows.select(*schemas.CATALOG_EVENTS.names))

    def reconcile(self, pattern: str) -> DataFrame:
        """Blocks from the meta files under a bucket, <block>.meta.json or the files in <block>.meta; bad files and repeated blocks are passed over."""
        return self._adopt(_metas(self.spark.read, pattern))

    def poll(self, bucket: str, files: int = 10_000) -> int:
        """Blocks whose meta files came into a bucket since the last poll; how many. The checkpoint of a stream over those files is the cursor.

        What a poll misses or a lost checkpoint repeats does no harm: known blocks are passed over, and reconcile() walks the whole bucket.
        """
        found = _metas(self.spark.readStream.option("maxFilesPerTrigger", files).option("maxFileAge", "36500d"), bucket)
        adopted: list[int] = []
        query = found.writeStream.foreachBatch(lambda batch, _: adopted.append(self._adopt(batch).count())).option("checkpointLocation", f"{self.root}/poll").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(adopted)

    def _adopt(self, found: DataFrame) -> DataFrame:
        sound = found.filter("block is not null and signal is not null and ts_min is not null and path is not null")
        known = self.blocks().select("block")
        fresh = sound.dropDuplicates(["block"]).join(known, "block", "left_anti")
        self._event("created", fresh)
        return fresh


def _metas(reader, pattern: str) -> DataFrame:
    """Catalog rows from the meta files under a bucket, by a reader of tables or of streams."""
    found = reader.schema(schemas.BLOCKS).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(pattern)
    file = F.col("_metadata.file_path")
    return found.filter(file.rlike(r"\.meta(/[^/]*)?\.json$|\.meta/[^/]*$") & ~file.contains("/_catalog/"))


def marks(events: DataFrame) -> DataFrame:
    """The highest segment that each writer's blocks of a signal and shard were made from."""
    made = events.filter("event = 'created' and writer is not null and segment is not null")
    return made.groupBy("writer", "signal", "shard").agg(F.max("segment").cast("long").alias("high"))


def created_blocks(events: DataFrame) -> DataFrame:
    """Blocks by their first creation."""
    first = Window.partitionBy("block").orderBy("at")
    return events.filter("event = 'created'").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*schemas.BLOCKS.names)


def live_blocks(events: DataFrame, signal: str | None = None) -> DataFrame:
    gone = events.filter("event in ('superseded', 'deleted')").select("block").distinct()
    live = created_blocks(events).join(gone, "block", "left_anti")
    live = live.filter(F.col("signal") == signal) if signal else live
    return live.orderBy("date", "ts_min", "block")


def candidates(live: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Blocks whose bounds touch the window, both ends inclusive."""
    out = live
    if start is not None:
        out = out.filter(F.col("ts_max") >= start)
    if end is not None:
        out = out.filter(F.col("ts_min") <= end)
    return out
