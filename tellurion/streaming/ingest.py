"""Streams into blocks, the live table, the tail, and history merged with what still streams.

A micro-batch is a segment: its id is the stream's batch id, which is dense and repeats after
a failure. A batch is published under a block id made of writer, shard and segment, so that a
repeated batch replaces itself.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurion.functions.labels import matches
from tellurion.functions.time import to_timestamp
from tellurion.sources import blocks
from tellurion.sources.catalog import Catalog

SHARDS = 8


def block_id(writer: str, signal: str, shard: int, segment: int) -> str:
    return hashlib.md5(f"{writer}/{signal}/{shard}/{segment}".encode()).hexdigest()


def to_blocks(catalog: Catalog, root: str, signal: str, writer: str, shard: int = 0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: labelled rows of a signal become one block for each batch."""
    key = {"metrics": "series_fingerprint", "logs": "stream_fingerprint"}.get(signal)

    def publish(batch: DataFrame, segment: int) -> None:
        name = block_id(writer, signal, shard, segment)
        if catalog.blocks().filter(F.col("block") == name).limit(1).count():
            return
        side = None
        if key:
            side = batch.groupBy(F.col(key).alias("fingerprint")).agg(F.any_value("labels").alias("labels")).withColumn("metric_type", F.lit(0).cast("short"))
        made = blocks.write_block(root, signal, batch, side, writer, shard, segment, block=name)
        if made is not None:
            catalog.insert(made)

    return publish


class BlockBuilder:
    """Collects the segments of one shard until a block is full or old enough, then writes them as one block.

    Segments wait in a folder, so that a builder made anew over the same
    root goes on where the last one ended. The block carries its last segment as its mark;
    segments up to that mark are never written again.
    """

    def __init__(self, catalog: Catalog, root: str, signal: str, writer: str, shard: int = 0, max_rows: int = blocks.MAX_ROWS, max_bytes: int = blocks.MAX_BYTES):
        self.catalog, self.root, self.signal, self.writer, self.shard = catalog, root.rstrip("/"), signal, writer, shard
        self.max_rows, self.max_bytes = max_rows, max_bytes
        self.spool = f"{self.root}/_open/{signal}/{writer}/{shard}"
        mark = catalog.watermarks().filter((F.col("writer") == writer) & (F.col("signal") == signal) & (F.col("shard") == shard)).first()
        self.high = mark.high if mark is not None else -1
        #: Rows, bytes and time of each open segment.
        self.open: dict[int, tuple[int, int, float]] = {}
        self.counters = {"batches": 0, "rows": 0, "blocks": 0, "repeated": 0}
        self._recover()

    def _fs(self, path: str):
        at = self.catalog.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.catalog.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _recover(self) -> None:
        fs, at = self._fs(self.spool)
        for f in fs.listStatus(at) if fs.exists(at) else []:
            segment = int(f.getPath().getName())
            path = f"{self.spool}/{segment}"
            if segment <= self.high or not fs.exists(self._fs(f"{path}/_SUCCESS")[1]):
                fs.delete(f.getPath(), True)
            else:
                self.open[segment] = (self.catalog.spark.read.parquet(path).count(), blocks.folder_size(self.catalog.spark, path), f.getModificationTime() / 1000)

    def add(self, batch: DataFrame, segment: int, now: float | None = None) -> bool:
        """Take a batch; whether that closed a block. Repeated batches replace themselves or are passed over."""
        self.counters["batches"] += 1
        if segment <= self.high:
            self.counters["repeated"] += 1
            return False
        path = f"{self.spool}/{segment}"
        batch.write.mode("overwrite").parquet(path)
        rows = batch.sparkSession.read.parquet(path).count()
        self.counters["rows"] += rows
        self.open[segment] = (rows, blocks.folder_size(self.catalog.spark, path), time.time() if now is None else now)
        if sum(n for n, _, _ in self.open.values()) >= self.max_rows or sum(s for _, s, _ in self.open.values()) >= self.max_bytes:
            self.close()
            return True
        return False

    def flush_if_aged(self, max_age: float, now: float | None = None) -> bool:
        """Close the block if its first segment has waited for so many seconds; whether it did."""
        if not self.open or (time.time() if now is None else now) - min(t for _, _, t in self.open.values()) < max_age:
            return False
        self.close()
        return True

    def close(self) -> None:
        order = sorted(self.open)
        rows = self.catalog.spark.read.parquet(*(f"{self.spool}/{s}" for s in order))
        key = {"metrics": "series_fingerprint", "logs": "stream_fingerprint"}.get(self.signal)
        side = rows.groupBy(F.col(key).alias("fingerprint")).agg(F.any_value("labels").alias("labels")).withColumn("metric_type", F.lit(0).cast("short")) if key else None
        made = blocks.write_block(self.root, self.signal, rows, side, self.writer, self.shard, order[-1], block=block_id(self.writer, self.signal, self.shard, order[-1]))
        if made is not None:
            self.catalog.insert(made)
            self.counters["blocks"] += 1
        self.high = order[-1]
        self.open.clear()
        fs, _ = self._fs(self.spool)
        for s in order:
            fs.delete(self._fs(f"{self.spool}/{s}")[1], True)


def sharded(builders: list[BlockBuilder], session: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that deals rows to builders by session id, so that a session's rows stay in one shard."""

    def publish(batch: DataFrame, segment: int) -> None:
        batch = batch.persist()
        try:
            shard = F.pmod(F.col(session), F.lit(len(builders)))
            with ThreadPoolExecutor(len(builders)) as pool:
                list(pool.map(lambda i: builders[i].add(batch.filter(shard == i), segment), range(len(builders))))
        finally:
            batch.unpersist()

    return publish


class LiveTable:
    """Recent rows by segment, one Parquet folder for each, bounded by age and bytes."""

    def __init__(self, spark: SparkSession, root: str, schema, max_age_s: float = 600, max_bytes: int = 256 << 20):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.max_age_s, self.max_bytes = max_age_s, max_bytes
        self.held: dict[tuple[str, int, int], tuple[float, int]] = {}

    def path(self, writer: str, shard: int, segment: int) -> str:
        return f"{self.root}/writer={writer}/shard={shard}/segment={segment}"

    def add(self, batch: DataFrame, segment: int, writer: str = "local", shard: int = 0, now: float | None = None) -> None:
        path = self.path(writer, shard, segment)
        batch.write.mode("overwrite").parquet(path)
        self.held[writer, shard, segment] = (time.time() if now is None else now, blocks.folder_size(self.spark, path))
        self.evict(now)

    def evict(self, now: float | None = None) -> list[tuple[str, int, int]]:
        """What is too old goes, then the oldest while there are too many bytes."""
        now = time.time() if now is None else now
        order = sorted(self.held, key=lambda k: self.held[k][0])
        out = [k for k in order if now - self.held[k][0] > self.max_age_s]
        rest = [k for k in order if k not in out]
        size = sum(self.held[k][1] for k in rest)
        while rest and size > self.max_bytes:
            size -= self.held[rest[0]][1]
            out.append(rest.pop(0))
        for k in out:
            del self.held[k]
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(*k))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return out

    def read(self) -> DataFrame:
        paths = [self.path(*k) for k in self.held]
        if not paths:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.select("*", F.lit("").alias("writer"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("segment")).limit(0)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        name = F.col("_metadata.file_path")
        return rows.select("*", F.regexp_extract(name, "/writer=([^/]+)", 1).alias("writer"), F.regexp_extract(name, "/shard=([^/]+)", 1).cast("int").alias("shard"), F.regexp_extract(name, "/segment=([^/]+)", 1).cast("long").alias("segment")).select(*[f.name for f in self.schema], "writer", "shard", "segment")


def snapshot(live: DataFrame, matchers: list[str] = (), start: int = 0, end: int = 0, contains: str | None = None) -> DataFrame:
    """Live rows of a query: absent labels count as empty, a bound of 0 is none."""
    rows = live.filter(matches(F.col("labels"), list(matchers)))
    rows = rows.filter(F.col("ts_unix_nano") >= start) if start else rows
    rows = rows.filter(F.col("ts_unix_nano") <= end) if end else rows
    return rows.filter(F.col("body").contains(contains)) if contains else rows


def not_stored(live: DataFrame, marks: DataFrame, signal: str) -> DataFrame:
    """Live rows that no block holds yet: those of writers without a mark, and those of later segments."""
    high = marks.filter(F.col("signal") == signal).select("writer", "shard", "high")
    return live.join(F.broadcast(high) if high.count() <= 100_000 else high, ["writer", "shard"], "left").filter("high is null or segment > high").drop("high")


def merged(history: DataFrame, live: DataFrame, marks: DataFrame, signal: str = "logs") -> DataFrame:
    """History and live rows without a gap or a duplicate, given marks and history of one catalog snapshot."""
    fresh = not_stored(live, marks, signal)
    return history.unionByName(fresh.select(*[c for c in history.columns if c in fresh.columns]), allowMissingColumns=True)


class Tail:
    """Subscribers to a stream: each has its matchers and a bounded queue; what does not fit is dropped and counted."""

    def __init__(self, capacity: int = 1000):
        self.capacity = capacity
        self.queues: dict[str, tuple[list[str], list, list[int]]] = {}

    def subscribe(self, name: str, matchers: list[str] = ()) -> None:
        self.queues[name] = (list(matchers), [], [0])

    def offer(self, batch: DataFrame, segment: int | None = None) -> None:
        for wanted, queue, dropped in self.queues.values():
            kept = batch.filter(matches(F.col("labels"), wanted))
            room = max(0, self.capacity - len(queue))
            rows = kept.orderBy("ts_unix_nano").limit(room + 1).collect()  # at most the capacity and one
            queue += rows[:room]
            if len(rows) > room:
                dropped[0] += kept.count() - room

    def take(self, name: str) -> list:
        _, queue, _ = self.queues[name]
        out = queue[:]
        queue.clear()
        return out

    def dropped(self, name: str) -> int:
        return self.queues[name][2][0]


def bounded(reader, path: str, files: int = 1000, size: str | None = None):
    """A stream of the Parquet files in a folder that takes at most so many files, or bytes, at a time: blocks that are slow to write hold the stream back."""
    reader = reader.option("maxBytesPerTrigger", size) if size else reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def run_once(stream: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drive a stream over what there is now and stop."""
    query = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def bottleneck(durations: dict[str, int]) -> str:
    """The phase in which a stream's batch spent most of its time, from its progress."""
    phases = {k: v for k, v in durations.items() if k != "triggerExecution"}
    return max(phases, key=phases.get) if phases else "idle"


def event_windows(stream: DataFrame, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Entries by event-time window and severity; rows later than the allowance are dropped. Beyond the ingest path, which drops none."""
    timed = stream.withColumn("ts", to_timestamp(F.col("ts_unix_nano"))).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(window, "severity").agg(F.count("*").alias("n"))


def session_ids(rows: DataFrame, key: str, gap_ns: int) -> DataFrame:
    """rows with a session number for each key: a pause of more than the gap starts the next."""
    order = Window.partitionBy(key).orderBy("ts_unix_nano")
    starts = (F.col("ts_unix_nano") - F.lag("ts_unix_nano").over(order)) > gap_ns
    return rows.withColumn("session", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
