"""Immutable sorted Parquet blocks with their sidecars.

A block is a folder <root>/<signal>/<yyyy>/<mm>/<dd>/<writer>/<block>.<kind>, main data sorted by
the signal's key. Postings, labels and blooms lie beside it; the catalog row comes last, so
that readers never meet a block without its sidecars.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion import schemas
from tellurion.functions.time import to_timestamp
from tellurion.sources import bloom, postings

MAX_ROWS, MAX_BYTES = 1_000_000, 128 << 20
#: The column that makes a row of a signal large, and one in which rows of the same key and time differ.
PAYLOAD = {"logs": "body", "profiles": "data"}
APART = {"metrics": "value", "logs": "body", "traces": "span_id", "profiles": "data"}
WRITER = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": str(128 << 20), "parquet.compression.codec.zstd.level": "1"}
SIDECAR = {"compression": "zstd", "parquet.enable.dictionary": "true"}


def zstd_level(saturated: bool, load_per_core: float) -> int:
    """Compression eases off while the host is busy, unless uploads are what is full."""
    return 3 if saturated else 1 if load_per_core >= 0.85 else 3


def should_close(rows: int, size: int) -> bool:
    return rows >= MAX_ROWS or size >= MAX_BYTES


def check(rows: DataFrame, signal: str) -> None:
    want = {f.name for f in schemas.TABLES[signal]}
    missing = sorted(want - set(rows.columns))
    if missing:
        raise ValueError(f"{signal} lack {', '.join(missing)}")


def write_block(root: str, signal: str, rows: DataFrame, dimension: DataFrame | None = None, writer: str = "local", shard: int = 0, segment: int | None = None, level: int = 0, block: str | None = None, parts: int | None = None) -> DataFrame | None:
    """Write one block; its catalog row, or None if there are no rows.

    parts: files of the block, by default one for each MAX_ROWS or MAX_BYTES, one task's work. Larger
    blocks are range-partitioned by the sort key, which keeps them sorted overall.
    """
    check(rows, signal)
    # A block's rows are read for its bounds, its files, its sidecars and its bloom. Making them again each time costs less than
    # keeping them, maps and all, and needs no memory; only rows that would come out otherwise each time are kept.
    kept = [] if rows._jdf.queryExecution().analyzed().deterministic() else [rows.persist(StorageLevel.MEMORY_AND_DISK)]
    if dimension is not None:
        kept.append(dimension.persist(StorageLevel.MEMORY_AND_DISK))
    try:
        return _write(root, signal, rows, dimension, writer, shard, segment, level, block or uuid.uuid4().hex, parts)
    finally:
        for df in reversed(kept):
            df.unpersist()


def _write(root: str, signal: str, rows: DataFrame, dimension: DataFrame | None, writer: str, shard: int, segment: int | None, level: int, block: str, parts: int | None) -> DataFrame | None:
    spark = rows.sparkSession
    schema = schemas.TABLES[signal]
    size = F.sum(F.octet_length(PAYLOAD[signal])) if signal in PAYLOAD else F.lit(0)
    stats = rows.agg(F.count("*"), F.min(schemas.TIME[signal]), F.max(schemas.TIME[signal]), F.date_format(to_timestamp(F.min(schemas.TIME[signal])), "yyyy/MM/dd"), size).first()
    if not stats[0]:
        return None
    base = f"{root.rstrip('/')}/{signal}/{stats[3]}/{writer}/{block}"
    sort = schemas.SORT[signal]
    data = rows.select(*(F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in schema))
    parts = parts or max(1, -(-stats[0] // MAX_ROWS), -(-(stats[4] or 0) // MAX_BYTES))
    # Rows of one key at one time are told apart by a hash, so that they need not meet in one task.
    dealt = data.repartition(1) if parts == 1 else data.repartitionByRange(parts, *sort, F.xxhash64(APART[signal]))
    dealt.sortWithinPartitions(*sort).write.options(**WRITER).option("maxRecordsPerFile", 1 << 22).mode("overwrite").parquet(f"{base}.{signal}")
    if dimension is not None:
        own = dimension.withColumn("block", F.lit(block))
        postings.build_postings(own, "block", slices=-(-stats[0] // MAX_ROWS)).select(*schemas.POSTINGS.names).sort("label_name", "label_value").coalesce(1).write.options(**SIDECAR).mode("overwrite").parquet(f"{base}.postings")
        own.select("block", "fingerprint", "labels", "metric_type").coalesce(1).write.options(**SIDECAR).mode("overwrite").parquet(f"{base}.series")
    if signal == "logs":
        bloom.build_blooms(rows.select(F.lit(block).alias("block"), "body")).coalesce(1).write.mode("overwrite").parquet(f"{base}.bloom")
    size = folder_size(spark, f"{base}.{signal}")
    row = (block, signal, base, root, stats[3].replace("/", "-"), level, stats[1], stats[2], stats[0], size, writer if segment is not None else None, shard, segment, 1)
    meta = spark.createDataFrame([row], schemas.BLOCKS)
    meta.coalesce(1).write.mode("overwrite").json(f"{base}.meta")
    return meta


def folder_size(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def delete_block(spark: SparkSession, base: str) -> None:
    for kind in (*schemas.SIGNALS, "postings", "series", "bloom", "meta"):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}.{kind}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_blocks(spark: SparkSession, signal: str, bases: Iterable[str]) -> DataFrame:
    """The union of blocks as one scan over many paths; no blocks make a typed empty table."""
    paths = [f"{b}.{signal}" for b in bases]
    schema = schemas.TABLES[signal]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def read_sidecar(spark: SparkSession, kind: str, bases: Iterable[str], schema) -> DataFrame:
    paths = [f"{b}.{kind}" for b in bases]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def all_fingerprints(spark: SparkSession, bases: Iterable[str]) -> DataFrame:
    """Sorted distinct fingerprints of each block, those of series without labels too."""
    side = read_sidecar(spark, "series", bases, "block string, fingerprint bigint, labels map<string,string>, metric_type smallint")
    return side.groupBy("block").agg(F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"))


def block_stats(rows: DataFrame, time: str) -> DataFrame:
    """Bounds and rows of each file of a scan."""
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(time).alias("ts_min"), F.max(time).alias("ts_max"), F.count("*").alias("row_count"))


