"""Session settings and the folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**SETTINGS, "spark.driver.memory": "12g", **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: dict[str, str] = {}
_made = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where that is unset and the master is local (tests) a folder of this process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tellurion-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(f"file://{_own[app]}/checkpoints")
    return f"file://{_own[app]}"


def saved(df: DataFrame, name: str = "part") -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage ends here, and the planner knows its size."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tellurion-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    if (made := getattr(_made, "paths", None)) is not None:
        made.append(path)
    return out


@contextmanager
def only_keeping(kept: list[DataFrame]):
    """Delete the tables that saved() makes in this thread inside the block, but for those in `kept` when it ends well."""
    outer, _made.paths = getattr(_made, "paths", None), []
    try:
        yield
        spared = {df.saved_path for df in kept}
        for path in _made.paths:
            if path not in spared:
                _delete(kept[0].sparkSession, path)
    finally:
        _made.paths = outer


def discard(df: DataFrame) -> None:
    """Delete a table made by saved() that nothing reads any more."""
    if path := getattr(df, "saved_path", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at.getParent(), True)


#: Rows and bytes of a batch that goes to a Python worker. Spark's own numbers suit narrow rows; with whole texts, workers
#: would hold batches of tens of megabytes, several times over.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that their Python workers can import it, and bound their batches."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    app = f"ship-{spark.sparkContext.applicationId}"
    if app in _own:
        return
    _own[app] = ""
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tellurion-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "tellurion_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
