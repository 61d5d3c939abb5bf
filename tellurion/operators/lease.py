"""Leases in a shared folder: one holder for each name at a time.

A term of a lease is a file that only one process can create; its modification time is the
last renewal. The next term may begin once that is a time to live ago. It needs a file system
whose exclusive creation is atomic (HDFS, local disks), not a plain object store.
"""

from __future__ import annotations

import threading
import time

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


class Lease:
    """A held lease. Calling it tells whether it still holds; the first renewal that fails ends it for good."""

    def __init__(self, folder: Leases, name: str, term: int):
        self.folder, self.name, self.term = folder, name, term
        self.renewed, self.lost = time.time(), False
        self._done = threading.Event()
        self._thread = threading.Thread(target=self._keep, daemon=True)
        self._thread.start()

    def __call__(self) -> bool:
        return not self.lost and time.time() - self.renewed < self.folder.ttl

    def _keep(self) -> None:
        while not self._done.wait(self.folder.ttl / 3):
            if not self.renew():
                return

    def renew(self) -> bool:
        now = time.time()
        try:
            if not self() or self.folder.terms(self.name)[-1] != self.term:
                raise TimeoutError(self.name)
            self.folder.touch(self.name, self.term, now)
            self.renewed = now
        except (TimeoutError, IndexError, Py4JError):
            self.lost = True
        return not self.lost

    def release(self) -> None:
        """Let the next holder in at once."""
        held = self()
        self._done.set()
        self._thread.join()  # a renewal under way would undo the release
        self.lost = True
        if held:
            self.folder.touch(self.name, self.term, 0)


class Leases:
    def __init__(self, spark: SparkSession, root: str, ttl: float = 30):
        self.spark, self.root, self.ttl = spark, root.rstrip("/"), ttl
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _file(self, name: str, term: int):
        return self._path(f"{name}/{term:012d}")

    def terms(self, name: str) -> list[int]:
        at = self._path(name)
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def touch(self, name: str, term: int, at: float) -> None:
        self._fs.setTimes(self._file(name, term), int(at * 1000), -1)

    def try_acquire(self, name: str) -> Lease | None:
        """The lease, or None while another holds it. An unreachable folder raises, so that nobody works without a lease."""
        held = self.terms(name)
        if held and time.time() - self._fs.getFileStatus(self._file(name, held[-1])).getModificationTime() / 1000 < self.ttl:
            return None
        term = held[-1] + 1 if held else 0
        try:
            self._fs.create(self._file(name, term), False).close()
        except Py4JError as e:
            if "FileAlreadyExists" in str(e):
                return None
            raise
        for old in held:  # the newest file alone decides
            self._fs.delete(self._file(name, old), False)
        return Lease(self, name, term)
