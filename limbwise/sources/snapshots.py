"""Tables that are replaced as a whole while others read them.

A snapshot is a folder of Parquet files. It becomes current when an empty file ``manifest-<number>.<folder>`` appears beside it, which is
one step in any store that Spark writes to, so a reader finds the old snapshot or the new one and never a half-written table. A
DataFrame that was read before a switch goes on with its own files. Old snapshots and folders of writers
that died stay until ``prune`` and are removed once they have been out of use for ``grace`` seconds, which must be longer than the longest read.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._files = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self) -> dict[str, float]:
        """Names in the folder with the seconds of their last change."""
        if not self._files.exists(self._at()):
            return {}
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._files.listStatus(self._at())}

    def _manifests(self, names) -> list[tuple[int, str, str]]:
        """(number, folder, manifest) in order; of two writers that took one number the later name counts."""
        found = [n for n in names if n.startswith("manifest-") and "." in n]
        return sorted((int(n[9:n.index(".")]), n[n.index(".") + 1:], n) for n in found)

    def current(self) -> str | None:
        """Path of the current snapshot; None before the first."""
        known = self._manifests(self._listed())
        return f"{self.path}/{known[-1][1]}" if known else None

    def read(self) -> DataFrame | None:
        at = self.current()
        return None if at is None else self.spark.read.parquet(at)

    def replace(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as the new current snapshot; it may be made from the old one."""
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        known = self._manifests(self._listed())
        self._files.create(self._at(f"manifest-{(known[-1][0] if known else 0) + 1:012d}.{folder}"), False).close()
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def prune(self, grace: float = 86_400.0) -> list[str]:
        """Remove what nobody should read any more; the names of the folders removed."""
        listed = self._listed()
        known, now = self._manifests(listed), time.time()
        gone = []
        for (_, folder, name), (_, _, after) in zip(known, known[1:]):
            if now - listed[after] >= grace:      # replaced that long ago
                gone.append(folder)
                self._files.delete(self._at(folder), True)
                self._files.delete(self._at(name), False)
        named = {folder for _, folder, _ in known}
        for folder in [n for n in listed if n.startswith("data-") and n not in named and now - listed[n] >= grace]:
            gone.append(folder)
            self._files.delete(self._at(folder), True)
        return gone
