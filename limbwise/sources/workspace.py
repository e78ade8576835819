"""Where intermediate tables and checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Without that setting a ``local`` session, whose executors are the driver, gets a folder of
    its own; on a cluster there is no folder that all machines share, so it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if context.master.startswith("local-cluster") or not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one table of one run, in the application's own folder."""
    return f"{scratch_root(spark)}/limbwise-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession, application: str | None = None) -> bool:
    """Remove the stored intermediates of this application, or of an ended one; was there anything.

    Call it when no DataFrame made so far is needed any more: results that were not written are read from these tables.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/limbwise-{application or spark.sparkContext.applicationId}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Used where a result feeds several branches of a multi-pass scan: the branches then
    read the table instead of repeating the work, and a lost executor costs no rerun.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
