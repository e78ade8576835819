"""Log and table sinks and their readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from limbwise.sources.snapshots import Snapshots

# The record layouts of the three logs.
PREDICTION = ("event_id string, timestamp timestamp, model string, predicted_class string, confidence double, "
              "status string, latency_ms double, fps double, human_action string, corrected_class string, "
              "source string, profile string, caption string")
FEEDBACK = ("feedback_id string, event_id string, timestamp timestamp, human_action string, predicted_class string, "
            "corrected_class string, confidence double, model string, note string, profile string")
FAILURE = ("failure_id string, timestamp timestamp, stage string, message string, model string, source string, "
           "session_id string")


def _path_missing(exc: AnalysisException) -> bool:
    return exc.getCondition() == "PATH_NOT_FOUND"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken lines are skipped, other keys land in ``extra``.

    A missing path is an empty log.
    """
    fields = StructType.fromDDL(schema)
    try:
        lines = spark.read.text(path)
    except AnalysisException as exc:
        if not _path_missing(exc):
            raise
        lines = spark.createDataFrame([], "value string")
    parsed = (lines.where(F.length(F.trim("value")) > 0)
              .withColumn("_r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
              .withColumn("_all", F.from_json("value", "map<string,string>")))
    names = F.array(*[F.lit(f) for f in fields.names])
    return parsed.where(F.col("_all").isNotNull()).select(
        "_r.*", F.map_filter("_all", lambda k, v: ~F.array_contains(names, k)).alias("extra"))


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str, time: str = "timestamp") -> None:
    """Append records, partitioned by day so that reviews and metrics prune by date."""
    df.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def append_stream(df: DataFrame, path: str, checkpoint: str, time: str = "timestamp") -> StreamingQuery:
    """The same sink for a stream: each record is written once, also across restarts."""
    return (df.withColumn("day", F.to_date(time)).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start(path))


def read_log(spark: SparkSession, path: str, days: tuple[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """The records that ``append_log`` or ``append_stream`` wrote, of the days from the first to the last of ``days``; other days are not opened.

    A missing path is an empty log where ``schema`` tells its columns.
    """
    try:
        log = spark.read.parquet(path)
    except AnalysisException as exc:
        if schema is None or not _path_missing(exc):
            raise
        log = spark.createDataFrame([], f"{schema}, day date")
    return log.where(F.col("day").between(*[F.lit(d).cast("date") for d in days])) if days else log


def write_training_set(copies: DataFrame, path: str, protocol: str) -> None:
    """Tensors as 32-bit floats, one row per clip copy, partitioned by protocol and split."""
    (copies.withColumn("protocol", F.lit(protocol)).withColumn("seq", F.col("seq").cast("array<array<float>>"))
     .write.mode("overwrite").partitionBy("protocol", "split").parquet(path))


def read_training_set(spark: SparkSession, path: str, protocol: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).where(F.col("protocol") == protocol)
    return df.where(F.col("split") == split) if split else df


def training_summary(copies: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows, clips and skips per split."""
    kept = copies.groupBy("split").agg(F.count("*").alias("samples"), F.count_if(F.col("copy") == 0).alias("clips"))
    skipped = rejected.groupBy("split").agg(F.count("*").alias("skipped"))
    return kept.join(skipped, "split", "full_outer").select(
        "split", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("samples", "clips", "skipped")])


def stored_index(spark: SparkSession, path: str, build: Callable[[], DataFrame], force_rebuild: bool = False, grace: float = 86_400.0) -> DataFrame:
    """The stored index; built and written when absent or when a rebuild is asked for.

    A rebuild is a new snapshot: readers of the old one are not disturbed, and a build that fails leaves it in place. Snapshots
    replaced more than ``grace`` seconds ago are removed.
    """
    table = Snapshots(spark, path)
    index = None if force_rebuild else table.read()
    if index is None:
        index = table.replace(build())
        table.prune(grace)
    return index


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """Metric tables: doubles rounded to 6 digits, header row."""
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*rounded).write.mode("overwrite").csv(path, header=True)


def read_metrics_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_metrics_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)
