"""Confidence-threshold sweep in one pass over the scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 0.20 to 0.95 in steps of 0.05.
GRID = tuple(round(0.20 + 0.05 * i, 2) for i in range(16))


def sweep(df: DataFrame, keys: Sequence[str], confidence: str = "confidence", correct: str = "correct",
          grid: Sequence[float] = GRID) -> DataFrame:
    """Coverage and selective accuracy per threshold.

    Each row only learns how many thresholds it passes; counts per that bin (at most
    ``len(grid) + 1`` per key) are then spread over the thresholds.
    """
    steps = F.array(*[F.lit(float(t)) for t in grid])
    bins = (df.withColumn("_bin", F.size(F.filter(steps, lambda t: t <= F.col(confidence))))
            .groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), F.count_if(correct).alias("_ok")))
    spread = bins.select(*keys, "_bin", "_n", "_ok", F.posexplode(steps).alias("_i", "threshold"))
    passed = F.col("_bin") > F.col("_i")
    sums = spread.groupBy(*keys, "threshold").agg(
        F.sum("_n").alias("_total"),
        F.sum(F.when(passed, F.col("_n")).otherwise(0)).alias("accepted"),
        F.sum(F.when(passed, F.col("_ok")).otherwise(0)).alias("accepted_correct"))
    coverage = F.col("accepted") / F.col("_total")
    return sums.select(
        *keys, "threshold", F.round(coverage, 6).alias("coverage"),
        F.round(F.try_divide(F.col("accepted_correct").cast("double"), F.col("accepted")), 6).alias("selective_accuracy"),
        F.round(1 - coverage, 6).alias("uncertain_rate"), "accepted", "accepted_correct",
        F.round(F.col("accepted_correct") / F.col("_total"), 6).alias("pessimistic_accuracy"))


def at_threshold(swept: DataFrame, threshold: float) -> DataFrame:
    """The sweep row at a configured threshold; empty when it is not on the grid."""
    return swept.where(F.abs(F.col("threshold") - threshold) < 1e-9)
