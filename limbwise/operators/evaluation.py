"""Classifier evaluation as aggregates over ``(keys, y_true, y_pred)`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limbwise.functions.columns import ratio
from limbwise.functions.quantiles import exact_percentiles


def confusion(df: DataFrame, keys: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Sparse confusion counts; at most k*k rows per key, so everything after is small."""
    return df.groupBy(*keys, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n"))


def dense_confusion(cells: DataFrame, keys: Sequence[str], classes: Sequence) -> DataFrame:
    """All k*k cells per key; absent cells are 0."""
    names = F.array(*[F.lit(c) for c in classes])
    grid = (cells.select(*keys).distinct()
            .withColumn("y_true", F.explode(names)).withColumn("y_pred", F.explode(names)))
    return (grid.join(cells, [*keys, "y_true", "y_pred"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def per_class(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs; undefined scores are 0."""
    hit = F.col("y_true") == F.col("y_pred")
    sides = cells.select(*keys, F.explode(F.array(
        F.struct(F.col("y_true").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(hit, F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("s"))
    sums = sides.groupBy(*keys, "s.class").agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return (sums.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def averages(classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro scores over classes with support, support-weighted scores, accuracy."""
    present = F.col("support") > 0
    total = F.sum("support")
    macro = [F.coalesce(F.avg(F.when(present, F.col(c))), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [ratio(F.sum(F.col(c) * F.col("support")), total).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return classes.groupBy(*keys).agg(
        total.alias("n_samples"), F.count_if(present).alias("n_classes"),
        ratio(F.sum("tp"), total).alias("accuracy"), *macro, *weighted)


def row_normalised(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    row = Window.partitionBy(*keys, "y_true")
    return cells.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(row), F.lit(1)))


def top_confusions(cells: DataFrame, keys: Sequence[str], limit: int = 20) -> DataFrame:
    """Most frequent off-diagonal cells per key; ties in class order."""
    rank = Window.partitionBy(*keys).orderBy(F.desc("n"), "y_true", "y_pred")
    return (cells.where((F.col("y_true") != F.col("y_pred")) & (F.col("n") > 0))
            .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit))


def extreme_classes(classes: DataFrame, keys: Sequence[str], weakest: int = 10, strongest: int = 5) -> DataFrame:
    """Lowest and highest F1 among classes with support; the top list is the sorted tail reversed."""
    up = Window.partitionBy(*keys).orderBy("f1", "class")
    down = Window.partitionBy(*keys).orderBy(F.desc("f1"), F.desc("class"))
    ranked = (classes.where(F.col("support") > 0)
              .withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down)))
    sides = F.array(F.struct(F.lit("weakest").alias("side"), F.col("_up").alias("rank"), (F.col("_up") <= weakest).alias("_in")),
                    F.struct(F.lit("strongest").alias("side"), F.col("_down").alias("rank"), (F.col("_down") <= strongest).alias("_in")))
    return (ranked.withColumn("_s", F.explode(sides)).where("_s._in")
            .select(*keys, "_s.side", "_s.rank", "class", "precision", "recall", "f1", "support"))


def wide_comparison(classes: DataFrame, models: Sequence[str], model: str = "model") -> DataFrame:
    """One row per class with every model's scores side by side (accuracy repeats recall)."""
    return classes.groupBy("class").pivot(model, list(models)).agg(
        F.round(F.first("precision"), 6).alias("precision"), F.round(F.first("recall"), 6).alias("recall"),
        F.round(F.first("recall"), 6).alias("accuracy"), F.round(F.first("f1"), 6).alias("f1"),
        F.first("support").alias("support"))


def rank_models(summary: DataFrame, models: Sequence[str], keys: Sequence[str] = (), score: str = "macro_f1") -> DataFrame:
    """Ranking by score, ties in model order; ``best`` marks the first."""
    position = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score), position)
    return summary.withColumn("rank", F.row_number().over(w)).withColumn("best", F.col("rank") == 1)


def latency_summary(timings: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Mean, p50, p95, count and throughput of a timing table per key."""
    means = timings.groupBy(*keys).agg(F.avg(value).alias("mean_ms"), F.count(value).alias("samples"))
    tails = exact_percentiles(timings, keys, value, {"p50_ms": 0.5, "p95_ms": 0.95})
    return means.join(tails, list(keys), "left").withColumn(
        "throughput_fps", F.coalesce(F.try_divide(F.lit(1000.0), F.col("mean_ms")), F.lit(0.0)))


def recall_extremes(classes: DataFrame, count: int = 5) -> DataFrame:
    """Mean recall over models per class; the lowest and the highest ``count`` classes."""
    mean = classes.groupBy("class").agg(F.avg("recall").alias("mean_recall"), F.max("support").alias("support"))
    low = mean.orderBy("mean_recall", "class").limit(count).withColumn("side", F.lit("needs review"))
    high = mean.orderBy(F.desc("mean_recall"), F.desc("class")).limit(count).withColumn("side", F.lit("high recall"))
    return low.unionByName(high)
