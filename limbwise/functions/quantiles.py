"""Exact interpolated percentiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limbwise.functions.columns import keyed_join


#: even parts of a slice that holds a wanted rank
PARTS = 4096


def _slice(value: Column) -> Column:
    """A monotone slice number: 1024 per power of two, mirrored for negative values."""
    size = F.least(F.greatest(F.abs(value), F.lit(1e-300)), F.lit(1e300))
    step = F.floor(F.log2(size) * 1024) + F.lit(1_100_000)
    return F.when(value == 0, 0).when(value > 0, step).otherwise(-step).cast("bigint")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """One row per key with the linear-interpolated percentiles in ``wanted``.

    Values are first reduced to ``(key, slice, value, count)`` and then to counts per slice,
    which say which slices hold a wanted rank. Those are cut again, evenly between their own
    least and largest value, as a narrow column lies in one slice; only the parts that hold a
    wanted rank are sorted, each in its own task. Null and NaN values are ignored; a key
    without values yields no row.
    """
    keys = list(keys)
    grain = keys or ["_all"]
    base = df.select(*keys, *([] if keys else [F.lit(0).alias("_all")]), value.cast("double").alias("_v"))
    sliced = (base.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_slice", _slice(F.col("_v")))
              .groupBy(*grain, "_slice", "_v").agg(F.count("*").alias("_n")))
    by_key = Window.partitionBy(*grain)
    sizes = (sliced.groupBy(*grain, "_slice").agg(F.sum("_n").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
             .withColumn("_before", F.coalesce(F.sum("_in").over(
                 by_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("_total", F.sum("_in").over(by_key)))
    ranks = {}
    for name, q in wanted.items():
        pos = (F.col("_total") - 1) * F.lit(float(q))
        ranks[name] = (F.floor(pos), F.ceil(pos), pos - F.floor(pos))
    needed = F.lit(False)
    for low, high, _ in ranks.values():
        for rank in (low, high):
            needed = needed | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_in")))
    span = F.col("_hi") - F.col("_lo")
    cut = keyed_join(sliced, sizes.where(needed).drop("_in"), [*grain, "_slice"]).withColumn(
        "_part", F.when(span > 0, F.floor(F.least(F.lit(1.0), (F.col("_v") - F.col("_lo")) / span) * PARTS)).otherwise(0))
    within = Window.partitionBy(*grain, "_slice").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (cut.groupBy(*grain, "_slice", "_part").agg(F.sum("_n").alias("_in"), F.first("_before").alias("_start"), F.first("_total").alias("_total"))
             .withColumn("_before", F.col("_start") + F.coalesce(F.sum("_in").over(within), F.lit(0))))
    own = Window.partitionBy(*grain, "_slice", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (keyed_join(cut.drop("_before", "_total", "_lo", "_hi"), parts.where(needed).drop("_in", "_start"), [*grain, "_slice", "_part"])
              .withColumn("_upto", F.col("_before") + F.sum("_n").over(own)))
    aggs = []
    for name, (low, high, part) in ranks.items():
        for end, rank in (("lo", low), ("hi", high)):
            hit = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{end}_{name}"))
        aggs.append(F.max(part).alias(f"_f_{name}"))
    found = ranked.groupBy(*grain).agg(*aggs)
    return found.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
        for n in wanted])
