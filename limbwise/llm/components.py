"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limbwise.sources.workspace import cut


def _least(edges: DataFrame) -> DataFrame:
    """``u``, ``v`` and the least node among ``u`` and its neighbours; a hot ``u`` is reduced in the map tasks first."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    return edges.join(least, "u").withColumn("_m", F.least("_m", "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = _least(down)
    return (least.select(F.col("v").alias("u"), F.col("_m").alias("v"))
            .union(least.select("u", F.col("_m").alias("v"))).where(F.col("u") != F.col("v")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of an edge (``u``, ``v``).

    Each round halves the depth of a component at least; it ends when a round changes nothing. The
    tables between rounds go to shared storage. No edges give no rows.
    """
    now = cut(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        then = cut(_small_star(_large_star(now)), "edges")
        new = _mark(then)
        now = then
        if new == mark:
            break
        mark = new
    return (now.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct())
