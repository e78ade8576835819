"""Counts of near-duplicate pairs over a recursive grid (A4, A5): no pair of clips is listed.

Unit vectors lie in grid cells of two projections, as wide as the distance that the cosine threshold allows, so partners are in
neighbouring cells. A cell of more than ``LEAF`` vectors is halved along the widest side of its bounding box, again and again, which gives a
binary tree per cell. Pairs of nodes are then followed from the roots down: boxes that are too far apart are dropped, boxes whose
farthest corners are near enough are counted whole from their sums, all others give way to their children. What is left are pairs of leaves,
whose vectors are compared as two matrices that give out sums only.

A dense heap of nearly equal vectors is thus one product of counts, and the work for the rest follows the surface
between near and far. Each round is a few equi-joins of node tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limbwise.functions.columns import keyed_join, total
from limbwise.sources.workspace import cut

LEAF = 256
WEIGHTS = ("copies", "n_train", "n_val", "n_test")
COUNTS = ("dup", "cross_any", "cross_train_test")
#: Distances between boxes are rounded sums; a decision for whole boxes keeps this far from the threshold
MARGIN = 1e-9


def pair_counts(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Clip pairs between two sets with the given sums of ``WEIGHTS``: all, across splits, train against test."""
    tt = a["n_train"] * b["n_test"] + a["n_test"] * b["n_train"]
    val = (a["n_train"] + a["n_test"]) * b["n_val"] + a["n_val"] * (b["n_train"] + b["n_test"])
    return {"dup": a["copies"] * b["copies"], "cross_any": tt + val, "cross_train_test": tt}


def inner_counts(w: dict[str, Column]) -> dict[str, Column]:
    """Clip pairs inside one set with the given sums."""
    tt = w["n_train"] * w["n_test"]
    return {"dup": (w["copies"] * (w["copies"] - 1) / 2).cast("bigint"), "cross_any": tt + (w["n_train"] + w["n_test"]) * w["n_val"], "cross_train_test": tt}


def _trees(points: DataFrame, node: list[str], width: int) -> tuple[DataFrame, DataFrame, int]:
    """(nodes with box, sums and ``leaf``; points with the ``path`` of their leaf; depth)."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in (*WEIGHTS, *[f"own_{c}" for c in COUNTS])]
    box = [F.array(*[fold(F.col("u")[i]) for i in range(width)]).alias(name) for fold, name in ((F.min, "lo"), (F.max, "hi"))]
    nodes, leaves, open_points = [], [], points
    while True:
        found = cut(open_points.groupBy(*node).agg(F.count("*").alias("n"), *sums, *box).withColumn("leaf", F.col("n") <= LEAF), "nodes")
        nodes.append(found)
        extent = F.zip_with("lo", "hi", lambda a, b: b - a)
        axis = (F.array_position(extent, F.array_max(extent)) - 1).cast("int")
        low, high = F.get("lo", axis), F.get("hi", axis)
        middle = low + (high - low) / 2
        halves = found.where(~F.col("leaf")).select(*node, axis.alias("_axis"), F.when(middle > low, middle).otherwise(high).alias("_at"))
        if halves.isEmpty():
            leaves.append(open_points)
            break
        told = keyed_join(open_points, halves, node, "left")
        leaves.append(told.where("_axis IS NULL").drop("_axis", "_at"))
        side = F.when(F.get("u", F.col("_axis")) < F.col("_at"), "0").otherwise("1")
        open_points = cut(told.where("_axis IS NOT NULL").withColumn("path", F.concat("path", side)).select(*points.columns), "halved")
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, leaves), len(nodes) - 1


def _leaf_sums(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Sums over the near pairs of two leaves; rows hold ``group, same, ua, wa, ub, wb`` with vectors and weights laid end to end."""
    def matrix(column: pa.Array, i: int, kind: type, rows: int) -> np.ndarray:
        return column[i].values.to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            wa, wb = (matrix(batch.column(c), i, np.int64, len(batch.column(c)[i]) // len(WEIGHTS)) for c in (3, 5))
            ua, ub = matrix(batch.column(2), i, np.float64, len(wa)), matrix(batch.column(4), i, np.float64, len(wb))
            sims = ua @ ub.T
            near = sims > threshold
            for x, y in zip(*np.nonzero(np.abs(sims - threshold) < 1e-12)):   # as a running sum, the way the pairs are scored
                near[x, y] = sum((ua[x] * ub[y]).tolist()) > threshold
            if batch.column(1)[i].as_py():
                near = np.triu(near, 1)
            met = (near.astype(np.int64) @ wb).T          # partners' weights of each row of a
            n, tr, va, te = wa.T
            tt = int(tr @ met[3] + te @ met[1])
            out.append((int(n @ met[0]), tt + int((tr + te) @ met[2] + va @ (met[1] + met[3])), tt))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 3)]], ["_group", *COUNTS])


def near_counts(groups: DataFrame, cells: list[Column], radius: float, group: str, threshold: float) -> DataFrame:
    """Per ``group``: ``COUNTS`` of the clip pairs of different rows of ``groups`` whose unit vectors ``u`` have a cosine above ``threshold``.

    ``cells`` are grid cells in which vectors within ``radius`` of each other differ by at most one.
    """
    node = ["_group", "c0", "c1", "path"]
    own = inner_counts({c: F.col(c) for c in WEIGHTS})
    points = cut(groups.select(F.struct(group).alias("_group"), cells[0].alias("c0"), cells[1].alias("c1"), F.lit("").alias("path"), "u", *WEIGHTS,
                               *[own[c].alias(f"own_{c}") for c in COUNTS]), "points")
    width = points.agg(F.max(F.size("u"))).first()[0]
    if width is None:
        return groups.select(group, *[F.lit(0).cast("bigint").alias(c) for c in COUNTS]).limit(0)
    nodes, leaves, depth = _trees(points, node, width)
    tree = nodes.select(F.struct(*node).alias("key"), "leaf", "lo", "hi", *WEIGHTS, *[f"own_{c}" for c in COUNTS])
    side = lambda s: tree.select(F.col("key").alias(s), F.struct("leaf", "lo", "hi", *WEIGHTS, *[f"own_{c}" for c in COUNTS]).alias(f"{s}_node"))
    roots = nodes.where("path = ''").select(*node)
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    frontier = roots.withColumn("d", step).select(F.struct(*node).alias("a"), F.struct(
        "_group", (F.col("c0") + F.col("d.x")).alias("c0"), (F.col("c1") + F.col("d.y")).alias("c1"), "path").alias("b"))
    counted, left = [], []
    # each round goes a level down in every node that is not a leaf, so after the depth of the trees only leaves are left
    for level in range(depth + 1):
        met = cut(frontier.join(side("a"), "a").join(side("b"), "b"), "frontier")
        corner = lambda f: total(F.transform(F.arrays_zip(*[F.col(c).alias(n) for c, n in (("a_node.lo", "al"), ("a_node.hi", "ah"), ("b_node.lo", "bl"), ("b_node.hi", "bh"))]), f))
        gap = corner(lambda x: F.pow(F.greatest(F.lit(0.0), x["al"] - x["bh"], x["bl"] - x["ah"]), F.lit(2.0)))
        reach = corner(lambda x: F.pow(F.greatest(x["ah"] - x["bl"], x["bh"] - x["al"]), F.lit(2.0)))
        near, same = radius * radius, F.col("a") == F.col("b")
        open_pairs = met.where(gap <= near + MARGIN).withColumn("whole", reach < near - 4 * MARGIN)
        weights = lambda s: {c: F.col(f"{s}_node.{c}") for c in WEIGHTS}
        across, inside = pair_counts(weights("a"), weights("b")), inner_counts(weights("a"))
        counted.append(open_pairs.where("whole").select("a._group", *[
            F.when(same, inside[c] - F.col(f"a_node.own_{c}")).otherwise(across[c]).alias(c) for c in COUNTS]))
        rest = open_pairs.where("NOT whole")
        both = F.col("a_node.leaf") & F.col("b_node.leaf")
        left.append(rest.where(both).select("a", "b"))
        child = lambda s: F.explode(F.when(F.col(f"{s}_node.leaf"), F.array(F.col(s))).otherwise(F.array(
            *[F.struct(*[F.col(f"{s}.{c}") for c in node[:3]], F.concat(f"{s}.path", F.lit(h)).alias("path")) for h in "01"]))).alias(f"{s}_")
        split = rest.where(~both).select("a", "b", "b_node", child("a")).select("a", "b", "a_", child("b")).where((F.col("a") != F.col("b")) | (F.col("a_") <= F.col("b_")))
        frontier = split.select(F.col("a_").alias("a"), F.col("b_").alias("b"))
        if level < depth and frontier.isEmpty():
            break
    members = cut(leaves.groupBy(F.struct(*node).alias("key")).agg(F.collect_list(F.struct("u", F.array(*WEIGHTS).alias("w"))).alias("m")).select(
        "key", F.flatten(F.transform("m", lambda x: x["u"])).alias("u"), F.flatten(F.transform("m", lambda x: x["w"])).alias("w")), "leaves")
    held = lambda s: members.select(F.col("key").alias(s), F.col("u").alias(f"u{s}"), F.col("w").alias(f"w{s}"))
    compared = reduce(DataFrame.unionByName, left).join(held("a"), "a").join(held("b"), "b").select("a._group", (F.col("a") == F.col("b")).alias("same"), "ua", "wa", "ub", "wb")
    schema = f"_group {compared.schema['_group'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    sums = compared.mapInArrow(lambda batches: _leaf_sums(batches, threshold), schema)
    out = reduce(DataFrame.unionByName, [*counted, sums]).groupBy("_group").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS])
    return out.select(F.col(f"_group.{group}").alias(group), *COUNTS)
