"""Nearest neighbours by inner product from a forest of random-projection trees (operator 9).

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, and queries a zero: the largest inner
product is then the smallest distance. Each tree splits at the median of a random projection. The forest is
fitted to a sample of at most ``SAMPLE`` vectors (documented bound); every row is routed to its leaf in every
tree. A query walks all trees at once through one priority queue ordered by the smallest margin on the
way to a node, and asks the first ``probes`` leaves it yields. Their number is fitted on the sample too: the
smallest that finds ``RECALL`` of the sample queries' true neighbours there, so unstructured vectors get a long
search and clustered ones a short one.

Neighbouring leaves and the queries that ask them meet in blocks of about ``BLOCK`` vectors as matrices; each block
returns the best of each query, scored again exactly, and only these are ranked.

Equal vectors are one entry. It carries its ``K`` + 1 smallest ids: larger ones can't be among the K
nearest, as ties go to smaller ids. Vectors that are null, zero, or hold null or non-finite components, rows
without id, and vectors whose length differs from that of most take no part. Repeated rows count once. Fewer
candidates than K: all of them. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limbwise.sources.workspace import cut

K, SAMPLE, TREES, RECALL = 20, 16_384, 3, 0.95
BLOCK = 16_384
PROBES = T.ArrayType(T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("leaves", T.ArrayType(T.IntegerType()))]))


class Forest(NamedTuple):
    """Full binary trees of ``depth``; node i has the children 2i+1 and 2i+2."""

    depth: int
    normals: np.ndarray    # (tree, node, component)
    offsets: np.ndarray    # (tree, node)
    largest: float         # norm
    probes: int


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.maximum(largest ** 2 - (x * x).sum(1), 0))[:, None]))


def plant(x: np.ndarray, depth: int, largest: float, seed: int = 11) -> Forest:
    """Trees over sample vectors: normals between two random members of the node, offsets at the median."""
    rng, points = np.random.default_rng(seed), lifted(x, largest)
    inner = 2 ** depth - 1
    normals, offsets = np.zeros((TREES, inner, points.shape[1])), np.zeros((TREES, inner))
    for tree in range(TREES):
        own = {0: np.arange(len(points))}
        for node in range(inner):
            here = own.pop(node)
            normal = rng.normal(size=points.shape[1])
            if len(here) > 1:
                a, b = points[rng.choice(here, 2, replace=False)]
                normal = a - b if np.any(a != b) else normal
            normal /= np.linalg.norm(normal)
            side = points[here] @ normal
            normals[tree, node], offsets[tree, node] = normal, np.median(side) if len(here) else 0.0
            own[2 * node + 1], own[2 * node + 2] = here[side < offsets[tree, node]], here[side >= offsets[tree, node]]
    return Forest(depth, normals, offsets, largest, TREES * 2 ** depth)


def leaves(x: np.ndarray, forest: Forest) -> np.ndarray:
    """(vector, tree) -> leaf."""
    points, out = lifted(x, forest.largest), np.zeros((len(x), TREES), np.int32)
    for tree in range(TREES):
        node = np.zeros(len(x), np.int64)
        for _ in range(forest.depth):
            side = np.einsum("ij,ij->i", points, forest.normals[tree, node]) >= forest.offsets[tree, node]
            node = 2 * node + 1 + side
        out[:, tree] = node - (2 ** forest.depth - 1)
    return out


def asked(query: np.ndarray, forest: Forest, most: int) -> list[tuple[int, int]]:
    """The first ``most`` leaves of all trees from one shared queue, nearest margin first."""
    point = np.append(query, 0.0)
    margin = forest.normals @ point - forest.offsets
    first = 2 ** forest.depth - 1
    queue, out = [(-np.inf, tree, 0) for tree in range(TREES)], []
    while queue and len(out) < most:
        cost, tree, node = heapq.heappop(queue)
        while node < first:
            m = margin[tree, node]
            near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (max(cost, abs(m)), tree, far))
            node = near
        out.append((tree, node - first))
    return out


def fit(x: np.ndarray, rows: int, largest: float, queries: int = 300) -> Forest:
    """A forest for ``rows`` vectors from sample ``x``, with the number of leaves to ask."""
    depth = int(np.clip(np.log2(max(rows, 1) / 1500), 2, max(2, np.log2(max(len(x), 1) / 16))))
    forest = plant(x, depth, largest)
    own, at = leaves(x, forest), np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
    rank = []
    for i in at:
        scores = x @ x[i]
        scores[i] = -np.inf
        near = np.argsort(-scores, kind="stable")[:K]
        order = {leaf: n for n, leaf in enumerate(asked(x[i], forest, forest.probes))}
        rank.append(np.min([[order[tree, own[j, tree]] for tree in range(TREES)] for j in near if j != i] or [[0]], 1))
    ranks = np.sort(np.concatenate(rank))
    return forest._replace(probes=int(ranks[int(np.ceil(RECALL * len(ranks))) - 1]) + 1)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the rows that take part, each once."""
    e = F.col("embedding")
    good = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(e, lambda c: c != 0)
    out = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(e, lambda c: c.cast("double") + 0.0).alias("v"))
    length = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return out.join(length, F.size("v") == F.col("n"), "left_semi").distinct()


def _key(v: Column) -> Column:
    return F.concat_ws("-", F.hex(F.xxhash64(v)), F.hex(F.xxhash64(F.lit(7), v)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def grouped(probes: list[tuple[int, int]], leaves_a_part: int) -> list[dict]:
    """Probes by tree and run of neighbouring leaves."""
    out: dict[tuple[int, int], list[int]] = {}
    for tree, leaf in probes:
        out.setdefault((tree, leaf // leaves_a_part), []).append(leaf)
    return [{"tree": t, "part": p, "leaves": found} for (t, p), found in out.items()]


def _best(asking: pa.Table, held: pa.Table) -> pa.Table:
    """The best ``K`` + 1 entries of a block for each query, among the leaves it asks; ties go to the smaller first id.

    Matrix products round otherwise than the exact score does, so all entries from the (``K`` + 1)-th down to twice the
    largest rounding error below it are scored again and ranked by score and first id.
    """
    out = pa.schema([("q", pa.string()), ("key", pa.string()), ("first", pa.int64()), ("score", pa.float64())])
    if not len(asking) or not len(held):
        return out.empty_table()
    vs, leaf = np.array(held["v"].to_pylist(), np.float64), held["leaf"].to_numpy()
    most, wanted, parts, at_once = min(K + 1, len(vs)), asking["leaves"].to_pylist(), [], 256
    qs, first = np.array(asking["qv"].to_pylist(), np.float64), held["first"].to_numpy()
    error = 4 * vs.shape[1] * np.finfo(np.float64).eps * np.sqrt((vs * vs).sum(1).max() * (qs * qs).sum(1))
    for lo in range(0, len(qs), at_once):
        here = qs[lo:lo + at_once]
        allowed = np.zeros((len(here), int(leaf.max()) + 1), bool)
        for i, found in enumerate(wanted[lo:lo + at_once]):
            allowed[i, [x for x in found if x < allowed.shape[1]]] = True
        rough = np.where(allowed[:, leaf], here @ vs.T, -np.inf)
        least = np.partition(rough, len(vs) - most, axis=1)[:, len(vs) - most] - 2 * error[lo:lo + at_once]
        row, col = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
        exact = (here[row] * vs[col]).sum(-1)
        order = np.lexsort((first[col], -exact, row))
        row, col = row[order], col[order]
        begins = np.searchsorted(row, row)
        kept = np.arange(len(row)) - begins < most
        parts.append((row[kept] + lo, col[kept]))
    q, v = (np.concatenate(x) for x in zip(*parts))
    return pa.table([asking["q"].take(pa.array(q)).cast(pa.string()), held["key"].take(pa.array(v)).cast(pa.string()),
                     held["first"].take(pa.array(v)).cast(pa.int64()), pa.array((qs[q] * vs[v]).sum(-1))], schema=out)


def nearest(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the nearest found for the rows where ``queries`` holds."""
    rows = cut(usable(vectors).withColumn("key", _key(F.col("v"))), "vectors")
    ids = rows.withColumn("_at", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("_at") <= k + 1)
    entries = cut(ids.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).join(
        ids.where("_at = 1").select("key", "v"), "key"), "entries")
    wanted = rows.where(queries).select(F.col("vec_id").alias("query_id"), "key")
    seen = entries.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))).first()
    total, largest = seen[0], float(seen[1] or 0.0)
    cents = max(1, min(10_000, int(10_000 * SAMPLE / max(total, 1))))
    sample = entries.where(F.pmod(F.xxhash64("key"), F.lit(10_000)) < cents).select("v").limit(2 * SAMPLE).collect()
    found = np.array([r["v"] for r in sample], np.float64)
    forest = fit(found, total, largest) if len(found) else Forest(0, np.zeros((TREES, 0, 1)), np.zeros((TREES, 0)), 0.0, TREES)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(list(leaves(_matrix(v), forest)) if len(v) else [], dtype=object)

    leaf_size = max(1, total // 2 ** forest.depth)
    leaves_a_part, splits = max(1, BLOCK // leaf_size), max(1, -(-leaf_size // BLOCK))
    parts_q = max(1, -(-total // (20 * BLOCK)))

    @F.pandas_udf(PROBES)
    def probed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series([grouped(asked(np.asarray(x, np.float64), forest, forest.probes), leaves_a_part) for x in v], dtype=object)
    searched = wanted.select("key").distinct()
    questions = entries.join(searched, "key", "left_semi").select(F.col("key").alias("q"), F.col("v").alias("qv"))
    split = lambda key, n: F.pmod(F.xxhash64(key, F.lit(3)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = (entries.select("key", "v", F.col("ids")[0].alias("first"), F.posexplode(placed("v")).alias("tree", "leaf"))
            .withColumn("part", F.floor(F.col("leaf") / leaves_a_part).cast("int")).withColumn("pv", split("key", splits)).withColumn("pq", every(parts_q)))
    asking = (questions.select("q", "qv", F.explode(probed("qv")).alias("p")).select("q", "qv", F.col("p.tree").alias("qt"), F.col("p.part").alias("ql"), "p.leaves")
              .withColumn("qq", split("q", parts_q)).withColumn("qp", every(splits)))
    best = asking.groupBy("qt", "ql", "qp", "qq").cogroup(held.groupBy("tree", "part", "pv", "pq")).applyInArrow(
        _best, "q string, key string, first bigint, score double")
    # an entry that k + 1 others precede by score and first id has no id among the k + 1 nearest
    by_entry = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    nearest_entries = (best.groupBy("q", "key", "first").agg(F.max("score").alias("score"))
                       .withColumn("_at", F.row_number().over(by_entry)).where(F.col("_at") <= k + 1).drop("_at"))
    top = (nearest_entries.join(entries.select("key", "ids"), "key")
           .select("q", "score", F.explode("ids").alias("vec_id")).withColumn("_at", F.row_number().over(by_score)).where(F.col("_at") <= k + 1))
    by_query = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return (wanted.distinct().join(top.withColumnRenamed("q", "key"), "key").where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
