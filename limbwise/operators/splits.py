"""Recording clusters, leakage-free splits and leakage checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limbwise.functions.columns import keyed_join, one_row
from limbwise.functions.draws import digest
from limbwise.functions.scans import Scan, hash_slice, running
from limbwise.operators.metadata import session_id
from limbwise.settings import Settings
from limbwise.sources.workspace import cut


def session_clusters(index: DataFrame, max_gap: int = 10, slice_width: int = 100_000) -> DataFrame:
    """Add ``cluster``: bursts of numeric session ids of one label, key ``label:start-end``.

    A new cluster starts when the gap to the previous id exceeds ``max_gap``. Non-numeric
    ids share ``label:other``. The scan runs over distinct (label, id) pairs in slices of
    the id range, so neither a large label nor a repeated id fills one task.
    """
    keyed = (index.withColumn("_id", session_id(F.col("FilePath")))
             .withColumn("_sid", F.when(F.col("_id").rlike("^\\d+$"), F.col("_id").try_cast("decimal(38,0)"))).drop("_id"))
    ids = cut(keyed.where(F.col("_sid").isNotNull()).select("label", "_sid").distinct()
              .withColumn("_slice", F.floor(F.col("_sid") / slice_width)), "session-ids")
    order = [F.col("_sid")]
    near = cut(running(ids, ["label"], "_slice", order, {
        "_prev": Scan("max", F.col("_sid"), inclusive=False),
        "_next": Scan("min", F.col("_sid"), backward=True, inclusive=False)}), "session-gaps")
    starts = F.coalesce(F.col("_sid") - F.col("_prev") > max_gap, F.lit(True))
    ends = F.coalesce(F.col("_next") - F.col("_sid") > max_gap, F.lit(True))
    spans = running(near, ["label"], "_slice", order, {
        "_start": Scan("max", F.when(starts, F.col("_sid"))),
        "_end": Scan("min", F.when(ends, F.col("_sid")), backward=True)})
    named = spans.select("label", "_sid", F.concat_ws(
        "", "label", F.lit(":"), F.col("_start").cast("string"), F.lit("-"), F.col("_end").cast("string")).alias("_name"))
    return (keyed_join(keyed, named, ["label", "_sid"], "left")
            .withColumn("cluster", F.coalesce("_name", F.concat(F.col("label"), F.lit(":other"))))
            .select(*index.columns, "cluster"))


def allocate(sizes: np.ndarray, counts: np.ndarray, quotas: dict[str, int]) -> dict[str, np.ndarray]:
    """Best-fit whole clusters to quotas, given how many clusters of each size exist.

    Each step takes the size nearest to the open quota (the larger on ties). It stops when
    the quota is met, or when the next cluster would overfill and 60 % is reached. A size
    that fits stays the best choice until it no longer fits, so equal picks go in one step.
    """
    free = counts.copy()
    taken = {}
    for name, quota in quotas.items():
        take, filled = np.zeros_like(free), 0
        while filled < quota and free.any():
            live = np.flatnonzero(free)
            room = quota - filled
            gap = np.abs(room - sizes[live])
            best = live[np.lexsort((-sizes[live], gap))[0]]
            size = int(sizes[best])
            if size > room and filled >= 0.6 * quota:
                break
            n = min(int(free[best]), max(1, room // size))
            free[best] -= n
            take[best] += n
            filled += n * size
        taken[name] = take
    return taken


def cluster_disjoint_split(clustered: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Replace ``split`` so that no recording cluster spans two splits.

    The allocation only depends on how many clusters of each size a label has, so each
    label's group holds its distinct sizes (about the square root of its clips at most).
    Within a size, clusters are chosen in md5 order by a sliced running count. Rows without
    a label or cluster belong to no group and stay in train.
    """
    sizes = cut(clustered.where(F.col("label").isNotNull() & F.col("cluster").isNotNull()).groupBy("label", "cluster").agg(F.count("*").alias("_size")), "cluster-sizes")
    histogram = sizes.groupBy("label", "_size").agg(F.count("*").alias("_clusters"))
    val, test = settings.val_fraction, settings.test_fraction

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        s, c = pdf["_size"].to_numpy(), pdf["_clusters"].to_numpy()
        n = int((s * c).sum())
        taken = allocate(s, c, {"test": max(1, round(n * test)), "val": max(1, round(n * val))})
        return pd.DataFrame({"label": pdf["label"], "_size": s, "_test": taken["test"], "_val": taken["val"]})

    quota = histogram.groupBy("label").applyInPandas(plan, "label string, _size bigint, _test bigint, _val bigint")
    hashed = (keyed_join(sizes, quota, ["label", "_size"])
              .withColumn("_h", digest(settings.seed, F.col("cluster"))).withColumn("_slice", hash_slice(F.col("_h"))))
    ranked = running(hashed, ["label", "_size"], "_slice", [F.col("_h"), F.col("cluster")],
                     {"_rank": Scan("sum", F.lit(1))})
    chosen = ranked.select("label", "cluster", F.when(F.col("_rank") <= F.col("_test"), "test").when(
        F.col("_rank") <= F.col("_test") + F.col("_val"), "val").otherwise("train").alias("split"))
    return (keyed_join(clustered.drop("split"), chosen, ["label", "cluster"], "left")
            .withColumn("split", F.coalesce("split", F.lit("train"))))


def session_carve_out(train: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Split ``train`` into train and val: whole sessions in md5 order until the target is met.

    The last session may overshoot; the target is max(1, half-even n * val_fraction) per label.
    Rows without a label or path stay in train.
    """
    if settings.val_fraction <= 0:
        return train.withColumn("split", F.lit("train"))
    keyed = train.withColumn("_sid", session_id(F.col("FilePath")))
    sessions = keyed.where(F.col("label").isNotNull() & F.col("_sid").isNotNull()).groupBy("label", "_sid").agg(F.count("*").alias("_n"))
    target = sessions.groupBy("label").agg(F.greatest(F.lit(1), F.rint(
        F.sum("_n") * F.lit(settings.val_fraction)).cast("bigint")).alias("_target"))
    hashed = (sessions.withColumn("_h", digest(settings.seed, F.col("label"), F.col("_sid")))
              .withColumn("_slice", hash_slice(F.col("_h"))))
    summed = running(hashed, ["label"], "_slice", [F.col("_h"), F.col("_sid")],
                     {"_before": Scan("sum", F.col("_n"), inclusive=False)}).join(target, "label")
    side = F.when(F.col("_before") < F.col("_target"), "val").otherwise("train").alias("split")
    return (keyed_join(keyed.drop("split"), summed.select("label", "_sid", side), ["label", "_sid"], "left")
            .withColumn("split", F.coalesce("split", F.lit("train"))).drop("_sid"))


def build_index(train: DataFrame, test: DataFrame, protocol: str, val: DataFrame | None = None,
                settings: Settings = Settings()) -> DataFrame:
    """Canonical index of a protocol, ``session_disjoint``, ``official`` or ``hf``, as a stored table."""
    if protocol == "session_disjoint":
        pool = train.unionByName(test)
        index = cluster_disjoint_split(session_clusters(pool, settings.cluster_gap), settings)
        return cut(index.select(*train.columns), "index")
    as_split = lambda df, name: df.withColumn("split", F.lit(name))
    if protocol == "official":
        return cut(session_carve_out(train, settings).select(*train.columns).unionByName(as_split(test, "test")), "index")
    if protocol == "hf":
        return as_split(train, "train").unionByName(as_split(val, "val")).unionByName(as_split(test, "test"))
    raise ValueError(f"unknown split protocol: {protocol}")


def split_summary(index: DataFrame, protocol: str) -> DataFrame:
    """One row: clips and classes per split, and sessions shared by train and test."""
    splits = ("train", "val", "test")
    # classes and sessions are reduced to distinct rows before they are counted
    clips = index.groupBy("split").agg(F.count("*").alias("n"))
    classes = index.select("split", "label").distinct().groupBy("split").agg(F.count("*").alias("classes"))
    pivot = clips.join(classes, "split").agg(
        *[F.coalesce(F.max(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s) for s in splits],
        *[F.coalesce(F.max(F.when(F.col("split") == s, F.col("classes"))), F.lit(0)).alias(f"classes_{s}") for s in splits])
    overlap = shared_sessions(index).agg(F.count("*").alias("session_overlap_train_test"))
    return one_row(pivot, overlap).withColumn("protocol", F.lit(protocol))


#: How each protocol comes by its validation split
VAL_STRATEGY = {"session_disjoint": "whole_clusters", "official": "whole_train_sessions", "hf": "given"}


def index_summary(index: DataFrame, protocol: str, settings: Settings = Settings()) -> DataFrame:
    """``split_summary`` with ``val_strategy`` and the settings that the split depends on."""
    drawn = protocol != "hf"
    return split_summary(index, protocol).withColumn("val_strategy", F.lit(VAL_STRATEGY[protocol])).withColumn(
        "val_fraction", F.lit(settings.val_fraction if drawn else None).cast("double")).withColumn("seed", F.lit(settings.seed if drawn else None).cast("bigint"))


def official_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row over the splits as published, before validation is carved out: sessions of ``test``, and how many of them ``train`` has too."""
    ids = lambda df: df.select(session_id(F.col("FilePath")).alias("session")).distinct()
    both = ids(test).join(ids(train).withColumn("_hit", F.lit(1)), "session", "left")
    return both.agg(F.count("*").alias("test_sessions"), F.count("_hit").alias("overlap"))


def spanning_clusters(clustered: DataFrame) -> DataFrame:
    """Clusters present in more than one split."""
    return (clustered.select("cluster", "split").distinct().groupBy("cluster")
            .agg(F.count("*").alias("splits")).where(F.col("splits") > 1))


def shared_sessions(index: DataFrame, a: str = "train", b: str = "test") -> DataFrame:
    """Session ids (as text, across labels) that occur in both splits."""
    ids = index.select("split", session_id(F.col("FilePath")).alias("session"))
    return ids.where(F.col("split") == a).select("session").intersect(ids.where(F.col("split") == b).select("session"))


def duplicate_paths(index: DataFrame) -> DataFrame:
    return index.groupBy("FilePath").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def cross_split_paths(index: DataFrame, a: str = "train", b: str = "test") -> DataFrame:
    side = lambda s: index.where(F.col("split") == s).select("FilePath")
    return side(a).intersect(side(b))


def one_sided_classes(index: DataFrame) -> DataFrame:
    """Classes that occur in train but not in test, or in test but not in train."""
    side = lambda s: index.where(F.col("split") == s).select("label").distinct()
    only = lambda x, y, name: side(x).join(side(y), "label", "left_anti").withColumn("side", F.lit(name))
    return only("train", "test", "train_only").unionByName(only("test", "train", "test_only"))
