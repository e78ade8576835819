"""Dataset audit: presence rates, signatures, near-duplicates, balance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limbwise.functions.columns import dot, keyed_join, one_row, ratio, total
from limbwise.functions.draws import lane, digest
from limbwise.functions.quantiles import exact_percentiles
from limbwise.operators.landmarks import group_flags, normalise
from limbwise.operators.nearcounts import COUNTS, WEIGHTS, inner_counts, near_counts
from limbwise.settings import Settings

RATES = ("pose_rate", "left_hand_rate", "right_hand_rate", "any_hand_rate", "both_hands_rate", "empty_frame_rate")


def clip_rates(frames: DataFrame, settings: Settings = Settings(), keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Share of frames showing each group, mean present points, whether z is used."""
    flags = group_flags(F.col("mask"), settings.layout)
    rate = lambda c: F.avg(c.cast("double"))
    names = dict(zip(("pose", "left_hand", "right_hand", "any_hand", "both_hands", "empty"), RATES))
    present = F.size(F.filter("mask", lambda m: m > 0))
    depth = F.array_max(F.transform("coords", lambda p: F.abs(p[2])))
    return frames.groupBy(*keys).agg(
        F.count("*").alias("n_frames"), *[rate(flags[k]).alias(v) for k, v in names.items()],
        F.avg(present).alias("mean_present"), (F.max(depth) > 1e-9).alias("z_available"))


def clip_status(index: DataFrame, rates: DataFrame, problems: DataFrame) -> DataFrame:
    """ok, corrupt (damaged or zero frames) or unreadable, with the error text."""
    joined = index.join(rates, "clip_id", "left").join(
        problems.select("clip_id", F.col("status").alias("_bad"), F.col("error").alias("_err")), "clip_id", "left")
    empty = F.coalesce("n_frames", F.lit(0)) == 0
    return (joined.withColumn("status", F.coalesce("_bad", F.when(empty, "corrupt").otherwise("ok")))
            .withColumn("error", F.coalesce("_err", F.when(F.col("_bad").isNull() & empty, "zero frames").otherwise("")))
            .withColumn("n_frames", F.coalesce("n_frames", F.lit(0))).drop("_bad", "_err"))


def signatures(frames: DataFrame, settings: Settings = Settings(), first_frames: int = 90, min_points: int = 10,
               keep: Sequence[str] = ()) -> DataFrame:
    """Mean normalised pose x, y of a clip's early frames as ``sig ARRAY<DOUBLE>``.

    A fixed number of scalar averages in one partial aggregate; no frame list is built.
    Rounded to 12 digits, since partial sums may arrive in any order.
    """
    lay = settings.layout
    n = lay.span("pose")[1]
    enough = F.size(F.filter(F.slice("mask", 1, n), lambda m: m > 0)) >= min_points
    poses = (frames.where((F.col("frame_idx") < first_frames) & enough)
             .withColumn("_n", F.flatten(F.transform(F.slice(normalise(F.col("coords"), F.col("mask"), lay), 1, n),
                                                     lambda p: F.slice(p, 1, 2)))))
    return poses.groupBy("clip_id", *keep).agg(
        F.array(*[F.round(F.avg(F.get("_n", F.lit(d))), 12) for d in range(2 * n)]).alias("sig"))


# -- near-duplicates ---------------------------------------------------------
def _unit(sig: Column) -> Column:
    return F.transform(sig, lambda v: v / F.sqrt(dot(sig, sig)))


def _project(u: Column, k: int) -> Column:
    """Projection on the k-th direction, a unit vector with signs drawn by position: |projection difference| <= distance."""
    sign = lambda i: F.when(F.xxhash64(F.lit(k), i).bitwiseAND(F.lit(1)) == 0, -1.0).otherwise(1.0)
    return total(F.transform(u, lambda v, i: v * sign(i))) / F.sqrt(F.size(u).cast("double"))


def duplicate_groups(signed: DataFrame, group: str = "label") -> DataFrame:
    """Clips of a label with exactly the same signature as one row with counts per split.

    Copies are collapsed before any pairing, so a group of copies costs one row.
    """
    usable = signed.where(F.sqrt(dot(F.col("sig"), F.col("sig"))) >= 1e-6)
    return usable.groupBy(group, "sig").agg(
        F.min("clip_id").alias("rep"), F.count("*").alias("copies"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")])


def similar_representatives(groups: DataFrame, group: str = "label", threshold: float = 0.999,
                            directions: int = 6, grid: int = 2) -> DataFrame:
    """Pairs of distinct signatures of one label with cosine above the threshold - exact.

    Unit vectors with cosine > c lie within r = sqrt(2 - 2c), so their projections on any
    unit direction differ by at most r. Two projections form a grid of cell width r:
    each row visits its own cell, partners visit the neighbours. The other projections
    are compared in the join condition before the full cosine is computed.
    """
    radius = math.sqrt(2.0 - 2.0 * threshold) + 1e-9
    unit = groups.withColumn("_u", _unit(F.col("sig")))
    # candidates meet with ids and projections only; vectors are fetched for those that are left
    proj = unit.select(group, "rep", F.array(*[_project(F.col("_u"), k) for k in range(directions)]).alias("_p"))
    cell = [F.floor(F.col("_p")[k] / radius).cast("bigint") for k in range(grid)]
    side = lambda s, p: proj.select(F.col(group).alias(f"g{s}"), F.col("rep").alias(s), F.col("_p").alias(p), *[c.alias(f"c{k}{s}") for k, c in enumerate(cell)])
    left, right = side("a", "pa"), side("b", "pb")
    for k in range(grid):
        right = right.withColumn(f"c{k}b", F.explode(F.array(*[F.col(f"c{k}b") + d for d in (-1, 0, 1)])))
    near = (F.col("ga") == F.col("gb")) & (F.col("a") < F.col("b"))
    for k in range(grid):
        near = near & (F.col(f"c{k}a") == F.col(f"c{k}b"))
    for k in range(directions):
        near = near & (F.abs(F.col("pa")[k] - F.col("pb")[k]) <= radius)
    pairs = left.join(right, near).select(F.col("ga").alias(group), "a", "b")
    vector = lambda s: unit.select(group, F.col("rep").alias(s), F.col("_u").alias(f"u{s}"))
    return (pairs.join(vector("a"), [group, "a"]).join(vector("b"), [group, "b"])
            .withColumn("similarity", dot(F.col("ua"), F.col("ub")))
            .where(F.col("similarity") > threshold)
            .select(group, "a", "b", "similarity"))


def duplicate_counts(signed: DataFrame, group: str = "label", threshold: float = 0.999) -> DataFrame:
    """Per label: pairs checked, near-duplicate pairs, pairs across splits (two readings).

    ``cross_any`` counts pairs whose splits differ with a train or test side, ``cross_train_test``
    only train against test. Copies are counted combinatorially, other pairs over a recursive grid (``nearcounts``).
    """
    groups = duplicate_groups(signed, group).withColumn("u", _unit(F.col("sig")))
    radius = math.sqrt(2.0 - 2.0 * threshold) + 1e-9
    cells = [F.floor(_project(F.col("u"), k) / radius).cast("bigint") for k in range(2)]
    own = inner_counts({c: F.col(c) for c in WEIGHTS})
    sizes = groups.groupBy(group).agg(F.sum("copies").alias("copies"))
    inner = groups.select(group, *[own[c].alias(c) for c in COUNTS])
    sums = inner.unionByName(near_counts(groups, cells, radius, group, threshold)).groupBy(group).agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS])
    checked = (F.col("copies") * (F.col("copies") - 1) / 2).cast("bigint")
    return keyed_join(sizes, sums, [group], "left").select(
        group, checked.alias("pairs_checked"), F.col("dup").alias("near_duplicates"), "cross_any", "cross_train_test")


def top_duplicate_pairs(signed: DataFrame, limit: int = 200, group: str = "label", threshold: float = 0.999) -> DataFrame:
    """The ``limit`` most similar clip pairs (similarity to 6 digits, then label and ids).

    Members of a signature group tie, so only the first ``limit + 1`` ids of a group can
    appear in the answer; pairs are listed from those alone.
    """
    groups = duplicate_groups(signed, group)
    rank = Window.partitionBy(group, "sig").orderBy("clip_id")
    members = (signed.join(groups.select(group, "sig", "rep"), [group, "sig"])
               .withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= limit + 1)
               .select(group, "rep", "clip_id", "split"))
    reps = (similar_representatives(groups, group, threshold)
            .unionByName(groups.where(F.col("copies") > 1).select(group, F.col("rep").alias("a"), F.col("rep").alias("b"),
                                                                  F.lit(1.0).alias("similarity")))
            .withColumn("similarity", F.round("similarity", 6))
            # each entry yields a clip pair that precedes all pairs of later entries (one tie per "a")
            .orderBy(F.desc("similarity"), group, "a", "b").limit(limit + 1))
    first = members.select(group, F.col("rep").alias("a"), F.col("clip_id").alias("ca"), F.col("split").alias("sa"))
    second = members.select(group, F.col("rep").alias("b"), F.col("clip_id").alias("cb"), F.col("split").alias("sb"))
    pairs = reps.join(first, [group, "a"]).join(second, [group, "b"]).where(
        (F.col("a") != F.col("b")) | (F.col("ca") < F.col("cb")))
    lo, hi = F.least("ca", "cb"), F.greatest("ca", "cb")
    return (pairs.select(group, lo.alias("clip_a"), hi.alias("clip_b"), "similarity",
                         F.when(F.col("ca") < F.col("cb"), F.col("sa")).otherwise(F.col("sb")).alias("split_a"),
                         F.when(F.col("ca") < F.col("cb"), F.col("sb")).otherwise(F.col("sa")).alias("split_b"))
            .orderBy(F.desc("similarity"), group, "clip_a", "clip_b").limit(limit))


# -- inventories and distributions -------------------------------------------
def class_inventory(clips: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Counts by split, usable and damaged clips, and the frame range per class.

    Frame counts are integers below the read cap, so the exact median stays small.
    """
    ok = F.col("status") == "ok"
    frames = F.when(ok, F.col("n_frames"))
    return clips.groupBy("label").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in splits],
        F.count_if(ok).alias("usable"), F.count_if(~ok).alias("corrupt"),
        F.coalesce(F.percentile(frames, F.lit(0.5)), F.lit(0.0)).alias("frames_median"),
        F.coalesce(F.min(frames), F.lit(0)).alias("frames_min"), F.coalesce(F.max(frames), F.lit(0)).alias("frames_max"))


def frame_statistics(clips: DataFrame) -> DataFrame:
    """Length statistics of usable clips (population deviation)."""
    ok = clips.where(F.col("status") == "ok")
    return ok.agg(F.avg("n_frames").alias("mean"), F.stddev_pop("n_frames").alias("std"),
                  *[F.percentile("n_frames", F.lit(q / 100)).alias(f"p{q}") for q in (5, 25, 50, 75, 95)],
                  F.min("n_frames").alias("min"), F.max("n_frames").alias("max"))


def rate_distribution(clips: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Mean, median, p5 and p95 of each presence rate over usable clips."""
    measures = {**{r: F.col(r) for r in RATES if r != "any_hand_rate"},
                "present_share": F.col("mean_present") / settings.layout.landmarks}
    long = clips.where(F.col("status") == "ok").select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in measures.items()])).alias("m")).select("m.*")
    means = long.groupBy("measure").agg(F.avg("v").alias("mean"))
    return means.join(exact_percentiles(long, ["measure"], F.col("v"), {"p5": 0.05, "p50": 0.5, "p95": 0.95}), "measure")


def low_hand_clips(clips: DataFrame, examples: int = 5) -> DataFrame:
    """Clips with hands in under half the frames and in none: count and first names."""
    ok = clips.where(F.col("status") == "ok")
    kinds = {"under_half": F.col("any_hand_rate") < 0.5, "none": F.col("any_hand_rate") == 0}
    tagged = ok.select("clip_id", F.explode(F.array_compact(F.array(*[
        F.when(test, F.lit(k)) for k, test in kinds.items()]))).alias("kind"))
    counts = tagged.groupBy("kind").agg(F.count("*").alias("clips"))
    firsts = None
    for k in kinds:
        part = tagged.where(F.col("kind") == k).orderBy("clip_id").limit(examples)
        firsts = part if firsts is None else firsts.unionByName(part)
    names = firsts.groupBy("kind").agg(F.array_sort(F.collect_list("clip_id")).alias("examples"))
    return counts.join(names, "kind")


def length_buckets(clips: DataFrame, settings: Settings = Settings()) -> DataFrame:
    n, target = F.col("n_frames"), settings.sequence_length
    return clips.where(F.col("status") == "ok").agg(
        F.count_if(n < settings.min_valid_frames).alias("too_short"), F.count_if(n < target).alias("below"),
        F.count_if(n > target).alias("above"), F.count_if(n == target).alias("equal"))


def resolutions(clips: DataFrame, limit: int = 6) -> DataFrame:
    return (clips.groupBy("height", "width").agg(F.count("*").alias("videos"))
            .orderBy(F.desc("videos"), "height", "width").limit(limit))


def class_balance(vocabulary: DataFrame, clips: DataFrame, small: int = 10) -> DataFrame:
    """Spread of usable clips per vocabulary class and the classes a test cannot score."""
    ok = clips.where(F.col("status") == "ok")
    per = ok.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("n_test"))
    full = vocabulary.join(per, "label", "left").select(
        "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_test", F.lit(0)).alias("n_test"))
    return full.agg(F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"),
                    (F.max("n") / F.greatest(F.min("n"), F.lit(1))).alias("imbalance"),
                    F.count_if(F.col("n") < small).alias("small_classes"),
                    F.count_if(F.col("n_test") == 0).alias("classes_without_test"))


def dataset_rollup(clips: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One summary row of the audited index."""
    ok = F.col("status") == "ok"
    main = clips.agg(F.count("*").alias("total_videos"), F.count_if(ok).alias("usable_videos"),
                     F.count_if(~ok).alias("corrupt_videos"),
                     *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")],
                     F.percentile(F.when(ok, F.col("n_frames")), F.lit(0.5)).alias("frames_median"),
                     F.min(F.when(ok, F.col("n_frames"))).alias("frames_min"),
                     F.max(F.when(ok, F.col("n_frames"))).alias("frames_max"))
    classes = vocabulary.select("label").distinct().agg(F.count("*").alias("num_classes"))
    return one_row(main, classes)


def corrupt_by_class(clips: DataFrame) -> DataFrame:
    return clips.where(F.col("status") != "ok").groupBy("label").agg(F.count("*").alias("corrupt"))


def extraction_statistics(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detector success per clip. ``both_hands_bound`` is min(left, right)/n, an upper bound of
    ``both_hands_rate``, the share of frames that show both."""
    pose, left, right = (F.col(c).isNotNull() for c in ("pose", "left_hand", "right_hand"))
    out = raw.groupBy(*keys).agg(
        F.count("*").alias("frames_read"), F.count_if(pose).alias("frames_with_pose"),
        F.count_if(left).alias("frames_with_left_hand"), F.count_if(right).alias("frames_with_right_hand"),
        F.count_if(left | right).alias("frames_with_any_hand"), F.count_if(~(pose | left | right)).alias("frames_with_nothing"),
        F.count_if(left & right).alias("_both"))
    n = F.col("frames_read")
    return (out.withColumn("extraction_success", ratio(n - F.col("frames_with_nothing"), n))
            .withColumn("both_hands_bound", ratio(F.least("frames_with_left_hand", "frames_with_right_hand"), n))
            .withColumn("both_hands_rate", ratio(F.col("_both"), n)).drop("_both"))


def buffer_statistics(raw: DataFrame, session: str, time: str) -> DataFrame:
    """Live presence rates and frame rate per session (elapsed time is at least 1 microsecond)."""
    stats = extraction_statistics(raw, [session])
    span = raw.groupBy(session).agg(((F.max(F.unix_micros(time)) - F.min(F.unix_micros(time))) / 1e6).alias("_s"))
    n = F.greatest(F.col("frames_read"), F.lit(1))
    return stats.join(span, session).select(
        session, F.col("frames_read").alias("frames_seen"), (F.col("frames_with_pose") / n).alias("pose_rate"),
        (F.col("frames_with_left_hand") / n).alias("left_hand_rate"), (F.col("frames_with_right_hand") / n).alias("right_hand_rate"),
        (F.col("frames_with_nothing") / n).alias("empty_rate"),
        (F.col("frames_read") / F.greatest(F.col("_s"), F.lit(1e-6))).alias("fps"))


def length_histogram(clips: DataFrame, bins: int = 40) -> DataFrame:
    """Equal-width histogram between the shortest and the longest usable clip."""
    counts = clips.where((F.col("status") == "ok") & (F.col("n_frames") > 0)).groupBy("n_frames").agg(F.count("*").alias("n"))
    edge = lambda f: counts.agg(f("n_frames")).scalar()
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_no = F.when(width == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor(F.try_divide(F.col("n_frames") - F.col("_lo"), width)), F.lit(bins - 1)))
    return (counts.withColumn("_lo", edge(F.min)).withColumn("_hi", edge(F.max)).select(bin_no.cast("int").alias("bin"), "n")
            .groupBy("bin").agg(F.sum("n").alias("clips")))


def class_quartiles(clips: DataFrame) -> DataFrame:
    return clips.where((F.col("status") == "ok") & (F.col("n_frames") > 0)).groupBy("label").agg(
        *[F.percentile("n_frames", F.lit(q)).alias(name) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
        F.count("*").alias("clips"))
