"""Perturbation grid and degradation report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limbwise.functions.columns import doubles, let
from limbwise.functions.draws import uniform
from limbwise.operators import evaluation as ev
from limbwise.operators.augment import jitter
from limbwise.operators.sequences import resample, skip_frames
from limbwise.settings import Settings

# Condition names, kinds and strengths.
CONDITIONS = {
    "clean": ("clean", 0.0),
    "landmark_dropout_p10": ("dropout", 0.10),
    "landmark_dropout_p30": ("dropout", 0.30),
    "hand_left_missing": ("left_hand", 0.0),
    "hand_right_missing": ("right_hand", 0.0),
    "both_hands_missing": ("hands", 0.0),
    "gaussian_sigma_10": ("gaussian", 0.10),
    "gaussian_sigma_25": ("gaussian", 0.25),
    "gaussian_sigma_50": ("gaussian", 0.50),
    "frame_drop_p20": ("frame_drop", 0.20),
    "frame_drop_p40": ("frame_drop", 0.40),
    "frame_drop_p60": ("frame_drop", 0.60),
    "frame_skip_keep50": ("frame_skip", 0.5),
    "mask_missing": ("mask", 0.0),
}


def drop_landmarks(seq: Column, prob: float, key: list, settings: Settings) -> Column:
    """Zero each landmark of each frame whose draw falls below ``prob``."""
    lay = settings.layout

    def frame(f: Column, i: Column) -> Column:
        pts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(lay.landmarks - 1)), lambda j: F.when(
            uniform("landmark", *key, i, j) < prob, doubles(lay.axes)).otherwise(F.slice(f, j * lay.axes + 1, F.lit(lay.axes)))))
        return F.concat(pts, F.slice(f, lay.width + 1, F.greatest(F.size(f) - lay.width, F.lit(0))))
    return F.transform(seq, frame)


def blank_features(seq: Column, first: int, stop: int | None) -> Column:
    """Zero the feature columns first .. stop-1 (to the end when stop is None)."""
    inside = lambda d: (d >= first) if stop is None else (d >= first) & (d < stop)
    return F.transform(seq, lambda f: F.transform(f, lambda v, d: F.when(inside(d), 0.0).otherwise(v)))


def drop_frames(seq: Column, prob: float, key: list, settings: Settings) -> Column:
    """Remove frames at random and resample to the old length; all stay if under 5 survive."""
    def apply(s: Column) -> Column:
        kept = F.filter(s, lambda f, i: uniform("drop", *key, i) >= prob)
        return let(kept, lambda k: resample(F.when(F.size(k) < settings.min_valid_frames, s).otherwise(k),
                                            settings.sequence_length, settings.input_width))
    return let(seq, apply)


def perturb(seq: Column, name: str, key: list, settings: Settings = Settings()) -> Column:
    """One named condition applied to a fixed-length sequence."""
    lay = settings.layout
    op, level = CONDITIONS[name]
    cols = lambda g: lay.span(g)[0] * lay.axes
    end = lambda g: sum(lay.span(g)) * lay.axes
    if op == "dropout":
        return drop_landmarks(seq, level, key, settings)
    if op in ("left_hand", "right_hand"):
        return blank_features(seq, cols(op), end(op))
    if op == "hands":
        return blank_features(seq, cols("left_hand"), end("right_hand"))
    if op == "gaussian":
        return jitter(seq, level, key, lay, op="gauss", whole=settings.with_mask)
    if op == "frame_drop":
        return drop_frames(seq, level, key, settings)
    if op == "frame_skip":
        return resample(skip_frames(seq, level), settings.sequence_length, settings.input_width)
    if op == "mask":
        return blank_features(seq, lay.width, None) if settings.with_mask else seq
    return seq


def condition_grid(sequences: DataFrame, models: Sequence[str], protocol: str,
                   conditions: Sequence[str] = tuple(CONDITIONS), settings: Settings = Settings()) -> DataFrame:
    """Every sequence under every (model, condition); draws are keyed by both and the protocol.

    The normalised sequences are built once and only then multiplied.
    """
    grid = (sequences.withColumn("model", F.explode(F.array(*map(F.lit, models))))
            .withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))))
    key = [settings.seed, F.col("condition"), F.col("model"), protocol, F.col("clip_id")]
    out = F.col("seq")
    for name in conditions:
        if CONDITIONS[name][0] != "clean":
            out = F.when(F.col("condition") == name, perturb(F.col("seq"), name, key, settings)).otherwise(out)
    return grid.withColumn("seq", out).withColumn("protocol", F.lit(protocol))


def condition_metrics(scored: DataFrame, keys: Sequence[str] = ("protocol", "split", "model", "condition"),
                      settings: Settings = Settings()) -> DataFrame:
    """Scores per condition with the mean confidence and the count below the gate.

    ``scored`` carries ``y_true``, ``y_pred`` and ``confidence``; one pass counts cells and
    sums confidences, the rest works on the cells.
    """
    keys = list(keys)
    cells = scored.groupBy(*keys, "y_true", "y_pred").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("_conf"),
        F.count_if(F.col("confidence") < settings.confidence_threshold).alias("_below"))
    scores = ev.averages(ev.per_class(cells, keys), keys)
    gate = cells.groupBy(*keys).agg((F.sum("_conf") / F.sum("n")).alias("mean_confidence"),
                                    F.sum("_below").alias("n_below_threshold"))
    return scores.join(gate, keys)


def deltas(metrics: DataFrame, keys: Sequence[str] = ("protocol", "split", "model")) -> DataFrame:
    """Differences to the clean row and the relative drop in percent."""
    w = Window.partitionBy(*keys)
    clean = lambda c: F.max(F.when(F.col("condition") == "clean", F.col(c))).over(w)
    return (metrics.withColumn("_a", clean("accuracy")).withColumn("_f", clean("macro_f1"))
            .withColumn("accuracy_delta", F.round(F.col("accuracy") - F.col("_a"), 6))
            .withColumn("macro_f1_delta", F.round(F.col("macro_f1") - F.col("_f"), 6))
            .withColumn("relative_accuracy_drop_pct", F.round(
                100 * (F.col("_a") - F.col("accuracy")) / F.greatest(F.col("_a"), F.lit(1e-9)), 3))
            .drop("_a", "_f"))


def best_per_condition(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """Most accurate model per condition; the first in model order wins ties."""
    position = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    w = Window.partitionBy("protocol", "split", "condition").orderBy(F.desc("accuracy"), position)
    return metrics.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
