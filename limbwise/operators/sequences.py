"""Clip assembly and time-axis expressions (Q1-Q7, Q11, Q14-Q16).

A clip is ``seq ARRAY<ARRAY<DOUBLE>>`` (frames x features) in frame order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limbwise.functions.columns import doubles, let, steps
from limbwise.operators.landmarks import normalise_frames
from limbwise.settings import Settings


def limit_frames(frames: DataFrame, cap: int, stride: int = 1) -> DataFrame:
    """Read cap and stride as a filter that reaches the scan."""
    kept = frames.where(F.col("frame_idx") < cap)
    return kept.where(F.col("frame_idx") % stride == 0) if stride > 1 else kept


def build_clips(frames: DataFrame, value: str = "features", settings: Settings = Settings(),
                keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per clip: ``seq``, ``t``, ``usable`` and the first frame's ``keep`` columns.

    ``(clip_id, frame_idx)`` is the key of ``frames``; a clip is gathered whole, as long as it
    is. ``limit_frames`` is there for callers that want fewer. One shuffle on clip_id.
    """
    ordered = F.array_sort(F.collect_list(F.struct("frame_idx", F.col(value).alias("v"))))
    return frames.groupBy("clip_id").agg(
        F.transform(ordered, lambda s: s["v"]).alias("seq"), F.count("*").cast("int").alias("t"),
        F.count_if(F.exists("mask", lambda m: m > 0)).cast("int").alias("usable"),
        *[F.min_by(c, "frame_idx").alias(c) for c in keep])


def resample(seq: Column, length: int, width: int) -> Column:
    """Linear interpolation over normalised time to ``length`` frames."""
    def apply(s: Column) -> Column:
        t = F.size(s)
        def frame(i: Column) -> Column:
            pos = i * (t - 1) / F.lit(float(max(length - 1, 1)))
            lo = F.floor(pos).cast("int")
            return let(pos - lo, lambda frac: F.zip_with(
                F.get(s, lo), F.get(s, F.least(lo + 1, t - 1)), lambda a, b: a + (b - a) * frac))
        return (F.when(t == length, s)
                .when(t == 0, F.array_repeat(doubles(width), length))
                .otherwise(F.transform(steps(length), frame)))
    return let(seq, apply)


def resample_uniform(seq: Column, length: int) -> Column:
    """Existing frames at half-even rounded positions, de-duplicated, last one repeated."""
    def apply(s: Column) -> Column:
        t = F.size(s)
        spots = F.array_distinct(F.transform(steps(length), lambda i: F.rint(
            i * (t - 1) / F.lit(float(max(length - 1, 1)))).cast("int")))
        return let(F.transform(spots, lambda i: F.get(s, i)), lambda picked: F.slice(
            F.concat(picked, F.array_repeat(F.element_at(picked, -1), length)), 1, length))
    return F.when(F.size(seq) > 0, let(seq, apply))


def pad_or_crop(seq: Column, length: int, width: int, mode: str = "edge") -> Column:
    """Centre crop, or pad half in front and the rest behind.

    ``edge`` fills both sides with the last frame, ``edge_both`` uses the true edges,
    ``zero`` fills with zeros.
    """
    def apply(s: Column) -> Column:
        t = F.size(s)
        pad = F.greatest(F.lit(length) - t, F.lit(0))
        before = F.floor(pad / 2).cast("int")
        zero, last = doubles(width), F.element_at(s, -1)
        front = {"zero": zero, "edge": last, "edge_both": F.element_at(s, 1)}[mode]
        back = zero if mode == "zero" else last
        start = F.floor(F.greatest(t - length, F.lit(0)) / 2).cast("int") + 1
        return F.when(t > length, F.slice(s, start, F.lit(length))).otherwise(
            F.concat(F.array_repeat(front, before), s, F.array_repeat(back, pad - before)))
    return F.when(F.size(seq) > 0, let(seq, apply)).otherwise(F.array_repeat(doubles(width), length))


def windows(seq: Column, length: int, stride: int, width: int) -> Column:
    """``ARRAY`` of windows; the tail is dropped, a short clip gives one resampled window."""
    t = F.size(seq)
    starts = F.sequence(F.lit(0), F.greatest(t - length, F.lit(0)), F.lit(stride))
    return F.when(t < length, F.array(resample(seq, length, width))).otherwise(
        F.transform(starts, lambda i: F.slice(seq, i + 1, F.lit(length))))


def temporal_crop(seq: Column, fraction: float, u: Column) -> Column:
    """Keep max(2, half-even t*(1-fraction)) frames from a start drawn by ``u`` in [0, 1)."""
    if fraction <= 0:
        return seq
    t = F.size(seq)
    keep = F.greatest(F.lit(2), F.rint(t * F.lit(1.0 - fraction)).cast("int"))
    start = F.floor(u * (t - keep + 1)).cast("int")
    return F.when(t <= 2, seq).otherwise(F.slice(seq, start + 1, keep))


def repeat_frames(seq: Column, prob: float, u) -> Column:
    """Replace frames after the first by their original predecessor where ``u(i) < prob``."""
    if prob <= 0:
        return seq
    return F.when(F.size(seq) < 3, seq).otherwise(F.transform(seq, lambda f, i: F.when(
        (i > 0) & (u(i) < prob), F.get(seq, i - 1)).otherwise(f)))


def skip_frames(seq: Column, keep_ratio: float) -> Column:
    """Every k-th frame, k = max(2, half-even 1/ratio); fewer than 2 left gives first and last."""
    if keep_ratio >= 1.0:
        return seq
    step = max(2, round(1.0 / max(keep_ratio, 1e-6)))
    kept = F.filter(seq, lambda f, i: i % step == 0)
    return (F.when(F.size(seq) < 3, seq)
            .when(F.size(kept) < 2, F.array(F.element_at(seq, 1), F.element_at(seq, -1))).otherwise(kept))


def one_hot(index: Column, count: int) -> Column:
    return F.transform(steps(count), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def clip_sequences(frames: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Frames to one fixed-length normalised sequence per usable clip, plus the reasons of the rest.

    Normalisation is per frame and happens before the only shuffle.
    """
    feats = normalise_frames(frames, settings)
    clips = build_clips(feats, "features", settings, keep)
    few = F.col("usable") < settings.min_valid_frames
    return (clips.withColumn("reason", F.when(few, F.lit("too few usable frames")))
            .withColumn("seq", F.when(~few, resample(F.col("seq"), settings.sequence_length, settings.input_width))))


def landmark_trace(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Raw coordinates resampled to the timeline of the features."""
    flat = frames.withColumn("raw", F.flatten("coords"))
    clips = build_clips(flat, "raw", settings)
    return clips.where(F.col("usable") >= settings.min_valid_frames).withColumn(
        "seq", resample(F.col("seq"), settings.sequence_length, settings.layout.width))
