"""Seeded augmentation and the training set (Q5-Q10, Q12, Q13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limbwise.functions.columns import doubles, let
from limbwise.functions.draws import digest, normals, uniform
from limbwise.operators.landmarks import mirror
from limbwise.operators.sequences import repeat_frames, resample, temporal_crop
from limbwise.settings import Layout, Settings


def drop_groups(seq: Column, prob: float, key: list, layout: Layout) -> Column:
    """Zero a whole group in a frame where its draw falls below ``prob``."""
    if prob <= 0:
        return seq

    def frame(f: Column, i: Column) -> Column:
        parts = []
        for name, count in layout.groups:
            first = layout.span(name)[0] * layout.axes
            n = count * layout.axes
            hit = uniform("group", *key, i, name) < prob
            parts.append(F.when(hit, doubles(n)).otherwise(F.slice(f, first + 1, n)))
        rest = F.slice(f, layout.width + 1, F.greatest(F.size(f) - layout.width, F.lit(0)))
        return F.concat(*parts, rest)
    return F.transform(seq, frame)


def jitter(seq: Column, sigma: float, key: list, layout: Layout, op: str = "jitter", whole: bool = False) -> Column:
    """Add seeded Gaussian noise to coordinates (and to mask columns only when ``whole``).

    One digest per (frame, landmark) gives the three normals of its axes.
    """
    if sigma <= 0:
        return seq

    def frame(f: Column, i: Column) -> Column:
        noise = lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                                lambda j: normals(digest(op, *key, i, j))))
        coords = F.zip_with(F.slice(f, 1, layout.width), noise(layout.landmarks), lambda v, z: v + z * sigma)
        rest = F.slice(f, layout.width + 1, F.greatest(F.size(f) - layout.width, F.lit(0)))
        if whole:  # noise for the mask columns comes from landmark numbers past the layout
            extra = F.slice(F.flatten(F.transform(
                F.sequence(F.lit(layout.landmarks), F.lit(2 * layout.landmarks)),
                lambda j: normals(digest(op, *key, i, j)))), F.lit(1), F.size(rest))
            rest = F.when(F.size(rest) > 0, F.zip_with(rest, extra, lambda v, z: v + z * sigma)).otherwise(rest)
        return F.concat(coords, rest)
    return F.transform(seq, frame)


def mirror_sequence(seq: Column, layout: Layout) -> Column:
    def frame(f: Column) -> Column:
        pts = F.transform(F.sequence(F.lit(0), F.lit(layout.landmarks - 1)),
                          lambda j: F.slice(f, j * layout.axes + 1, F.lit(layout.axes)))
        return F.flatten(mirror(pts, layout))
    return F.transform(seq, frame)


def augment(seq: Column, key: list, settings: Settings = Settings()) -> Column:
    """Crop and resample, repeat, group dropout, jitter, mirror, resample - in this order."""
    s, lay = settings, settings.layout
    length, width = s.sequence_length, s.input_width
    cropped = resample(temporal_crop(seq, s.crop_fraction, uniform("crop", *key)), length, width) if s.crop_fraction > 0 else seq
    repeated = let(cropped, lambda c: repeat_frames(c, s.frame_repeat_prob, lambda i: uniform("repeat", *key, i)))
    noisy = jitter(drop_groups(repeated, s.group_dropout_prob, key, lay), s.jitter_sigma, key, lay)
    if s.mirror_prob > 0:
        noisy = let(noisy, lambda n: F.when(
            uniform("mirror", *key) < s.mirror_prob, mirror_sequence(n, lay)).otherwise(n))
    return resample(noisy, length, width)


def training_copies(sequences: DataFrame, settings: Settings = Settings(), enabled: bool = True) -> DataFrame:
    """Copies 0..n of train clips (copy 0 is the original), one row for other splits.

    ``sequences(clip_id, split, seq, ...)``. The draws depend on (seed, clip, copy) only.
    """
    extra = settings.augment_copies if enabled else 0
    copies = F.when(F.col("split") == "train", F.sequence(F.lit(0), F.lit(extra))).otherwise(F.array(F.lit(0)))
    rows = sequences.withColumn("copy", F.explode(copies))
    key = [settings.seed, F.col("clip_id"), F.col("copy")]
    return rows.withColumn("seq", F.when(F.col("copy") == 0, F.col("seq")).otherwise(augment(F.col("seq"), key, settings)))
