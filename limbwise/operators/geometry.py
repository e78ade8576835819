"""Axis correction and its calibration from anatomical ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limbwise.functions.columns import one_row
from limbwise.functions.draws import digest
from limbwise.functions.quantiles import exact_percentiles
from limbwise.settings import Settings


def axis_scale(vid_shape: Column | None = None, explicit: Column | None = None,
               settings: Settings = Settings()) -> Column:
    """Explicit scale, else (width/height)^2 of a given shape (1.0 if invalid), else the configured one."""
    options = []
    if explicit is not None:
        options.append(explicit)
    if vid_shape is not None:
        h, w = vid_shape[0], vid_shape[1]
        from_shape = F.when((h > 0) & (w > 0), F.pow(F.try_divide(w.cast("double"), h), 2)).otherwise(1.0)
        options.append(F.when(vid_shape.isNotNull(), from_shape))
    return F.coalesce(*options, F.lit(settings.x_axis_scale))


def scale_x(coords: Column, scale: Column) -> Column:
    return F.transform(coords, lambda p: F.transform(p, lambda v, a: F.when(a == 0, v * scale).otherwise(v)))


def frame_ratios(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Shoulder/torso and nose-eye/inter-eye ratio per frame, null where points are missing."""
    lay, p, m = settings.layout, F.col("coords"), F.col("mask")
    seen = lambda *js: F.array_min(F.array(*[m[j] for j in js])) > 0
    shoulder = F.abs(p[lay.left_shoulder][0] - p[lay.right_shoulder][0])
    torso = F.abs(p[lay.left_shoulder][1] - p[lay.left_hip][1])
    eyes = F.abs(p[lay.left_eye][0] - p[lay.right_eye][0])
    drop = F.abs((p[lay.left_eye][1] + p[lay.right_eye][1]) / 2 - p[lay.nose][1])
    body_ok = seen(lay.left_shoulder, lay.right_shoulder, lay.left_hip, lay.right_hip) & (torso > 1e-6)
    face_ok = seen(lay.nose, lay.left_eye, lay.right_eye) & (eyes > 1e-6)
    return frames.select("clip_id", "frame_idx", F.when(body_ok, F.try_divide(shoulder, torso)).alias("body"),
                         F.when(face_ok, F.try_divide(drop, eyes)).alias("face"))


def clip_ratios(ratios: DataFrame, min_values: int = 5) -> DataFrame:
    """Median per clip over at least ``min_values`` frames (a clip is frame-capped, so its group is small)."""
    keep = lambda c: F.when(F.count(c) >= min_values, F.percentile(c, F.lit(0.5))).alias(c)
    return ratios.groupBy("clip_id").agg(F.count("*").alias("frames"), keep("body"), keep("face"))


def calibration(clips: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: medians over clips, implied x scales, their mean and its gap to theory."""
    counts = clips.agg(F.count("*").alias("videos_used"), F.sum("frames").alias("frames_used"))
    long = clips.select(F.explode(F.array(
        F.struct(F.lit("body").alias("kind"), F.col("body").alias("v")),
        F.struct(F.lit("face").alias("kind"), F.col("face").alias("v")))).alias("r")).select("r.*")
    med = exact_percentiles(long, ["kind"], F.col("v"), {"median": 0.5})
    one = med.agg(
        F.max(F.when(F.col("kind") == "body", F.col("median"))).alias("body_ratio"),
        F.max(F.when(F.col("kind") == "face", F.col("median"))).alias("face_ratio"))
    return _implied(one_row(counts, one), settings)


def _implied(one: DataFrame, settings: Settings) -> DataFrame:
    body = F.try_divide(F.lit(settings.reference_body_ratio), F.col("body_ratio"))
    face = F.col("face_ratio") / settings.reference_face_ratio
    known = F.array_compact(F.array(F.col("scale_body"), F.col("scale_face")))
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known))
    theory = settings.theoretical_axis_scale
    return (one.withColumn("scale_body", body).withColumn("scale_face", face)
            .withColumn("scale_measured", F.coalesce(mean, F.lit(settings.x_axis_scale)))
            .withColumn("scale_theory", F.lit(theory))
            .withColumn("gap_percent", 100 * F.abs(F.col("scale_measured") - theory) / theory))


def sample_clips(clips: DataFrame, limit: int, seed: int = 42, key: str = "clip_id") -> DataFrame:
    """Seeded sample: the ``limit`` lowest digests of (seed, clip), independent of partitioning."""
    return (clips.withColumn("_h", digest(seed, F.col(key))).orderBy("_h", key).limit(limit).drop("_h"))


def photo_ratios(photos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Reference ratios from normalised photo landmarks put back to pixels (x*width, y*height)."""
    lay = settings.layout
    px = F.transform("pose", lambda p: F.array(p[0] * F.col("width"), p[1] * F.col("height")))
    pts = photos.withColumn("_px", px)
    at = lambda j, a: F.col("_px")[j][a]
    gap = lambda f: F.sqrt(F.pow(f(0), 2) + F.pow(f(1), 2))
    shoulder = gap(lambda a: at(lay.left_shoulder, a) - at(lay.right_shoulder, a))
    torso = gap(lambda a: (at(lay.left_shoulder, a) + at(lay.right_shoulder, a)) / 2
                - (at(lay.left_hip, a) + at(lay.right_hip, a)) / 2)
    eyes = F.abs(at(lay.left_eye, 0) - at(lay.right_eye, 0))
    drop = F.abs((at(lay.left_eye, 1) + at(lay.right_eye, 1)) / 2 - at(lay.nose, 1))
    per_photo = pts.where(F.col("pose").isNotNull()).select(
        F.when(torso > 1e-6, F.try_divide(shoulder, torso)).alias("body"),
        F.when(eyes > 1e-6, F.try_divide(drop, eyes)).alias("face"))
    long = per_photo.select(F.explode(F.create_map(F.lit("body"), F.col("body"), F.lit("face"), F.col("face"))).alias("kind", "v"))
    med = exact_percentiles(long, ["kind"], F.col("v"), {"ratio": 0.5})
    counts = long.groupBy("kind").agg(F.count("v").alias("photos"))
    return counts.join(med, "kind", "left")


