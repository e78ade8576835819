"""Per-frame landmark expressions: slices, masks, packing, body normalisation.

Frames are ``coords ARRAY<ARRAY<DOUBLE>>`` with ``mask ARRAY<DOUBLE>``. Everything is a
row-local projection, so it runs before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limbwise.functions.columns import doubles, let, total
from limbwise.settings import Layout, Settings


def group_slice(arr: Column, layout: Layout, group: str) -> Column:
    first, count = layout.span(group)
    return F.slice(arr, first + 1, count)


def presence_mask(coords: Column, visibility: Column | None = None, threshold: float = 0.5) -> Column:
    """1.0 where any coordinate is non-zero and, if given for every point, visibility >= threshold."""
    moved = lambda p: F.exists(p, lambda v: v != 0)
    if visibility is None:
        return F.transform(coords, lambda p: F.when(moved(p), 1.0).otherwise(0.0))
    usable = F.coalesce(F.size(visibility) == F.size(coords), F.lit(False))
    return F.when(usable, F.zip_with(coords, visibility, lambda p, v: F.when(
        moved(p) & (v >= threshold), 1.0).otherwise(0.0))).otherwise(presence_mask(coords))


def confidence_mask(confidences: Column, landmarks: int, threshold: float = 0.5) -> Column:
    """1.0 where the confidence is strictly above the threshold; all ones when absent."""
    return F.coalesce(F.transform(confidences, lambda c: F.when(c > threshold, 1.0).otherwise(0.0)),
                      doubles(landmarks, 1.0))


def _fit(points: Column, count: int, filler: Column) -> Column:
    return F.slice(F.concat(points, F.array_repeat(filler, count)), 1, count)


def pack(pose: Column, left: Column, right: Column, visibility: Column | None = None,
         settings: Settings = Settings()) -> Column:
    """Detector groups to ``STRUCT<coords, mask>`` in layout order.

    Groups are cut or zero-padded to their slots; points that fail the mask become zero.
    Pose visibility comes from ``visibility`` or from a fourth pose coordinate.
    """
    lay = settings.layout
    zero = doubles(lay.axes)
    none = F.array().cast("array<array<double>>")
    xyz = lambda group, n: F.transform(F.slice(F.coalesce(group, none), 1, n), lambda p: F.slice(p, 1, lay.axes))
    n_pose, n_left, n_right = (lay.span(g)[1] for g in ("pose", "left_hand", "right_hand"))
    cut_pose = F.slice(F.coalesce(pose, none), 1, n_pose)
    own = F.when(F.size(F.get(cut_pose, F.lit(0))) > lay.axes, F.transform(cut_pose, lambda p: F.get(p, F.lit(lay.axes))))
    seen = own if visibility is None else F.coalesce(F.slice(visibility, 1, n_pose), own)
    pose_xyz = xyz(pose, n_pose)
    pose_mask = F.when(seen.isNotNull(), presence_mask(pose_xyz, seen, settings.visibility_threshold)).otherwise(
        presence_mask(pose_xyz))
    coords = F.concat(_fit(pose_xyz, n_pose, zero), _fit(xyz(left, n_left), n_left, zero),
                      _fit(xyz(right, n_right), n_right, zero))
    mask = F.concat(_fit(pose_mask, n_pose, F.lit(0.0)),
                    _fit(presence_mask(xyz(left, n_left)), n_left, F.lit(0.0)),
                    _fit(presence_mask(xyz(right, n_right)), n_right, F.lit(0.0)))
    return let(mask, lambda m: F.struct(blank(coords, m, lay.axes).alias("coords"), m.alias("mask")))


def blank(coords: Column, mask: Column, axes: int = 3) -> Column:
    """Zero the points whose mask is not positive."""
    return F.zip_with(coords, mask, lambda p, m: F.when(m > 0, p).otherwise(doubles(axes)))


def to_features(coords: Column, mask: Column, settings: Settings = Settings()) -> Column:
    """Flat vector of a frame, with the mask appended when the build uses it."""
    flat = F.flatten(coords)
    return F.concat(flat, mask) if settings.with_mask else flat


def from_features(vec: Column, settings: Settings = Settings()) -> Column:
    """Inverse of ``to_features`` as ``STRUCT<coords, mask>``."""
    lay = settings.layout
    coords = F.transform(F.sequence(F.lit(0), F.lit(lay.landmarks - 1)),
                         lambda j: F.slice(vec, j * lay.axes + 1, F.lit(lay.axes)))
    mask = F.when(F.size(vec) >= lay.width + lay.landmarks, F.slice(vec, lay.width + 1, lay.landmarks)
                  ).otherwise(presence_mask(coords)) if settings.with_mask else presence_mask(coords)
    return F.struct(coords.alias("coords"), mask.alias("mask"))


def body_reference(coords: Column, mask: Column, layout: Layout) -> Column:
    """``STRUCT<centre, scale, basis>``: shoulders, else hips, else the centroid with scale 1."""
    def between(a: int, b: int) -> tuple[Column, Column, Column]:
        p, q = coords[a], coords[b]
        seen = (mask[a] > 0) & (mask[b] > 0)
        return seen, F.zip_with(p, q, lambda x, y: (x + y) / 2), F.sqrt(total(F.zip_with(p, q, lambda x, y: (x - y) * (x - y))))

    s_seen, s_mid, s_width = between(layout.left_shoulder, layout.right_shoulder)
    h_seen, h_mid, h_width = between(layout.left_hip, layout.right_hip)
    present = F.filter(coords, lambda p, j: F.get(mask, j) > 0)
    centroid = let(present, lambda pts: F.transform(F.sequence(F.lit(0), F.lit(layout.axes - 1)), lambda a: F.coalesce(
        F.try_divide(total(F.transform(pts, lambda p: F.get(p, a))), F.size(pts)), F.lit(0.0))))
    anchor = lambda centre, scale, name: F.struct(centre.alias("centre"), scale.alias("scale"), F.lit(name).alias("basis"))
    anywhere = F.exists(mask, lambda m: m > 0)
    return (F.when(s_seen & (s_width > 1e-6), anchor(s_mid, s_width, "shoulders"))
            .when(h_seen & (h_width > 1e-6), anchor(h_mid, h_width, "hips"))
            .when(anywhere, anchor(centroid, F.lit(1.0), "centroid"))
            .otherwise(anchor(doubles(layout.axes), F.lit(1.0), "none")))


def normalise(coords: Column, mask: Column, layout: Layout) -> Column:
    """Coordinates relative to the body reference in units of its width; masked points are 0."""
    def apply(ref: Column) -> Column:
        scale = F.greatest(ref["scale"], F.lit(1e-6))
        return F.zip_with(coords, mask, lambda p, m: F.when(m > 0, F.zip_with(
            p, ref["centre"], lambda v, c: (v - c) / scale)).otherwise(doubles(layout.axes)))
    return let(body_reference(coords, mask, layout), apply)


def normalise_frames(frames: DataFrame, settings: Settings = Settings(), mask: str | None = "mask") -> DataFrame:
    """Add ``features`` and a 0/1 ``mask``; masks are derived when ``mask`` is None.

    Frames whose mask length does not match the layout fail the job.
    """
    lay = settings.layout
    given = presence_mask(F.col("coords")) if mask is None else F.transform(
        F.col(mask), lambda m: F.when(m > 0, 1.0).otherwise(0.0))
    checked = F.when(F.size(given) == lay.landmarks, given).otherwise(F.raise_error(F.lit(
        f"mask length must be {lay.landmarks}")).cast("array<double>"))
    df = frames.withColumn("mask", checked)
    visible = blank(F.col("coords"), F.col("mask"), lay.axes)
    out = let(visible, lambda v: normalise(v, F.col("mask"), lay))
    return df.withColumn("features", to_features(out, F.col("mask"), settings))


def mirror(coords: Column, layout: Layout) -> Column:
    """Swap the hand slots and negate x everywhere; pose left and right stay in place."""
    swapped = F.concat(group_slice(coords, layout, "pose"), group_slice(coords, layout, "right_hand"),
                       group_slice(coords, layout, "left_hand"))
    return F.transform(swapped, lambda p: F.transform(p, lambda v, a: F.when(a == 0, -v).otherwise(v)))


def group_flags(mask: Column, layout: Layout) -> dict[str, Column]:
    """Which landmark groups a frame shows."""
    seen = {g: F.exists(group_slice(mask, layout, g), lambda m: m > 0) for g, _ in layout.groups}
    left, right = seen["left_hand"], seen["right_hand"]
    return {"pose": seen["pose"], "left_hand": left, "right_hand": right, "any_hand": left | right,
            "both_hands": left & right, "empty": ~F.exists(mask, lambda m: m > 0)}
