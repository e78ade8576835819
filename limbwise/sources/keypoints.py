"""Keypoint files to frames, and the scan for damaged files.

A file holds one clip: ``keypoints`` (T, N, 3), optional ``confidences`` (T, N) and
``vid_shape`` (height, width), as JSON or as ``.npz`` without pickled objects. Files are
spread over tasks; decoding a file is the only Python step, the rest are expressions.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limbwise.operators.geometry import axis_scale, scale_x
from limbwise.operators.landmarks import blank, confidence_mask
from limbwise.settings import Settings

_FRAME = ("path string, frames_total int, frame_idx int, coords array<array<double>>, confidences array<double>, vid_shape array<int>")
_CHECK = "path string, status string, error string, n_frames int"


def decode(content: bytes) -> tuple[np.ndarray, np.ndarray | None, list[int] | None]:
    """Arrays of one file. Zip members are checked by CRC; object arrays are refused."""
    if content[:2] == b"PK":
        with np.load(io.BytesIO(content), allow_pickle=False) as data:
            doc = {k: data[k] for k in data.files}
    else:
        doc = json.loads(content.decode("utf-8"))
    points = np.asarray(doc.get("keypoints", np.zeros((0, 0, 3))), dtype=np.float64)
    if points.ndim != 3 and points.size:
        raise ValueError(f"unexpected keypoints shape {points.shape}")
    conf = doc.get("confidences")
    conf = None if conf is None else np.asarray(conf, dtype=np.float64)
    shape = doc.get("vid_shape")
    return points, conf if conf is not None and conf.ndim == 2 else None, (
        None if shape is None else [int(v) for v in np.asarray(shape).ravel()[:2]])


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
            .load(root).select("path", "content"))


def read_keypoints(spark: SparkSession, root: str, glob: str = "*", settings: Settings = Settings(),
                   correct_axis: bool = True, limit: int | None = None) -> DataFrame:
    """Frames of all readable files: ``path, frames_total, frame_idx, coords, mask, vid_shape, x_axis_scale``.

    ``limit`` reads the first frames of a file only (none by default); ``frames_total`` tells what a
    file holds. Files that can't be decoded are the rows of ``unreadable_files``. Points without confidence are zeroed.
    """

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    points, conf, shape = decode(content)
                except Exception:  # a row of unreadable_files
                    continue
                t = len(points) if limit is None else min(limit, len(points))
                yield pd.DataFrame({
                    "path": path, "frames_total": len(points), "frame_idx": np.arange(t, dtype="int32"),
                    "coords": [p.tolist() for p in points[:t]],
                    "confidences": [c.tolist() for c in conf[:t]] if conf is not None else [None] * t,
                    "vid_shape": [shape] * t})
    raw = _files(spark, root, glob).mapInPandas(frames, _FRAME)
    scale = axis_scale(F.col("vid_shape"), settings=settings) if correct_axis else F.lit(1.0)
    mask = confidence_mask(F.col("confidences"), settings.layout.landmarks, settings.confidence_point_threshold)
    scaled = raw.withColumn("x_axis_scale", scale).withColumn("mask", mask)
    moved = scaled.withColumn("coords", scale_x(F.col("coords"), F.col("x_axis_scale")))
    return moved.withColumn("coords", blank(F.col("coords"), F.col("mask"), settings.layout.axes)).drop("confidences")


def scan_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Read every file to the end: ``path, status`` (ok, corrupt, unreadable), ``error, n_frames``."""
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    n = len(decode(content)[0])
                    rows.append((path, "ok" if n else "corrupt", "" if n else "zero frames", n))
                except zipfile.BadZipFile as exc:
                    rows.append((path, "corrupt", f"{type(exc).__name__}: {exc}", 0))
                except Exception as exc:
                    rows.append((path, "unreadable", f"{type(exc).__name__}: {exc}", 0))
            yield pd.DataFrame(rows, columns=["path", "status", "error", "n_frames"])
    return _files(spark, root, glob).mapInPandas(check, _CHECK)


def unreadable_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files that ``read_keypoints`` gives no frames of, with the reason."""
    return scan_files(spark, root, glob).where(F.col("status") != "ok")


def scan_summary(scan: DataFrame) -> DataFrame:
    return scan.groupBy("status").agg(F.count("*").alias("files"), F.sum("n_frames").alias("frames"))
