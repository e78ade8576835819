"""Dataset to metrics: frames and an index to sequences, a fitted scorer and its scores.

Per-frame work runs before the only shuffle of frames (by clip); the evaluation works on
at most k*k cells per model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limbwise.operators import evaluation as ev
from limbwise.operators.augment import training_copies
from limbwise.operators.metadata import class_index
from limbwise.operators.scoring import CentroidScorer, argmax, fit_centroids
from limbwise.operators.sequences import clip_sequences
from limbwise.settings import Settings
from limbwise.sources.workspace import cut


def indexed_sequences(frames: DataFrame, index: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per indexed clip: ``clip_id, label, split, seq, reason``."""
    return clip_sequences(frames, settings).join(index.select("clip_id", "label", "split"), "clip_id")


def training_tables(index: DataFrame, frames: DataFrame, problems: DataFrame, settings: Settings = Settings(), augment: bool = True) -> tuple[DataFrame, DataFrame]:
    """The stored training set of an index ``clip_id, label, split``: its copies, and the clips left out with the ``reason``.

    Copies have ``class_index`` (place of the label among all labels of the index), ``copy`` (0 is the original), ``frames_source`` and ``seq``. Clips in
    ``problems`` (``clip_id, error``) give that error as the reason, others ``too few usable frames`` or, where nothing was read, ``no frames``.
    """
    classes = class_index(index).withColumnRenamed("index", "class_index")
    read = clip_sequences(frames.join(problems.select("clip_id"), "clip_id", "left_anti"), settings).select("clip_id", "seq", F.col("t").alias("frames_source"), F.col("reason").alias("_few"))
    bad = problems.groupBy("clip_id").agg(F.min("error").alias("_error"))
    told = index.select("clip_id", "label", "split").join(bad, "clip_id", "left").join(read, "clip_id", "left").withColumn(
        "reason", F.coalesce("_error", "_few", F.when(F.col("frames_source").isNull(), "no frames")))
    told = cut(told.drop("_error", "_few"), "training")
    kept = told.where("reason IS NULL").drop("reason").join(classes, "label", "left")
    return training_copies(kept, settings, augment), told.where("reason IS NOT NULL").select("clip_id", "label", "split", "reason")


def fit(sequences: DataFrame, settings: Settings = Settings(), augment: bool = False, sharpness: float = 8.0) -> CentroidScorer:
    """Fit on the train split, with augmented copies when asked for."""
    train = sequences.where((F.col("split") == "train") & F.col("reason").isNull())
    rows = training_copies(train, settings) if augment else train
    return fit_centroids(rows, "label", F.flatten("seq"), settings, sharpness)


def decisions(sequences: DataFrame, model: CentroidScorer, name: str) -> DataFrame:
    """``model, split, clip_id, y_true, y_pred, confidence`` of every usable clip."""
    names = F.array(*map(F.lit, model.classes))
    scored = model.score(sequences.where(F.col("reason").isNull()), F.flatten("seq"))
    return scored.select(F.lit(name).alias("model"), "split", "clip_id", F.col("label").cast("string").alias("y_true"),
                         F.get(names, argmax(F.col("probs"))).alias("y_pred"), F.array_max("probs").alias("confidence"))


def metrics(decided: DataFrame) -> DataFrame:
    """Averaged scores per model and split."""
    keys = ["model", "split"]
    return ev.averages(ev.per_class(ev.confusion(decided, keys), keys), keys)
