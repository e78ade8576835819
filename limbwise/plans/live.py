"""Live frames to smoothed decisions as one streaming query with two keyed stages.

The scorer runs between the stages as an ordinary projection, so model calls are batched
over sessions and never happen inside a state callback.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limbwise.operators import landmarks as lm
from limbwise.operators import scoring as sc
from limbwise.operators.live import control_epochs, hand_loss, lives, ring_buffer
from limbwise.operators.live import throttle as throttle_frames
from limbwise.operators.smoothing import smooth
from limbwise.settings import Settings
from limbwise.streaming.sessions import process_frames, smooth_stream


def frame_features(raw: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Detector groups to the feature vector of a frame (stateless)."""
    packed = raw.withColumn("_f", lm.pack(F.col("pose"), F.col("left_hand"), F.col("right_hand"), settings=settings))
    placed = packed.select("session_id", "seq", "ts", "kind", (F.col("left_hand").isNotNull() | F.col("right_hand").isNotNull()).alias("has_hands"),
                           F.col("_f.coords").alias("coords"), F.col("_f.mask").alias("mask"))
    return lm.normalise_frames(placed, settings).select("session_id", "seq", "ts", "kind", "has_hands", F.col("features").alias("value"))


def gated_windows(windows: DataFrame, scorer: sc.CentroidScorer, settings: Settings = Settings(), extra: tuple[str, ...] = ()) -> DataFrame:
    """Ready windows to gated labels: idle gate, scorer, smart threshold; ``extra`` columns are kept."""
    ready = windows.where("ready").withColumn("_h", sc.hand_activity(F.col("buffer"), settings))
    scored = scorer.score(ready, F.flatten("buffer"))
    gated = sc.stream_gate(scored, F.array(*map(F.lit, scorer.classes)), settings,
                           sc.is_idle(F.col("_h.presence"), F.col("_h.motion"), settings))
    return gated.select("session_id", "ts", "seq", "epoch", *extra, F.col("gated").alias("label"), F.col("raw_confidence").alias("confidence"))


def live_decisions(raw: DataFrame, scorer: sc.CentroidScorer, settings: Settings = Settings(), stride: int = 1,
                   throttle: bool = True, watermark: str = "1 minute", reorder: bool = False) -> DataFrame:
    """With ``reorder`` both stages hold rows until the watermark: decisions then equal ``replayed_decisions`` for any order of arrival inside it."""
    windows = process_frames(frame_features(raw, settings), settings, stride, throttle, watermark, reorder)
    return smooth_stream(gated_windows(windows, scorer, settings), settings, watermark=None, reorder=reorder)


def replayed_decisions(raw: DataFrame, scorer: sc.CentroidScorer, settings: Settings = Settings(), stride: int = 1) -> DataFrame:
    """Batch twin over stored frames and control rows: the same decisions, sessions shared by many tasks.

    Lives and resets split a session as the stream's state does: the throttle starts anew with a life, buffer and
    hand loss also with a reset, the smoother with each buffer and with a silence between its own rows.
    """
    life, part = ("session_id", "life"), ("session_id", "life", "resets")
    frames = throttle_frames(control_epochs(frame_features(raw, settings), settings), settings, life)
    wiped = hand_loss(frames, settings, part)
    windows = ring_buffer(wiped, F.col("value"), settings, (*part, "epoch"), stride=stride)
    gated = gated_windows(windows, scorer, settings, ("life", "resets"))
    spoken = lives(gated.withColumnRenamed("life", "_life"), settings, ("session_id", "_life", "resets", "epoch")).withColumnRenamed("life", "pause")
    return smooth(spoken, settings, ("session_id", "_life", "resets", "epoch", "pause"), "ts").drop("_life", "pause")
