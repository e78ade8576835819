"""Clip requests: validate, score once, gate, and turn the decisions into log records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limbwise.operators import validate as va
from limbwise.operators.events import prediction_events
from limbwise.operators.scoring import CentroidScorer, clip_gate
from limbwise.operators.sequences import resample
from limbwise.settings import Settings


@dataclass(frozen=True)
class Answer:
    decided: DataFrame
    refused: DataFrame

    def events(self, key: list[str]) -> DataFrame:
        """Prediction records, ready for ``sources.logs.append_log``."""
        return prediction_events(self.decided, key)


def answer(requests: DataFrame, scorer: CentroidScorer, settings: Settings = Settings()) -> Answer:
    """Requests with ``features`` and an optional own ``threshold`` to decisions and refusals."""
    checked = va.validate(requests, va.payload_rules(settings))
    good = va.accepted(checked).withColumn("seq", resample(F.col("features"), settings.sequence_length, settings.input_width))
    scored = scorer.score(good, F.flatten("seq"))
    threshold = F.coalesce("threshold", F.lit(settings.confidence_threshold))
    return Answer(clip_gate(scored, F.array(*map(F.lit, scorer.classes)), threshold), va.quarantined(checked))
