"""Row rules with reasons: valid rows and a quarantine from one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limbwise.operators.events import ACTIONS
from limbwise.settings import Settings


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reasons``: the names of the rules a row breaks (a null test counts as kept)."""
    broken = [F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).drop("reasons")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0)


def payload_rules(settings: Settings = Settings()) -> dict[str, Column]:
    """Scoring request: features or a clip path, sizes and threshold in range."""
    features, t = F.col("features"), F.size("features")
    return {
        "empty": t > 0,
        "too_few_frames": (t == 0) | (t >= settings.min_valid_frames),
        "too_many_frames": t <= settings.max_sequence_length,
        "wrong_width": F.forall(features, lambda r: F.size(r) == settings.input_width),
        "both_sources": ~(features.isNotNull() & (F.length(F.coalesce("dataset_clip", F.lit(""))) > 0)),
        "threshold_range": F.col("threshold").between(0.05, 0.999),
        "unknown_model": F.col("model").isin(*settings.models),
        "profile_too_long": F.length("profile") <= 32,
    }


def feedback_rules() -> dict[str, Column]:
    blank = F.length(F.trim(F.coalesce("corrected_class", F.lit("")))) == 0
    return {
        "unknown_action": F.coalesce(F.col("human_action").isin(*ACTIONS), F.lit(False)),
        "class_length": F.length(F.coalesce("predicted_class", F.lit(""))).between(1, 64),
        "corrected_length": F.length("corrected_class") <= 64,
        "event_id_length": F.length(F.col("event_id").cast("string")) <= 32,
        "confidence_range": F.col("confidence").between(0.0, 1.0),
        "note_length": F.length("note") <= 500,
        "correct_needs_class": ~((F.col("human_action") == "CORRECT") & blank),
    }


def with_known_class(df: DataFrame, vocabulary: DataFrame, column: str = "corrected_class") -> DataFrame:
    """Flag ``known_class``: the class is blank or, upper-cased, in the vocabulary."""
    names = vocabulary.select(F.upper(F.trim("label")).alias("_k"), F.lit(True).alias("_hit")).distinct()
    keyed = df.withColumn("_k", F.upper(F.trim(column)))
    return (keyed.join(names, "_k", "left")
            .withColumn("known_class", (F.length(F.coalesce("_k", F.lit(""))) == 0) | F.col("_hit").isNotNull())
            .drop("_k", "_hit"))


def profile_rules(settings: Settings = Settings()) -> dict[str, Column]:
    return {
        "name_format": F.coalesce(F.col("name").rlike("^[A-Za-z0-9_\\-]{1,32}$"), F.lit(False)),
        "unknown_action": F.col("action").isin("create", "update", "calibrate", "fine_tune",
                                               "reset_fine_tune", "delete"),
        "unknown_model": F.col("base_model").isin(*settings.models),
        "threshold_range": F.col("threshold").between(0.05, 0.999),
        "calibrate_needs_data": (F.col("action") != "calibrate")
        | ((F.coalesce("n_features", F.lit(0)) > 0) & (F.coalesce("n_labels", F.lit(0)) > 0)),
    }


def split_by_usable_frames(clips: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``rejected`` and ``reason`` from the count of frames with any landmark."""
    few = F.col("usable") < settings.min_valid_frames
    return clips.withColumn("rejected", few).withColumn(
        "reason", F.when(few, F.lit("too few usable frames")))


def allowed_clips(requests: DataFrame, index: DataFrame, column: str = "clip") -> DataFrame:
    """Resolve requested paths against the index; unsafe or unknown paths get a reason."""
    path = F.regexp_replace(F.trim(F.coalesce(column, F.lit(""))), "^/+", "")
    known = index.select(F.trim("FilePath").alias("_path"), F.lit(True).alias("_hit")).distinct()
    safe = ~F.contains(F.col("_path"), F.lit(".."))
    return (requests.withColumn("_path", path).join(known, "_path", "left")
            .withColumn("reason", F.when(~safe, "invalid clip path").when(F.col("_hit").isNull(), "unknown clip"))
            .withColumn("FilePath", F.when(F.col("reason").isNull(), F.col("_path")))
            .drop("_path", "_hit"))
