"""Recognition log: event records, verdict join, review filters, metrics (J*, P11, P12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limbwise.functions.columns import keyed_join, one_row, ratio
from limbwise.functions.quantiles import exact_percentiles
from limbwise.settings import Settings

# The human verdicts.
ACTIONS = ("ACCEPT", "CORRECT", "REJECT")


def record_id(*key: str) -> Column:
    """12 hex digits derived from the record's own key, so a rerun writes the same id."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256), 1, 12)


def prediction_events(df: DataFrame, key: list[str], extra: list[str] | None = None) -> DataFrame:
    """Log records of scored rows: confidence to 6, latency to 3, fps to 2 digits."""
    have = set(df.columns)
    optional = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t).alias(c)
    return df.select(
        record_id(*key).alias("event_id"), "timestamp", "model", "predicted_class",
        F.round("confidence", 6).alias("confidence"), "status",
        F.round("latency_ms", 3).alias("latency_ms"),
        F.round(optional("fps", "double"), 2).alias("fps"),
        F.lit(None).cast("string").alias("human_action"),
        F.lit(None).cast("string").alias("corrected_class"),
        optional("source", "string"), optional("profile", "string"), optional("caption", "string"),
        *[F.col(c) for c in extra or []])


def feedback_events(df: DataFrame, key: list[str]) -> DataFrame:
    """Verdict records: action upper-cased, blank corrections become null."""
    return (df.withColumn("feedback_id", record_id(*key))
            .withColumn("human_action", F.upper(F.trim("human_action")))
            .withColumn("corrected_class", F.nullif(F.col("corrected_class"), F.lit("")))
            .withColumn("confidence", F.round("confidence", 6)))


def failure_events(df: DataFrame, key: list[str]) -> DataFrame:
    """Failure records: stage cut at 64 characters, message at 1000."""
    return (df.withColumn("failure_id", record_id(*key))
            .withColumn("stage", F.substring("stage", 1, 64))
            .withColumn("message", F.substring("message", 1, 1000)))


def with_verdicts(predictions: DataFrame, feedback: DataFrame, order: str) -> DataFrame:
    """Each prediction with its newest verdict, which overrides the event's own fields.

    Verdicts are reduced to one per event before the join, so a hot event id costs a
    partial aggregate and the join stays one-to-one.
    """
    newest = (feedback.where(F.col("event_id").isNotNull())
              .groupBy("event_id")
              .agg(F.max_by(F.struct("human_action", "corrected_class"), order).alias("_v")))
    joined = predictions.join(newest, "event_id", "left")
    seen = F.col("_v").isNotNull()
    out = (joined
           .withColumn("human_action", F.when(seen, F.col("_v.human_action")).otherwise(F.col("human_action")))
           .withColumn("corrected_class",
                       F.when(seen, F.col("_v.corrected_class")).otherwise(F.col("corrected_class")))
           .drop("_v"))
    return out.withColumn("wrong", is_wrong())


def is_wrong() -> Column:
    corrected = F.coalesce(F.length("corrected_class") > 0, F.lit(False))
    return corrected | F.coalesce(F.col("human_action") == "REJECT", F.lit(False))


def review_filter(events: DataFrame, *, min_confidence: float | None = None,
                  max_confidence: float | None = None, status: str | None = None,
                  predicted_class: str | None = None, action: str | None = None,
                  model: str | None = None, source: str | None = None,
                  only_corrected: bool = False, only_rejected: bool = False,
                  only_uncertain: bool = False, settings: Settings = Settings()) -> DataFrame:
    """Error-review filters; texts ignore case, a null confidence counts as 0."""
    conf = F.coalesce("confidence", F.lit(0.0))
    same = lambda c, text: F.upper(F.coalesce(c, F.lit(""))) == text.upper()
    tests: list[Column] = []
    if min_confidence is not None:
        tests.append(conf >= min_confidence)
    if max_confidence is not None:
        tests.append(conf <= max_confidence)
    if status:
        tests.append(same("status", status))
    if predicted_class:
        tests.append(same("predicted_class", predicted_class))
    if action:
        tests.append(same("human_action", action))
    if model:
        tests.append(F.col("model") == model)
    if source:
        tests.append(F.col("source") == source)
    if only_corrected:
        tests.append(F.length(F.coalesce("corrected_class", F.lit(""))) > 0)
    if only_rejected:
        tests.append(F.col("human_action") == "REJECT")
    if only_uncertain:
        tests.append(same("status", settings.uncertain))
    for test in tests:
        events = events.where(test)
    return events


def newest_first(events: DataFrame, limit: int, time: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """The newest ``limit`` rows (a top-k, not a full sort)."""
    return events.orderBy(F.col(time).desc(), F.col(tie).asc()).limit(limit)


def newest_failures(failures: DataFrame, limit: int, tie: str = "failure_id") -> DataFrame:
    return failures.orderBy(F.col("timestamp").desc(), F.col(tie).desc()).limit(limit)


def flagged(events: DataFrame, text: str = "", settings: Settings = Settings()) -> DataFrame:
    """Uncertain or not plainly accepted rows whose text columns contain ``text``."""
    doubtful = (F.coalesce(F.col("status") == settings.uncertain, F.lit(False))
                | (F.coalesce(F.col("human_action"), F.lit("ACCEPT")) != "ACCEPT"))
    needle = text.strip().lower()
    columns = [c for c in ("predicted_class", "model", "note", "corrected_class", "source") if c in events.columns]
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle))
    return events.where(doubtful & found)


def log_metrics(predictions: DataFrame, feedback: DataFrame, by: list[str] | None = None,
                settings: Settings = Settings()) -> DataFrame:
    """Counts, confidence, latency and verdict figures of a log, optionally per ``by``.

    Null and zero latencies are left out, as are null confidences; missing parts give 0.
    """
    by = list(by or [])
    latency = F.when(F.col("latency_ms") != 0, F.col("latency_ms"))
    counts = predictions.groupBy(*by).agg(
        F.count("*").alias("predictions_total"),
        F.count_if(F.col("status") == settings.uncertain).alias("uncertain_total"),
        F.avg("confidence").alias("confidence_mean"), F.min("confidence").alias("confidence_min"),
        F.max("confidence").alias("confidence_max"),
        F.avg(latency).alias("latency_mean"), F.max(latency).alias("latency_max"))
    tails = exact_percentiles(predictions, by, latency, {"latency_p50": 0.5, "latency_p95": 0.95})
    decided = F.col("human_action").isin(*ACTIONS)
    verdicts = feedback.groupBy(*by).agg(
        F.count("*").alias("feedback_total"),
        F.count_if(F.length("corrected_class") > 0).alias("corrections_total"),
        F.count_if(decided).alias("decided"),
        *[F.count_if(F.col("human_action") == a).alias(a.lower() + "_total") for a in ACTIONS])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    zero_d = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    # without keys every part is one row, also for an empty log
    merged = keyed_join(keyed_join(counts, tails, by, "left"), verdicts, by, "full_outer") if by else one_row(counts, tails, verdicts)
    return merged.select(
        *by, zero("predictions_total"), zero("feedback_total"), zero("corrections_total"),
        zero("accept_total"), zero("correct_total"), zero("reject_total"), zero("uncertain_total"),
        ratio(F.coalesce("uncertain_total", F.lit(0)), F.coalesce("predictions_total", F.lit(0))).alias("uncertain_rate"),
        zero_d("confidence_mean"), zero_d("confidence_min"), zero_d("confidence_max"),
        zero_d("latency_mean"), zero_d("latency_p50"), zero_d("latency_p95"), zero_d("latency_max"),
        F.coalesce(F.try_divide(F.lit(1000.0), F.col("latency_mean")), F.lit(0.0)).alias("throughput_fps"),
        F.try_divide(F.col("accept_total").cast("double"), F.col("decided")).alias("agreement_rate"),
        (F.coalesce("uncertain_total", F.lit(0)) + F.coalesce("reject_total", F.lit(0))
         + F.coalesce("corrections_total", F.lit(0))).alias("review_total"))


def log_counts(predictions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Long table ``(kind, key, n)`` of status, class, model and action counts.

    One aggregate per log: the grouping sets expand each row before the partial
    aggregate, which reduces it to the distinct keys at once.
    """
    entry = lambda kind, c, default: F.struct(F.lit(kind).alias("kind"), F.coalesce(c, F.lit(default)).alias("key"))
    p = predictions.select(F.explode(F.array(
        entry("status", F.col("status"), "UNKNOWN"), entry("class", F.col("predicted_class"), "UNKNOWN"),
        entry("model", F.col("model"), "unknown"))).alias("e"))
    f = feedback.select(entry("action", F.col("human_action"), "UNKNOWN").alias("e"))
    return p.unionByName(f).groupBy("e.kind", "e.key").agg(F.count("*").alias("n"))


def top_classes(predictions: DataFrame, limit: int = 15) -> DataFrame:
    return (predictions.groupBy(F.coalesce("predicted_class", F.lit("UNKNOWN")).alias("predicted_class"))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicted_class").limit(limit))


def counts_as_maps(counts: DataFrame) -> DataFrame:
    """The summary form: one map per kind (a log has few distinct statuses and models)."""
    return counts.where(F.col("kind") != "class").groupBy("kind").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("counts"))


def correction_pairs(feedback: DataFrame, min_count: int = 1) -> DataFrame:
    return (feedback.where(F.length("corrected_class") > 0)
            .groupBy(F.col("predicted_class").alias("predicted"), F.col("corrected_class").alias("corrected"))
            .agg(F.count("*").alias("count")).where(F.col("count") >= min_count))


def with_stand_ins(predictions: DataFrame, feedback: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Predictions plus one stand-in per feedback event id the log does not know.

    Unknown measurements stay null and the row is flagged ``fallback_logged``.
    """
    known = predictions.select("event_id")
    orphans = (feedback.where(F.col("event_id").isNotNull()).join(known, "event_id", "left_anti")
               .groupBy("event_id").agg(F.min_by(F.struct("timestamp", "predicted_class", "model"), "ord").alias("_f")))
    stand_in = orphans.select(
        "event_id", F.col("_f.timestamp").alias("timestamp"),
        F.coalesce("_f.model", F.lit(settings.default_model)).alias("model"),
        F.coalesce("_f.predicted_class", F.lit("UNKNOWN")).alias("predicted_class"),
        F.lit("CONFIDENT").alias("status"), F.lit("live-camera").alias("source"),
        F.lit(True).alias("fallback_logged"))
    return (predictions.withColumn("fallback_logged", F.lit(False))
            .unionByName(stand_in, allowMissingColumns=True))
