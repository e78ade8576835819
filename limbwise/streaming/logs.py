"""Streaming log jobs: windowed metrics, verdict join, session windows, rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from limbwise.operators.events import is_wrong
from limbwise.operators.live import log_counts_by_latency, windowed_metrics
from limbwise.settings import Settings
from limbwise.streaming.sessions import bucket, next_timer


def metrics_stream(predictions: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "1 hour",
                   settings: Settings = Settings()) -> DataFrame:
    """Log metrics per window of a stream; a window is final once the watermark passes it."""
    return windowed_metrics(predictions.withWatermark("timestamp", delay), width, slide, settings=settings)


def log_windows_stream(predictions: DataFrame, feedback: DataFrame, width: str = "1 day", slide: str | None = None, by: tuple[str, ...] = ("model",),
                       delay: str = "1 hour", settings: Settings = Settings()) -> DataFrame:
    """``live.log_counts_by_latency`` of two streams: one aggregate over their union, so both share one watermark.

    A window comes out as counts per latency, so no row of the state grows with the log; give the sink to ``live.log_window_figures``.
    """
    timed = [df.withWatermark("timestamp", delay) for df in (predictions, feedback)]
    return log_counts_by_latency(*timed, width, slide, by, settings)


def _fields(row) -> tuple:
    """Values of a nested row, which comes as a mapping or as a row."""
    return tuple(row.values()) if isinstance(row, dict) else tuple(row)


class VerdictProcessor(StatefulProcessor):
    """The open predictions of the event ids of a bucket and the newest verdict on each.

    A prediction comes out as soon as it arrives and again whenever a verdict changes it; ``version`` counts these rows, so the
    one with the highest is current. Verdicts are ordered by ``ord``, the place in the log they were appended at: one that arrives
    after a newer verdict changes nothing, one that arrives before its prediction waits for it. An id that got no row for
    ``wait_ms`` of event time is closed and its state is dropped.

    Most ids get one or two rows, so ids share their calls to the state store by ``sessions.bucket``.
    """

    VERDICT = "ord bigint, human_action string, corrected_class string"

    def __init__(self, key: T.DataType, prediction: T.StructType, wait_ms: int):
        self.known = T.StructType([
            T.StructField("event_id", key), T.StructField("open", T.ArrayType(prediction)), T.StructField("verdict", T.StructType.fromDDL(self.VERDICT)),
            T.StructField("version", T.LongType()), T.StructField("last_ms", T.LongType())])
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", self.known)

    def _read(self) -> dict:
        stored = self.events.get() if self.events.exists() else ()
        return {key: ([*map(tuple, shown)], None if verdict is None else tuple(verdict), version, last_ms) for key, shown, verdict, version, last_ms in stored}

    def _keep(self, events: dict, watermark: int) -> None:
        rows = [(key, *event) for key, event in events.items() if event[3] + self.wait_ms > watermark]
        self.events.put(rows) if rows else self.events.clear()
        next_timer(self.handle, min((r[4] + self.wait_ms for r in rows), default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events, came = self._read(), {}
        for r in rows:
            shown, said, at_ms = came.get(r["event_id"], ([], None, 0))
            if r["p"] is not None:
                shown.append(_fields(r["p"]))
            if r["v"] is not None:
                verdict = _fields(r["v"])
                said = verdict if said is None or verdict[0] > said[0] else said
            came[r["event_id"]] = shown, said, max(at_ms, r["at_ms"])
        for event_id, (shown, given, at_ms) in came.items():
            known, newest, version, last_ms = events.get(event_id, ([], None, 0, 0))
            changed = given is not None and (newest is None or given[0] >= newest[0])
            again = changed and (newest is None or given[1:] != newest[1:])
            if changed:
                newest = given
            for place, p in enumerate([*known, *shown]):
                if again or place >= len(known):
                    version += 1
                    yield Row(p=p, v=newest, place=place, version=version)
            events[event_id] = [*known, *shown], newest, version, max(last_ms, at_ms)
        self._keep(events, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._keep(self._read(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def last_verdict_stream(predictions: DataFrame, feedback: DataFrame, wait: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Changes of predictions under their newest verdict: the columns of ``predictions`` (human fields overridden as in
    ``events.with_verdicts``) with ``wrong``, ``place`` (which of the predictions that share the id) and ``version``.

    Give the sink to ``current_verdicts`` for one row per prediction. Predictions and verdicts of an id may come in any
    order within ``wait`` of event time. Predictions without an id take no verdict and pass by the state; verdicts without one are left out.
    """
    names, schema = predictions.columns, predictions.schema
    verdict = T.StructType.fromDDL(VerdictProcessor.VERDICT)
    given = predictions.withWatermark("timestamp", delay).select("event_id", "timestamp", F.struct(*names).alias("p"), F.lit(None).cast(verdict).alias("v"))
    said = feedback.withWatermark("timestamp", delay).select("event_id", "timestamp", F.lit(None).cast(schema).alias("p"),
                           F.struct(F.col("ord").cast("bigint").alias("ord"), "human_action", "corrected_class").alias("v"))
    rows = given.unionByName(said).where("event_id IS NOT NULL").withColumn("at_ms", F.unix_millis("timestamp")).withColumn("bucket", bucket("event_id"))
    out = T.StructType([T.StructField("p", schema), T.StructField("v", verdict), T.StructField("place", T.LongType()), T.StructField("version", T.LongType())])
    processor = VerdictProcessor(rows.schema["event_id"].dataType, schema, int(pd.Timedelta(wait).total_seconds() * 1000))
    changes = rows.groupBy("bucket").transformWithState(processor, out, "Append", "EventTime")
    nameless = predictions.where("event_id IS NULL").select(
        F.struct(*names).alias("p"), F.lit(None).cast(verdict).alias("v"), F.lit(0).cast("bigint").alias("place"), F.lit(1).cast("bigint").alias("version"))
    seen = F.col("v").isNotNull()
    human = {c: F.when(seen, F.col(f"v.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in ("human_action", "corrected_class")}
    return changes.unionByName(nameless).select(*[human.get(c, F.col(f"p.{c}")) for c in names], "place", "version").withColumn("wrong", is_wrong())


def current_verdicts(changes: DataFrame) -> DataFrame:
    """One row per prediction of a stored ``last_verdict_stream``: the last version. Rows without an id are all kept."""
    rest = [c for c in changes.columns if c not in ("event_id", "place")]
    last = changes.where("event_id IS NOT NULL").groupBy("event_id", "place").agg(F.max_by(F.struct(*rest), "version").alias("_r"))
    return last.select("event_id", "place", "_r.*").unionByName(changes.where("event_id IS NULL"))


def verdict_stream(predictions: DataFrame, feedback: DataFrame, within: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Predictions left-joined to the feedback that arrives up to ``within`` later.

    The time bound lets both sides drop old state. A prediction without feedback comes out
    once the bound has passed; one with several verdicts gives a row for each.
    """
    p = predictions.withWatermark("timestamp", delay).alias("p")
    f = (feedback.select(F.col("event_id").alias("f_event_id"), F.col("timestamp").alias("f_time"), "ord",
                         F.col("human_action").alias("f_action"), F.col("corrected_class").alias("f_class"))
         .withWatermark("f_time", delay).alias("f"))
    near = (F.col("event_id") == F.col("f_event_id")) & (F.col("f_time") >= F.col("timestamp")) & (
        F.col("f_time") <= F.col("timestamp") + F.expr(f"INTERVAL {within}"))
    return p.join(f, near, "left_outer")


def session_stream(events: DataFrame, settings: Settings = Settings(), key: str = "session_id", time: str = "ts",
                   delay: str = "1 hour") -> DataFrame:
    """Sessions closed by more than ``session_idle_seconds`` of silence, as native session windows.

    A session window ends where its gap is reached, so the gap is one microsecond longer.
    """
    gap = f"{settings.session_idle_seconds} seconds 1 microsecond"
    out = events.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w")).agg(
        F.count("*").alias("events"), F.max(time).alias("ended"))
    return out.select(key, F.col("w.start").alias("started"), "ended", "events")


def rate_stream(access: DataFrame, settings: Settings = Settings(), client: str = "client", time: str = "ts",
                slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Requests per client in sliding windows and whether they exceed the limit."""
    width = f"{settings.rate_window_seconds} seconds"
    out = access.withWatermark(time, delay).groupBy(client, F.window(time, width, slide).alias("w")).agg(
        F.count("*").alias("requests"))
    return out.select(client, F.col("w.start").alias("window_start"), "requests",
                      (F.col("requests") > settings.rate_limit).alias("over_limit"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, write Parquet exactly once, and stop."""
    query = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return query
