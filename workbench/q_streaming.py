"""Streaming queries: the tables are replayed as files and the sink is read back."""

from dataclasses import replace

from pyspark.sql import functions as F

from limbwise.operators.live import log_window_figures
from limbwise.sources.workspace import scratch_path
from limbwise.streaming import logs as sl
from limbwise.streaming import sessions as ss
from workbench.fixtures import SMALL, with_sql
from workbench.q_smoothing import EMIT, LIVE, LOG_SQL, LOSS, emit_sql, hand_stream, log_row, vote_sql
from workbench.registry import query

r6 = lambda c: F.round(c, 6).alias(c)
# sessions of the event table pause for days; the timer must not end them here
OPEN = replace(SMALL, session_idle_seconds=400 * 86400)


def replay(t, df, time, batches=2):
    """Write ``df`` as time-ordered groups of files and read one group per micro-batch.

    A file source takes older files first, so the groups are written one after the other.
    """
    path = scratch_path(t.spark, "replay")
    seconds = df.select(F.unix_seconds(time).cast("double").alias("s"))
    cuts = seconds.approxQuantile("s", [i / batches for i in range(1, batches)], 0.01)
    edges = [-float("inf"), *cuts, float("inf")]
    for low, high in zip(edges, edges[1:]):
        at = F.unix_seconds(time)
        df.where((at >= low) & (at < high)).repartition(4).write.mode("append").parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


def replay_late(t, df, time, key, seconds, batches=3):
    """Write ``df`` in the order of an arrival up to ``seconds`` after the row's time, one group of files per micro-batch."""
    path = scratch_path(t.spark, "late")
    arrival = F.unix_micros(time) + F.pmod(F.xxhash64(*key), F.lit(seconds * 1_000_000))
    low, high = df.agg(F.min(arrival), F.max(arrival)).first()
    edges = [low + (high + 1 - low) * i // batches for i in range(batches + 1)]
    for a, b in zip(edges, edges[1:]):
        df.where((arrival >= a) & (arrival < b)).repartition(4).write.mode("append").parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


def drain(t, df, mode="append"):
    path, checkpoint = scratch_path(t.spark, "sink"), scratch_path(t.spark, "checkpoint")
    sl.run_available(df, path, checkpoint, mode)
    return t.spark.read.schema(df.schema).parquet(path)


@query("T4_smoothing_stream", with_sql("label_stream", f"""WITH {vote_sql()}, {EMIT} SELECT session_id, seq, candidate, round(smoothed, 6) AS smoothed, votes, streak, stable, should_emit, status FROM full_""", True))
def _(t):
    ss.use_rocksdb(t.spark)
    labels = t.label_stream().withColumnRenamed("now", "ts").withColumn("epoch", F.lit(0).cast("bigint"))
    out = drain(t, ss.smooth_stream(replay(t, labels, "ts"), OPEN, "1 day"))
    return out.select("session_id", "seq", "candidate", r6("smoothed"), F.col("votes").cast("bigint").alias("votes"), "streak",
                      "stable", "should_emit", "status")


@query("T1_T3_frame_stream", with_sql("label_stream", f"""WITH {LOSS} SELECT session_id, seq, empty_streak, cleared, pushes, pushes >= 4 AND pushes % 2 = 0 AND NOT cleared AS ready FROM (
 SELECT *, row_number() OVER (PARTITION BY session_id, epoch ORDER BY pos) AS pushes FROM loss)"""))
def _(t):
    ss.use_rocksdb(t.spark)
    frames = hand_stream(t).withColumn("kind", F.lit("frame")).withColumn("value", F.array("confidence")).drop("confidence")
    s = replace(LIVE, session_idle_seconds=400 * 86400)
    out = drain(t, ss.process_frames(replay(t, frames, "ts"), s, stride=2, throttle=False, watermark="1 day"))
    return out.select("session_id", "seq", F.col("empty_streak").cast("bigint").alias("empty_streak"), "cleared", "pushes", "ready")


@query("T9_control_events", with_sql("label_stream", """WITH e AS (SELECT *, sum((label = 'signup')::INT) OVER (PARTITION BY session_id ORDER BY now, seq) AS ep FROM label_stream),
 f AS (SELECT *, row_number() OVER (PARTITION BY session_id, ep ORDER BY now, seq) AS pushes FROM e WHERE label <> 'signup') SELECT session_id, seq, pushes, pushes >= 4 AS ready FROM f"""))
def _(t):
    ss.use_rocksdb(t.spark)
    label = F.col("label")
    rows = t.label_stream().select("session_id", "seq", F.col("now").alias("ts"), F.when(label == "signup", "reset").otherwise("frame").alias("kind"),
                                   F.lit(True).alias("has_hands"), F.array("confidence").alias("value"))
    s = replace(LIVE, session_idle_seconds=400 * 86400)
    out = drain(t, ss.process_frames(replay(t, rows, "ts"), s, throttle=False, watermark="1 day"))
    return out.select("session_id", "seq", "pushes", "ready")


# rows of an append stream appear once the watermark (latest time minus the delay) has passed them
MARK = "mark AS (SELECT (max(epoch_us(ts)) // 1000) * 1000 - 3600000000 AS wm FROM events)"


@query("T12_metrics_stream", with_sql("predictions", f"""WITH {MARK} SELECT time_bucket(INTERVAL 1 DAY, "timestamp") AS window_start, model, count(*) AS predictions_total, sum((status = 'UNCERTAIN')::INT)::BIGINT AS uncertain_total,
 round(avg(confidence) + 1e-9, 6) AS confidence_mean, round(avg(nullif(latency_ms, 0)), 6) AS latency_mean FROM predictions GROUP BY 1, 2 HAVING epoch_us(time_bucket(INTERVAL 1 DAY, "timestamp")) + 86400000000 <= (SELECT wm FROM mark)"""))
def _(t):
    p = t.predictions()
    out = drain(t, sl.metrics_stream(replay(t, p, "timestamp"), "1 day", delay="1 hour"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "model", "predictions_total",
                      "uncertain_total", F.round(F.col("confidence_mean") + 1e-9, 6).alias("confidence_mean"), r6("latency_mean"))


@query("T13_verdict_stream", with_sql("predictions feedback", """WITH mark AS (SELECT (max(epoch_us("timestamp")) // 1000) * 1000 - 3600000000 AS wm FROM feedback) SELECT p.event_id, p.predicted_class, f.ord, f.human_action AS f_action, f.corrected_class AS f_class FROM predictions p LEFT JOIN feedback f USING (event_id)
 WHERE f.event_id IS NOT NULL OR epoch_us(p."timestamp") + 86400000000 < (SELECT wm FROM mark)"""))
def _(t):
    out = drain(t, sl.verdict_stream(replay(t, t.predictions(), "timestamp"), replay(t, t.feedback(), "timestamp"), "1 day"))
    return out.select("event_id", "predicted_class", "ord", "f_action", "f_class")


@query("T13_last_verdicts", with_sql("predictions feedback", """WITH v AS (SELECT event_id, arg_max(human_action, ord) AS human_action, arg_max(coalesce(corrected_class, ''), ord) AS corrected_class FROM feedback GROUP BY 1)
 SELECT p.event_id, p.predicted_class, p.confidence, v.human_action, nullif(v.corrected_class, '') AS corrected_class, coalesce(v.corrected_class <> '' OR v.human_action = 'REJECT', false) AS wrong FROM predictions p LEFT JOIN v USING (event_id)"""))
def _(t):
    ss.use_rocksdb(t.spark)
    late = sl.last_verdict_stream(replay_late(t, t.predictions(), "timestamp", ["event_id"], 86400), replay_late(t, t.feedback(), "timestamp", ["ord", "event_id"], 86400), "3 days", "1 day")
    return sl.current_verdicts(drain(t, late)).select("event_id", "predicted_class", "confidence", "human_action", "corrected_class", "wrong")


@query("T12_log_windows_stream", with_sql("predictions feedback", f"""WITH {LOG_SQL}, mark AS (SELECT least((SELECT max(epoch_us("timestamp")) FROM predictions), (SELECT max(epoch_us("timestamp")) FROM feedback)) // 1000 * 1000 - 3600000000 AS wm)
 SELECT * FROM lw WHERE epoch_us(window_start) + 86400000000 <= (SELECT wm FROM mark)"""))
def _(t):
    counts = drain(t, sl.log_windows_stream(replay(t, t.predictions(), "timestamp"), replay(t, t.feedback(), "timestamp"), "1 day"))
    return log_row(log_window_figures(counts))


@query("T6_session_stream", f"""WITH {MARK}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 43200000000 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id AS session_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, s
 HAVING epoch_us(max(ts)) + 43200000000 <= (SELECT wm FROM mark)""")
def _(t):
    ev = t.events().select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts")
    out = drain(t, sl.session_stream(replay(t, ev, "ts"), replace(SMALL, session_idle_seconds=43200)))
    return out.select("session_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "events")


@query("T7_rate_stream", """WITH mark AS (SELECT (max(epoch_us(ts)) // 1000) * 1000 - 60000000 AS wm FROM events), w AS (SELECT user_id AS client, time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * k AS window_start FROM events, (VALUES (0), (1)) v(k))
 SELECT client, window_start, count(*) AS requests, count(*) > 2 AS over_limit FROM w GROUP BY ALL HAVING epoch_us(window_start) + 86400000000 <= (SELECT wm FROM mark)""")
def _(t):
    access = t.events().select(F.col("user_id").alias("client"), "ts")
    out = drain(t, sl.rate_stream(replay(t, access, "ts"), replace(SMALL, rate_window_seconds=86400, rate_limit=2), slide="12 hours"))
    return out.select("client", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "requests", "over_limit")


# the label stream sixty times as fast: pauses of users are minutes, so sessions end by the 900 s of the default settings
FAST = replace(LIVE, cooldown_seconds=1440.0, session_slice_seconds=2880)
FAST_SQL = """fast AS (SELECT * REPLACE (make_timestamp(epoch_us(now) // 60) AS now) FROM label_stream),
 gaps AS (SELECT *, coalesce((epoch_us(now) - lag(epoch_us(now)) OVER (PARTITION BY session_id ORDER BY now, seq) > 900000000)::INT, 0) AS c FROM fast),
 lived AS (SELECT * EXCLUDE (c), sum(c) OVER (PARTITION BY session_id ORDER BY now, seq)::BIGINT AS life FROM gaps),
 mark AS (SELECT max(epoch_us(now)) // 1000 * 1000 - 600000000 AS wm FROM fast)"""


def fast_stream(t):
    return t.label_stream().withColumn("ts", F.expr("timestamp_micros(unix_micros(now) div 60)")).drop("now")


@query("T4_reordered_stream", with_sql("label_stream", f"""WITH {FAST_SQL}, {vote_sql(part="session_id, life", source="lived")}, {emit_sql("session_id, life", 1440)}
 SELECT session_id, seq, candidate, round(smoothed, 6) AS smoothed, votes, streak, stable, should_emit, status FROM full_ WHERE epoch_us(now) <= (SELECT wm FROM mark)""", True))
def _(t):
    ss.use_rocksdb(t.spark)
    labels = fast_stream(t).withColumn("epoch", F.lit(0).cast("bigint"))
    out = drain(t, ss.smooth_stream(replay_late(t, labels, "ts", ["seq"], 600), FAST, "10 minutes", reorder=True))
    return out.select("session_id", "seq", "candidate", r6("smoothed"), F.col("votes").cast("bigint").alias("votes"), "streak", "stable", "should_emit", "status")


@query("T9_T10_reordered_frames", with_sql("label_stream", f"""WITH {FAST_SQL}, e AS (SELECT *, sum((label = 'signup')::INT) OVER (PARTITION BY session_id, life ORDER BY now, seq) AS ep FROM lived),
 f AS (SELECT *, row_number() OVER (PARTITION BY session_id, life, ep ORDER BY now, seq) AS pushes, row_number() OVER (PARTITION BY session_id, life ORDER BY now, seq) AS k FROM e WHERE label <> 'signup')
 SELECT session_id, seq, pushes, pushes >= 4 AS ready, max(epoch_us(now) // 1000 - k) OVER (PARTITION BY session_id, life ORDER BY k) + k AS frame_ms FROM f
 QUALIFY epoch_us(now) <= (SELECT wm FROM mark)"""))
def _(t):
    ss.use_rocksdb(t.spark)
    rows = fast_stream(t).select("session_id", "seq", "ts", F.when(F.col("label") == "signup", "reset").otherwise("frame").alias("kind"),
                                 F.lit(True).alias("has_hands"), F.array("confidence").alias("value"))
    out = drain(t, ss.process_frames(replay_late(t, rows, "ts", ["seq"], 600), FAST, throttle=False, watermark="10 minutes", reorder=True))
    return out.select("session_id", "seq", "pushes", "ready", "frame_ms")


def live_frames(t):
    """Detector output of the clips as camera sessions: a frame every 33 ms, a session per label."""
    c, i = F.col("clip_id"), F.col("frame_idx")
    return t.raw_frames().select(
        (c % 5).alias("session_id"), F.col("vec_id").alias("seq"), F.timestamp_millis(1704067200000 + F.col("vec_id") * 33).alias("ts"),
        F.lit("frame").alias("kind"), "pose", "left_hand", "right_hand")


@query("X3_live_chain")
def _(t):
    from limbwise.operators.sequences import clip_sequences
    from limbwise.operators.scoring import fit_centroids
    from limbwise.plans.live import live_decisions
    ss.use_rocksdb(t.spark)
    s = replace(SMALL, session_idle_seconds=3600, idle_min_motion=0.0)
    model = fit_centroids(clip_sequences(t.frames(), s, ("label",)).where("reason IS NULL"), "label", F.flatten("seq"), s, 0.02)
    out = drain(t, live_decisions(replay(t, live_frames(t), "ts"), model, s, throttle=True))
    return out.select("session_id", "seq", "candidate", r6("smoothed"), "streak", "stable", "should_emit", "status", "logged")
