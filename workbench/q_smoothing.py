"""Label smoothing and live batch-twin queries."""

from dataclasses import replace

from pyspark.sql import functions as F

from limbwise.operators import live as lv
from limbwise.operators import smoothing as sm
from workbench.fixtures import SMALL, with_sql
from workbench.registry import query

r6 = lambda c: F.round(c, 6).alias(c)


def vote_sql(window=3, need=2, part="session_id", source="label_stream", stable=2):
    """CTEs up to the stable flag, written with plain windows over whole sessions."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY now, seq) AS pos FROM {source}),
 win AS (SELECT a.*, b.label AS wl, b.confidence AS wc, b.pos AS wp FROM o a JOIN o b ON {" AND ".join(f"a.{p} = b.{p}" for p in part.split(", "))} AND b.pos BETWEEN a.pos - {window - 1} AND a.pos),
 tally AS (SELECT {part}, pos, wl, count(*) AS votes, min(wp) AS early, avg(wc) AS conf FROM win GROUP BY {part}, pos, wl),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part}, pos ORDER BY votes DESC, early) AS r FROM tally) WHERE r = 1),
 cand AS (SELECT o.*, b.votes, b.conf AS smoothed, CASE WHEN b.votes >= {need} THEN b.wl ELSE 'UNCERTAIN' END AS candidate FROM o JOIN best b USING ({part}, pos)),
 ch AS (SELECT *, CASE WHEN lag(candidate) OVER (PARTITION BY {part} ORDER BY pos) = candidate THEN 0 ELSE 1 END AS c FROM cand),
 isl AS (SELECT *, sum(c) OVER (PARTITION BY {part} ORDER BY pos) AS island FROM ch),
 st AS (SELECT *, row_number() OVER (PARTITION BY {part}, island ORDER BY pos) AS streak FROM isl),
 stable AS (SELECT *, candidate NOT IN ('UNCERTAIN', 'IDLE') AND streak >= {stable} AS stable FROM st)"""


def emit_sql(part="session_id", cooldown=86400):
    """CTEs from the stable flag to emission and status, by a walk along each session."""
    same = " AND ".join(f"n.{p} = w.{p}" for p in part.split(", "))
    own = ", ".join(f"n.{p}" for p in part.split(", "))
    due = f"n.candidate <> w.candidate OR n.m - w.last_at >= {cooldown * 1_000_000}"
    return f"""nums AS (SELECT {part}, pos, candidate, epoch_us(now) AS m, row_number() OVER (PARTITION BY {part} ORDER BY pos) AS k FROM stable WHERE stable),
 walk AS (SELECT {part}, pos, candidate, k, m AS last_at, true AS emit FROM nums WHERE k = 1
  UNION ALL SELECT {own}, n.pos, n.candidate, n.k, CASE WHEN {due} THEN n.m ELSE w.last_at END, {due} FROM walk w JOIN nums n ON {same} AND n.k = w.k + 1),
 full_ AS (SELECT s.*, coalesce(w.emit, false) AS should_emit, CASE candidate WHEN 'IDLE' THEN 'IDLE' WHEN 'UNCERTAIN' THEN 'UNCERTAIN' ELSE CASE WHEN stable THEN 'CONFIDENT' ELSE 'PENDING' END END AS status
  FROM stable s LEFT JOIN (SELECT {part}, pos, emit FROM walk) w USING ({part}, pos))"""


EMIT = emit_sql()
BASE = vote_sql()
FULL = f"{BASE}, {EMIT}"


def smoothed(t):
    return sm.smooth(t.label_stream(), SMALL)


def one(name, sql, cols, recursive=False):
    body = f"WITH {FULL if recursive else BASE} SELECT session_id, seq, {sql} FROM {'full_' if recursive else 'stable'}"

    @query(name, with_sql("label_stream", body, recursive))
    def _(t):
        out = sm.majority_votes(t.label_stream(), SMALL)
        if "streak" in cols:
            out = sm.with_streaks(out, SMALL)
        if recursive:
            out = smoothed(t)
        return out.select("session_id", "seq", *[r6(c) if c == "smoothed" else F.col(c).cast("bigint").alias(c) if c in ("votes", "streak") else F.col(c) for c in cols])


one("H1_H3_majority_vote", "candidate, votes", ["candidate", "votes"])
one("H2_smoothed_confidence", "round(smoothed, 6) AS smoothed", ["smoothed"])
one("H4_H5_streak_stable", "streak, stable", ["streak", "stable"])
one("H6_H7_emission_status", "should_emit, status", ["should_emit", "status"], True)


@query("H6_no_suppression", with_sql("label_stream", f"WITH {BASE} SELECT session_id, seq, stable AS should_emit FROM stable"))
def _(t):
    return sm.smooth(t.label_stream(), replace(SMALL, suppress_duplicates=False)).select("session_id", "seq", "should_emit")


@query("H4_null_session", with_sql("label_stream", f"""WITH ns AS (SELECT * REPLACE (CASE WHEN session_id % 3 = 0 THEN -1 ELSE session_id END AS session_id) FROM label_stream),
 {vote_sql(source="ns")} SELECT nullif(session_id, -1) AS session_id, seq, candidate, streak, stable FROM stable"""))
def _(t):
    nameless = t.label_stream().withColumn("session_id", F.when(F.col("session_id") % 3 != 0, F.col("session_id")))
    return sm.smooth(nameless, SMALL).select("session_id", "seq", "candidate", F.col("streak").cast("bigint").alias("streak"), "stable")


def with_undo(t):
    """Emitted words of the event stream; purchases take a word back."""
    s = t.label_stream().join(t.events().select(F.col("event_id").alias("seq"), "event_type"), "seq")
    return s.select("session_id", "seq", "now", F.when(F.col("event_type") != "purchase", F.col("label")).alias("word"),
                    (F.col("event_type") == "purchase").alias("undo"))


CAPTION = """a AS (SELECT user_id AS session_id, event_id AS seq, ts, label AS word, CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END AS step FROM events JOIN label_stream ON seq = event_id),
 s AS (SELECT *, sum(step) OVER (PARTITION BY session_id ORDER BY ts, seq) AS total FROM a),
 l AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY session_id ORDER BY ts, seq)) AS h FROM s),
 f AS (SELECT *, min(h) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM l),
 words AS (SELECT session_id, h::BIGINT AS place, word, epoch_us(ts) // 172800000000 AS slice FROM f WHERE step = 1 AND coalesce(later, h) >= h)"""


@query("H8_caption_words", with_sql("label_stream", f"WITH {CAPTION} SELECT session_id, place, word FROM words"))
def _(t):
    return sm.caption_words(with_undo(t), SMALL)


@query("H8_caption_lines", with_sql("label_stream", f"WITH {CAPTION} SELECT session_id, string_agg(word, ' ' ORDER BY place) AS text FROM words GROUP BY ALL"))
def _(t):
    return sm.caption_lines(sm.caption_words(with_undo(t), SMALL))


EPOCH = "ep AS (SELECT l.*, sum((seq % 17 = 0)::INT) OVER (PARTITION BY session_id ORDER BY now, seq)::BIGINT AS epoch FROM label_stream l)"


@query("H9_reset", with_sql("label_stream", f"WITH {EPOCH}, {vote_sql(part='session_id, epoch', source='ep')} SELECT session_id, seq, epoch, candidate, streak, stable FROM stable"))
def _(t):
    marked = sm.with_epochs(t.label_stream().withColumn("reset", F.col("seq") % 17 == 0), SMALL, "reset")
    keys = ("session_id", "epoch")
    return sm.with_streaks(sm.majority_votes(marked, SMALL, keys), SMALL, keys).select(
        "session_id", "seq", "epoch", "candidate", F.col("streak").cast("bigint").alias("streak"), "stable")


@query("H10_window_override", with_sql("label_stream", f"WITH {vote_sql(5, 3, stable=1)} SELECT session_id, seq, candidate, votes, stable FROM stable"))
def _(t):
    s = sm.for_window(5, SMALL)
    return sm.with_streaks(sm.majority_votes(t.label_stream(), s), s).select(
        "session_id", "seq", "candidate", F.col("votes").cast("bigint").alias("votes"), "stable")


# -- live twins --------------------------------------------------------------
LIVE = replace(SMALL, hand_loss_frames=3, sequence_length=4, frame_gap_ms=6 * 3600 * 1000)


def hand_stream(t):
    return t.label_stream().select("session_id", "seq", F.col("now").alias("ts"), (F.col("label") != "UNCERTAIN").alias("has_hands"),
                                   "confidence")


LOSS = """hs AS (SELECT *, label <> 'UNCERTAIN' AS hands, row_number() OVER (PARTITION BY session_id ORDER BY now, seq) AS pos FROM label_stream),
 g AS (SELECT *, count(*) FILTER (hands) OVER (PARTITION BY session_id ORDER BY pos) AS grp FROM hs),
 e AS (SELECT *, CASE WHEN hands THEN 0 ELSE pos - coalesce(max(pos) FILTER (hands) OVER (PARTITION BY session_id ORDER BY pos), 0) END AS empty_streak FROM g),
 loss AS (SELECT *, empty_streak >= 3 AS cleared, coalesce(sum((empty_streak >= 3)::INT) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS epoch FROM e)"""


@query("T3_hand_loss", with_sql("label_stream", f"WITH {LOSS} SELECT session_id, seq, empty_streak, cleared, epoch FROM loss"))
def _(t):
    return lv.hand_loss(hand_stream(t), LIVE).select("session_id", "seq", "empty_streak", "cleared", "epoch")


@query("T1_ring_buffer", with_sql("label_stream", f"""WITH {LOSS} SELECT session_id, seq, pushes, pushes >= 4 AND pushes % 2 = 0 AND NOT cleared AS ready, least(pushes, 4)::INT AS filled, round(total, 6) AS total FROM (
 SELECT *, row_number() OVER w AS pushes, sum(confidence) OVER (PARTITION BY session_id, epoch ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS total FROM loss WINDOW w AS (PARTITION BY session_id, epoch ORDER BY pos))"""))
def _(t):
    out = lv.ring_buffer(lv.hand_loss(hand_stream(t), LIVE), F.col("confidence"), LIVE, stride=2)
    return out.select("session_id", "seq", "pushes", "ready", F.size("buffer").alias("filled"),
                      F.round(F.aggregate("buffer", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("T2_throttle", with_sql("label_stream", """WITH n AS (SELECT session_id, seq, epoch_us(now) AS m, row_number() OVER (PARTITION BY session_id ORDER BY now, seq) AS k FROM label_stream),
 w AS (SELECT session_id, seq, k, m AS last_at, true AS ok FROM n WHERE k = 1 UNION ALL
  SELECT n.session_id, n.seq, n.k, CASE WHEN n.m - w.last_at >= 21600000000 THEN n.m ELSE w.last_at END, n.m - w.last_at >= 21600000000 FROM w JOIN n ON n.session_id = w.session_id AND n.k = w.k + 1)
 SELECT session_id, seq FROM w WHERE ok""", True))
def _(t):
    return lv.throttle(hand_stream(t), LIVE).select("session_id", "seq")


@query("T5_change_log", with_sql("label_stream", f"""WITH {BASE}, d AS (SELECT *, CASE candidate WHEN 'IDLE' THEN 'IDLE' WHEN 'UNCERTAIN' THEN 'UNCERTAIN' ELSE CASE WHEN stable THEN 'CONFIDENT' ELSE 'PENDING' END END AS status FROM stable),
 n AS (SELECT *, lag(candidate || '/' || status) OVER (PARTITION BY session_id ORDER BY pos) AS last_ FROM d WHERE status <> 'IDLE')
 SELECT session_id, seq, candidate, status FROM n WHERE last_ IS DISTINCT FROM candidate || '/' || status"""))
def _(t):
    decided = sm.with_status(sm.with_streaks(sm.majority_votes(t.label_stream(), SMALL), SMALL), SMALL)
    return lv.change_log(decided.drop("_slice"), SMALL).select("session_id", "seq", "candidate", "status")


@query("T6_session_expiry", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 43200000000 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id AS session_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, s""")
def _(t):
    ev = t.events().select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts")
    out = lv.sessions(ev, replace(SMALL, session_idle_seconds=43200))
    return out.select("session_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "events")


@query("T7_request_rates", """SELECT event_id, count(*) OVER w AS requests, count(*) OVER w > 2 AS over_limit FROM (SELECT *, epoch_us(ts) AS m FROM events)
 WINDOW w AS (PARTITION BY user_id ORDER BY m RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""")
def _(t):
    access = t.events().select("event_id", F.col("user_id").alias("client"), "ts")
    return lv.request_rates(access, replace(SMALL, rate_window_seconds=86400, rate_limit=2)).select("event_id", "requests", "over_limit")


@query("T8_smoothed_rate", with_sql("label_stream", """WITH n AS (SELECT session_id, seq, confidence * 30 AS v, row_number() OVER (PARTITION BY session_id ORDER BY now, seq) AS k FROM label_stream),
 w AS (SELECT session_id, seq, k, v AS ema FROM n WHERE k = 1 UNION ALL SELECT n.session_id, n.seq, n.k, 0.9::DOUBLE * w.ema + 0.1::DOUBLE * n.v FROM w JOIN n ON n.session_id = w.session_id AND n.k = w.k + 1)
 SELECT session_id, seq, round(ema, 6) AS fps_ema FROM w""", True))
def _(t):
    out = lv.smoothed_rate(hand_stream(t), F.col("confidence") * 30, SMALL)
    return out.select("session_id", "seq", r6("fps_ema"))


@query("T10_monotone_time", """WITH n AS (SELECT user_id AS session_id, event_id AS seq, (value * 100)::BIGINT + event_id AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 w AS (SELECT *, max(t - k) OVER (PARTITION BY session_id ORDER BY k) + k AS frame_ms FROM n) SELECT session_id, seq, frame_ms FROM w""")
def _(t):
    df = t.events().select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").alias("arrival"),
                           (F.rint(F.col("value") * 100).cast("bigint") + F.col("event_id")).alias("ts_ms"))
    return lv.monotone_time(df, SMALL).select("session_id", "seq", "frame_ms")


@query("T11_stage_timings", """WITH l AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, s.stage, CASE s.stage WHEN 'decode' THEN value WHEN 'buffer' THEN value / 10 ELSE value * 2 END AS ms
 FROM events, (VALUES ('decode'), ('buffer'), ('model')) s(stage)) SELECT window_start, stage, count(*) AS frames, round(avg(ms), 4) AS mean_ms, round(quantile_disc(ms, 0.95), 4) AS p95_ms FROM l GROUP BY ALL""")
def _(t):
    rows = t.events().select("ts", F.col("value").alias("decode"), (F.col("value") / 10).alias("buffer"), (F.col("value") * 2).alias("model"))
    out = lv.stage_timings(rows, ["decode", "buffer", "model"], "ts", "1 day")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "stage", "frames", F.round("mean_ms", 4).alias("mean_ms"),
                      F.round("p95_ms", 4).alias("p95_ms"))


@query("T12_windowed_metrics", with_sql("predictions", """SELECT time_bucket(INTERVAL 1 DAY, "timestamp") AS window_start, model, count(*) AS predictions_total,
 sum((status = 'UNCERTAIN')::INT)::BIGINT AS uncertain_total, round(avg((status = 'UNCERTAIN')::INT), 6) AS uncertain_rate, round(avg(confidence) + 1e-9, 6) AS confidence_mean,
 max(confidence) AS confidence_max, round(avg(nullif(latency_ms, 0)), 6) AS latency_mean, max(latency_ms) AS latency_max FROM predictions GROUP BY 1, 2"""))
def _(t):
    out = lv.windowed_metrics(t.predictions(), "1 day")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "model", "predictions_total", "uncertain_total",
                      r6("uncertain_rate"), F.round(F.col("confidence_mean") + 1e-9, 6).alias("confidence_mean"), "confidence_max", r6("latency_mean"), "latency_max")


LOG_SQL = """p AS (SELECT time_bucket(INTERVAL 1 DAY, "timestamp") AS window_start, model, count(*) AS predictions_total, sum((status = 'UNCERTAIN')::INT) AS uncertain_total, avg(confidence) AS cm,
  avg(nullif(latency_ms, 0)) AS lm, quantile_disc(nullif(latency_ms, 0), 0.5) AS p50, quantile_disc(nullif(latency_ms, 0), 0.95) AS p95 FROM predictions GROUP BY 1, 2),
 f AS (SELECT time_bucket(INTERVAL 1 DAY, "timestamp") AS window_start, model, count(*) AS feedback_total, count(corrected_class) AS corrections_total, count(*) FILTER (human_action = 'ACCEPT') AS accept_total,
  count(*) FILTER (human_action = 'CORRECT') AS correct_total, count(*) FILTER (human_action = 'REJECT') AS reject_total FROM feedback GROUP BY 1, 2),
 lw AS (SELECT window_start, model, coalesce(predictions_total, 0) AS predictions_total, coalesce(feedback_total, 0) AS feedback_total, coalesce(corrections_total, 0) AS corrections_total,
  coalesce(accept_total, 0) AS accept_total, coalesce(correct_total, 0) AS correct_total, coalesce(reject_total, 0) AS reject_total, coalesce(uncertain_total, 0)::BIGINT AS uncertain_total,
  round(coalesce(cm, 0) + 1e-9, 6) AS confidence_mean, coalesce(p50, 0) AS latency_p50, coalesce(p95, 0) AS latency_p95, round(coalesce(1000 / lm, 0), 6) AS throughput_fps,
  round(accept_total / nullif(accept_total + correct_total + reject_total, 0), 6) AS agreement_rate FROM p FULL JOIN f USING (window_start, model))"""


def log_row(out):
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "model", "predictions_total", "feedback_total", "corrections_total", "accept_total",
                      "correct_total", "reject_total", "uncertain_total", F.round(F.col("confidence_mean") + 1e-9, 6).alias("confidence_mean"), "latency_p50", "latency_p95",
                      r6("throughput_fps"), r6("agreement_rate"))


@query("T12_log_windows", with_sql("predictions feedback", f"WITH {LOG_SQL} SELECT * FROM lw"))
def _(t):
    return log_row(lv.log_windows(t.predictions(), t.feedback(), "1 day"))
