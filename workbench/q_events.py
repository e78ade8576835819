"""Recognition-log queries."""

from pyspark.sql import functions as F

from limbwise.operators import events as ev
from limbwise.operators import validate as va
from workbench.fixtures import CLASSES, SMALL, with_sql
from workbench.registry import query

r6 = lambda c: F.round(c, 6).alias(c)

JOINED = """
WITH newest AS (SELECT event_id, max_by(human_action, ord) AS fa, max_by(coalesce(corrected_class, ''), ord) AS fc FROM feedback GROUP BY 1),
joined AS (SELECT p.*, n.fa AS human_action, nullif(n.fc, '') AS corrected_class,
  coalesce(nullif(n.fc, '') IS NOT NULL OR n.fa = 'REJECT', false) AS wrong
  FROM predictions p LEFT JOIN newest n USING (event_id))
"""
EVENT_COLS = ["event_id", "timestamp", "model", "predicted_class", "confidence", "status", "latency_ms",
              "human_action", "corrected_class", "source", "wrong"]
COLS = ", ".join(f'"{c}"' if c == "timestamp" else c for c in EVENT_COLS)


def joined(t):
    return ev.with_verdicts(t.predictions(), t.feedback(), "ord")


def plain(df):
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("J1_prediction_events", """
SELECT substr(sha256('predictions|' || event_id), 1, 12) AS event_id,
 CASE event_id % 3 WHEN 0 THEN 'lstm' WHEN 1 THEN 'gru' ELSE 'gru_mha' END AS model, event_type AS predicted_class,
 round(least(value / 200, 1), 6) AS confidence, round(value, 3) AS latency_ms, round(value / 7, 2) AS fps, user_id AS session_id
FROM events""")
def _(t):
    df = t.events().select(F.lit("predictions").alias("kind"), "event_id", F.col("ts").alias("timestamp"),
                           F.element_at(F.array(*map(F.lit, SMALL.models)), (F.col("event_id") % 3 + 1).cast("int")).alias("model"),
                           F.col("event_type").alias("predicted_class"),
                           F.least(F.col("value") / 200, F.lit(1.0)).alias("confidence"), F.lit("CONFIDENT").alias("status"),
                           F.col("value").alias("latency_ms"), (F.col("value") / 7).alias("fps"),
                           F.col("user_id").alias("session_id"))
    return ev.prediction_events(df, ["kind", "event_id"], ["session_id"]).select(
        "event_id", "model", "predicted_class", "confidence", "latency_ms", "fps", "session_id")


@query("J2_feedback_events", with_sql("feedback", """
SELECT substr(sha256('feedback|' || event_id || '|' || ord), 1, 12) AS feedback_id, event_id, human_action,
       predicted_class, corrected_class, model FROM feedback"""))
def _(t):
    raw = (t.feedback().withColumn("kind", F.lit("feedback")).withColumn("confidence", F.lit(None).cast("double"))
           .withColumn("human_action", F.concat(F.lit(" "), F.lower("human_action"))))
    return ev.feedback_events(raw, ["kind", "event_id", "ord"]).select(
        "feedback_id", "event_id", "human_action", "predicted_class", "corrected_class", "model")


@query("J2_failure_events", """
SELECT substr(sha256('documents|' || doc_id), 1, 12) AS failure_id, substr(source || ':' || lang || repeat('x', 70), 1, 64) AS stage,
       md5(substr(text, 1, 1000)) AS message_md5, length(substr(text, 1, 1000)) AS message_length FROM documents""")
def _(t):
    raw = t.table("documents").select(
        F.lit("documents").alias("kind"), "doc_id",
        F.concat("source", F.lit(":"), "lang", F.lit("x" * 70)).alias("stage"), F.col("text").alias("message"))
    return ev.failure_events(raw, ["kind", "doc_id"]).select(
        "failure_id", "stage", F.md5("message").alias("message_md5"), F.length("message").cast("bigint").alias("message_length"))


@query("J3_events_with_verdict", with_sql("predictions feedback", JOINED + f"SELECT {COLS} FROM joined"))
def _(t):
    return plain(joined(t)).select(*EVENT_COLS)


@query("J4_wrong_by_model", with_sql("predictions feedback", JOINED + """
SELECT model, predicted_class, count(*) AS n, sum(wrong::INT)::BIGINT AS wrong FROM joined GROUP BY 1, 2"""))
def _(t):
    return joined(t).groupBy("model", "predicted_class").agg(
        F.count("*").alias("n"), F.count_if("wrong").alias("wrong"))


@query("J5_newest_events", with_sql("predictions feedback", JOINED + f"""
SELECT {COLS} FROM joined ORDER BY "timestamp" DESC, event_id LIMIT 100"""))
def _(t):
    return plain(ev.newest_first(joined(t), 100)).select(*EVENT_COLS)


METRICS = """
, p AS (SELECT {by} count(*) AS predictions_total, sum((status = 'UNCERTAIN')::INT)::BIGINT AS uncertain_total,
  avg(confidence) AS cm, min(confidence) AS cmin, max(confidence) AS cmax,
  avg(nullif(latency_ms, 0)) AS lm, max(nullif(latency_ms, 0)) AS lmax,
  quantile_cont(nullif(latency_ms, 0), 0.5) AS p50, quantile_cont(nullif(latency_ms, 0), 0.95) AS p95 FROM predictions {group}),
f AS (SELECT {by} count(*) AS feedback_total, count(corrected_class) AS corrections_total,
  sum((human_action='ACCEPT')::INT)::BIGINT AS a, sum((human_action='CORRECT')::INT)::BIGINT AS c, sum((human_action='REJECT')::INT)::BIGINT AS r FROM feedback {group})
SELECT {by} predictions_total, feedback_total, corrections_total, a AS accept_total, c AS correct_total, r AS reject_total,
  uncertain_total, round(uncertain_total / predictions_total, 6) AS uncertain_rate, round(cm, 6) AS confidence_mean,
  cmin AS confidence_min, cmax AS confidence_max, round(lm, 6) AS latency_mean, round(p50, 6) AS latency_p50,
  round(p95, 6) AS latency_p95, lmax AS latency_max, round(1000.0::DOUBLE / lm, 6) AS throughput_fps,
  round(a / (a + c + r), 6) AS agreement_rate, uncertain_total + r + corrections_total AS review_total
FROM p {join}"""
ROUNDED = ["uncertain_rate", "confidence_mean", "latency_mean", "latency_p50", "latency_p95", "throughput_fps", "agreement_rate"]


def metrics(t, by):
    out = ev.log_metrics(t.predictions(), t.feedback(), by)
    return out.select(*[r6(c) if c in ROUNDED else F.col(c) for c in out.columns])


@query("J6_metrics_summary", with_sql("predictions feedback", "WITH x AS (SELECT 1)" + METRICS.format(by="", group="", join="CROSS JOIN f")))
def _(t):
    return metrics(t, [])


@query("J6_metrics_by_model", with_sql("predictions feedback", "WITH x AS (SELECT 1)" + METRICS.format(
    by="model,", group="GROUP BY model", join="JOIN f USING (model)")))
def _(t):
    return metrics(t, ["model"])


@query("J6_null_model", with_sql("predictions feedback", "WITH x AS (SELECT 1)" + METRICS.format(
    by="m,", group="GROUP BY m", join="JOIN f USING (m)").replace("SELECT m,", "SELECT nullif(m, '') AS model,").replace(
    "(SELECT nullif(m, '') AS model, count", "(SELECT coalesce(nullif(model, 'gru'), '') AS m, count")))
def _(t):
    nameless = lambda df: df.withColumn("model", F.when(F.col("model") != "gru", F.col("model")))
    out = ev.log_metrics(nameless(t.predictions()), nameless(t.feedback()), ["model"])
    return out.select(*[r6(c) if c in ROUNDED else F.col(c) for c in out.columns])


@query("J6_counts", with_sql("predictions feedback", """
SELECT 'status' AS kind, status AS key, count(*) AS n FROM predictions GROUP BY 2
UNION ALL SELECT 'class', predicted_class, count(*) FROM predictions GROUP BY 2
UNION ALL SELECT 'model', model, count(*) FROM predictions GROUP BY 2
UNION ALL SELECT 'action', human_action, count(*) FROM feedback GROUP BY 2"""))
def _(t):
    return ev.log_counts(t.predictions(), t.feedback())


@query("J6_count_maps", with_sql("predictions feedback", """
WITH c AS (SELECT 'status' AS kind, status AS key, count(*) AS n FROM predictions GROUP BY 2
UNION ALL SELECT 'model', model, count(*) FROM predictions GROUP BY 2
UNION ALL SELECT 'action', human_action, count(*) FROM feedback GROUP BY 2)
SELECT kind, '{' || string_agg('"' || key || '":' || n, ',' ORDER BY key) || '}' AS counts FROM c GROUP BY kind"""))
def _(t):
    return ev.counts_as_maps(ev.log_counts(t.predictions(), t.feedback())).select("kind", F.to_json("counts").alias("counts"))


@query("J6_top_classes", with_sql("predictions", """
SELECT predicted_class, count(*) AS n FROM predictions GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15"""))
def _(t):
    return ev.top_classes(t.predictions())


@query("J6_metrics_lineitem", """
WITH p AS (SELECT l_returnflag AS model, count(*) AS predictions_total, round(avg(l_discount), 6) AS confidence_mean,
  round(avg(l_extendedprice), 4) AS latency_mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS latency_p50,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS latency_p95, max(l_extendedprice) AS latency_max FROM lineitem GROUP BY 1)
SELECT * FROM p""")
def _(t):
    p = t.table("lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_discount").alias("confidence"),
                                   F.col("l_extendedprice").alias("latency_ms"), F.lit("CONFIDENT").alias("status"))
    out = ev.log_metrics(p, t.feedback().limit(0), ["model"])
    return out.select("model", "predictions_total", r6("confidence_mean"), F.round("latency_mean", 4).alias("latency_mean"),
                      r6("latency_p50"), r6("latency_p95"), "latency_max")


@query("J7_correction_pairs", with_sql("feedback", """
SELECT predicted_class AS predicted, corrected_class AS corrected, count(*) AS count FROM feedback
WHERE corrected_class IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2"""))
def _(t):
    return ev.correction_pairs(t.feedback(), 2)


@query("J8_newest_failures", """
SELECT substr(sha256('f|' || event_id), 1, 12) AS failure_id, user_id AS session_id, event_type AS stage
FROM events WHERE event_type = 'error' ORDER BY ts DESC, substr(sha256('f|' || event_id), 1, 12) DESC LIMIT 5000""")
def _(t):
    raw = t.events().where(F.col("event_type") == "error").select(
        F.lit("f").alias("k"), "event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("stage"),
        F.col("props").alias("message"), F.col("user_id").alias("session_id"))
    return ev.newest_failures(ev.failure_events(raw, ["k", "event_id"]), 5000).select("failure_id", "session_id", "stage")


@query("J9_stand_in_events", with_sql("predictions feedback", """
WITH known AS (SELECT * FROM predictions WHERE status <> 'UNCERTAIN')
SELECT event_id, model, predicted_class, status, source, false AS fallback_logged FROM known
UNION ALL SELECT event_id, model, predicted_class, 'CONFIDENT', 'live-camera', true FROM feedback
WHERE ord = 1 AND event_id NOT IN (SELECT event_id FROM known)"""))
def _(t):
    known = t.predictions().where(F.col("status") != "UNCERTAIN")
    return ev.with_stand_ins(known, t.feedback()).select(
        "event_id", "model", "predicted_class", "status", "source", "fallback_logged")


@query("J10_review_total", with_sql("predictions feedback", """
SELECT (SELECT count(*) FROM predictions WHERE status = 'UNCERTAIN') +
 (SELECT sum((human_action = 'REJECT')::INT + (corrected_class IS NOT NULL)::INT) FROM feedback)::BIGINT AS review_total"""))
def _(t):
    return ev.log_metrics(t.predictions(), t.feedback()).select("review_total")


@query("P11_review_filter", with_sql("predictions feedback", JOINED + f"""
SELECT {COLS} FROM joined WHERE confidence >= 0.1::DOUBLE AND confidence <= 0.9::DOUBLE AND model = 'gru' AND source = 'api'
 AND human_action = 'CORRECT' AND predicted_class = 'click'"""))
def _(t):
    return plain(ev.review_filter(joined(t), min_confidence=0.1, max_confidence=0.9, model="gru", source="api",
                                  action="correct", predicted_class="CLICK", only_corrected=True)).select(*EVENT_COLS)


@query("P11_uncertain_rejected", with_sql("predictions feedback", JOINED + """
SELECT event_id, confidence FROM joined WHERE status = 'UNCERTAIN' AND human_action = 'REJECT'"""))
def _(t):
    return ev.review_filter(joined(t), status="uncertain", only_uncertain=True, only_rejected=True).select("event_id", "confidence")


@query("P12_flagged_search", with_sql("predictions feedback", JOINED + f"""
SELECT {COLS} FROM joined WHERE (status = 'UNCERTAIN' OR (human_action IS NOT NULL AND human_action <> 'ACCEPT'))
 AND (contains(lower(predicted_class), 'rr') OR contains(model, 'rr') OR contains(coalesce(corrected_class, ''), 'rr') OR contains(source, 'rr'))"""))
def _(t):
    return plain(ev.flagged(joined(t), " RR ")).select(*EVENT_COLS)


@query("P9_feedback_rules", """
WITH f AS (SELECT event_id, CASE WHEN value < 20 THEN lower(event_type) WHEN value < 60 THEN 'CORRECT' ELSE 'ACCEPT' END AS human_action,
  repeat(event_type, (event_id % 20)::INT) AS predicted_class, CASE WHEN user_id % 3 = 0 THEN event_type WHEN user_id % 3 = 1 THEN '  ' END AS corrected_class,
  value / 100 AS confidence, repeat(props, user_id::INT % 60) AS note FROM events)
SELECT event_id, array_to_string(list_filter([
  CASE WHEN human_action NOT IN ('ACCEPT', 'CORRECT', 'REJECT') THEN 'unknown_action' END,
  CASE WHEN length(predicted_class) NOT BETWEEN 1 AND 64 THEN 'class_length' END,
  CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence_range' END,
  CASE WHEN length(note) > 500 THEN 'note_length' END,
  CASE WHEN human_action = 'CORRECT' AND trim(coalesce(corrected_class, '')) = '' THEN 'correct_needs_class' END], lambda v: v IS NOT NULL), ',') AS reasons,
  trim(coalesce(corrected_class, '')) = '' OR corrected_class IN ('click', 'error') AS known_class
FROM f""")
def _(t):
    raw = t.events().select(
        "event_id", F.when(F.col("value") < 20, F.lower("event_type")).when(F.col("value") < 60, "CORRECT").otherwise("ACCEPT").alias("human_action"),
        F.expr("repeat(event_type, cast(event_id % 20 as int))").alias("predicted_class"),
        F.when(F.col("user_id") % 3 == 0, F.col("event_type")).when(F.col("user_id") % 3 == 1, "  ").alias("corrected_class"),
        (F.col("value") / 100).alias("confidence"), F.expr("repeat(props, cast(user_id % 60 as int))").alias("note"))
    vocab = t.spark.createDataFrame([("Click",), ("error",)], "label string")
    checked = va.validate(va.with_known_class(raw, vocab), va.feedback_rules())
    return checked.select("event_id", F.array_join("reasons", ",").alias("reasons"), "known_class")
