"""Scoring and evaluation queries."""

from pyspark.sql import functions as F

from limbwise.functions.columns import one_row
from limbwise.functions.draws import uniform
from limbwise.operators import evaluation as ev
from limbwise.operators import scoring as sc
from limbwise.operators import thresholds as th
from workbench.fixtures import LABELS, SMALL, scored, with_sql
from workbench.registry import query

def class_names():
    return F.array(*[F.lit(c) for c in LABELS])

KEYS = ["model", "split"]
r6 = lambda c: F.round(c, 6).alias(c)


def decided(t):
    return scored(t).select("model", "split", "vec_id", F.col("label").alias("y_true"),
                            F.get(class_names(), sc.argmax(F.col("probs"))).alias("y_pred"), F.array_max("probs").alias("confidence"))


def cells(t):
    return ev.confusion(decided(t), KEYS)


CELLS = "cells AS (SELECT model, split, label::VARCHAR AS y_true, pred::VARCHAR AS y_pred, count(*) AS n FROM decided GROUP BY ALL)"
CLASSES_SQL = CELLS + """,
pc AS (SELECT model, split, class, support, predicted, tp,
  CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM (
  SELECT model, split, class, sum(s)::BIGINT AS support, sum(q)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM (
   SELECT model, split, y_true AS class, n AS s, 0 AS q, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM cells
   UNION ALL SELECT model, split, y_pred, 0, n, 0 FROM cells) GROUP BY ALL)),
pcf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pc),
summary AS (SELECT model, split, sum(support)::BIGINT AS n_samples, sum((support > 0)::INT)::BIGINT AS n_classes, sum(tp) / sum(support) AS accuracy,
  avg(precision) FILTER (support > 0) AS macro_precision, avg(recall) FILTER (support > 0) AS macro_recall, avg(f1) FILTER (support > 0) AS macro_f1,
  sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall,
  sum(f1 * support) / sum(support) AS weighted_f1 FROM pcf GROUP BY model, split)"""


def q(body, names="decided"):
    return with_sql(names, body)


@query("G1_class_probabilities", q("SELECT model, vec_id, c::VARCHAR AS class, round(p, 6) AS p FROM scored", "scored"))
def _(t):
    return scored(t).select("model", "vec_id", F.posexplode("probs").alias("i", "p")).select(
        "model", "vec_id", F.get(class_names(), F.col("i")).alias("class"), r6("p"))


@query("G1_top_classes_in_blocks", q("""
SELECT vec_id, rank, class, p FROM (SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c))::INT AS rank, c::VARCHAR AS class, round(p, 6) AS p
 FROM scored WHERE model = 'gru_mha') WHERE rank <= 3""", "scored"))
def _(t):
    base, e = t.table("embeddings").withColumn("label", F.col("label").cast("string")), F.col("embedding").cast("array<double>")
    model = sc.fit_centroid_blocks(base.where(uniform("fit", F.col("vec_id")) < 0.8), "label", e, block_bytes=2048)
    return model.top_classes(base, ["vec_id"], e, 3).select("vec_id", F.posexplode("best").alias("i", "b")).select(
        "vec_id", (F.col("i") + 1).alias("rank"), F.col("b.label").alias("class"), F.round("b.p", 6).alias("p"))


@query("G3_vocabulary_filter", q("""
SELECT vec_id, model, c::VARCHAR AS class, round(CASE WHEN c IN (1, 4, 7) THEN p / s ELSE 0 END, 6) AS p
FROM (SELECT *, sum(CASE WHEN c IN (1, 4, 7) THEN p ELSE 0 END) OVER (PARTITION BY model, vec_id) AS s FROM scored)""", "scored"))
def _(t):
    kept = sc.filter_vocabulary(F.col("probs"), class_names(), F.array(F.lit(" 4"), F.lit("1 "), F.lit("7"), F.lit("zz")))
    return scored(t).select("model", "vec_id", F.posexplode(kept).alias("i", "p")).select(
        "model", "vec_id", F.get(class_names(), F.col("i")).alias("class"), r6("p"))


@query("G6_argmax", q("SELECT model, vec_id, pred::VARCHAR AS label, round(conf, 6) AS confidence FROM decided"))
def _(t):
    return decided(t).select("model", "vec_id", F.col("y_pred").alias("label"), r6("confidence"))


@query("G7_stream_gate", q("""SELECT model, vec_id, pred::VARCHAR AS raw_sign, round(conf, 6) AS raw_confidence,
CASE WHEN conf >= 0.1::DOUBLE AND margin >= 0.01::DOUBLE THEN pred::VARCHAR ELSE 'UNCERTAIN' END AS gated FROM decided"""))
def _(t):
    from dataclasses import replace
    out = sc.stream_gate(scored(t), class_names(), replace(SMALL, smart_min_prob=0.1, smart_min_margin=0.01))
    return out.select("model", "vec_id", "raw_sign", r6("raw_confidence"), "gated")


@query("G8_clip_gate", q("""SELECT model, vec_id, pred::VARCHAR AS predicted_class,
CASE WHEN conf >= 0.15::DOUBLE THEN 'CONFIDENT' ELSE 'UNCERTAIN' END AS status,
CASE WHEN conf >= 0.15::DOUBLE THEN pred::VARCHAR ELSE 'UNCERTAIN' END AS gated_sign FROM decided"""))
def _(t):
    return sc.clip_gate(scored(t), class_names(), 0.15).select("model", "vec_id", "predicted_class", "status", "gated_sign")


@query("G9_top_k", q("""SELECT model, vec_id, rank, c::VARCHAR AS class, round(p, 6) AS probability FROM (
 SELECT *, row_number() OVER (PARTITION BY model, vec_id ORDER BY p DESC, c) AS rank FROM scored) WHERE rank <= 5""", "scored"))
def _(t):
    return scored(t).select("model", "vec_id", F.posexplode(sc.top_k(F.col("probs"), class_names(), 5)).alias("i", "s")).select(
        "model", "vec_id", (F.col("i") + 1).cast("bigint").alias("rank"), "s.class", F.round("s.probability", 6).alias("probability"))


def batch(t):
    s = scored(t).where("model = 'gru_mha'")
    v = F.col("vec_id")
    clips = t.table("embeddings").select(
        F.col("vec_id").alias("clip_id"), F.concat(F.lit("clip_"), v.cast("string"), F.lit(".mov")).alias("file"),
        F.when(v % 4 != 0, F.col("label").cast("string")).otherwise("").alias("true_class"))
    ok = s.where((v % 17 != 0) & (v % 13 != 0)).select(
        F.col("vec_id").alias("clip_id"), "probs", ((v * 37 % 1000) / 10).alias("latency_ms"))
    problems = s.where(v % 17 == 0).select(F.col("vec_id").alias("clip_id"), F.lit("ERROR").alias("status"),
                                           F.lit("ValueError: bad file").alias("error"))
    return sc.batch_rows(clips, ok, problems, class_names(), 0.15)


BATCH = """rows AS (SELECT e.vec_id AS clip_id, 'clip_' || e.vec_id || '.mov' AS file,
 CASE WHEN e.vec_id % 4 <> 0 THEN e.label::VARCHAR ELSE '' END AS true_class,
 CASE WHEN e.vec_id % 17 = 0 THEN 'ERROR' WHEN e.vec_id % 13 = 0 THEN 'SKIPPED' ELSE d.pred::VARCHAR END AS predicted_class,
 CASE WHEN e.vec_id % 17 = 0 OR e.vec_id % 13 = 0 THEN 0 ELSE round(d.conf, 6) END AS confidence,
 CASE WHEN e.vec_id % 17 = 0 THEN 'ERROR' WHEN e.vec_id % 13 = 0 THEN 'SKIPPED' WHEN d.conf >= 0.15::DOUBLE THEN 'CONFIDENT' ELSE 'UNCERTAIN' END AS status,
 CASE WHEN e.vec_id % 17 = 0 OR e.vec_id % 13 = 0 THEN 0 ELSE (e.vec_id * 37 % 1000) / 10 END AS latency_ms,
 CASE WHEN e.vec_id % 17 = 0 OR e.vec_id % 13 = 0 OR e.vec_id % 4 = 0 THEN NULL ELSE (d.pred = e.label)::INT END AS correct,
 CASE WHEN e.vec_id % 17 = 0 THEN 'ValueError: bad file' WHEN e.vec_id % 13 = 0 THEN 'no usable landmarks' ELSE '' END AS error
FROM embeddings e JOIN decided d ON d.vec_id = e.vec_id AND d.model = 'gru_mha')"""


@query("G10_batch_scoring", q("WITH " + BATCH + "SELECT * FROM rows"))
def _(t):
    return batch(t).select("clip_id", "file", "true_class", "predicted_class", "confidence", "status", "latency_ms", "correct", "error")


@query("G11_batch_summary", q("WITH " + BATCH + """SELECT count(*) AS clips, count(correct) AS labelled_clips, round(avg(correct), 6) AS accuracy,
 round(avg((status = 'UNCERTAIN')::INT), 6) AS uncertain_rate, round(avg(latency_ms) FILTER (status IN ('CONFIDENT', 'UNCERTAIN')), 3) AS mean_latency_ms,
 round(quantile_cont(latency_ms, 0.95) FILTER (status IN ('CONFIDENT', 'UNCERTAIN')), 3) AS p95_latency_ms,
 round(1000 / avg(latency_ms) FILTER (status IN ('CONFIDENT', 'UNCERTAIN')), 2) AS throughput_fps,
 sum((status = 'ERROR')::INT)::BIGINT AS errors, sum((status = 'SKIPPED')::INT)::BIGINT AS skipped FROM rows"""))
def _(t):
    out = sc.batch_summary(batch(t), [])
    return out.select(*[r6(c) if c in ("accuracy", "uncertain_rate") else F.col(c) for c in out.columns])


@query("G12_rolling_latency", with_sql("predictions", """
SELECT event_id, round(avg(latency_ms) OVER w + 1e-9, 6) AS mean_latency_ms, round(quantile_cont(latency_ms, 0.95) OVER w, 6) AS p95_latency_ms,
 round(1000 / avg(latency_ms) OVER w, 4) AS throughput_fps FROM predictions
WINDOW w AS (PARTITION BY model ORDER BY "timestamp", event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)"""))
def _(t):
    return sc.rolling_latency(t.predictions(), ["model"], "timestamp", "event_id", settings=SMALL).select(
        "event_id", F.round(F.col("mean_latency_ms") + 1e-9, 6).alias("mean_latency_ms"), r6("p95_latency_ms"), F.round("throughput_fps", 4).alias("throughput_fps"))


@query("G2_logistic_fit")
def _(t):
    base = t.table("embeddings").withColumn("label", F.col("label").cast("string")).withColumn(
        "split", F.when(uniform("fit", F.col("vec_id")) < 0.8, "train").otherwise("val"))
    vec = F.col("embedding").cast("array<double>")
    model = sc.fit_logistic(base.where("split = 'train'"), "label", vec, 10)
    names = F.array(*[F.lit(c) for c in model.stages[0].labels])
    rows = sc.logistic_probabilities(model, base, vec)
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.avg(
        (F.get(names, sc.argmax(F.col("probs"))) == F.col("label")).cast("double")).alias("accuracy"))


@query("G2_training_report", """WITH s AS (SELECT vec_id, label, ('0x' || substr(md5('fit|' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.8::DOUBLE AS train FROM embeddings)
 SELECT count(DISTINCT label) FILTER (train)::INT AS classes, 64 AS features, 10 AS max_iter, count(*) FILTER (train) AS train_rows, count(*) FILTER (NOT train) AS val_rows,
 true AS falls, true AS learned, 0::BIGINT AS bad_rows, 0::BIGINT AS changed_rows FROM s""")
def _(t):
    """Fit, store, load again: the history falls, the train rows are told better than by chance, probabilities are distributions, the loaded model gives the same."""
    from limbwise.sources.workspace import scratch_path
    vec, path = F.col("embedding").cast("array<double>"), scratch_path(t.spark, "logistic")
    base = t.table("embeddings").withColumn("label", F.col("label").cast("string"))
    train, val = (base.where((uniform("fit", F.col("vec_id")) < 0.8) == F.lit(side)) for side in (True, False))
    model = sc.fit_logistic(train, "label", vec, 10)
    sc.store_model(model, sc.training_report(model, train, val, "label", vec), path)
    again = sc.stored_model(path)
    one, two = (sc.logistic_probabilities(m, base, vec).select("vec_id", F.col("probs").alias(f"p{k}")) for k, m in enumerate((model, again)))
    total = F.aggregate("p0", F.lit(0.0), lambda a, p: a + p)
    sums = one.join(two, "vec_id").agg(F.count_if((F.abs(total - 1) > 1e-9) | F.exists("p0", lambda p: p < 0)).alias("bad_rows"), F.count_if(F.col("p0") != F.col("p1")).alias("changed_rows"))
    report = t.spark.read.schema("classes int, features int, max_iter int, reg_param double, objective array<double>, train_rows bigint, train_accuracy double, val_rows bigint, val_accuracy double").json(f"{path}/report")
    falls = F.forall(F.sequence(F.lit(1), F.size("objective") - 1), lambda i: F.get("objective", i) <= F.get("objective", i - 1) + 1e-9)
    common = train.groupBy("label").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("share"))
    learned = sc.beats_chance(F.col("train_accuracy"), F.col("train_rows"), F.col("share"))
    told = one_row(report, common).select("classes", "features", "max_iter", "train_rows", "val_rows", falls.alias("falls"), learned.alias("learned"))
    return one_row(told, sums)


@query("E1_confusion", q("WITH " + CELLS + "SELECT * FROM cells"))
def _(t):
    return cells(t)


@query("E1_dense_confusion", q("WITH " + CELLS + """SELECT model, split, a::VARCHAR AS y_true, b::VARCHAR AS y_pred, coalesce(n, 0) AS n
FROM (SELECT DISTINCT model, split FROM cells) CROSS JOIN range(0, 10) x(a) CROSS JOIN range(0, 10) y(b)
LEFT JOIN cells c USING (model, split) WHERE false UNION ALL
SELECT k.model, k.split, a::VARCHAR, b::VARCHAR, coalesce(c.n, 0) FROM (SELECT DISTINCT model, split FROM cells) k
CROSS JOIN range(0, 10) x(a) CROSS JOIN range(0, 10) y(b) LEFT JOIN cells c ON c.model = k.model AND c.split = k.split AND c.y_true = a::VARCHAR AND c.y_pred = b::VARCHAR"""))
def _(t):
    return ev.dense_confusion(cells(t), KEYS, LABELS)


@query("E2_per_class", q("WITH " + CLASSES_SQL + "SELECT model, split, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pcf"))
def _(t):
    return ev.per_class(cells(t), KEYS).select(*KEYS, "class", r6("precision"), r6("recall"), r6("f1"), "support")


SCORES = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]


@query("E3_E4_averages", q("WITH " + CLASSES_SQL + "SELECT model, split, n_samples, n_classes, "
                           + ", ".join(f"round({c}, 6) AS {c}" for c in SCORES) + " FROM summary"))
def _(t):
    return ev.averages(ev.per_class(cells(t), KEYS), KEYS).select(*KEYS, "n_samples", "n_classes", *[r6(c) for c in SCORES])


@query("E2_truth_labels", """
WITH c AS (SELECT quality AS y, 1 - toxic AS p FROM labels), k AS (SELECT class, sum((y = class)::INT) AS support, sum((p = class)::INT) AS predicted,
 sum((y = class AND p = class)::INT) AS tp FROM c, (VALUES (0), (1)) v(class) GROUP BY class HAVING support + predicted > 0)
SELECT class::VARCHAR AS class, support::BIGINT AS support, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS precision,
 round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall FROM k""")
def _(t):
    rows = t.table("labels").select(F.lit("x").alias("m"), F.col("quality").cast("string").alias("y_true"),
                                    (1 - F.col("toxic")).cast("string").alias("y_pred"))
    return ev.per_class(ev.confusion(rows, ["m"]), ["m"]).select("class", "support", r6("precision"), r6("recall"))


@query("E5_row_normalised", q("WITH " + CELLS + "SELECT model, split, y_true, y_pred, round(n / sum(n) OVER (PARTITION BY model, split, y_true), 6) AS share FROM cells"))
def _(t):
    return ev.row_normalised(cells(t), KEYS).select(*KEYS, "y_true", "y_pred", r6("share"))


@query("E6_top_confusions", q("WITH " + CELLS + """SELECT model, split, y_true, y_pred, n, rank FROM (SELECT *, row_number() OVER (
 PARTITION BY model, split ORDER BY n DESC, y_true, y_pred)::INT AS rank FROM cells WHERE y_true <> y_pred) WHERE rank <= 20"""))
def _(t):
    return ev.top_confusions(cells(t), KEYS)


@query("E7_extreme_classes", q("WITH " + CLASSES_SQL + """, s AS (SELECT * FROM pcf WHERE support > 0)
SELECT model, split, 'weakest' AS side, rank, class, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY f1, class)::INT AS rank FROM s) WHERE rank <= 10
UNION ALL SELECT model, split, 'strongest', rank, class, round(f1, 6) FROM (SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY f1 DESC, class DESC)::INT AS rank FROM s) WHERE rank <= 5"""))
def _(t):
    return ev.extreme_classes(ev.per_class(cells(t), KEYS), KEYS).select(*KEYS, "side", "rank", "class", r6("f1"))


@query("E8_wide_comparison", q("WITH " + CLASSES_SQL + "SELECT class, " + ", ".join(
    f"max({'CASE WHEN' } model = '{m}' THEN round({s}, 6) END) AS {m}_{n}" for m in SMALL.models
    for s, n in (("precision", "precision"), ("recall", "recall"), ("recall", "accuracy"), ("f1", "f1")))
    + ", " + ", ".join(f"max(CASE WHEN model = '{m}' THEN support END) AS {m}_support" for m in SMALL.models)
    + " FROM pcf WHERE split = 'test' GROUP BY class"))
def _(t):
    return ev.wide_comparison(ev.per_class(cells(t).where("split = 'test'"), KEYS), SMALL.models)


@query("E9_model_ranking", q("WITH " + CLASSES_SQL + """SELECT split, model, round(macro_f1, 6) AS macro_f1, rank, rank = 1 AS best FROM (SELECT *, row_number() OVER (PARTITION BY split
 ORDER BY macro_f1 DESC, CASE model WHEN 'lstm' THEN 1 WHEN 'gru' THEN 2 ELSE 3 END)::INT AS rank FROM summary)"""))
def _(t):
    ranked = ev.rank_models(ev.averages(ev.per_class(cells(t), KEYS), KEYS), SMALL.models, ["split"])
    return ranked.select("split", "model", r6("macro_f1"), "rank", "best")


LAT = "round(avg(value), 6) AS mean_ms, count(value) AS samples, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(1000 / avg(value), 6) AS throughput_fps"


@query("E10_latency_summary", f"SELECT CASE event_id % 3 WHEN 0 THEN 'lstm' WHEN 1 THEN 'gru' ELSE 'gru_mha' END AS model, {LAT} FROM events GROUP BY 1")
def _(t):
    out = ev.latency_summary(t.predictions().join(t.events().select("event_id", "value"), "event_id"), ["model"], F.col("value"))
    return out.select("model", r6("mean_ms"), "samples", r6("p50_ms"), r6("p95_ms"), r6("throughput_fps"))


@query("E10_latency_per_class", f"SELECT event_type, {LAT} FROM events GROUP BY 1")
def _(t):
    out = ev.latency_summary(t.events(), ["event_type"], F.col("value"))
    return out.select("event_type", r6("mean_ms"), "samples", r6("p50_ms"), r6("p95_ms"), r6("throughput_fps"))


@query("E11_recall_extremes", q("WITH " + CLASSES_SQL + """, m AS (SELECT class, avg(recall) AS mr, max(support) AS support FROM pcf WHERE split = 'test' GROUP BY class)
(SELECT class, round(mr, 6) AS mean_recall, support, 'needs review' AS side FROM m ORDER BY mr, class LIMIT 5)
UNION ALL (SELECT class, round(mr, 6), support, 'high recall' FROM m ORDER BY mr DESC, class DESC LIMIT 5)"""))
def _(t):
    pc = ev.per_class(cells(t).where("split = 'test'"), KEYS)
    return ev.recall_extremes(pc).select("class", r6("mean_recall"), "support", "side")


SWEEP = """swept AS (SELECT model, split, th / 100.0::DOUBLE AS threshold, count(*) AS n, sum((conf >= th / 100.0::DOUBLE)::INT)::BIGINT AS accepted,
 sum((conf >= th / 100.0::DOUBLE AND pred = label)::INT)::BIGINT AS accepted_correct FROM (SELECT model, split, label, pred, least(conf * 3, 1) AS conf FROM decided), range(20, 96, 5) r(th) GROUP BY ALL)
SELECT model, split, threshold, round(accepted / n, 6) AS coverage, round(CASE WHEN accepted > 0 THEN accepted_correct / accepted END, 6) AS selective_accuracy,
 round(1 - accepted / n, 6) AS uncertain_rate, accepted, accepted_correct, round(accepted_correct / n, 6) AS pessimistic_accuracy FROM swept"""


def swept(t):
    rows = decided(t).withColumn("correct", F.col("y_true") == F.col("y_pred")).withColumn(
        "confidence", F.least(F.col("confidence") * 3, F.lit(1.0)))
    return th.sweep(rows, KEYS)


@query("E12_threshold_sweep", q("WITH " + SWEEP))
def _(t):
    return swept(t)


@query("E13_sweep_at_default", q("WITH " + SWEEP + " WHERE abs(threshold - 0.38::DOUBLE) < 1e-9"))
def _(t):
    return th.at_threshold(swept(t), SMALL.confidence_threshold)


@query("E13_sweep_at_configured", q("WITH " + SWEEP + " WHERE abs(threshold - 0.7::DOUBLE) < 1e-9"))
def _(t):
    return th.at_threshold(swept(t), 0.70)
