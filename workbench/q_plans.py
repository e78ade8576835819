"""End-to-end queries."""

from dataclasses import replace

from pyspark.sql import functions as F

from limbwise.functions.draws import uniform
from limbwise.operators.landmarks import normalise_frames
from limbwise.operators.sequences import build_clips
from limbwise.plans import dataset, requests
from workbench.fixtures import SMALL, draw_sql, with_sql
from workbench.q_robustness import grid_sql
from workbench.registry import query

r6 = lambda c: F.round(c, 6).alias(c)
US = draw_sql("'split'", "clip_id")
DECIDED = grid_sql(("clean",)) + f""", used AS (SELECT *, CASE WHEN {US} < 0.4::DOUBLE THEN 'test' ELSE 'train' END AS split FROM grid WHERE model = 'lstm'),
 cen AS (SELECT label AS c, i, d, avg(v) AS v FROM used WHERE split = 'train' GROUP BY ALL),
 dist AS (SELECT u.split, u.clip_id, any_value(u.label) AS label, k.c, -0.02::DOUBLE * sum((u.v - k.v) * (u.v - k.v)) AS s FROM used u JOIN cen k ON k.i = u.i AND k.d = u.d GROUP BY u.split, u.clip_id, k.c),
 pr AS (SELECT *, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY clip_id) AS p FROM (SELECT *, max(s) OVER (PARTITION BY clip_id) AS m FROM dist)),
 dec AS (SELECT split, clip_id, any_value(label)::VARCHAR AS y_true, arg_max(c, p)::VARCHAR AS y_pred, max(p) AS confidence FROM pr GROUP BY split, clip_id)"""


def index(t):
    u = uniform("split", F.col("clip_id"))
    return t.frames().groupBy("clip_id").agg(F.min_by("label", "frame_idx").alias("label")).withColumn(
        "split", F.when(u < 0.4, "test").otherwise("train"))


def fitted(t):
    seqs = dataset.indexed_sequences(t.frames(), index(t), SMALL)
    return seqs, dataset.fit(seqs, SMALL, sharpness=0.02)


@query("X1_dataset_to_metrics", with_sql("seq", f"""WITH {DECIDED}, pc AS (SELECT split, class, sum((y_true = class)::INT) AS sup, sum((y_pred = class)::INT) AS prd, sum((y_true = class AND y_pred = class)::INT) AS tp
   FROM dec JOIN (SELECT DISTINCT label::VARCHAR AS class FROM seq) ON true GROUP BY ALL),
 pf AS (SELECT *, CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END AS f1 FROM pc)
 SELECT 'centroid' AS model, split, sum(sup)::BIGINT AS n_samples, round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(f1) FILTER (sup > 0), 6) AS macro_f1, round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1 FROM pf GROUP BY split"""))
def _(t):
    seqs, model = fitted(t)
    return dataset.metrics(dataset.decisions(seqs, model, "centroid")).select(
        "model", "split", "n_samples", r6("accuracy"), r6("macro_f1"), r6("weighted_f1"))


@query("X2_clip_requests", with_sql("seq clips", f"""WITH {DECIDED} SELECT c.clip_id, CASE WHEN c.t < 5 THEN 'too_few_frames' WHEN c.t > 15 THEN 'too_many_frames' ELSE '' END AS reasons,
 CASE WHEN c.t BETWEEN 5 AND 15 THEN y_pred END AS predicted_class, CASE WHEN c.t BETWEEN 5 AND 15 THEN round(confidence, 6) END AS confidence,
 CASE WHEN c.t NOT BETWEEN 5 AND 15 THEN NULL WHEN confidence >= (5 + c.clip_id % 5) / 20 THEN 'CONFIDENT' ELSE 'UNCERTAIN' END AS status
 FROM clips c LEFT JOIN dec USING (clip_id) WHERE c.usable >= 5 OR c.t < 5"""))
def _(t):
    _, model = fitted(t)
    clips = build_clips(normalise_frames(t.frames(), SMALL), "features", SMALL).where("usable >= 5 OR t < 5")
    req = clips.select("clip_id", F.col("seq").alias("features"), F.lit(None).cast("string").alias("dataset_clip"),
                       ((5 + F.col("clip_id") % 5) / 20).alias("threshold"), F.lit("gru").alias("model"), F.lit(None).cast("string").alias("profile"))
    out = requests.answer(req, model, replace(SMALL, max_sequence_length=15))
    cols = ["clip_id", "reasons", "predicted_class", "confidence", "status"]
    decided = out.decided.withColumn("reasons", F.lit("")).withColumn("confidence", F.round("confidence", 6)).select(*cols)
    refused = out.refused.withColumn("reasons", F.array_join("reasons", ",")).select("clip_id", "reasons")
    return decided.unionByName(refused, allowMissingColumns=True)


US3 = f"CASE WHEN {US} < 0.15::DOUBLE THEN 'test' WHEN {US} < 0.25::DOUBLE THEN 'val' ELSE 'train' END"
SET = f"""idx AS (SELECT clip_id, label::VARCHAR AS label, {US3} AS split, t, usable, dense_rank() OVER (ORDER BY label::VARCHAR) - 1 AS class_index FROM clips),
 told AS (SELECT *, CASE WHEN clip_id % 11 = 3 THEN 'damaged' WHEN usable < 5 THEN 'too few usable frames' END AS reason FROM idx)"""


def training_set(t):
    u = uniform("split", F.col("clip_id"))
    clips = t.frames().groupBy("clip_id").agg(F.min_by(F.col("label").cast("string"), "frame_idx").alias("label")).withColumn(
        "split", F.when(u < 0.15, "test").when(u < 0.25, "val").otherwise("train"))
    return dataset.training_tables(clips, t.frames(), clips.where(F.col("clip_id") % 11 == 3).select("clip_id", F.lit("damaged").alias("error")), SMALL)


@query("S12_training_meta", with_sql("clips", f"""WITH {SET} SELECT clip_id, label, class_index::INT AS class_index, split, copy::INT AS copy, t::INT AS frames_source, 12 AS frames FROM told, range(0, 2) r(copy)
 WHERE reason IS NULL AND (copy = 0 OR split = 'train')"""))
def _(t):
    return training_set(t)[0].select("clip_id", "label", "class_index", "split", "copy", "frames_source", F.size("seq").alias("frames"))


@query("S12_skipped_clips", with_sql("clips", f"WITH {SET} SELECT clip_id, label, split, reason FROM told WHERE reason IS NOT NULL"))
def _(t):
    return training_set(t)[1]


@query("S12_training_counts", with_sql("clips", f"""WITH {SET} SELECT split, sum(CASE WHEN reason IS NOT NULL THEN 0 WHEN split = 'train' THEN 2 ELSE 1 END)::BIGINT AS samples, count(*) FILTER (reason IS NULL) AS clips,
 count(reason) AS skipped FROM told GROUP BY split"""))
def _(t):
    from limbwise.sources import logs
    return logs.training_summary(*training_set(t))
