"""Perturbation and degradation queries."""

from pyspark.sql import functions as F

from limbwise.functions.draws import uniform
from limbwise.operators import robustness as rb
from limbwise.operators.scoring import argmax, fit_centroids
from limbwise.operators.sequences import clip_sequences
from workbench.fixtures import SMALL, draw_sql, normal_sql, with_sql
from workbench.registry import query

r6 = lambda c: F.round(c, 6).alias(c)
MODELS = ("lstm", "gru")
PROTO = "session_disjoint"


def sequences(t):
    u = uniform("split", F.col("clip_id"))
    return (clip_sequences(t.frames(), SMALL, ("label",)).where("reason IS NULL")
            .select("clip_id", F.col("label").cast("string").alias("y_true"),
                    F.when(u < 0.4, "test").otherwise("train").alias("split"), "seq"))


def key_sql(op, cond, *more):
    return (f"'{op}'", "'42'", cond, "model", f"'{PROTO}'", "clip_id", *more)


def condition_sql(name):
    """SELECT clip_id, label, model, i, d, v for one condition over ``base`` (seq x models)."""
    op, level = rb.CONDITIONS[name]
    c = f"'{name}'"
    head = "SELECT clip_id, label, model, i, d, "
    if op == "dropout":
        return head + f"CASE WHEN {draw_sql(*key_sql('landmark', c, 'i', 'd // 3'))} < {level}::DOUBLE THEN 0 ELSE v END AS v FROM base"
    if op in ("left_hand", "right_hand", "hands"):
        lo, hi = {"left_hand": (33, 48), "right_hand": (48, 63), "hands": (33, 63)}[op]
        return head + f"CASE WHEN d >= {lo} AND d < {hi} THEN 0 ELSE v END AS v FROM base"
    if op == "gaussian":
        return head + f"v + {level}::DOUBLE * ({normal_sql(key_sql('gauss', c, 'i', 'd // 3'), 'd % 3')}) AS v FROM base"
    if op in ("frame_drop", "frame_skip"):
        keep = f"{draw_sql(*key_sql('drop', c, 'i'))} >= {level}::DOUBLE" if op == "frame_drop" else "i % 2 = 0"
        return f"""SELECT a.clip_id, a.label, a.model, g.i, a.d, a.v + (b.v - a.v) * (g.i * (a.n - 1) / 11.0::DOUBLE - floor(g.i * (a.n - 1) / 11.0::DOUBLE)) AS v
 FROM range(0, 12) g(i) JOIN kept_{name} a ON a.r = floor(g.i * (a.n - 1) / 11.0::DOUBLE)
 JOIN kept_{name} b ON b.clip_id = a.clip_id AND b.model = a.model AND b.d = a.d AND b.r = least(floor(g.i * (a.n - 1) / 11.0::DOUBLE) + 1, a.n - 1)""", keep
    return head + "v FROM base"


def grid_sql(names):
    ctes = ["base AS (SELECT clip_id, label, m.model, i, d, v FROM seq, (VALUES ('lstm'), ('gru')) m(model))"]
    parts = []
    for name in names:
        sql = condition_sql(name)
        if isinstance(sql, tuple):
            sql, keep = sql
            ctes.append(f"""kept_{name} AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY clip_id, model ORDER BY i) - 1 AS r, (count(*) OVER (PARTITION BY clip_id, model, d)) AS n FROM (
 SELECT *, count(*) FILTER (k) OVER (PARTITION BY clip_id, model, d) AS alive FROM (SELECT *, {keep} AS k FROM base)) WHERE k OR alive < 5)""")
        parts.append(f"SELECT '{name}' AS condition, * FROM ({sql})")
    ctes.append("grid AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")")
    return ", ".join(ctes)


def grid(t, names):
    return rb.condition_grid(sequences(t), MODELS, PROTO, names, SMALL)


def values(df):
    return (df.select("condition", "model", "clip_id", F.posexplode("seq").alias("i", "f"))
            .select("condition", "model", "clip_id", "i", F.posexplode("f").alias("d", "v"))
            .select("condition", "model", "clip_id", "i", "d", r6("v")))


def register(key, names):
    @query(key, with_sql("seq", f"WITH {grid_sql(names)} SELECT condition, model, clip_id, i::INT AS i, d::INT AS d, round(v, 6) AS v FROM grid"))
    def _(t):
        return values(grid(t, names))


register("R1_clean_copy", ("clean",))
register("R2_landmark_dropout", ("landmark_dropout_p10", "landmark_dropout_p30"))
register("R3_missing_hands", ("hand_left_missing", "hand_right_missing", "both_hands_missing"))
register("R4_gaussian", ("gaussian_sigma_10", "gaussian_sigma_25", "gaussian_sigma_50"))
register("R5_frame_drop", ("frame_drop_p20", "frame_drop_p40", "frame_drop_p60"))
register("R6_frame_skip", ("frame_skip_keep50",))


@query("R7_mask_missing", with_sql("lm", """WITH f AS (SELECT clip_id, frame_idx, j*3 + a AS d, CASE a WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS v FROM lm, range(0, 3) r(a)
 UNION ALL SELECT clip_id, frame_idx, 63 + j, 0 FROM lm) SELECT clip_id, frame_idx AS i, d::INT AS d, round(v, 6) AS v FROM f"""))
def _(t):
    from dataclasses import replace
    s = replace(SMALL, with_mask=True)
    one = t.frames().select("clip_id", "frame_idx", F.array(F.concat(F.flatten("coords"), "mask")).alias("seq"))
    gone = one.select("clip_id", F.col("frame_idx").alias("i"), rb.perturb(F.col("seq"), "mask_missing", [], s)[0].alias("f"))
    return gone.select("clip_id", "i", F.posexplode("f").alias("d", "v")).select("clip_id", "i", "d", r6("v"))


def scored(t):
    """Every condition scored by a per-model centroid classifier (gru sees the hands only)."""
    base = sequences(t)
    flat = F.flatten("seq")
    hands = F.flatten(F.transform("seq", lambda f: F.slice(f, 34, 30)))
    every = grid(t, tuple(rb.CONDITIONS))
    out = None
    for model, part, sharp in (("lstm", flat, 0.02), ("gru", hands, 0.05)):
        scorer = fit_centroids(base.where("split = 'train'"), "y_true", part, SMALL, sharp)
        names = F.array(*map(F.lit, scorer.classes))
        rows = (scorer.score(every.where(F.col("model") == model), part)
                .select("protocol", "split", "model", "condition", "clip_id", "y_true",
                        F.get(names, argmax(F.col("probs"))).alias("y_pred"), F.array_max("probs").alias("confidence")))
        out = rows if out is None else out.unionByName(rows)
    return out


US = draw_sql("'split'", "clip_id")
SCORED_SQL = grid_sql(tuple(rb.CONDITIONS)) + f""", used AS (SELECT *, CASE WHEN {US} < 0.4::DOUBLE THEN 'test' ELSE 'train' END AS split FROM grid WHERE model = 'lstm' OR d >= 33),
 cen AS (SELECT model, label AS c, i, d, avg(v) AS v FROM used WHERE condition = 'clean' AND split = 'train' GROUP BY ALL),
 dist AS (SELECT u.condition, u.model, u.split, u.clip_id, any_value(u.label) AS label, k.c, -(CASE u.model WHEN 'lstm' THEN 0.02 ELSE 0.05 END)::DOUBLE * sum((u.v - k.v) * (u.v - k.v)) AS s FROM used u JOIN cen k ON k.model = u.model AND k.i = u.i AND k.d = u.d GROUP BY u.condition, u.model, u.split, u.clip_id, k.c),
 pr AS (SELECT *, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY condition, model, clip_id) AS p FROM (SELECT *, max(s) OVER (PARTITION BY condition, model, clip_id) AS m FROM dist)),
 dec AS (SELECT condition, model, split, clip_id, any_value(label)::VARCHAR AS y_true, arg_max(c, p)::VARCHAR AS y_pred, max(p) AS confidence FROM pr GROUP BY condition, model, split, clip_id),
 pc AS (SELECT condition, model, split, class, sum((y_true = class)::INT) AS sup, sum((y_pred = class)::INT) AS prd, sum((y_true = class AND y_pred = class)::INT) AS tp
   FROM dec JOIN (SELECT DISTINCT label::VARCHAR AS class FROM seq) ON true GROUP BY ALL),
 pf AS (SELECT *, CASE WHEN prd > 0 THEN tp / prd ELSE 0 END AS pre, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rec, CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END AS f1 FROM pc),
 met AS (SELECT condition, model, split, sum(tp) / sum(sup) AS accuracy, avg(pre) FILTER (sup > 0) AS macro_precision, avg(rec) FILTER (sup > 0) AS macro_recall, avg(f1) FILTER (sup > 0) AS macro_f1,
   sum(f1 * sup) / sum(sup) AS weighted_f1 FROM pf GROUP BY ALL),
 gate AS (SELECT condition, model, split, avg(confidence) AS mean_confidence, sum((confidence < 0.38::DOUBLE)::INT)::BIGINT AS n_below_threshold FROM dec GROUP BY ALL),
 metrics AS (SELECT * FROM met JOIN gate USING (condition, model, split))"""
M = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "mean_confidence"]


@query("R8_condition_grid", with_sql("seq", f"""WITH c AS (SELECT DISTINCT clip_id FROM seq) SELECT clip_id, model, condition, 12 AS frames FROM c, (VALUES ('lstm'), ('gru')) m(model), (VALUES {", ".join(f"('{c}')" for c in rb.CONDITIONS)}) k(condition)"""))
def _(t):
    return grid(t, tuple(rb.CONDITIONS)).select("clip_id", "model", "condition", F.size("seq").alias("frames"))


@query("R9_condition_metrics", with_sql("seq", f"WITH {SCORED_SQL} SELECT condition, model, split, n_below_threshold, " + ", ".join(f"round({c}, 6) AS {c}" for c in M) + " FROM metrics"))
def _(t):
    return rb.condition_metrics(scored(t), settings=SMALL).select("condition", "model", "split", "n_below_threshold", *[r6(c) for c in M])


@query("R10_deltas", with_sql("seq", f"""WITH {SCORED_SQL} SELECT m.condition, m.model, m.split, round(m.accuracy - c.accuracy, 6) AS accuracy_delta, round(m.macro_f1 - c.macro_f1, 6) AS macro_f1_delta,
 round(100 * (c.accuracy - m.accuracy) / greatest(c.accuracy, 1e-9), 3) AS relative_accuracy_drop_pct FROM metrics m JOIN metrics c ON c.condition = 'clean' AND c.model = m.model AND c.split = m.split"""))
def _(t):
    return rb.deltas(rb.condition_metrics(scored(t), settings=SMALL)).select(
        "condition", "model", "split", "accuracy_delta", "macro_f1_delta", "relative_accuracy_drop_pct")


@query("R11_best_per_condition", with_sql("seq", f"""WITH {SCORED_SQL} SELECT condition, split, model, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY condition, split ORDER BY round(accuracy, 9) DESC, CASE model WHEN 'lstm' THEN 1 ELSE 2 END) AS r FROM metrics) WHERE r = 1"""))
def _(t):
    return rb.best_per_condition(rb.condition_metrics(scored(t), settings=SMALL), MODELS).select("condition", "split", "model", r6("accuracy"))
