"""Time-axis, augmentation and training-set queries."""

from dataclasses import replace

from pyspark.sql import functions as F

from limbwise.functions.draws import uniform
from limbwise.operators import augment as ag
from limbwise.operators import scoring as sc
from limbwise.operators import sequences as sq
from workbench.fixtures import SMALL, TEST_LAYOUT, draw_sql, normal_sql, with_sql
from workbench.registry import query

r6 = lambda c: F.round(c, 6).alias(c)
W = TEST_LAYOUT.width


def features(t):
    """Normalised clips before resampling (usable ones), with t and label."""
    from limbwise.operators.landmarks import normalise_frames
    clips = sq.build_clips(normalise_frames(t.frames(), SMALL), "features", SMALL, ("label",))
    return clips.where(F.col("usable") >= SMALL.min_valid_frames)


def sequences(t):
    return sq.clip_sequences(t.frames(), SMALL, ("label",)).where("reason IS NULL")


def long(df, keys=("clip_id",), col="seq"):
    return (df.select(*keys, F.posexplode(col).alias("i", "f")).select(*keys, "i", F.posexplode("f").alias("d", "v"))
            .select(*keys, "i", "d", r6("v")))


OUT = "clip_id, i::INT AS i, d::INT AS d, round(v, 6) AS v"


@query("Q1_resample_linear", with_sql("seq", f"SELECT {OUT} FROM seq"))
def _(t):
    return long(features(t).withColumn("seq", sq.resample(F.col("seq"), 12, W)))


@query("Q2_resample_uniform", with_sql("feat", f"""WITH p AS (SELECT DISTINCT t, round_even(g.i * (t - 1) / 11.0::DOUBLE, 0)::INT AS p FROM (SELECT DISTINCT t FROM feat), range(0, 12) g(i)),
 q AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM p),
 s AS (SELECT q.t, g.i, q.p FROM q JOIN range(0, 12) g(i) ON g.i = q.i OR (q.i = q.n - 1 AND g.i > q.i))
 SELECT clip_id, s.i::INT AS i, d::INT AS d, round(v, 6) AS v FROM feat JOIN s ON s.t = feat.t AND s.p = feat.frame_idx"""))
def _(t):
    return long(features(t).withColumn("seq", sq.resample_uniform(F.col("seq"), 12)))


PAD = """WITH p AS (SELECT t, g.i, CASE WHEN t > 12 THEN (t - 12) // 2 + g.i ELSE g.i - (12 - t) // 2 END AS s FROM (SELECT DISTINCT t FROM feat), range(0, 12) g(i))
 SELECT clip_id, p.i::INT AS i, d::INT AS d, round({value}, 6) AS v FROM p JOIN feat f ON f.t = p.t AND f.frame_idx = CASE WHEN s < 0 THEN {front} WHEN s >= p.t THEN p.t - 1 ELSE s END"""


@query("Q3_pad_edge", with_sql("feat", PAD.format(value="v", front="p.t - 1")))
def _(t):
    return long(features(t).withColumn("seq", sq.pad_or_crop(F.col("seq"), 12, W, "edge")))


@query("Q3_pad_edge_both", with_sql("feat", PAD.format(value="v", front="0")))
def _(t):
    return long(features(t).withColumn("seq", sq.pad_or_crop(F.col("seq"), 12, W, "edge_both")))


@query("Q3_pad_zero", with_sql("feat", PAD.format(value="CASE WHEN s < 0 OR s >= p.t THEN 0 ELSE v END", front="0")))
def _(t):
    return long(features(t).withColumn("seq", sq.pad_or_crop(F.col("seq"), 12, W, "zero")))


@query("Q4_windows", with_sql("seq", """SELECT clip_id, (frame_idx // 1 * 0 + s.w)::INT AS w, (frame_idx - s.w * 5)::INT AS i, d::INT AS d, round(v, 6) AS v
 FROM feat JOIN range(0, 10) s(w) ON t >= 12 AND s.w * 5 + 12 <= t AND frame_idx BETWEEN s.w * 5 AND s.w * 5 + 11
 UNION ALL SELECT clip_id, 0, i::INT, d::INT, round(v, 6) FROM seq WHERE clip_id IN (SELECT clip_id FROM clips WHERE t < 12)"""))
def _(t):
    df = features(t).select("clip_id", F.posexplode(sq.windows(F.col("seq"), 12, 5, W)).alias("w", "seq"))
    return long(df, ("clip_id", "w"))


@query("Q5_temporal_crop", with_sql("feat", f"""WITH k AS (SELECT clip_id, t, keep, floor({draw_sql("'crop'", "'42'", "clip_id", "1")} * (t - keep + 1))::INT AS start FROM (
 SELECT *, greatest(2, round_even(t * 0.7::DOUBLE, 0))::INT AS keep FROM (SELECT DISTINCT clip_id, t FROM feat)))
 SELECT f.clip_id, (frame_idx - start)::INT AS i, d::INT AS d, round(v, 6) AS v FROM feat f JOIN k USING (clip_id) WHERE frame_idx >= start AND frame_idx < start + keep"""))
def _(t):
    u = uniform("crop", 42, F.col("clip_id"), 1)
    return long(features(t).withColumn("seq", sq.temporal_crop(F.col("seq"), 0.3, u)))


@query("Q6_frame_repeat", with_sql("feat", f"""SELECT f.clip_id, f.frame_idx::INT AS i, f.d::INT AS d, round(CASE WHEN f.frame_idx > 0 AND {draw_sql("'repeat'", "'42'", "f.clip_id", "1", "f.frame_idx")} < 0.4::DOUBLE THEN p.v ELSE f.v END, 6) AS v
 FROM feat f LEFT JOIN feat p ON p.clip_id = f.clip_id AND p.d = f.d AND p.frame_idx = f.frame_idx - 1"""))
def _(t):
    return long(features(t).withColumn("seq", sq.repeat_frames(
        F.col("seq"), 0.4, lambda i: uniform("repeat", 42, F.col("clip_id"), 1, i))))


@query("Q7_frame_skip", with_sql("feat", """SELECT clip_id, (frame_idx // 3)::INT AS i, d::INT AS d, round(v, 6) AS v FROM feat WHERE frame_idx % 3 = 0"""))
def _(t):
    return long(features(t).withColumn("seq", sq.skip_frames(F.col("seq"), 0.3)))


GROUP = "CASE WHEN d < 33 THEN 'pose' WHEN d < 48 THEN 'left_hand' ELSE 'right_hand' END"


@query("Q8_group_dropout", with_sql("feat", f"""SELECT clip_id, frame_idx::INT AS i, d::INT AS d,
 round(CASE WHEN {draw_sql("'group'", "'42'", "clip_id", "frame_idx", GROUP)} < 0.3::DOUBLE THEN 0 ELSE v END, 6) AS v FROM feat"""))
def _(t):
    return long(features(t).withColumn("seq", ag.drop_groups(F.col("seq"), 0.3, [42, F.col("clip_id")], TEST_LAYOUT)))


@query("Q9_gaussian_jitter", with_sql("feat", f"""SELECT clip_id, frame_idx::INT AS i, d::INT AS d,
 round(v + 0.05::DOUBLE * ({normal_sql(("'jitter'", "'42'", "clip_id", "frame_idx", "d // 3"), "d % 3")}), 6) AS v FROM feat"""))
def _(t):
    return long(features(t).withColumn("seq", ag.jitter(F.col("seq"), 0.05, [42, F.col("clip_id")], TEST_LAYOUT)))


POLICY = replace(SMALL, frame_repeat_prob=0.3, group_dropout_prob=0.2, crop_fraction=0.25, jitter_sigma=0.02, mirror_prob=0.5)
KEY = ("'42'", "clip_id", "1")


AUGMENTED = f"""k AS (SELECT clip_id, 9 AS keep, floor({draw_sql("'crop'", *KEY)} * (12 - 9 + 1))::INT AS start FROM (SELECT DISTINCT clip_id FROM seq)),
 c AS (SELECT g.i, a.clip_id, a.d, a.v + (b.v - a.v) * (g.i * 8 / 11.0::DOUBLE - floor(g.i * 8 / 11.0::DOUBLE)) AS v FROM range(0, 12) g(i) JOIN k ON true
   JOIN seq a ON a.clip_id = k.clip_id AND a.i = k.start + floor(g.i * 8 / 11.0::DOUBLE)
   JOIN seq b ON b.clip_id = k.clip_id AND b.d = a.d AND b.i = k.start + least(floor(g.i * 8 / 11.0::DOUBLE) + 1, 8)),
 r AS (SELECT f.clip_id, f.i, f.d, CASE WHEN f.i > 0 AND {draw_sql("'repeat'", "'42'", "f.clip_id", "1", "f.i")} < 0.3::DOUBLE THEN p.v ELSE f.v END AS v
   FROM c f LEFT JOIN c p ON p.clip_id = f.clip_id AND p.d = f.d AND p.i = f.i - 1),
 g AS (SELECT clip_id, i, d, CASE WHEN {draw_sql("'group'", *KEY, "i", GROUP)} < 0.2::DOUBLE THEN 0 ELSE v END AS v FROM r),
 n AS (SELECT clip_id, i, d, v + 0.02::DOUBLE * ({normal_sql(("'jitter'", *KEY, "i", "d // 3"), "d % 3")}) AS v FROM g),
 m AS (SELECT *, {draw_sql("'mirror'", *KEY)} < 0.5::DOUBLE AS mir FROM n)"""
MIRRORED = "clip_id, i::INT AS i, (CASE WHEN mir AND d >= 48 THEN d - 15 WHEN mir AND d >= 33 THEN d + 15 ELSE d END)::INT AS d, round(CASE WHEN mir AND d % 3 = 0 THEN -v ELSE v END, 6) AS v"


@query("Q10_augmentation", with_sql("seq", f"WITH {AUGMENTED} SELECT {MIRRORED} FROM m"))
def _(t):
    return long(sequences(t).withColumn("seq", ag.augment(F.col("seq"), [42, F.col("clip_id"), F.lit(1)], POLICY)))


@query("Q11_clip_sequences", with_sql("seq", f"SELECT {OUT} FROM seq"))
def _(t):
    return long(sequences(t))


@query("P6_rejected_clips", with_sql("clips", """SELECT clip_id, t::INT AS t, usable::INT AS usable, usable < 5 AS rejected,
 CASE WHEN usable < 5 THEN 'too few usable frames' END AS reason FROM clips"""))
def _(t):
    from limbwise.operators.validate import split_by_usable_frames
    clips = sq.build_clips(t.frames().withColumn("features", F.col("mask")), "features", SMALL)
    return split_by_usable_frames(clips, SMALL).select("clip_id", "t", "usable", "rejected", "reason")


def split():
    u = uniform("split", F.col("clip_id"))
    return F.when(u < 0.15, "test").when(u < 0.25, "val").otherwise("train")


def training(t):
    return ag.training_copies(sequences(t).withColumn("split", split()), POLICY)


US = draw_sql("'split'", "clip_id")


@query("Q12_training_copies", with_sql("seq", f"""SELECT clip_id, split, copy::INT AS copy, label::VARCHAR AS label, 12 AS frames FROM (SELECT DISTINCT clip_id, label,
 CASE WHEN {US} < 0.15::DOUBLE THEN 'test' WHEN {US} < 0.25::DOUBLE THEN 'val' ELSE 'train' END AS split FROM seq), range(0, 2) r(copy) WHERE copy = 0 OR split = 'train'"""))
def _(t):
    return training(t).select("clip_id", "split", "copy", F.col("label").cast("string").alias("label"), F.size("seq").alias("frames"))


@query("Q12_training_set", with_sql("seq", f"""WITH {AUGMENTED}, side AS (SELECT clip_id, CASE WHEN {US} < 0.15::DOUBLE THEN 'test' WHEN {US} < 0.25::DOUBLE THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT clip_id FROM seq)),
 every AS (SELECT {OUT}, 0 AS copy FROM seq UNION ALL SELECT {MIRRORED}, 1 FROM m)
 SELECT every.clip_id, split, copy::INT AS copy, i, d, v FROM every JOIN side ON side.clip_id = every.clip_id WHERE copy = 0 OR split = 'train'"""))
def _(t):
    return long(training(t), ("clip_id", "split", "copy"))


@query("Q14_one_hot", """SELECT vec_id, i::INT AS i, (i = label)::INT::DOUBLE AS v FROM embeddings, range(0, 10) r(i)""")
def _(t):
    return t.table("embeddings").select("vec_id", F.posexplode(sq.one_hot(F.col("label"), 10)).alias("i", "v"))


@query("Q16_landmark_trace", with_sql("lm clips", """WITH raw AS (SELECT clip_id, frame_idx, j*3 + a AS d, CASE a WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS v, t FROM lm JOIN clips USING (clip_id), range(0, 3) r(a) WHERE usable >= 5)
 SELECT f.clip_id, g.i::INT AS i, f.d::INT AS d, round(f.v + (h.v - f.v) * (g.i * (f.t - 1) / 11.0::DOUBLE - floor(g.i * (f.t - 1) / 11.0::DOUBLE)), 6) AS v
 FROM range(0, 12) g(i) JOIN raw f ON f.frame_idx = floor(g.i * (f.t - 1) / 11.0::DOUBLE) JOIN raw h ON h.clip_id = f.clip_id AND h.d = f.d
 AND h.frame_idx = least(floor(g.i * (f.t - 1) / 11.0::DOUBLE) + 1, f.t - 1)"""))
def _(t):
    return long(sq.landmark_trace(t.frames(), SMALL))


@query("G4_hand_activity", with_sql("seq", """SELECT clip_id, round(avg((s > 1e-4)::INT), 6) AS presence, round(sum(m) / (11 * 30), 6) AS motion FROM (
 SELECT clip_id, i, sum(abs(v)) AS s, sum(dm) AS m FROM (SELECT clip_id, i, d, v, coalesce(abs(v - lag(v) OVER (PARTITION BY clip_id, d ORDER BY i)), 0) AS dm FROM seq WHERE d >= 33) GROUP BY clip_id, i) GROUP BY clip_id"""))
def _(t):
    df = sequences(t).withColumn("h", sc.hand_activity(F.col("seq"), SMALL))
    return df.select("clip_id", F.round("h.presence", 6).alias("presence"), F.round("h.motion", 6).alias("motion"))


@query("G5_idle_gate", with_sql("seq", """SELECT clip_id, (presence < 0.9::DOUBLE OR motion < 0.6::DOUBLE) AS idle FROM (SELECT clip_id, avg((s > 1e-4)::INT) AS presence, sum(m) / (11 * 30) AS motion FROM (
 SELECT clip_id, i, sum(abs(v)) AS s, sum(dm) AS m FROM (SELECT clip_id, i, d, v, coalesce(abs(v - lag(v) OVER (PARTITION BY clip_id, d ORDER BY i)), 0) AS dm FROM seq WHERE d >= 33) GROUP BY clip_id, i) GROUP BY clip_id)"""))
def _(t):
    s = replace(SMALL, idle_min_presence=0.9, idle_min_motion=0.6)
    df = sequences(t).withColumn("h", sc.hand_activity(F.col("seq"), s))
    return df.select("clip_id", sc.is_idle(F.col("h.presence"), F.col("h.motion"), s).alias("idle"))


@query("P8_payload_rules", with_sql("clips", """SELECT clip_id, array_to_string(list_filter([CASE WHEN t < 5 THEN 'too_few_frames' END, CASE WHEN t > 15 THEN 'too_many_frames' END,
 CASE WHEN clip_id % 6 = 1 THEN 'wrong_width' END, CASE WHEN clip_id % 5 = 2 THEN 'both_sources' END,
 CASE WHEN clip_id % 10 / 10.0 < 0.05 THEN 'threshold_range' END, CASE WHEN clip_id % 7 = 3 THEN 'unknown_model' END], lambda v: v IS NOT NULL), ',') AS reasons FROM clips"""))
def _(t):
    from limbwise.operators.validate import payload_rules, validate
    c = F.col("clip_id")
    flat = t.frames().withColumn("v", F.when(c % 6 == 1, F.slice(F.flatten("coords"), 1, 60)).otherwise(F.flatten("coords")))
    req = sq.build_clips(flat, "v", SMALL).select(
        "clip_id", F.col("seq").alias("features"), F.when(c % 5 == 2, F.lit("a/b.mov")).alias("dataset_clip"),
        ((c % 10) / 10).alias("threshold"), F.when(c % 7 == 3, "vgg").otherwise("gru").alias("model"), F.lit("me").alias("profile"))
    return validate(req, payload_rules(replace(SMALL, max_sequence_length=15))).select(
        "clip_id", F.array_join("reasons", ",").alias("reasons"))
