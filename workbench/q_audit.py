"""Dataset-audit queries."""

from pyspark.sql import functions as F

from limbwise.functions.draws import uniform
from limbwise.operators import audit as au
from workbench.fixtures import SMALL, draw_sql, with_sql
from workbench.registry import query

r6 = lambda c: F.round(c, 6).alias(c)


def split_of(key="clip_id"):
    u = uniform("split", F.col(key))
    return F.when(u < 0.15, "test").when(u < 0.25, "val").otherwise("train")


U = draw_sql("'split'", "clip_id")
RATES = f"""fr AS (SELECT clip_id, frame_idx, any_value(label) AS label, bool_or(present AND j < 11) AS p, bool_or(present AND j BETWEEN 11 AND 15) AS l, bool_or(present AND j >= 16) AS r,
  sum(present::INT) AS n, max(abs(z)) AS zz FROM lm GROUP BY clip_id, frame_idx),
rates AS (SELECT clip_id, count(*) AS n_frames, avg(p::INT) AS pose_rate, avg(l::INT) AS left_hand_rate, avg(r::INT) AS right_hand_rate, avg((l OR r)::INT) AS any_hand_rate,
  avg((l AND r)::INT) AS both_hands_rate, avg((n = 0)::INT) AS empty_frame_rate, avg(n) AS mean_present, max(zz) > 1e-9 AS z_available,
  min_by(label, frame_idx)::VARCHAR AS label FROM fr GROUP BY clip_id),
audited AS (SELECT *, CASE WHEN {U} < 0.15::DOUBLE THEN 'test' WHEN {U} < 0.25::DOUBLE THEN 'val' ELSE 'train' END AS split,
  CASE WHEN clip_id % 11 = 3 THEN 'corrupt' WHEN clip_id % 11 = 7 THEN 'unreadable' ELSE 'ok' END AS status FROM rates)"""


def audited(t):
    frames = t.frames()
    rates = au.clip_rates(frames, SMALL)
    index = frames.groupBy("clip_id").agg(F.min_by(F.col("label").cast("string"), "frame_idx").alias("label")).withColumn("split", split_of())
    problems = index.where(F.col("clip_id") % 11 == 3).select("clip_id", F.lit("corrupt").alias("status"), F.lit("BadZipFile: CRC").alias("error")).unionByName(
        index.where(F.col("clip_id") % 11 == 7).select("clip_id", F.lit("unreadable").alias("status"), F.lit("ValueError: shape").alias("error")))
    return au.clip_status(index, rates, problems)


def vocab(t):
    return t.table("embeddings").select(F.col("label").cast("string").alias("label")).distinct().unionByName(
        t.spark.createDataFrame([("spare",)], "label string"))


R = ["pose_rate", "left_hand_rate", "right_hand_rate", "any_hand_rate", "both_hands_rate", "empty_frame_rate", "mean_present"]


@query("A1_clip_rates", with_sql("lm", f"WITH {RATES} SELECT clip_id, n_frames, z_available, " + ", ".join(f"round({c}, 6) AS {c}" for c in R) + " FROM rates"))
def _(t):
    return au.clip_rates(t.frames(), SMALL).select("clip_id", "n_frames", "z_available", *[r6(c) for c in R])


@query("A2_clip_status", with_sql("lm", f"""WITH {RATES} SELECT clip_id, label, split, status, n_frames,
 CASE status WHEN 'ok' THEN '' WHEN 'corrupt' THEN 'BadZipFile: CRC' ELSE 'ValueError: shape' END AS error FROM audited"""))
def _(t):
    return audited(t).select("clip_id", "label", "split", "status", "n_frames", "error")


SIG = """posed AS (SELECT clip_id, frame_idx FROM lm WHERE j < 11 AND frame_idx < 90 GROUP BY ALL HAVING sum(present::INT) >= 10),
sigl AS (SELECT clip_id, j*2 + a AS d, round(avg(CASE a WHEN 0 THEN x ELSE y END), 12) AS v FROM nl JOIN posed USING (clip_id, frame_idx), range(0, 2) r(a) WHERE j < 11 GROUP BY clip_id, d)"""


@query("A3_pose_signature", with_sql("nl", f"WITH {SIG} SELECT clip_id, d::INT AS d, round(v, 6) AS v FROM sigl"))
def _(t):
    return au.signatures(t.frames(), SMALL).select("clip_id", F.posexplode("sig").alias("d", "v")).select("clip_id", "d", r6("v"))


# Copies are made by folding clip ids, so signature groups of several clips exist.
SIGNED = f"""sv AS (SELECT clip_id, list(v ORDER BY d) AS sig FROM sigl GROUP BY clip_id),
signed AS (SELECT clip_id * 3 + k AS clip_id, sig, ((clip_id) % 3)::VARCHAR AS label,
  CASE WHEN {draw_sql("'split'", "clip_id * 3 + k")} < 0.15::DOUBLE THEN 'test' WHEN {draw_sql("'split'", "clip_id * 3 + k")} < 0.25::DOUBLE THEN 'val' ELSE 'train' END AS split
  FROM sv, range(0, 3) r(k) WHERE k <= clip_id % 3),
pairs AS (SELECT a.label, a.clip_id AS clip_a, b.clip_id AS clip_b, a.split AS split_a, b.split AS split_b,
  list_dot_product(a.sig, b.sig) / (sqrt(list_dot_product(a.sig, a.sig)) * sqrt(list_dot_product(b.sig, b.sig))) AS sim
  FROM signed a JOIN signed b ON a.label = b.label AND a.clip_id < b.clip_id)"""
LIMIT_SIM = 0.6


def signed(t):
    sig = au.signatures(t.frames(), SMALL)
    copies = sig.select((F.col("clip_id") % 3).cast("string").alias("label"), "sig", F.explode(
        F.transform(F.sequence(F.lit(0), (F.col("clip_id") % 3).cast("int")), lambda k: F.col("clip_id") * 3 + k)).alias("clip_id"))
    return copies.withColumn("split", split_of())


@query("A4_A5_duplicate_counts", with_sql("nl", f"""WITH {SIG}, {SIGNED} SELECT label, count(*) AS pairs_checked, sum((sim > {LIMIT_SIM})::INT)::BIGINT AS near_duplicates,
 sum((sim > {LIMIT_SIM} AND split_a <> split_b)::INT)::BIGINT AS cross_any,
 sum((sim > {LIMIT_SIM} AND split_a <> split_b AND 'val' NOT IN (split_a, split_b))::INT)::BIGINT AS cross_train_test FROM pairs GROUP BY label"""))
def _(t):
    return au.duplicate_counts(signed(t), threshold=LIMIT_SIM)


@query("A4_top_duplicate_pairs", with_sql("nl", f"""WITH {SIG}, {SIGNED} SELECT label, clip_a, clip_b, round(sim, 6) AS similarity, split_a, split_b FROM pairs
 WHERE sim > {LIMIT_SIM} ORDER BY round(sim, 6) DESC, label, clip_a, clip_b LIMIT 200"""))
def _(t):
    return au.top_duplicate_pairs(signed(t), 200, threshold=LIMIT_SIM)


@query("A6_class_inventory", with_sql("lm", f"""WITH {RATES} SELECT label, sum((split = 'train')::INT)::BIGINT AS train, sum((split = 'val')::INT)::BIGINT AS val, sum((split = 'test')::INT)::BIGINT AS test,
 sum((status = 'ok')::INT)::BIGINT AS usable, sum((status <> 'ok')::INT)::BIGINT AS corrupt, coalesce(median(n_frames) FILTER (status = 'ok'), 0) AS frames_median,
 coalesce(min(n_frames) FILTER (status = 'ok'), 0) AS frames_min, coalesce(max(n_frames) FILTER (status = 'ok'), 0) AS frames_max FROM audited GROUP BY label"""))
def _(t):
    return au.class_inventory(audited(t))


@query("A7_frame_statistics", with_sql("lm", f"""WITH {RATES} SELECT round(avg(n_frames), 6) AS mean, round(stddev_pop(n_frames), 6) AS std, """ + ", ".join(
    f"quantile_cont(n_frames, {p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95)) + ", min(n_frames) AS min, max(n_frames) AS max FROM audited WHERE status = 'ok'"))
def _(t):
    out = au.frame_statistics(audited(t))
    return out.select(*[r6(c) if c in ("mean", "std") else F.col(c) for c in out.columns])


@query("A8_rate_distribution", with_sql("lm", f"""WITH {RATES}, l AS (UNPIVOT (SELECT pose_rate::DOUBLE AS pose_rate, left_hand_rate::DOUBLE AS left_hand_rate, right_hand_rate::DOUBLE AS right_hand_rate,
 both_hands_rate::DOUBLE AS both_hands_rate, empty_frame_rate::DOUBLE AS empty_frame_rate, mean_present / 21 AS present_share FROM audited WHERE status = 'ok')
 ON pose_rate, left_hand_rate, right_hand_rate, both_hands_rate, empty_frame_rate, present_share INTO NAME measure VALUE v)
 SELECT measure, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS p5, round(median(v), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95 FROM l GROUP BY measure"""))
def _(t):
    return au.rate_distribution(audited(t), SMALL).select("measure", r6("mean"), r6("p5"), r6("p50"), r6("p95"))


@query("A9_low_hand_clips", with_sql("lm", f"""WITH {RATES}, k AS (SELECT 'under_half' AS kind, clip_id FROM audited WHERE status = 'ok' AND any_hand_rate < 0.5
 UNION ALL SELECT 'none', clip_id FROM audited WHERE status = 'ok' AND any_hand_rate = 0)
 SELECT kind, count(*) AS clips, array_to_string((list(clip_id ORDER BY clip_id))[1:5], ',') AS examples FROM k GROUP BY kind"""))
def _(t):
    return au.low_hand_clips(audited(t)).select("kind", "clips", F.array_join("examples", ",").alias("examples"))


@query("A10_length_buckets", with_sql("lm", f"""WITH {RATES} SELECT sum((n_frames < 5)::INT)::BIGINT AS too_short, sum((n_frames < 12)::INT)::BIGINT AS below, sum((n_frames > 12)::INT)::BIGINT AS above,
 sum((n_frames = 12)::INT)::BIGINT AS equal FROM audited WHERE status = 'ok'"""))
def _(t):
    return au.length_buckets(audited(t), SMALL)


@query("A11_resolutions", """SELECT 720 + p_size % 4 * 360 AS height, 1280 + p_size % 3 * 320 AS width, count(*) AS videos FROM part
 GROUP BY 1, 2 ORDER BY videos DESC, height, width LIMIT 6""")
def _(t):
    clips = t.table("part").select((720 + F.col("p_size") % 4 * 360).alias("height"), (1280 + F.col("p_size") % 3 * 320).alias("width"))
    return au.resolutions(clips)


@query("A12_class_balance", with_sql("lm", f"""WITH {RATES}, v AS (SELECT DISTINCT label::VARCHAR AS label FROM embeddings UNION ALL SELECT 'spare'),
 c AS (SELECT label, count(*) AS n, sum((split = 'test')::INT) AS nt FROM audited WHERE status = 'ok' GROUP BY label), f AS (SELECT label, coalesce(n, 0) AS n, coalesce(nt, 0) AS nt FROM v LEFT JOIN c USING (label))
 SELECT min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(max(n) / greatest(min(n), 1), 6) AS imbalance,
 sum((n < 10)::INT)::BIGINT AS small_classes, sum((nt = 0)::INT)::BIGINT AS classes_without_test FROM f"""))
def _(t):
    out = au.class_balance(vocab(t), audited(t))
    return out.select(*[r6(c) if c in ("mean", "std", "imbalance") else F.col(c) for c in out.columns])


@query("A13_dataset_rollup", with_sql("lm", f"""WITH {RATES} SELECT count(*) AS total_videos, sum((status = 'ok')::INT)::BIGINT AS usable_videos, sum((status <> 'ok')::INT)::BIGINT AS corrupt_videos,
 sum((split = 'train')::INT)::BIGINT AS train, sum((split = 'val')::INT)::BIGINT AS val, sum((split = 'test')::INT)::BIGINT AS test,
 median(n_frames) FILTER (status = 'ok') AS frames_median, min(n_frames) FILTER (status = 'ok') AS frames_min, max(n_frames) FILTER (status = 'ok') AS frames_max,
 (SELECT count(DISTINCT label) + 1 FROM embeddings) AS num_classes FROM audited"""))
def _(t):
    return au.dataset_rollup(audited(t), vocab(t))


@query("A13_corrupt_by_class", with_sql("lm", f"WITH {RATES} SELECT label, count(*) AS corrupt FROM audited WHERE status <> 'ok' GROUP BY label"))
def _(t):
    return au.corrupt_by_class(audited(t))


EXTR = """f AS (SELECT clip_id, frame_idx, vec_id, vec_id % 13 <> 5 AS p, NOT (vec_id % 7 = 0 OR clip_id % 9 = 4) AS l, NOT (vec_id % 5 = 0 OR clip_id % 9 = 4) AS r FROM addressed)"""


@query("A14_extraction_statistics", with_sql("addressed", f"""WITH {EXTR}, s AS (SELECT clip_id, count(*) AS frames_read, sum(p::INT)::BIGINT AS frames_with_pose, sum(l::INT)::BIGINT AS frames_with_left_hand,
 sum(r::INT)::BIGINT AS frames_with_right_hand, sum((l OR r)::INT)::BIGINT AS frames_with_any_hand, sum((NOT (p OR l OR r))::INT)::BIGINT AS frames_with_nothing, sum((l AND r)::INT) AS b FROM f GROUP BY clip_id)
 SELECT * EXCLUDE (b), round((frames_read - frames_with_nothing) / frames_read, 6) AS extraction_success, round(least(frames_with_left_hand, frames_with_right_hand) / frames_read, 6) AS both_hands_bound,
 round(b / frames_read, 6) AS both_hands_rate FROM s"""))
def _(t):
    out = au.extraction_statistics(t.raw_frames(), ["clip_id"])
    return out.select(*[r6(c) if c.startswith(("extraction", "both")) else F.col(c) for c in out.columns])


@query("A15_buffer_statistics", with_sql("addressed", f"""WITH {EXTR} SELECT clip_id, count(*) AS frames_seen, round(avg(p::INT), 6) AS pose_rate, round(avg(l::INT), 6) AS left_hand_rate, round(avg(r::INT), 6) AS right_hand_rate,
 round(avg((NOT (p OR l OR r))::INT), 6) AS empty_rate, round(count(*) / greatest((max(frame_idx) - min(frame_idx)) * 0.033::DOUBLE, 1e-6), 3) AS fps FROM f GROUP BY clip_id"""))
def _(t):
    raw = t.raw_frames().withColumn("ts", F.timestamp_millis(1704067200000 + F.col("clip_id") * 1000 + F.col("frame_idx") * 33))
    out = au.buffer_statistics(raw, "clip_id", "ts")
    return out.select("clip_id", "frames_seen", r6("pose_rate"), r6("left_hand_rate"), r6("right_hand_rate"), r6("empty_rate"), F.round("fps", 3).alias("fps"))


@query("A16_length_histogram", """WITH c AS (SELECT length(text) % 300 + 1 AS n FROM documents), s AS (SELECT min(n) AS lo, max(n) AS hi FROM c)
 SELECT least(floor((n - lo) / ((hi - lo) / 40)), 39)::INT AS bin, count(*) AS clips FROM c, s GROUP BY 1""")
def _(t):
    clips = t.table("documents").select(F.lit("ok").alias("status"), (F.length("text") % 300 + 1).alias("n_frames"))
    return au.length_histogram(clips)


@query("A16_class_quartiles", """SELECT lang AS label, quantile_cont(length(text) % 300 + 1, 0.25) AS q1, quantile_cont(length(text) % 300 + 1, 0.5) AS median,
 quantile_cont(length(text) % 300 + 1, 0.75) AS q3, count(*) AS clips FROM documents GROUP BY lang""")
def _(t):
    clips = t.table("documents").select(F.lit("ok").alias("status"), F.col("lang").alias("label"), (F.length("text") % 300 + 1).alias("n_frames"))
    return au.class_quartiles(clips)
