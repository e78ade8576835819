"""Profile and remaining source queries."""

from pyspark.sql import functions as F

from limbwise.operators import events as ev
from limbwise.operators import profiles as pr
from limbwise.operators import sequences as sq
from limbwise.operators.validate import profile_rules, validate
from limbwise.sources import catalogue as cat
from limbwise.sources import keypoints as kp
from limbwise.sources import logs
from limbwise.sources.workspace import scratch_path
from workbench.fixtures import CLASSES, LABELS, SMALL, TEST_LAYOUT, scored, with_sql
from workbench.registry import query

r6 = lambda c: F.round(c, 6).alias(c)


def changes(t):
    """Orders as profile changes of the customer: status F creates, O updates, P deletes."""
    k = F.col("o_orderkey")
    return t.table("orders").select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderdate").alias("changed_at"), k.alias("seq"),
        F.when(F.col("o_orderstatus") == "F", "create").when(F.col("o_orderstatus") == "O", "update").otherwise("delete").alias("action"),
        F.when(k % 4 != 3, F.element_at(F.array(*map(F.lit, SMALL.models)), (k % 3 + 1).cast("int"))).alias("base_model"),
        F.when(F.col("o_orderpriority") < "2", F.floor(F.col("o_totalprice")) % 1000 / 1000).alias("threshold"),
        F.when(F.col("o_orderpriority") > "5", F.array(F.lit("view"), F.lit("click"))).when(F.col("o_orderpriority") > "4", F.array(F.lit("error")))
        .alias("vocabulary"))


CHANGES = """ch AS (SELECT 'u' || o_custkey AS name, o_orderdate AS changed_at, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'create' WHEN 'O' THEN 'update' ELSE 'delete' END AS action,
 CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'lstm' WHEN o_orderkey % 3 = 1 THEN 'gru' ELSE 'gru_mha' END AS base_model,
 CASE WHEN o_orderpriority < '2' THEN floor(o_totalprice)::BIGINT % 1000 / 1000 END AS threshold,
 CASE WHEN o_orderpriority > '5' THEN 'view|click' WHEN o_orderpriority > '4' THEN 'error' END AS vocabulary FROM orders),
 b AS (SELECT name, arg_max(action, (changed_at, seq)) AS a, max((changed_at, seq)) AS since FROM ch WHERE action <> 'update' GROUP BY name),
 live AS (SELECT ch.* FROM ch JOIN b USING (name) WHERE a = 'create' AND (changed_at, seq) >= since),
 prof AS (SELECT name, coalesce(arg_max(base_model, (changed_at, seq)) FILTER (base_model IS NOT NULL), 'gru_mha') AS base_model,
  coalesce(arg_max(vocabulary, (changed_at, seq)) FILTER (vocabulary IS NOT NULL), '') AS vocabulary,
  arg_max(threshold, (changed_at, seq)) FILTER (threshold IS NOT NULL) AS threshold_requested FROM live GROUP BY name),
 profiles AS (SELECT *, least(greatest(coalesce(threshold_requested, 0.38::DOUBLE), 0.18::DOUBLE), 0.58::DOUBLE) AS threshold FROM prof)"""


def profiles(t):
    return pr.current_profiles(changes(t), ["changed_at", "seq"], SMALL)


def event_vocab(t):
    return t.table("events").select(F.col("event_type").alias("label")).distinct()


@query("U1_U3_current_profiles", f"WITH {CHANGES} SELECT name, base_model, vocabulary, round(threshold_requested, 6) AS threshold_requested, round(threshold, 6) AS threshold FROM profiles")
def _(t):
    return profiles(t).select("name", "base_model", F.array_join("vocabulary", "|").alias("vocabulary"), r6("threshold_requested"), r6("threshold"))


@query("U2_resolve_vocabulary", """WITH r AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN ['HELLO', 'GOOD_MORNING', 'THANK_YOU', 'GOOD'] WHEN 'MACHINERY' THEN [' Click', 'VIEW '] WHEN 'HOUSEHOLD' THEN ['signup', 'nope', 'x'] ELSE ['error'] END AS v FROM customer),
 x AS (SELECT c_custkey, unnest(v) AS raw, generate_subscripts(v, 1) AS i FROM r), m AS (SELECT *, CASE WHEN lower(trim(raw)) IN ('click', 'error', 'purchase', 'signup', 'view') THEN lower(trim(raw)) END AS o FROM x)
 SELECT c_custkey AS name, CASE WHEN count(*) = count(o) THEN string_agg(o, '|' ORDER BY i) END AS vocabulary, coalesce(string_agg(raw, '|' ORDER BY i) FILTER (o IS NULL), '') AS unknown FROM m GROUP BY c_custkey""")
def _(t):
    s = F.col("c_mktsegment")
    given = F.when(s == "MACHINERY", F.array(F.lit(" Click"), F.lit("VIEW "))).when(
        s == "HOUSEHOLD", F.array(F.lit("signup"), F.lit("nope"), F.lit("x"))).otherwise(F.array(F.lit("error")))
    req = t.table("customer").select(F.col("c_custkey").alias("name"), pr.preset_vocabulary(
        F.when(s == "BUILDING", "greetings"), given).alias("vocabulary"))
    return pr.resolve_vocabulary(req, event_vocab(t)).select(
        "name", F.array_join("vocabulary", "|").alias("vocabulary"), F.array_join("unknown", "|").alias("unknown"))


EFFECTIVE = CHANGES + """, eff AS (SELECT *, CASE vocabulary WHEN '' THEN 'click|error|purchase|signup|view' WHEN 'view|click' THEN 'click|view' ELSE vocabulary END AS classes FROM profiles)"""


@query("U4_effective_vocabulary", f"WITH {EFFECTIVE} SELECT name, classes FROM eff")
def _(t):
    return pr.effective_vocabulary(profiles(t), event_vocab(t)).select("name", F.array_join("classes", "|").alias("classes"))


def samples(t):
    return t.events().select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("sample"),
                             F.when(F.col("value") > 80, "wave").otherwise(F.concat(F.lit(" "), F.upper("event_type"))).alias("label"))


SAMPLES = EFFECTIVE + """, sm AS (SELECT 'u' || user_id AS name, event_id AS sample, CASE WHEN value > 80 THEN 'wave' ELSE event_type END AS label FROM events),
 chk AS (SELECT sm.*, CASE WHEN e.classes IS NULL THEN 'unknown profile' WHEN label = 'wave' THEN 'unknown label' WHEN NOT list_contains(string_split(classes, '|'), label) THEN 'outside profile vocabulary' END AS reason FROM sm LEFT JOIN eff e USING (name)),
 good AS (SELECT * FROM chk WHERE reason IS NULL), cnt AS (SELECT name, label, count(*) AS samples FROM good GROUP BY ALL)"""


def checked(t):
    return pr.check_samples(samples(t), profiles(t), event_vocab(t))


@query("U5_check_samples", f"WITH {SAMPLES} SELECT name, sample, label, reason FROM chk")
def _(t):
    return checked(t).select("name", "sample", "label", "reason")


@query("U5_sample_counts", f"WITH {SAMPLES} SELECT * FROM cnt")
def _(t):
    return pr.sample_counts(checked(t).where("reason IS NULL"))


def uploads(t):
    """Clicks of a user as an upload: ``value`` decides its clips, frames, widths and labels."""
    clips, k = F.floor("value").cast("int") % 4, F.col("event_id")
    width = F.when(k % 7 == 3, SMALL.input_width - 1).otherwise(SMALL.input_width)
    frames = F.when(k % 11 == 5, 0).otherwise(3)
    label = F.when(k % 13 == 6, F.lit("wave")).otherwise(F.concat(F.upper("event_type"), F.lit(" ")))
    return t.events().select(
        k.alias("upload"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"),
        F.array_repeat(F.array_repeat(F.array_repeat(F.lit(0.5), width), frames), clips).alias("features"),
        F.array_repeat(label, clips + (k % 5 == 2).cast("int")).alias("labels"))


UPLOADS = EFFECTIVE + """, up AS (SELECT event_id AS upload, 'u' || user_id AS name, floor(value)::INT % 4 AS clips, CASE WHEN event_id % 13 = 6 THEN 'wave' ELSE event_type END AS label,
  floor(value)::INT % 4 > 0 AND (event_id % 7 = 3 OR event_id % 11 = 5) AS shape, event_id % 5 = 2 AS uneven FROM events),
 uc AS (SELECT up.*, CASE WHEN shape THEN 'features_shape' WHEN uneven THEN 'label_count' WHEN e.classes IS NULL THEN 'unknown_profile' WHEN clips > 0 AND label = 'wave' THEN 'unknown_label'
  WHEN clips > 0 AND NOT list_contains(string_split(e.classes, '|'), label) THEN 'outside_vocabulary' END AS reason FROM up LEFT JOIN eff e USING (name))"""


@query("U5_check_uploads", f"WITH {UPLOADS} SELECT upload, name, reason FROM uc")
def _(t):
    return pr.check_uploads(uploads(t), profiles(t), event_vocab(t), SMALL).select("upload", "name", "reason")


@query("U5_sample_totals", f"""WITH {UPLOADS}, s AS (SELECT name, label, sum(clips)::BIGINT AS n FROM uc WHERE reason IS NULL AND clips > 0 GROUP BY ALL),
 g AS (SELECT name, sum(n)::BIGINT AS n, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' AS per FROM s GROUP BY name)
 SELECT p.name, coalesce(g.n, 0) AS calibration_samples, coalesce(per, '{{}}') AS per_class_samples FROM profiles p LEFT JOIN g USING (name)""")
def _(t):
    taken = pr.uploaded_labels(pr.check_uploads(uploads(t), profiles(t), event_vocab(t), SMALL))
    return pr.with_totals(profiles(t), taken).select("name", "calibration_samples", F.to_json("per_class_samples").alias("per_class_samples"))


@query("U6_eligibility", f"""WITH {SAMPLES}, s AS (SELECT p.name, coalesce(sum(samples), 0)::BIGINT AS samples, count(label) AS classes FROM profiles p LEFT JOIN cnt USING (name) GROUP BY p.name)
 SELECT *, CASE WHEN samples < 20 THEN 'few_samples' WHEN classes < 2 THEN 'one_class' ELSE 'ok' END AS reason,
 samples >= 20 AND classes >= 2 AS eligible FROM s""")
def _(t):
    return pr.eligibility(profiles(t), pr.sample_counts(checked(t).where("reason IS NULL")), SMALL)


@query("U7_hold_out", f"""WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY md5('42|' || name || '|' || sample), sample) AS k, count(*) OVER (PARTITION BY name) AS n FROM good),
 h AS (SELECT *, CASE WHEN n - round_even(n * 0.2::DOUBLE, 0) < 2 THEN 0 ELSE round_even(n * 0.2::DOUBLE, 0) END AS held FROM r) SELECT name, sample, CASE WHEN k > n - held THEN 'heldout' ELSE 'train' END AS part FROM h""")
def _(t):
    return pr.hold_out(checked(t).where("reason IS NULL"), "sample", SMALL).select("name", "sample", "part")


@query("U8_apply_profiles", with_sql("scored", f"""WITH pf AS (SELECT * FROM (VALUES ('p0', [1, 2, 3], 0.5), ('p1', [0, 9], 0.2), ('p2', NULL, 0.3)) v(profile, allowed, th)),
 s AS (SELECT s.*, 'p' || vec_id % 4 AS profile FROM scored s WHERE model = 'gru_mha'), j AS (SELECT s.*, coalesce(th, 0.38) AS th, allowed IS NULL OR list_contains(allowed, c) AS keep FROM s LEFT JOIN pf USING (profile)),
 f AS (SELECT vec_id, profile, th, c, CASE WHEN keep THEN p ELSE 0 END / sum(CASE WHEN keep THEN p ELSE 0 END) OVER (PARTITION BY vec_id) AS p FROM j),
 d AS (SELECT vec_id, profile, any_value(th)::DOUBLE AS th, arg_max(c, p)::VARCHAR AS predicted_class, max(p) AS confidence FROM f GROUP BY vec_id, profile)
 SELECT vec_id, profile, predicted_class, round(confidence, 6) AS confidence, CASE WHEN confidence >= th THEN 'CONFIDENT' ELSE 'UNCERTAIN' END AS status FROM d"""))
def _(t):
    prof = t.spark.createDataFrame([("p0", ["1", "2", "3"], 0.5), ("p1", ["0", "9"], 0.2), ("p2", [], 0.3)],
                                   "name string, vocabulary array<string>, threshold double")
    rows = scored(t).where("model = 'gru_mha'").withColumn("profile", F.concat(F.lit("p"), (F.col("vec_id") % 4).cast("string")))
    out = pr.apply_profiles(rows, prof, F.array(*map(F.lit, LABELS)), SMALL)
    return out.select("vec_id", "profile", "predicted_class", r6("confidence"), "status")


@query("P10_profile_rules", """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE 'user_' || c_custkey END AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'calibrate' WHEN 'MACHINERY' THEN 'create' ELSE lower(c_mktsegment) END AS action,
 CASE WHEN c_nationkey % 2 = 0 THEN 'gru' ELSE 'cnn' END AS base_model, c_acctbal / 5000 AS threshold, c_nationkey % 3 AS n FROM customer)
 SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(name, '[A-Za-z0-9_-]{1,32}') THEN 'name_format' END, CASE WHEN action NOT IN ('calibrate', 'create') THEN 'unknown_action' END,
 CASE WHEN base_model = 'cnn' THEN 'unknown_model' END, CASE WHEN threshold NOT BETWEEN 0.05 AND 0.999 THEN 'threshold_range' END, CASE WHEN action = 'calibrate' AND n = 0 THEN 'calibrate_needs_data' END], lambda v: v IS NOT NULL), ',') AS reasons FROM r""")
def _(t):
    s = F.col("c_mktsegment")
    req = t.table("customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.concat(F.lit("user_"), F.col("c_custkey").cast("string"))).alias("name"),
        F.when(s == "BUILDING", "calibrate").when(s == "MACHINERY", "create").otherwise(F.lower(s)).alias("action"),
        F.when(F.col("c_nationkey") % 2 == 0, "gru").otherwise("cnn").alias("base_model"), (F.col("c_acctbal") / 5000).alias("threshold"),
        (F.col("c_nationkey") % 3).alias("n_features"), (F.col("c_nationkey") % 3).alias("n_labels"))
    return validate(req, profile_rules(SMALL)).select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


# -- files -------------------------------------------------------------------
def keypoint_folder(t, damage=False):
    """One JSON keypoint file per clip, written by Spark; with ``damage`` some are cut or empty."""
    root = scratch_path(t.spark, "keypoints")
    c = F.col("clip_id")
    clips = sq.build_clips(t.frames().withColumn("one", F.struct("coords", "mask")), "one", SMALL)
    doc = F.to_json(F.struct(F.transform("seq", lambda s: s["coords"]).alias("keypoints"), F.transform("seq", lambda s: s["mask"]).alias("confidences"),
                             F.when(c % 3 == 0, F.array(F.lit(1080), F.lit(1920))).alias("vid_shape")))
    if damage:
        doc = F.when(c % 11 == 3, F.substring(doc, 1, 40)).when(c % 11 == 7, F.lit('{"keypoints": []}')).otherwise(doc)
    clips.select(c.alias("clip"), doc.alias("value")).write.partitionBy("clip").text(root)
    return root


CLIP = lambda: F.regexp_extract("path", "clip=(\\d+)", 1).cast("bigint").alias("clip_id")


@query("S4_list_files", with_sql("clips", "SELECT clip_id FROM clips"))
def _(t):
    return cat.list_files(t.spark, keypoint_folder(t), "*.txt").select(CLIP())


@query("S6_read_keypoints", with_sql("lm", """SELECT clip_id, frame_idx, j::INT AS j, present::INT::DOUBLE AS m, round(x * CASE WHEN clip_id % 3 = 0 THEN pow(1920.0::DOUBLE / 1080, 2) ELSE 3.1605::DOUBLE END, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM lm"""))
def _(t):
    df = kp.read_keypoints(t.spark, keypoint_folder(t), "*.txt", SMALL)
    long = df.select(CLIP(), "frame_idx", F.posexplode(F.arrays_zip("coords", "mask")).alias("j", "z"))
    return long.select("clip_id", "frame_idx", "j", F.col("z.mask").alias("m"), *[F.round(F.col("z.coords")[a], 6).alias(n) for a, n in enumerate("xyz")])


@query("S7_scan_files", with_sql("clips", """SELECT clip_id, CASE clip_id % 11 WHEN 3 THEN 'unreadable' WHEN 7 THEN 'corrupt' ELSE 'ok' END AS status, CASE WHEN clip_id % 11 IN (3, 7) THEN 0 ELSE t END::INT AS n_frames FROM clips"""))
def _(t):
    return kp.scan_files(t.spark, keypoint_folder(t, True), "*.txt").select(CLIP(), "status", "n_frames")


def prediction_records(t):
    df = t.predictions().withColumn("kind", F.lit("p"))
    return ev.prediction_events(df, ["kind", "event_id"], ["session_id"])


@query("S10_read_jsonl", with_sql("predictions", """SELECT substr(sha256('p|' || event_id), 1, 12) AS event_id, model, predicted_class, confidence, status, latency_ms, source, session_id::VARCHAR AS session FROM predictions"""))
def _(t):
    path = scratch_path(t.spark, "jsonl")
    logs.write_jsonl(prediction_records(t), path)
    t.spark.range(3).select(F.element_at(F.array(F.lit("   "), F.lit("{broken"), F.lit("")), (F.col("id") + 1).cast("int")).alias("value")).write.mode("append").text(path)
    return logs.read_jsonl(t.spark, path, logs.PREDICTION).select(
        "event_id", "model", "predicted_class", "confidence", "status", "latency_ms", "source", F.col("extra")["session_id"].alias("session"))


@query("S11_append_logs", with_sql("predictions", """SELECT "timestamp"::DATE::VARCHAR AS day, model, count(*) AS n, round(sum(confidence), 6) AS conf FROM predictions GROUP BY ALL"""))
def _(t):
    path = scratch_path(t.spark, "log")
    rows = prediction_records(t)
    for source in ("api", "live-camera"):
        logs.append_log(rows.where(F.col("source") == source), path)
    return t.spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "model").agg(
        F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("conf"))


@query("S11_stream_logs", with_sql("predictions feedback", """WITH f AS (SELECT ord, event_id, human_action, predicted_class, coalesce(corrected_class, '') AS corrected_class, "timestamp" FROM feedback)
 SELECT 'feedback' AS log, "timestamp"::DATE::VARCHAR AS day, human_action AS what, count(*) AS n, count(nullif(corrected_class, '')) AS extra FROM f GROUP BY ALL
 UNION ALL SELECT 'failure', ts::DATE::VARCHAR, event_type, count(*), count(DISTINCT substr(sha256('f|' || event_id), 1, 12)) FROM events WHERE event_type = 'error' GROUP BY ALL"""))
def _(t):
    """Verdicts and failures appended by two streams, then read back."""
    from workbench.q_streaming import replay
    said = ev.feedback_events(replay(t, t.feedback().withColumn("confidence", F.lit(0.5)), "timestamp"), ["event_id", "ord"]).withColumn("note", F.lit(None).cast("string"))
    broken = t.events().where(F.col("event_type") == "error").select(F.lit("f").alias("k"), "event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("stage"),
                                                                      F.col("props").alias("message"), F.col("user_id").cast("string").alias("session_id"))
    paths = {}
    for name, stream in (("feedback", said), ("failure", ev.failure_events(replay(t, broken, "timestamp"), ["k", "event_id"]))):
        paths[name] = scratch_path(t.spark, name)
        logs.append_stream(stream, paths[name], scratch_path(t.spark, f"{name}-check")).awaitTermination()
    back = lambda name, what, extra: logs.read_log(t.spark, paths[name]).groupBy(F.lit(name).alias("log"), F.col("day").cast("string").alias("day"), F.col(what).alias("what")).agg(
        F.count("*").alias("n"), F.count_distinct(extra).alias("extra") if extra == "failure_id" else F.count(extra).alias("extra"))
    return back("feedback", "human_action", "corrected_class").unionByName(back("failure", "stage", "failure_id"))


@query("S12_training_set", with_sql("seq", """WITH c AS (SELECT DISTINCT clip_id, CASE WHEN clip_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM seq) SELECT split, sum(CASE split WHEN 'train' THEN 2 ELSE 1 END)::BIGINT AS samples, count(*) AS clips FROM c GROUP BY split"""))
def _(t):
    from limbwise.operators.augment import training_copies
    path = scratch_path(t.spark, "tensors")
    seqs = sq.clip_sequences(t.frames(), SMALL, ("label",)).where("reason IS NULL").withColumn("split", F.when(F.col("clip_id") % 3 == 0, "test").otherwise("train"))
    logs.write_training_set(training_copies(seqs, SMALL), path, "official")
    back = logs.read_training_set(t.spark, path, "official")
    return logs.training_summary(back, back.limit(0)).select("split", "samples", "clips")


@query("S13_stored_index", with_sql("clip_index", 'SELECT "FilePath", split FROM clip_index'))
def _(t):
    path = scratch_path(t.spark, "index")
    logs.stored_index(t.spark, path, lambda: t.clip_index().limit(10))
    logs.stored_index(t.spark, path, lambda: t.clip_index(), force_rebuild=True)
    return logs.stored_index(t.spark, path, lambda: t.clip_index().limit(1)).select("FilePath", "split")


@query("S14_S15_metric_csv", with_sql("predictions", "SELECT model, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM predictions GROUP BY model"))
def _(t):
    path = scratch_path(t.spark, "metrics")
    logs.write_metrics_csv(t.predictions().groupBy("model").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence")), path)
    return logs.read_metrics_csv(t.spark, path, "model string, n bigint, mean_confidence double")


@query("S15_metric_json", with_sql("predictions", "SELECT model, count(*) AS n FROM predictions GROUP BY model"))
def _(t):
    path = scratch_path(t.spark, "metrics-json")
    rows = t.predictions().groupBy("model").agg(F.count("*").alias("n"))
    rows.agg(F.to_json(F.collect_list(F.struct("model", "n"))).alias("value")).write.text(path)
    return logs.read_metrics_json(t.spark, path, "model string, n bigint")
