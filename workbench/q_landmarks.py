"""Per-frame landmark and geometry queries."""

from pyspark.sql import functions as F

from limbwise.operators import geometry as geo
from limbwise.operators import landmarks as lm
from limbwise.operators.sequences import limit_frames
from workbench.fixtures import SMALL, TEST_LAYOUT, draw_sql, with_sql
from workbench.registry import query

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)
KEY = ["clip_id", "frame_idx"]


def points(df, col="coords", extra=()):
    """Long form: one row per landmark."""
    return df.select(*KEY, *extra, F.posexplode(col).alias("j", "p")).select(
        *KEY, *extra, "j", r6(F.col("p")[0], "x"), r6(F.col("p")[1], "y"), r6(F.col("p")[2], "z"))


XYZ = "round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z"


@query("L1_group_slice", with_sql("lm", f"SELECT clip_id, frame_idx, (j - 11)::INT AS j, {XYZ} FROM lm WHERE j BETWEEN 11 AND 15"))
def _(t):
    return points(t.frames().withColumn("hand", lm.group_slice(F.col("coords"), TEST_LAYOUT, "left_hand")), "hand")


@query("L2_presence_mask", with_sql("lm", """SELECT clip_id, frame_idx, j::INT AS j, present::INT::DOUBLE AS m,
 (present AND (vec_id + j) % 10 >= 5)::INT::DOUBLE AS seen FROM lm"""))
def _(t):
    vis = F.transform("coords", lambda p, j: ((F.col("vec_id") + j) % 10) / 10)
    pair = F.zip_with(lm.presence_mask(F.col("coords")), lm.presence_mask(F.col("coords"), vis, 0.5), lambda a, b: F.array(a, b))
    return t.frames().select(*KEY, F.posexplode(pair).alias("j", "z")).select(
        *KEY, "j", F.col("z")[0].alias("m"), F.col("z")[1].alias("seen"))


@query("L3_confidence_mask", with_sql("addressed", """SELECT clip_id, frame_idx, j::INT AS j,
 CASE WHEN clip_id % 5 = 0 THEN 1.0 ELSE ((vec_id + j) % 4 / 4.0::DOUBLE > 0.5::DOUBLE)::INT::DOUBLE END AS m FROM addressed, range(0, 21) r(j)"""))
def _(t):
    conf = F.when(F.col("clip_id") % 5 != 0, F.transform("coords", lambda p, j: ((F.col("vec_id") + j) % 4) / 4))
    return t.frames().select(*KEY, F.posexplode(lm.confidence_mask(conf, 21, 0.5)).alias("j", "m"))


PACKED = """packed AS (SELECT clip_id, frame_idx, vec_id, j, ok, CASE WHEN ok THEN e[j*3+1] ELSE 0 END AS x, CASE WHEN ok THEN e[j*3+2] ELSE 0 END AS y,
 CASE WHEN ok THEN e[j*3+3] ELSE 0 END AS z FROM (SELECT *, CASE WHEN j < 11 THEN vec_id % 13 <> 5 AND (vec_id*31 + j*17) % 11 <> 0
   WHEN j < 16 THEN vec_id % 7 <> 0 AND clip_id % 9 <> 4 ELSE vec_id % 5 <> 0 AND clip_id % 9 <> 4 END AS ok FROM addressed, range(0, 21) r(j)))"""


@query("L4_pack_groups", with_sql("addressed", f"WITH {PACKED} SELECT clip_id, frame_idx, j::INT AS j, ok::INT::DOUBLE AS m, {XYZ} FROM packed"))
def _(t):
    packed = lm.pack(F.col("pose"), F.col("left_hand"), F.col("right_hand"), settings=SMALL)
    df = t.raw_frames().select(*KEY, packed.alias("f")).select(*KEY, F.arrays_zip("f.coords", "f.mask").alias("z"))
    return df.select(*KEY, F.posexplode("z").alias("j", "z")).select(
        *KEY, "j", F.col("z.mask").alias("m"), *[r6(F.col("z.coords")[a], n) for a, n in enumerate("xyz")])


@query("L5_flatten", with_sql("lm", """SELECT clip_id, frame_idx, d::INT AS d, round(CASE WHEN d >= 63 THEN p ELSE v END, 6) AS v FROM (
 SELECT clip_id, frame_idx, j*3 + a AS d, CASE a WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS v, 0 AS p FROM lm, range(0, 3) r(a)
 UNION ALL SELECT clip_id, frame_idx, 63 + j, 0, present::INT FROM lm)"""))
def _(t):
    from dataclasses import replace
    vec = lm.to_features(F.col("coords"), F.col("mask"), replace(SMALL, with_mask=True))
    return t.frames().select(*KEY, F.posexplode(vec).alias("d", "v")).select(*KEY, "d", r6("v"))


@query("L5_unflatten", with_sql("lm", f"SELECT clip_id, frame_idx, j::INT AS j, present::INT::DOUBLE AS m, {XYZ} FROM lm"))
def _(t):
    from dataclasses import replace
    s = replace(SMALL, with_mask=True)
    back = lm.from_features(lm.to_features(F.col("coords"), F.col("mask"), s), s)
    df = t.frames().select(*KEY, back.alias("f")).select(*KEY, F.arrays_zip("f.coords", "f.mask").alias("z"))
    return df.select(*KEY, F.posexplode("z").alias("j", "z")).select(
        *KEY, "j", F.col("z.mask").alias("m"), *[r6(F.col("z.coords")[a], n) for a, n in enumerate("xyz")])


@query("L6_body_reference", with_sql("ref", """SELECT clip_id, frame_idx, round(rx, 6) AS x, round(ry, 6) AS y, round(rz, 6) AS z,
 round(scale, 6) AS scale, basis FROM ref"""))
def _(t):
    ref = lm.body_reference(F.col("coords"), F.col("mask"), TEST_LAYOUT)
    return t.frames().select(*KEY, ref.alias("r")).select(
        *KEY, *[r6(F.col("r.centre")[a], n) for a, n in enumerate("xyz")], F.round("r.scale", 6).alias("scale"), "r.basis")


@query("L7_normalise_frame", with_sql("nl", f"SELECT clip_id, frame_idx, j::INT AS j, {XYZ} FROM nl"))
def _(t):
    return points(t.frames().withColumn("n", lm.normalise(F.col("coords"), F.col("mask"), TEST_LAYOUT)), "n")


@query("L8_normalise_clip", with_sql("nl", """SELECT clip_id, frame_idx, (j*3 + a)::INT AS d,
 round(CASE a WHEN 0 THEN x WHEN 1 THEN y ELSE z END, 6) AS v FROM nl, range(0, 3) r(a)"""))
def _(t):
    df = lm.normalise_frames(t.frames().drop("mask"), SMALL, mask=None)
    return df.select(*KEY, F.posexplode("features").alias("d", "v")).select(*KEY, "d", r6("v"))


@query("L9_mirror_hands", with_sql("lm", """SELECT clip_id, frame_idx, (CASE WHEN j < 11 THEN j WHEN j < 16 THEN j + 5 ELSE j - 5 END)::INT AS j,
 round(-x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM lm"""))
def _(t):
    return points(t.frames().withColumn("m", lm.mirror(F.col("coords"), TEST_LAYOUT)), "m")


@query("L10_axis_scale", with_sql("addressed", """SELECT clip_id, frame_idx, round(s, 6) AS scale, round(e[1] * s, 6) AS x0, round(e[2], 6) AS y0
 FROM (SELECT *, CASE WHEN clip_id % 4 = 1 THEN 2.0 WHEN clip_id % 3 = 0 THEN pow(1920.0::DOUBLE / 1080, 2) WHEN clip_id % 3 = 1 THEN 1.0 ELSE 3.1605 END::DOUBLE AS s FROM addressed)
 WHERE vec_id % 13 <> 5"""))
def _(t):
    explicit = F.when(F.col("clip_id") % 4 == 1, 2.0)
    df = t.raw_frames().where(F.col("pose").isNotNull()).withColumn("scale", geo.axis_scale(F.col("vid_shape"), explicit, SMALL))
    df = df.withColumn("p", geo.scale_x(F.col("pose"), F.col("scale"))[0])
    return df.select(*KEY, r6("scale"), r6(F.col("p")[0], "x0"), r6(F.col("p")[1], "y0"))


RATIOS = """wide AS (SELECT clip_id, frame_idx, """ + ", ".join(
    f"max(CASE WHEN j = {j} THEN {a} END) AS {a}{j}" for j in range(7) for a in "xy") + """,
 bool_and(present) FILTER (j IN (3, 4, 5, 6)) AS bs, bool_and(present) FILTER (j IN (0, 1, 2)) AS fs FROM lm GROUP BY clip_id, frame_idx),
ratios AS (SELECT clip_id, frame_idx, CASE WHEN bs AND abs(y3 - y5) > 1e-6 THEN abs(x3 - x4) / abs(y3 - y5) END AS body,
 CASE WHEN fs AND abs(x1 - x2) > 1e-6 THEN abs((y1 + y2) / 2 - y0) / abs(x1 - x2) END AS face FROM wide),
clipr AS (SELECT clip_id, count(*) AS frames, CASE WHEN count(body) >= 5 THEN median(body) END AS body, CASE WHEN count(face) >= 5 THEN median(face) END AS face FROM ratios GROUP BY clip_id)"""


@query("L11_frame_ratios", with_sql("lm", f"WITH {RATIOS} SELECT clip_id, frame_idx, round(body, 6) AS body, round(face, 6) AS face FROM ratios"))
def _(t):
    return geo.frame_ratios(t.frames(), SMALL).select(*KEY, r6("body"), r6("face"))


@query("L11_clip_medians", with_sql("lm", f"WITH {RATIOS} SELECT clip_id, frames, round(body, 6) AS body, round(face, 6) AS face FROM clipr"))
def _(t):
    return geo.clip_ratios(geo.frame_ratios(t.frames(), SMALL)).select("clip_id", "frames", r6("body"), r6("face"))


@query("L11_calibration", with_sql("lm", f"""WITH {RATIOS}, m AS (SELECT count(*) AS videos_used, sum(frames)::BIGINT AS frames_used, median(body) AS b, median(face) AS f FROM clipr),
 s AS (SELECT *, 0.6566::DOUBLE / b AS sb, f / 0.5238::DOUBLE AS sf FROM m)
 SELECT videos_used, frames_used, round(b, 6) AS body_ratio, round(f, 6) AS face_ratio, round(sb, 6) AS scale_body, round(sf, 6) AS scale_face,
 round((sb + sf) / 2, 6) AS scale_measured, round(100 * abs((sb + sf) / 2 - pow(1920.0::DOUBLE / 1080, 2)) / pow(1920.0::DOUBLE / 1080, 2), 6) AS gap_percent FROM s"""))
def _(t):
    out = geo.calibration(geo.clip_ratios(geo.frame_ratios(t.frames(), SMALL)), SMALL)
    return out.select("videos_used", "frames_used", *[r6(c) for c in (
        "body_ratio", "face_ratio", "scale_body", "scale_face", "scale_measured", "gap_percent")])


@query("L12_clip_sample", with_sql("clips", """SELECT clip_id, t::BIGINT AS frames FROM clips ORDER BY md5('42|' || clip_id), clip_id LIMIT 20"""))
def _(t):
    clips = t.frames().groupBy("clip_id").agg(F.count("*").alias("frames"))
    return geo.sample_clips(clips, 20, 42)


@query("L13_photo_ratios", with_sql("addressed", """WITH px AS (SELECT vec_id, list_transform(range(0, 7), lambda j: e[j*3+1] * (640 + vec_id % 5 * 100)) AS x,
  list_transform(range(0, 7), lambda j: e[j*3+2] * 480) AS y FROM addressed WHERE vec_id % 13 <> 5),
 r AS (SELECT sqrt(pow(x[4] - x[5], 2) + pow(y[4] - y[5], 2)) AS sh, sqrt(pow((x[4] + x[5]) / 2 - (x[6] + x[7]) / 2, 2) + pow((y[4] + y[5]) / 2 - (y[6] + y[7]) / 2, 2)) AS torso,
  abs(x[2] - x[3]) AS eyes, abs((y[2] + y[3]) / 2 - y[1]) AS drop_ FROM px),
 l AS (SELECT 'body' AS kind, CASE WHEN torso > 1e-6 THEN sh / torso END AS v FROM r UNION ALL SELECT 'face', CASE WHEN eyes > 1e-6 THEN drop_ / eyes END FROM r)
 SELECT kind, count(v) AS photos, round(median(v), 6) AS ratio FROM l GROUP BY kind"""))
def _(t):
    photos = t.raw_frames().select("pose", (640 + F.col("vec_id") % 5 * 100).alias("width"), F.lit(480).alias("height"))
    return geo.photo_ratios(photos, SMALL).select("kind", "photos", r6("ratio"))


@query("Q15_frame_limit", with_sql("addressed", "SELECT clip_id, frame_idx FROM addressed WHERE frame_idx < 15 AND frame_idx % 2 = 0"))
def _(t):
    return limit_frames(t.frames(), 15, 2).select(*KEY)
