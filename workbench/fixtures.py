"""Driver tables reshaped into the engine's inputs.

Every rule is arithmetic, string or md5 work, so Spark and SQL build the same rows.
``SQL`` holds the SQL twin of each fixture; ``with_sql`` prepends what a query needs.
All rows of the source tables are used.

* ``frames``: one row per embedding. Runs of 40 vectors become clips of 3, 7, 12 and
  18 frames (too short, shorter, equal and longer than the target length). Element
  3j..3j+2 is landmark j; single landmarks and whole groups go missing by rule.
* ``predictions`` / ``feedback``: the events as a recognition log. An event has
  feedback when ``k`` in its props is below 30 and a second verdict below 8.
* ``label_stream``: the events as per-user label observations.
* ``clip_index``: the orders as a clip catalogue, label = priority, number = key.
* ``scored``: nearest-centroid probabilities per embedding.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limbwise.functions.draws import uniform
from limbwise.settings import Layout, Settings

TEST_LAYOUT = Layout(
    groups=(("pose", 11), ("left_hand", 5), ("right_hand", 5)),
    nose=0, left_eye=1, right_eye=2,
    left_shoulder=3, right_shoulder=4, left_hip=5, right_hip=6,
)
SMALL = Settings(layout=TEST_LAYOUT, sequence_length=12, window_stride=5, stable_after=2,
                 cooldown_seconds=86400.0, session_slice_seconds=2 * 86400)
CLASSES = ("click", "error", "purchase", "signup", "view")


class Tables:
    """Lazy access to the driver tables of one scale folder and to the fixtures."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    # -- recognition log -----------------------------------------------------
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def predictions(self) -> DataFrame:
        conf = F.round(F.least(F.col("value") / 200, F.lit(1.0)), 6)
        return self.events().select(
            "event_id", F.col("ts").alias("timestamp"),
            F.element_at(F.array(*map(F.lit, SMALL.models)), (F.col("event_id") % 3 + 1).cast("int")).alias("model"),
            F.col("event_type").alias("predicted_class"), conf.alias("confidence"),
            F.when(conf < 0.38, "UNCERTAIN").otherwise("CONFIDENT").alias("status"),
            F.round("value", 3).alias("latency_ms"),
            F.lit(None).cast("string").alias("human_action"),
            F.lit(None).cast("string").alias("corrected_class"),
            F.when(F.col("user_id") % 2 == 0, "api").otherwise("live-camera").alias("source"),
            F.col("user_id").alias("session_id"))

    def feedback(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        verdicts = F.when(k < 8, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        base = (self.events().withColumn("k", k).where(F.col("k") < 30)
                .withColumn("ord", F.explode(verdicts)))
        action = F.element_at(F.array(F.lit("ACCEPT"), F.lit("CORRECT"), F.lit("REJECT")),
                              ((F.col("k") + F.col("ord") - 1) % 3 + 1).cast("int"))
        following = F.element_at(F.array(*map(F.lit, CLASSES[1:] + CLASSES[:1])),
                                 F.array_position(F.array(*map(F.lit, CLASSES)), F.col("event_type")).cast("int"))
        return base.select(
            "event_id", "ord", F.col("ts").alias("timestamp"), action.alias("human_action"),
            F.col("event_type").alias("predicted_class"),
            F.when(action == "CORRECT", following).alias("corrected_class"),
            F.element_at(F.array(*map(F.lit, SMALL.models)), (F.col("event_id") % 3 + 1).cast("int")).alias("model"))

    def label_stream(self) -> DataFrame:
        """session_id, seq (event id: time order inside a session), label, confidence, now."""
        conf = F.round(F.least(F.col("value") / 200, F.lit(1.0)), 6)
        return self.events().select(
            F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"),
            F.when(F.col("value") < 5, "IDLE").when(F.col("value") < 12, "UNCERTAIN")
            .when(F.col("event_type").isin("click", "view"), "click").otherwise(F.col("event_type")).alias("label"),
            conf.alias("confidence"), F.col("ts").alias("now"))

    # -- landmarks -----------------------------------------------------------
    def addressed(self) -> DataFrame:
        """Embeddings with their clip address and the elements as doubles."""
        o = F.col("vec_id") % 40
        return self.table("embeddings").select(
            "vec_id", "label", F.col("embedding").cast("array<double>").alias("e"),
            (F.floor(F.col("vec_id") / 40) * 4 + (o >= 3).cast("int") + (o >= 10).cast("int")
             + (o >= 22).cast("int")).cast("bigint").alias("clip_id"),
            (o - F.when(o >= 22, 22).when(o >= 10, 10).when(o >= 3, 3).otherwise(0)).cast("int").alias("frame_idx"))

    @staticmethod
    def missing(j: Column) -> Column:
        v, c = F.col("vec_id"), F.col("clip_id")
        no_hands = c % 9 == 4
        return (((v * 31 + j * 17) % 11 == 0) | ((j < 11) & (v % 13 == 5))
                | ((j >= 11) & (j <= 15) & ((v % 7 == 0) | no_hands))
                | ((j >= 16) & ((v % 5 == 0) | no_hands)))

    def frames(self) -> DataFrame:
        n = TEST_LAYOUT.landmarks
        point = lambda j: F.slice(F.col("e"), j * 3 + 1, F.lit(3))
        idx = F.sequence(F.lit(0), F.lit(n - 1))
        return self.addressed().select(
            "clip_id", "frame_idx", "vec_id", "label",
            F.transform(idx, lambda j: F.when(self.missing(j), F.array_repeat(F.lit(0.0), 3))
                        .otherwise(point(j))).alias("coords"),
            F.transform(idx, lambda j: F.when(self.missing(j), 0.0).otherwise(1.0)).alias("mask"))

    def raw_frames(self) -> DataFrame:
        """Detector output: groups may be absent, pose carries visibility, x is squeezed."""
        v, c = F.col("vec_id"), F.col("clip_id")
        part = lambda first, count: F.transform(F.sequence(F.lit(first), F.lit(first + count - 1)),
                                                lambda j: F.slice(F.col("e"), j * 3 + 1, F.lit(3)))
        pose = F.transform(part(0, 11), lambda p, j: F.concat(p, F.array(
            F.when((v * 31 + j * 17) % 11 == 0, 0.2).otherwise(0.9))))
        gone = c % 9 == 4
        return self.addressed().select(
            "clip_id", "frame_idx", "vec_id", "label",
            F.when(v % 13 != 5, pose).alias("pose"),
            F.when(~((v % 7 == 0) | gone), part(11, 5)).alias("left_hand"),
            F.when(~((v % 5 == 0) | gone), part(16, 5)).alias("right_hand"),
            F.when(c % 3 == 0, F.array(F.lit(1080), F.lit(1920)))
            .when(c % 3 == 1, F.array(F.lit(0), F.lit(0))).alias("vid_shape"))

    # -- catalogue -----------------------------------------------------------
    def clip_index(self) -> DataFrame:
        """Orders as clips; the split is a fixed draw on the file path."""
        path = F.concat_ws("/", "o_orderstatus", "o_orderpriority",
                           F.concat(F.lit("MVI_"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit(".MOV")))
        u = uniform("split", path)
        return self.table("orders").select(
            path.alias("FilePath"), F.element_at(F.split(path, "/"), -1).alias("Video"),
            F.col("o_orderpriority").alias("raw_word"), F.col("o_orderpriority").alias("label"),
            F.col("o_orderstatus").alias("Category"),
            F.when(u < 0.15, "test").when(u < 0.25, "val").otherwise("train").alias("split"),
            F.col("o_orderkey").alias("row_no"))

    def gloss_map(self) -> DataFrame:
        return (self.table("part").select("p_name").distinct().where(F.col("p_name") < "n")
                .select(F.col("p_name").alias("actual_gloss"),
                        F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("normalized_gloss")))

    def part_clips(self) -> DataFrame:
        """Parts as a catalogue with free-text words (some padded, in mixed case)."""
        word = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" "), F.initcap("p_name"), F.lit(" "))
                      ).otherwise(F.col("p_name"))
        return self.table("part").select(
            F.col("p_partkey").alias("row_no"), F.col("p_type").alias("Category"), word.alias("Word"),
            F.concat_ws("/", "p_type", word, F.concat(F.lit("clip_"), F.col("p_partkey").cast("string"),
                                                      F.lit(".mp4"))).alias("FilePath"),
            F.when(F.col("p_size") <= 40, "train").otherwise("test").alias("split"))


SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "predictions": ((), """
        SELECT event_id, ts AS "timestamp",
               CASE event_id % 3 WHEN 0 THEN 'lstm' WHEN 1 THEN 'gru' ELSE 'gru_mha' END AS model,
               event_type AS predicted_class,
               round(least(value / 200, 1.0::DOUBLE), 6) AS confidence,
               CASE WHEN round(least(value / 200, 1.0::DOUBLE), 6) < 0.38::DOUBLE THEN 'UNCERTAIN' ELSE 'CONFIDENT' END AS status,
               round(value, 3) AS latency_ms,
               CASE WHEN user_id % 2 = 0 THEN 'api' ELSE 'live-camera' END AS source,
               user_id AS session_id
        FROM events"""),
    "feedback": ((), """
        SELECT event_id, ord, ts AS "timestamp", human_action, event_type AS predicted_class,
               CASE WHEN human_action = 'CORRECT' THEN
                 CASE event_type WHEN 'click' THEN 'error' WHEN 'error' THEN 'purchase' WHEN 'purchase' THEN 'signup'
                                 WHEN 'signup' THEN 'view' ELSE 'click' END END AS corrected_class,
               CASE event_id % 3 WHEN 0 THEN 'lstm' WHEN 1 THEN 'gru' ELSE 'gru_mha' END AS model
        FROM (SELECT *, CASE (k + ord - 1) % 3 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'CORRECT' ELSE 'REJECT' END AS human_action
              FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
              CROSS JOIN (VALUES (1), (2)) v(ord)
              WHERE k < 30 AND (ord = 1 OR k < 8))"""),
    "label_stream": ((), """
        SELECT user_id AS session_id, event_id AS seq,
               CASE WHEN value < 5 THEN 'IDLE' WHEN value < 12 THEN 'UNCERTAIN'
                    WHEN event_type IN ('click', 'view') THEN 'click' ELSE event_type END AS label,
               round(least(value / 200, 1.0::DOUBLE), 6) AS confidence, ts AS now
        FROM events"""),
    "addressed": ((), """
        SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e,
               (vec_id // 40) * 4 + (o >= 3)::INT + (o >= 10)::INT + (o >= 22)::INT AS clip_id,
               (o - CASE WHEN o >= 22 THEN 22 WHEN o >= 10 THEN 10 WHEN o >= 3 THEN 3 ELSE 0 END)::INT AS frame_idx
        FROM (SELECT *, vec_id % 40 AS o FROM embeddings)"""),
    # long form: one row per landmark
    "lm": (("addressed",), """
        SELECT clip_id, frame_idx, vec_id, label, j, NOT gone AS present,
               CASE WHEN gone THEN 0 ELSE e[j*3+1] END AS x, CASE WHEN gone THEN 0 ELSE e[j*3+2] END AS y,
               CASE WHEN gone THEN 0 ELSE e[j*3+3] END AS z
        FROM (SELECT *, ((vec_id*31 + j*17) % 11 = 0) OR (j < 11 AND vec_id % 13 = 5)
                 OR (j BETWEEN 11 AND 15 AND (vec_id % 7 = 0 OR clip_id % 9 = 4))
                 OR (j >= 16 AND (vec_id % 5 = 0 OR clip_id % 9 = 4)) AS gone
              FROM addressed, range(0, 21) t(j))"""),
    "ref": (("lm",), """
        SELECT clip_id, frame_idx,
          CASE WHEN s_ok THEN sx WHEN h_ok THEN hx ELSE coalesce(cx, 0) END AS rx,
          CASE WHEN s_ok THEN sy WHEN h_ok THEN hy ELSE coalesce(cy, 0) END AS ry,
          CASE WHEN s_ok THEN sz WHEN h_ok THEN hz ELSE coalesce(cz, 0) END AS rz,
          CASE WHEN s_ok THEN sw WHEN h_ok THEN hw ELSE 1.0 END AS scale,
          CASE WHEN s_ok THEN 'shoulders' WHEN h_ok THEN 'hips' WHEN cx IS NOT NULL THEN 'centroid' ELSE 'none' END AS basis
        FROM (SELECT *, n_s = 2 AND sw > 1e-6 AS s_ok, n_h = 2 AND hw > 1e-6 AS h_ok FROM (
          SELECT clip_id, frame_idx,
            sum((j IN (3,4) AND present)::INT) AS n_s, sum((j IN (5,6) AND present)::INT) AS n_h,
            (sum(CASE WHEN j IN (3,4) THEN x ELSE 0 END))/2 AS sx, (sum(CASE WHEN j IN (3,4) THEN y ELSE 0 END))/2 AS sy,
            (sum(CASE WHEN j IN (3,4) THEN z ELSE 0 END))/2 AS sz,
            (sum(CASE WHEN j IN (5,6) THEN x ELSE 0 END))/2 AS hx, (sum(CASE WHEN j IN (5,6) THEN y ELSE 0 END))/2 AS hy,
            (sum(CASE WHEN j IN (5,6) THEN z ELSE 0 END))/2 AS hz,
            sqrt(pow(sum(CASE j WHEN 4 THEN x WHEN 3 THEN -x ELSE 0 END),2)+pow(sum(CASE j WHEN 4 THEN y WHEN 3 THEN -y ELSE 0 END),2)
                 +pow(sum(CASE j WHEN 4 THEN z WHEN 3 THEN -z ELSE 0 END),2)) AS sw,
            sqrt(pow(sum(CASE j WHEN 6 THEN x WHEN 5 THEN -x ELSE 0 END),2)+pow(sum(CASE j WHEN 6 THEN y WHEN 5 THEN -y ELSE 0 END),2)
                 +pow(sum(CASE j WHEN 6 THEN z WHEN 5 THEN -z ELSE 0 END),2)) AS hw,
            avg(x) FILTER (present) AS cx, avg(y) FILTER (present) AS cy, avg(z) FILTER (present) AS cz
          FROM lm GROUP BY clip_id, frame_idx))"""),
    # normalised landmarks
    "nl": (("lm", "ref"), """
        SELECT clip_id, frame_idx, label, j, present,
               CASE WHEN present THEN (x - rx) / greatest(scale, 1e-6) ELSE 0 END AS x,
               CASE WHEN present THEN (y - ry) / greatest(scale, 1e-6) ELSE 0 END AS y,
               CASE WHEN present THEN (z - rz) / greatest(scale, 1e-6) ELSE 0 END AS z
        FROM lm JOIN ref USING (clip_id, frame_idx)"""),
    "clips": (("lm",), """
        SELECT clip_id, count(*) AS t, sum(has::INT) AS usable, min_by(label, frame_idx) AS label
        FROM (SELECT clip_id, frame_idx, label, bool_or(present) AS has FROM lm GROUP BY ALL) GROUP BY clip_id"""),
    # normalised clip features, long: one row per (clip, frame, feature d)
    "feat": (("nl", "clips"), """
        SELECT n.clip_id, c.label, c.t, frame_idx, j*3+a AS d, CASE a WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS v
        FROM nl n JOIN clips c USING (clip_id), range(0, 3) r(a) WHERE c.usable >= 5"""),
    # resampled to 12 frames
    "seq": (("feat",), """
        SELECT f.clip_id, f.label, g.i AS i, f.d,
               f.v + (h.v - f.v) * (g.i * (f.t - 1) / 11.0::DOUBLE - floor(g.i * (f.t - 1) / 11.0::DOUBLE)) AS v
        FROM range(0, 12) g(i) JOIN feat f ON f.frame_idx = floor(g.i * (f.t - 1) / 11.0::DOUBLE)
        JOIN feat h ON h.clip_id = f.clip_id AND h.d = f.d
             AND h.frame_idx = least(floor(g.i * (f.t - 1) / 11.0::DOUBLE) + 1, f.t - 1)"""),
    "clip_index": ((), """
        SELECT *, split_part("FilePath", '/', -1) AS "Video",
               CASE WHEN u < 0.15::DOUBLE THEN 'test' WHEN u < 0.25::DOUBLE THEN 'val' ELSE 'train' END AS split FROM (
          SELECT *, ('0x' || substr(md5('split|' || "FilePath"), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (
            SELECT o_orderstatus || '/' || o_orderpriority || '/MVI_' || lpad(o_orderkey::VARCHAR, 6, '0') || '.MOV' AS "FilePath",
                   o_orderpriority AS raw_word, o_orderpriority AS label, o_orderstatus AS "Category", o_orderkey AS row_no
            FROM orders))"""),
    "gloss_map": ((), """
        SELECT DISTINCT p_name AS actual_gloss, upper(replace(p_name, ' ', '_')) AS normalized_gloss
        FROM part WHERE p_name < 'n'"""),
    "part_clips": ((), """
        SELECT row_no, "Category", "Word", "Category" || '/' || "Word" || '/clip_' || row_no || '.mp4' AS "FilePath", split
        FROM (SELECT p_partkey AS row_no, p_type AS "Category",
               CASE WHEN p_size % 5 = 0 THEN ' ' || array_to_string(list_transform(string_split(p_name, ' '),
                    lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' ELSE p_name END AS "Word",
               CASE WHEN p_size <= 40 THEN 'train' ELSE 'test' END AS split FROM part)"""),
}


def with_sql(names: str, body: str, recursive: bool = False) -> str:
    """``body`` with the CTEs of the named fixtures (space separated) and their inputs."""
    order: list[str] = []

    def need(name: str) -> None:
        deps, _ = SQL[name]
        for dep in deps:
            need(dep)
        if name not in order:
            order.append(name)
    for name in names.split():
        need(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n][1]})" for n in order)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"{head}{ctes},\n{body[5:]}"
    return f"{head}{ctes}\n{body}"


def draw_sql(*parts: str, word: int = 0) -> str:
    """SQL twin of ``uniform``: parts are SQL expressions cast to text."""
    key = "md5(concat_ws('|', " + ", ".join(f"({p})::VARCHAR" for p in parts) + "))"
    return f"(('0x' || substr({key}, {1 + 8 * word}, 8))::BIGINT / 4294967296.0::DOUBLE)"


def normal_sql(parts: tuple[str, ...], axis: str) -> str:
    """SQL twin of ``normals``; ``axis`` is an expression giving 0, 1 or 2."""
    u = [draw_sql(*parts, word=k) for k in range(4)]
    return (f"CASE {axis} WHEN 0 THEN sqrt(-2.0::DOUBLE*ln(1-{u[0]}))*cos(2*pi()*{u[1]}) "
            f"WHEN 1 THEN sqrt(-2.0::DOUBLE*ln(1-{u[0]}))*sin(2*pi()*{u[1]}) "
            f"ELSE sqrt(-2.0::DOUBLE*ln(1-{u[2]}))*cos(2*pi()*{u[3]}) END")


# -- scored embeddings --------------------------------------------------------
# Three scorers that differ in the vector part they look at: first half, second half, all.
PARTS = {"lstm": (1, 32), "gru": (33, 32), "gru_mha": (1, 64)}
LABELS = tuple(str(i) for i in range(10))


def scored(t: Tables) -> DataFrame:
    """(model, split, vec_id, label, probs): centroids fitted on the drawn train part."""
    from dataclasses import replace

    from limbwise.operators.scoring import fit_centroids
    base = t.table("embeddings").select("vec_id", F.col("label").cast("string").alias("label"),
                                        F.col("embedding").cast("array<double>").alias("e"),
                                        F.when(uniform("fit", F.col("vec_id")) < 0.8, "train").otherwise("test").alias("split"))
    whole = fit_centroids(base.where("split = 'train'"), "label", F.col("e"))
    out = None
    for model, (first, count) in PARTS.items():
        part = F.slice("e", first, count)
        scorer = replace(whole, centroids=whole.centroids[:, first - 1:first - 1 + count])
        rows = base.select(F.lit(model).alias("model"), "split", "vec_id", "label", scorer.probabilities(part).alias("probs"))
        out = rows if out is None else out.unionByName(rows)
    return out


SQL["emb_part"] = (("addressed",), """
    SELECT m.model, vec_id, label, d, e[d] AS v,
           CASE WHEN ('0x' || substr(md5('fit|' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.8::DOUBLE THEN 'train' ELSE 'test' END AS split
    FROM addressed, range(1, 65) r(d), (VALUES ('lstm', 1, 32), ('gru', 33, 64), ('gru_mha', 1, 64)) m(model, lo, hi)
    WHERE d BETWEEN lo AND hi""")
SQL["scored"] = (("emb_part",), """
    SELECT model, split, vec_id, label, c, exp(-8 * d2 - max(-8 * d2) OVER w) / sum(exp(-8 * d2 - top)) OVER w AS p
    FROM (SELECT *, max(-8 * d2) OVER (PARTITION BY model, vec_id) AS top FROM (
      SELECT e.model, any_value(e.split) AS split, e.vec_id, any_value(e.label) AS label, k.label AS c, sum((e.v - k.v) * (e.v - k.v)) AS d2
      FROM emb_part e JOIN (SELECT model, label, d, avg(v) AS v FROM emb_part WHERE split = 'train' GROUP BY ALL) k
      ON e.model = k.model AND e.d = k.d GROUP BY e.model, e.vec_id, k.label))
    WINDOW w AS (PARTITION BY model, vec_id)""")
SQL["decided"] = (("scored",), """
    SELECT model, split, vec_id, any_value(label) AS label, arg_max(c, p) AS pred, max(p) AS conf,
           max(p) - max(p, 2)[2] AS margin FROM scored GROUP BY model, split, vec_id""")
