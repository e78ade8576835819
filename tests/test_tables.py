"""Splits, duplicates, evaluation, logs, files and profiles on small known inputs."""

import itertools
import json
import os
import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from limbwise.operators import audit, evaluation, events, metadata, nearcounts, profiles, scoring, splits, thresholds, validate
from limbwise.settings import Settings
from limbwise.sources import catalogue, keypoints, logs, snapshots, workspace
from limbwise.sources.workspace import scratch_path

S = Settings()


# -- metadata and splits -----------------------------------------------------
@pytest.mark.parametrize("name,want", [("a/MVI_0031.MOV", "0031"), ("MVI_0060_1.MP4", "0060"), ("x/y/mvi-4155.MOV", "4155"),
                                       ("clip-final.mov", "clip-final"), ("take12b7.mov", "127"), ("noext", "noext")])
def test_session_id(spark, name, want):
    assert spark.createDataFrame([(name,)], "p string").select(metadata.session_id(F.col("p"))).first()[0] == want


def test_clusters_by_hand(spark):
    ids = [5, 1, 12, 11, 40, 51, 41]
    rows = [(i, f"c/w/MVI_{n}.MOV", "A") for i, n in enumerate(ids)] + [(90, "c/w/final.mov", "A"), (91, "c/w/MVI_7.MOV", "B"), (92, "c/w/MVI_7.MP4", "B")]
    df = spark.createDataFrame(rows, "row_no long, FilePath string, label string")
    for width in (3, 100_000):
        got = {r["row_no"]: r["cluster"] for r in splits.session_clusters(df, slice_width=width).collect()}
        assert {got[i] for i in (0, 1, 2, 3)} == {"A:1-12"} and {got[i] for i in (4, 5, 6)} == {"A:40-51"}
        assert got[90] == "A:other" and got[91] == got[92] == "B:7-7"


@pytest.mark.parametrize("sizes,quota,want", [
    ([2, 3, 5], 4, [5]),            # 3 and 5 are equally near: the larger, though it overfills an empty quota
    ([1, 2, 3, 3], 5, [2, 3]),      # after 3 the open room is 2
    ([6, 6, 9], 10, [9]),           # 6 would overfill and 60 % is reached
    ([4, 4, 4], 10, [4, 4]),        # 8 of 10 is past 60 %, a third 4 would overfill
    ([1, 1, 1], 10, [1, 1, 1]), ([100], 1, [100]), ([7, 20], 12, [7, 20])])
def test_allocation_by_hand(sizes, quota, want):
    values, counts = np.unique(sizes, return_counts=True)
    assert np.repeat(values, splits.allocate(values, counts, {"x": quota})["x"]).tolist() == want


def test_allocation_properties():
    rng = random.Random(1)
    for _ in range(300):
        sizes = np.array([rng.choice([1, 1, 2, 3, 5, 8, 20, 100]) for _ in range(rng.randint(1, 40))])
        quotas = {"test": max(1, round(sizes.sum() * 0.15)), "val": max(1, round(sizes.sum() * 0.1))}
        values, counts = np.unique(sizes, return_counts=True)
        got, left = splits.allocate(values, counts, quotas), counts.copy()
        for name, quota in quotas.items():
            left = left - got[name]
            filled, free = int((got[name] * values).sum()), values[left > 0]
            assert (left >= 0).all()
            if filled < quota and len(free):   # stopped early: the best fit would overfill, and enough is there
                best = max(free, key=lambda v: (-abs(quota - filled - v), v))
                assert best > quota - filled and filled >= 0.6 * quota
            if filled > quota:                 # the last one taken overfilled: without it less than 60 % was there
                over = values[(got[name] > 0) & (values > filled - quota)]
                assert any(filled - v < 0.6 * quota or v <= quota - (filled - v) for v in over)


def test_splits_keep_rows_without_label_or_path(spark):
    rows = [(i, None if i % 5 == 0 else "c/w/MVI_%d.MOV" % (i * 20), None if i % 4 == 0 else "A", "train") for i in range(20)]
    df = spark.createDataFrame(rows, "row_no long, FilePath string, label string, split string")
    for out in (splits.session_carve_out(df, S), splits.cluster_disjoint_split(splits.session_clusters(df), S)):
        got = {r["row_no"]: r["split"] for r in out.collect()}
        assert sorted(got) == list(range(20)) and all(got[i] == "train" for i in range(0, 20, 4))
    assert {r["split"] for r in splits.session_carve_out(df, S).collect()} == {"train", "val"}


def test_session_ids_beyond_bigint(spark):
    big = 10 ** 25
    df = spark.createDataFrame([(0, f"c/w/MVI_{big}.MOV", "A"), (1, f"c/w/MVI_{big + 4}.MOV", "A"), (2, f"c/w/MVI_{big + 40}.MOV", "A")], "row_no long, FilePath string, label string")
    got = {r["row_no"]: r["cluster"] for r in splits.session_clusters(df).collect()}
    assert got == {0: f"A:{big}-{big + 4}", 1: f"A:{big}-{big + 4}", 2: f"A:{big + 40}-{big + 40}"}


def test_metrics_of_a_null_model(spark):
    p = spark.createDataFrame([(None, "OK", 0.5, 4.0, "A"), ("m", "OK", 0.5, 2.0, "A")], "model string, status string, confidence double, latency_ms double, predicted_class string")
    f = spark.createDataFrame([(None, "ACCEPT", None, "A")], "model string, human_action string, corrected_class string, predicted_class string")
    got = {r["model"]: (r["predictions_total"], r["feedback_total"], r["latency_p50"]) for r in events.log_metrics(p, f, ["model"]).collect()}
    assert got == {None: (1, 1, 4.0), "m": (1, 0, 2.0)}


def test_disjoint_split_is_whole_and_stable(spark):
    rng, rows = random.Random(2), []
    for i in range(600):
        label = "HOT" if i % 3 else f"L{i % 5}"
        rows.append((i, f"c/w/MVI_{rng.randint(1, 4000)}.MOV", label))
    df = spark.createDataFrame(rows, "row_no long, FilePath string, label string")
    run = lambda d: sorted((r["row_no"], r["split"]) for r in splits.cluster_disjoint_split(splits.session_clusters(d), S).collect())
    first = run(df.repartition(1))
    assert [i for i, _ in first] == list(range(600)) and first == run(df.repartition(23))
    clustered = splits.cluster_disjoint_split(splits.session_clusters(df), S)
    assert splits.spanning_clusters(clustered).count() == 0
    assert {r["split"] for r in clustered.select("split").distinct().collect()} == {"train", "val", "test"}


def test_carve_out_takes_whole_sessions(spark):
    df = spark.createDataFrame([(i, f"a/b/MVI_{i // 4}.MOV", "A", "train") for i in range(40)], "row_no long, FilePath string, label string, split string")
    out = splits.session_carve_out(df, S).collect()
    val = [r["row_no"] // 4 for r in out if r["split"] == "val"]
    assert len(out) == 40 and len(val) == 4 and len(set(val)) == 1


def test_class_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "label string")
    assert {r["label"]: r["index"] for r in metadata.class_index(df).collect()} == {"a": 0, "b": 1, "c": 2}
    many = spark.range(20_000).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("label"))
    assert metadata.class_index(many).where(F.col("label") != F.concat(F.lit("c"), F.lpad(F.col("index").cast("string"), 6, "0"))).count() == 0


# -- near-duplicates ---------------------------------------------------------
def test_duplicates_equal_brute_force_with_a_group_of_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (12, 10))
    rows = []
    for i in range(90):
        v = base[0] if i < 30 else base[rng.integers(12)] + rng.normal(0, 0.02, 10) * (i % 3)
        rows.append((i, "A" if i % 4 else "B", v.tolist(), ["train", "val", "test"][i % 3]))
    df = spark.createDataFrame(rows, "clip_id long, label string, sig array<double>, split string")
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    pairs = [(p, q, cos(p[2], q[2])) for p, q in itertools.combinations(rows, 2) if p[1] == q[1]]
    near = [(p, q, c) for p, q, c in pairs if c > 0.999]
    counts = {r["label"]: r for r in audit.duplicate_counts(df).collect()}
    for label in "AB":
        mine = [(p, q) for p, q, _ in near if p[1] == label]
        assert counts[label]["pairs_checked"] == sum(p[1] == label for p, _, _ in pairs)
        assert counts[label]["near_duplicates"] == len(mine)
        assert counts[label]["cross_any"] == sum(p[3] != q[3] for p, q in mine)
        assert counts[label]["cross_train_test"] == sum({p[3], q[3]} == {"train", "test"} for p, q in mine)
    want = sorted(((-round(c, 6), p[1], p[0], q[0]) for p, q, c in near))[:25]
    got = [(-r["similarity"], r["label"], r["clip_a"], r["clip_b"]) for r in audit.top_duplicate_pairs(df, 25).collect()]
    assert sorted(got) == want


def brute_counts(rows, threshold=0.999):
    """Clip pairs per label by comparing all."""
    out = {}
    for label in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == label and np.linalg.norm(r[2]) >= 1e-6]
        u = np.array([np.array(r[2]) / np.linalg.norm(r[2]) for r in own]).reshape(len(own), -1)
        a, b = np.nonzero(np.triu(u @ u.T > threshold, 1)) if len(own) else ((), ())
        split = [(own[i][3], own[j][3]) for i, j in zip(a, b)]
        out[label] = (len(own) * (len(own) - 1) // 2, len(split), sum(x != y for x, y in split), sum({x, y} == {"train", "test"} for x, y in split))
    return out


@pytest.mark.parametrize("leaf", [25, 256])
def test_duplicate_counts_over_divided_cells(spark, leaf, monkeypatch):
    """Heaps inside the radius, around it and spread out, copies, opposite and tiny vectors, a null label."""
    monkeypatch.setattr(nearcounts, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    rows = []
    for i in range(420):
        centre = np.eye(6)[i % 3] * (-1 if i % 50 == 0 else 1)
        v = centre + rng.normal(0, [0.001, 0.02, 0.3][i % 3 if i % 2 else (i // 7) % 3], 6)
        rows.append((i, ["A", "A", "A", "B", None][i % 5], (v * (1e-8 if i % 97 == 0 else 1 + i % 3)).tolist(), ["train", "val", "test"][i % 7 % 3]))
    rows += [(1000 + i, "A", rows[i % 5][2], "test") for i in range(40)] + [(2000, "lone", [1.0] * 6, "train")]
    df = spark.createDataFrame(rows, "clip_id long, label string, sig array<double>, split string")
    got = {r["label"]: (r["pairs_checked"], r["near_duplicates"], r["cross_any"], r["cross_train_test"]) for r in audit.duplicate_counts(df).collect()}
    assert got == brute_counts(rows) and got["A"][1] > 2000
    assert audit.duplicate_counts(df.limit(0)).count() == 0


def test_a_dense_cell_is_counted_whole(spark):
    """60,000 different signatures in one cell: some 1,800 million pairs, none of them listed or compared one by one."""
    n = 60_000
    noise = lambda k: (F.rand(k) - 0.5) * 0.004
    heap = spark.range(n).select(F.col("id").alias("clip_id"), F.lit("A").alias("label"), F.array(F.lit(1.0), *[noise(k) for k in range(4)]).alias("sig"),
                                 F.element_at(F.array(F.lit("train"), F.lit("test")), (F.col("id") % 2 + 1).cast("int")).alias("split"))
    row = audit.duplicate_counts(heap).first()
    assert (row["pairs_checked"], row["near_duplicates"], row["cross_train_test"]) == (n * (n - 1) // 2, n * (n - 1) // 2, n * n // 4)


# -- evaluation --------------------------------------------------------------
def test_scores_by_hand(spark):
    rows = [("m", t, p) for t, p in [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "c")] * 2 + [("c", "a")]]
    cells = evaluation.confusion(spark.createDataFrame(rows, "model string, y_true string, y_pred string"), ["model"])
    got = {r["class"]: r for r in evaluation.per_class(cells, ["model"]).collect()}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["f1"], got["a"]["support"]) == (0.75, 0.75, 0.75, 4)
    assert (got["b"]["precision"], got["b"]["recall"]) == pytest.approx((2 / 3, 0.5))
    assert (got["c"]["precision"], got["c"]["recall"], got["c"]["f1"], got["c"]["support"]) == (0, 0, 0, 1)
    avg = evaluation.averages(evaluation.per_class(cells, ["model"]), ["model"]).first()
    f1_b = 2 * (2 / 3) * 0.5 / (2 / 3 + 0.5)
    assert avg["accuracy"] == pytest.approx(5 / 9) and avg["macro_f1"] == pytest.approx((0.75 + f1_b) / 3)
    assert avg["weighted_f1"] == pytest.approx((0.75 * 4 + f1_b * 4) / 9) and avg["n_samples"] == 9


@pytest.mark.parametrize("window", [1, 2, 7, 200])
def test_rolling_latency_slides_over_slices(spark, window):
    rng, rows = random.Random(window), []
    for i in range(600):
        rows.append(("gru" if i % 9 else None, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(40_000)), i, None if i % 50 == 3 else float(rng.randrange(100))))
    df = spark.createDataFrame(rows, "model string, ts timestamp, seq long, latency_ms double")
    out = {r["seq"]: r for r in scoring.rolling_latency(df, ["model"], "ts", "seq", settings=replace(S, latency_window=window, session_slice_seconds=600)).collect()}
    assert len(out) == len(rows)
    for model in ("gru", None):
        own = sorted((r for r in rows if r[0] == model), key=lambda r: (r[1], r[2]))
        for n, r in enumerate(own):
            last = [x[3] for x in own[max(0, n + 1 - window):n + 1] if x[3] is not None]
            got = out[r[2]]
            if not last:
                assert got["mean_latency_ms"] is None and got["p95_latency_ms"] is None and got["throughput_fps"] == 0
            else:
                assert got["mean_latency_ms"] == pytest.approx(np.mean(last)) and got["p95_latency_ms"] == pytest.approx(np.percentile(last, 95))


def test_sweep_by_hand(spark):
    df = spark.createDataFrame([("m", c, ok) for c, ok in [(0.2, True), (0.5, False), (0.9, True), (0.1, True)]], "model string, confidence double, correct boolean")
    rows = {r["threshold"]: r for r in thresholds.sweep(df, ["model"]).collect()}
    assert len(rows) == 16
    assert (rows[0.2]["accepted"], rows[0.2]["accepted_correct"], rows[0.2]["coverage"]) == (3, 2, 0.75)
    assert (rows[0.5]["selective_accuracy"], rows[0.5]["pessimistic_accuracy"]) == (0.5, 0.25)
    assert rows[0.95]["selective_accuracy"] is None and rows[0.95]["uncertain_rate"] == 1.0


# -- logs --------------------------------------------------------------------
def log(spark):
    now = datetime(2024, 1, 1)
    rows = [("e1", now, "gru", "A", 0.9, "CONFIDENT", 2.0), ("e2", now, "gru", "B", None, "UNCERTAIN", 0.0), ("e3", now, "lstm", "A", 0.5, "CONFIDENT", 4.0)]
    p = spark.createDataFrame(rows, "event_id string, timestamp timestamp, model string, predicted_class string, confidence double, status string, latency_ms double")
    for c in ("human_action", "corrected_class"):
        p = p.withColumn(c, F.lit(None).cast("string"))
    f = spark.createDataFrame([("e1", 1, now, "ACCEPT", "A", None, "gru"), ("e1", 2, now, "CORRECT", "A", "B", "gru"), ("zz", 3, now, "REJECT", "C", None, None)],
                              "event_id string, ord int, timestamp timestamp, human_action string, predicted_class string, corrected_class string, model string")
    return p, f


def test_newest_verdict_wins_and_metrics(spark):
    p, f = log(spark)
    got = {r["event_id"]: r for r in events.with_verdicts(p, f, "ord").collect()}
    assert got["e1"]["human_action"] == "CORRECT" and got["e1"]["wrong"] and not got["e2"]["wrong"]
    m = events.log_metrics(p, f).first()
    assert (m["predictions_total"], m["uncertain_rate"], m["confidence_mean"], m["latency_mean"], m["latency_p50"]) == (3, pytest.approx(1 / 3), 0.7, 3.0, 3.0)
    assert m["agreement_rate"] == pytest.approx(1 / 3) and m["throughput_fps"] == pytest.approx(1000 / 3) and m["review_total"] == 3
    empty = events.log_metrics(p.limit(0), f.limit(0)).first()
    assert empty["predictions_total"] == 0 and empty["latency_p95"] == 0 and empty["agreement_rate"] is None
    stand = events.with_stand_ins(p, f).where("fallback_logged").collect()
    assert [(r["event_id"], r["model"], r["confidence"]) for r in stand] == [("zz", "gru_mha", None)]


def test_review_filters_treat_null_confidence_as_zero(spark):
    p, f = log(spark)
    e = events.with_verdicts(p, f, "ord")
    ids = lambda df: sorted(r["event_id"] for r in df.collect())
    assert ids(events.review_filter(e, max_confidence=0.6)) == ["e2", "e3"]
    assert ids(events.review_filter(e, predicted_class="a", only_corrected=True)) == ["e1"]
    assert ids(events.flagged(e)) == ["e1", "e2"]


def test_jsonl_skips_bad_lines_and_keeps_extra_keys(spark):
    path = scratch_path(spark, "jsonl")
    os.makedirs(path)
    with open(os.path.join(path, "a.jsonl"), "w") as f:
        f.write('{"event_id": "e1", "confidence": 0.5, "session_id": "s9"}\n\n   \n{"event_id": "e2", \nnot json\n{"event_id": "e3"}\n')
    rows = {r["event_id"]: r for r in logs.read_jsonl(spark, path, logs.PREDICTION).collect()}
    assert set(rows) == {"e1", "e3"} and rows["e1"]["extra"] == {"session_id": "s9"} and rows["e1"]["confidence"] == 0.5
    assert logs.read_jsonl(spark, path + "-absent", logs.PREDICTION).count() == 0


# -- files -------------------------------------------------------------------
def test_keypoint_files_npz_json_and_damage(spark):
    root = scratch_path(spark, "files")
    os.makedirs(os.path.join(root, "Cat"))
    pts = np.random.default_rng(1).normal(0, 1, (4, 75, 3))
    conf = np.ones((4, 75))
    conf[0, 5] = 0.0
    np.savez_compressed(os.path.join(root, "Cat", "a.npz"), keypoints=pts, confidences=conf, vid_shape=np.array([1080, 1920]))
    with open(os.path.join(root, "Cat", "b.json"), "w") as f:
        json.dump({"keypoints": pts[:2].tolist()}, f)
    whole = open(os.path.join(root, "Cat", "a.npz"), "rb").read()
    open(os.path.join(root, "Cat", "cut.npz"), "wb").write(whole[:-200])
    np.savez(os.path.join(root, "Cat", "obj.npz"), keypoints=np.array([{"a": 1}], dtype=object))
    frames = keypoints.read_keypoints(spark, root).withColumn("f", metadata.file_name(F.col("path"))).orderBy("f", "frame_idx").collect()
    assert [(r["f"], r["frame_idx"]) for r in frames] == [("a.npz", i) for i in range(4)] + [("b.json", 0), ("b.json", 1)]
    assert frames[0]["coords"][5] == [0, 0, 0] and frames[0]["mask"][5] == 0
    assert np.allclose(frames[1]["coords"], pts[1] * [(1920 / 1080) ** 2, 1, 1])
    assert np.allclose(frames[4]["coords"], pts[0] * [3.1605, 1, 1]) and sum(frames[4]["mask"]) == 75
    status = {metadata_name(r["path"]): r["status"] for r in keypoints.scan_files(spark, root).collect()}
    assert status == {"a.npz": "ok", "b.json": "ok", "cut.npz": "corrupt", "obj.npz": "unreadable"}


def metadata_name(path):
    return path.rsplit("/", 1)[-1]


def test_file_resolution_prefers_exact_folders(spark):
    index = spark.createDataFrame([("Home/1. Fan/MVI_1.MOV",), ("Home/2. Pen/MVI_2.MOV",), ("Home/3. Hat/MVI_3.MOV",), ("short.mov",)], "FilePath string")
    files = spark.createDataFrame([("Z/Home/1. Fan/Extra/MVI_1.npz",), ("Z/Home/1. Fan/MVI_1.npz",), ("Z/home/deep/mvi_2.NPZ",), ("Z/Other/3. Hat/MVI_3.npz",)], "path string")
    got = {r["FilePath"]: (r["member"], r["match"]) for r in catalogue.resolve_files(index, files, ".npz").collect()}
    assert got == {"Home/1. Fan/MVI_1.MOV": ("Z/Home/1. Fan/MVI_1.npz", "exact"), "Home/2. Pen/MVI_2.MOV": ("Z/home/deep/mvi_2.NPZ", "fallback"),
                   "Home/3. Hat/MVI_3.MOV": (None, None), "short.mov": (None, None)}


def test_a_rebuild_does_not_disturb_a_reader(spark):
    path = scratch_path(spark, "snapshots")
    table = snapshots.Snapshots(spark, path)
    assert table.read() is None and table.current() is None
    before = logs.stored_index(spark, path, lambda: spark.range(5).repartition(3))
    assert logs.stored_index(spark, path, lambda: spark.range(9)).count() == 5
    with pytest.raises(Exception):
        logs.stored_index(spark, path, lambda: spark.range(7).withColumn("x", F.raise_error(F.lit("no"))), force_rebuild=True)
    assert logs.stored_index(spark, path, lambda: None).count() == 5            # a failed rebuild is never seen
    after = logs.stored_index(spark, path, lambda: table.read().union(spark.range(2)), force_rebuild=True)
    assert (before.count(), after.count(), table.read().count()) == (5, 7, 7)   # the reader of the old one goes on
    assert len(table.prune(3600)) == 0 and before.count() == 5
    left = table.prune(0)
    assert len(left) == 2 and table.read().count() == 7   # the old one and the failed one
    assert len([n for n in os.listdir(path) if n.startswith("data-")]) == 1


def test_two_writers_leave_one_current_snapshot(spark):
    path = scratch_path(spark, "snapshots")
    a, b = snapshots.Snapshots(spark, path), snapshots.Snapshots(spark, path)
    known = b._listed()
    a.replace(spark.range(1))
    b._listed, listed = lambda: known, b._listed            # the second writer has not seen the first one's manifest
    b.replace(spark.range(2))
    b._listed = listed
    assert a.current() == b.current() and a.read().count() in (1, 2)


def test_scratch_tables_can_be_cleared(spark):
    kept = workspace.cut(spark.range(3), "kept")
    assert kept.count() == 3
    folder = os.path.dirname(scratch_path(spark, "x"))
    ended = os.path.join(os.path.dirname(folder), "limbwise-ended")
    os.makedirs(ended)
    assert workspace.clear_scratch(spark, "ended") and not os.path.exists(ended) and not workspace.clear_scratch(spark, "ended")
    assert os.path.exists(folder) and kept.count() == 3


# -- profiles ----------------------------------------------------------------
def test_profile_state_and_threshold(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = [("a", day(0), 1, "create", "lstm", 0.99, ["X"]), ("a", day(1), 2, "update", None, 0.2, None), ("b", day(0), 3, "create", None, None, None),
            ("b", day(1), 4, "delete", None, None, None), ("b", day(2), 5, "update", "gru", None, None), ("c", day(0), 6, "create", "gru", 0.9, ["X"]),
            ("c", day(1), 7, "delete", None, None, None), ("c", day(2), 8, "create", None, None, None)]
    df = spark.createDataFrame(rows, "name string, changed_at timestamp, seq int, action string, base_model string, threshold double, vocabulary array<string>")
    got = {r["name"]: (r["base_model"], r["vocabulary"], round(r["threshold"], 6)) for r in profiles.current_profiles(df, ["changed_at", "seq"]).collect()}
    assert got == {"a": ("lstm", ["X"], 0.2), "c": ("gru_mha", [], 0.38)}
    clamp = spark.createDataFrame([(0.0,), (0.4,), (0.99,)], "v double").select(profiles.clamp_threshold(F.col("v"))).collect()
    assert [round(r[0], 6) for r in clamp] == [0.18, 0.4, 0.58]


def test_uploads_are_taken_whole(spark):
    day = datetime(2024, 1, 1)
    profile = profiles.current_profiles(spark.createDataFrame([("a", day, 1, "create", None, None, ["HELLO", "BANK"]), ("b", day, 2, "create", None, None, None)],
                                                              "name string, changed_at timestamp, seq int, action string, base_model string, threshold double, vocabulary array<string>"), ["changed_at", "seq"])
    index = spark.createDataFrame([("HELLO",), ("BANK",), ("WATER",)], "label string")
    s = replace(S, layout=replace(S.layout, groups=(("pose", 1),)))
    clip, narrow = [[0.0] * 3] * 2, [[0.0] * 2] * 2
    rows = [(1, "a", [clip] * 3, ["hello", " BANK", "HELLO"]), (2, "a", [clip, narrow], ["HELLO"] * 2), (3, "a", [clip], ["HELLO"] * 2), (4, "a", [clip], ["NOPE"]),
            (5, "a", [clip] * 2, ["HELLO", "WATER"]), (6, "x", [clip], ["HELLO"]), (7, "b", [clip], ["water"]), (8, "a", None, None), (9, "a", [clip], None),
            (10, "a", [[]], ["HELLO"]), (11, "a", [clip, None], ["HELLO"] * 2), (12, "a", [clip], [None]), (13, "a", [clip], ["BANK"])]
    uploads = spark.createDataFrame(rows, "upload int, name string, features array<array<array<double>>>, labels array<string>")
    checked = profiles.check_uploads(uploads, profile, index, s)
    assert {r["upload"]: r["reason"] for r in checked.collect()} == {
        1: None, 2: "features_shape", 3: "label_count", 4: "unknown_label", 5: "outside_vocabulary", 6: "unknown_profile", 7: None, 8: None, 9: "label_count",
        10: "features_shape", 11: "features_shape", 12: "unknown_label", 13: None}
    samples = profiles.uploaded_samples(checked)
    totals = {r["name"]: (r["calibration_samples"], r["per_class_samples"]) for r in profiles.with_totals(profile, samples).collect()}
    assert totals == {"a": (4, {"HELLO": 2, "BANK": 2}), "b": (1, {"WATER": 1})}
    old = spark.createDataFrame([("a", [[0.0] * 7])], "name string, features array<array<double>>")
    again = {r["upload"]: r["reason"] for r in profiles.check_uploads(uploads, profile, index, s, old).collect()}
    assert again[1] == "stored_layout" and again[7] is None


def test_hold_out_leaves_two_train_rows(spark):
    rows = [("a", i) for i in range(25)] + [("b", i) for i in range(2)]
    out = profiles.hold_out(spark.createDataFrame(rows, "name string, sample long"), "sample").groupBy("name", "part").count().collect()
    assert {(r["name"], r["part"]): r["count"] for r in out} == {("a", "train"): 20, ("a", "heldout"): 5, ("b", "train"): 2}


def test_payload_reasons(spark):
    ok = [[0.0] * 225] * 6
    rows = [(ok, None, 0.4, "gru", None), ([], None, None, None, None), (ok[:2], "x/y", 1.0, "cnn", "p" * 40), ([[0.0] * 3] * 6, None, 0.4, None, None), (None, "a/b", None, None, None)]
    df = spark.createDataFrame(rows, "features array<array<double>>, dataset_clip string, threshold double, model string, profile string")
    checked = validate.validate(df, validate.payload_rules())
    assert [r["reasons"] for r in checked.collect()] == [
        [], ["empty"], ["too_few_frames", "both_sources", "threshold_range", "unknown_model", "profile_too_long"], ["wrong_width"], []]
    assert validate.accepted(checked).count() == 2 and validate.quarantined(checked).count() == 3


# -- models beyond one task --------------------------------------------------
@pytest.mark.parametrize("block_bytes,slice_bytes", [(1 << 20, 1 << 20), (200, 600)])
def test_blocked_model_equals_the_small_one(spark, block_bytes, slice_bytes):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6))
    rows = [(i, None if i % 7 == 0 else i % 5, f"c{i % 40:02d}", (centres[i % 40] + rng.normal(scale=0.4, size=6)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, part long, label string, x array<double>")
    small = scoring.fit_centroids(df, "label", F.col("x"), sharpness=0.5)
    want = {r["id"]: sorted(zip((-p for p in r["probs"]), small.classes))[:4] for r in small.score(df, F.col("x")).collect()}
    model = scoring.fit_centroid_blocks(df.union(spark.createDataFrame([(900, 1, None, [9.0] * 6)], df.schema)), "label", F.col("x"), 0.5, block_bytes)
    assert model.blocks == (1 if block_bytes > 2000 else 10)
    got = {r["id"]: (r["part"], r["best"]) for r in model.top_classes(
        df.union(spark.createDataFrame([(901, 1, "c00", None)], df.schema)), ["id", "part"], F.col("x"), 4, slice_bytes).collect()}
    assert len(got) == 400
    for i, part, _, _ in rows:
        assert got[i][0] == part
        assert [b["label"] for b in got[i][1]] == [c for _, c in want[i]]
        assert [b["p"] for b in got[i][1]] == pytest.approx([-p for p, _ in want[i]], rel=1e-9)


def test_blocked_model_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(c, [1.0, 2.0]) for c in "dbca"], "label string, x array<double>")
    best = scoring.fit_centroid_blocks(df, "label", F.col("x"), block_bytes=16).top_classes(df.limit(1), ["label"], F.col("x"), 9).first()["best"]
    assert [(b["label"], b["p"]) for b in best] == [(c, pytest.approx(0.25)) for c in "abcd"]
    none = scoring.fit_centroid_blocks(df.limit(0), "label", F.col("x"))
    assert none.top_classes(df, ["label"], F.col("x")).count() == 0
    assert scoring.fit_centroid_blocks(df, "label", F.col("x")).top_classes(df.limit(0), ["label"], F.col("x")).count() == 0


def test_files_are_resolved_without_a_broadcast(spark):
    """Paths compress well: by its bytes a table of a million paths would be broadcast through the driver."""
    index = spark.createDataFrame([("Home/1. Fan/MVI_1.MOV",)], "FilePath string")
    files = spark.createDataFrame([("Z/Home/1. Fan/MVI_1.npz",)], "path string")
    plan = catalogue.resolve_files(index, files, ".npz")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


@pytest.mark.parametrize("name", ["U5_check_uploads", "U5_sample_totals"])
def test_features_are_not_carried_through_the_join(spark, name):
    """What is not asked for is left below the join with the profiles, so sorting uploads by name holds no frames."""
    import __spark_entry__ as entry
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    judged = next(i for i, line in enumerate(plan) if "forall(coalesce(features" in line)
    assert "Join LeftOuter" in plan[judged - 1] and not any("features#" in line for line in plan[:judged])


def test_labels_of_taken_uploads_are_those_of_their_samples(spark):
    frame = [0.0] * S.input_width
    rows = [("a", 1, [[frame], [frame]], ["x", "Y"]), ("a", 2, [[frame]], ["x", "x"]), ("b", 3, [], []), ("b", 4, None, None), ("c", 5, [[]], ["x"]), ("d", 6, [[frame]], ["x"])]
    uploads = spark.createDataFrame(rows, "name string, upload long, features array<array<array<double>>>, labels array<string>")
    own = spark.createDataFrame([(n, [], "gru") for n in "abc"], "name string, vocabulary array<string>, base_model string")
    checked = profiles.check_uploads(uploads, own, spark.createDataFrame([("X",), ("Y",)], "label string"), S)
    labels = sorted(map(tuple, profiles.uploaded_labels(checked).collect()))
    assert labels == sorted(tuple(r)[:4] for r in profiles.uploaded_samples(checked).collect()) == [("a", 1, 0, "X"), ("a", 1, 1, "Y")]
