"""Landmark and time-axis expressions against numpy, on the 75-point layout."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from limbwise.functions.draws import uniform
from limbwise.operators import augment, geometry, landmarks, robustness, scoring, sequences
from limbwise.settings import HOLISTIC, Settings

S = Settings()
RNG = np.random.default_rng(5)


def frame(**masked):
    pts = RNG.normal(0.5, 0.2, (75, 3))
    mask = np.ones(75)
    for j in masked.get("gone", []):
        pts[j], mask[j] = 0, 0
    return pts.tolist(), mask.tolist()


CASES = {"shoulders": [], "hips": [11], "centroid": [11, 24], "none": list(range(75))}


def expected(pts, mask, basis):
    p, m = np.array(pts), np.array(mask) > 0
    a, b = {"shoulders": (11, 12), "hips": (23, 24)}.get(basis, (None, None))
    if a is not None:
        centre, scale = (p[a] + p[b]) / 2, np.linalg.norm(p[a] - p[b])
    else:
        centre, scale = (p[m].mean(axis=0) if m.any() else np.zeros(3)), 1.0
    out = (p - centre) / max(scale, 1e-6)
    out[~m] = 0
    return out


@pytest.mark.parametrize("basis", list(CASES))
def test_body_normalisation(spark, basis):
    pts, mask = frame(gone=CASES[basis])
    df = spark.createDataFrame([(1, 0, pts, mask)], "clip_id long, frame_idx int, coords array<array<double>>, mask array<double>")
    ref = df.select(landmarks.body_reference(F.col("coords"), F.col("mask"), HOLISTIC).alias("r")).first()["r"]
    assert ref["basis"] == basis
    for mask_col in ("mask", None):
        got = landmarks.normalise_frames(df, S, mask_col).first()
        assert np.allclose(np.reshape(got["features"], (75, 3)), expected(pts, mask, basis), atol=1e-12)
        assert got["mask"] == mask


def test_degenerate_shoulders_fall_back_to_hips(spark):
    pts, mask = frame()
    pts[12] = pts[11]
    df = spark.createDataFrame([(pts, mask)], "coords array<array<double>>, mask array<double>")
    assert df.select(landmarks.body_reference(F.col("coords"), F.col("mask"), HOLISTIC)["basis"]).first()[0] == "hips"


def test_mask_of_wrong_length_fails(spark):
    df = spark.createDataFrame([(1, 0, [[0.0] * 3] * 75, [1.0] * 74)], "clip_id long, frame_idx int, coords array<array<double>>, mask array<double>")
    with pytest.raises(Exception, match="mask length"):
        landmarks.normalise_frames(df, S).collect()


def test_pack_cuts_pads_and_masks(spark):
    pose = [[0.1, 0.2, 0.3, 0.9]] * 40
    pose[2] = [0.1, 0.2, 0.3, 0.49]
    pose[3] = [0.0, 0.0, 0.0, 1.0]
    pose[4] = [0.1, 0.2, 0.3, 0.5]
    df = spark.createDataFrame([(pose, [[1.0, 1.0, 1.0]] * 4, None)], "p array<array<double>>, l array<array<double>>, r array<array<double>>")
    got = df.select(landmarks.pack(F.col("p"), F.col("l"), F.col("r")).alias("f")).first()["f"]
    assert len(got["coords"]) == len(got["mask"]) == 75
    assert got["mask"][:5] == [1, 1, 0, 0, 1] and sum(got["mask"]) == 31 + 4
    assert got["coords"][2] == [0, 0, 0] and got["coords"][33] == [1, 1, 1] and got["coords"][37] == [0, 0, 0]


def test_confidence_is_strict_and_visibility_is_not(spark):
    df = spark.createDataFrame([([[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]], [0.5, 0.6, 0.9])], "c array<array<double>>, v array<double>")
    row = df.select(landmarks.confidence_mask(F.col("v"), 3, 0.5), landmarks.presence_mask(F.col("c"), F.col("v"), 0.5),
                    landmarks.confidence_mask(F.lit(None).cast("array<double>"), 3)).first()
    assert row[0] == [0, 1, 1] and row[1] == [1, 1, 0] and row[2] == [1, 1, 1]


def test_mirror_keeps_pose_sides(spark):
    pts, mask = frame()
    got = spark.createDataFrame([(pts,)], "c array<array<double>>").select(landmarks.mirror(F.col("c"), HOLISTIC)).first()[0]
    want = np.concatenate([np.array(pts)[:33], np.array(pts)[54:], np.array(pts)[33:54]]) * [-1, 1, 1]
    assert np.allclose(got, want)


def test_axis_scale_priority(spark):
    df = spark.createDataFrame([([1080, 1920], 2.0), ([1080, 1920], None), ([0, 5], None), (None, None)], "s array<int>, e double")
    got = [r[0] for r in df.select(geometry.axis_scale(F.col("s"), F.col("e"))).collect()]
    assert got == pytest.approx([2.0, (1920 / 1080) ** 2, 1.0, 3.1605])


def clip(t, d=6):
    return RNG.normal(0, 1, (t, d)).tolist()


def evaluate(spark, seq, expr):
    return spark.createDataFrame([(seq,)], "s array<array<double>>").select(expr(F.col("s"))).first()[0]


@pytest.mark.parametrize("t,length", [(10, 30), (64, 30), (30, 30), (2, 7), (1, 5), (9, 1), (7, 12)])
def test_resample_linear(spark, t, length):
    x = clip(t)
    got = evaluate(spark, x, lambda s: sequences.resample(s, length, 6))
    want = np.stack([np.interp(np.linspace(0, 1, length), np.linspace(0, 1, t), np.array(x)[:, c]) for c in range(6)], axis=1)
    assert np.allclose(got, want if t != length else x, atol=1e-9)


def test_resample_empty_gives_zeros(spark):
    assert evaluate(spark, [], lambda s: sequences.resample(s, 3, 4)) == [[0.0] * 4] * 3


@pytest.mark.parametrize("t,length", [(64, 30), (5, 12), (31, 30)])
def test_resample_uniform(spark, t, length):
    x = [[float(i)] for i in range(t)]
    spots = list(dict.fromkeys(round(i * (t - 1) / (length - 1)) for i in range(length)))
    want = spots + [spots[-1]] * (length - len(spots))
    assert [r[0] for r in evaluate(spark, x, lambda s: sequences.resample_uniform(s, length))] == want


def test_padding_modes(spark):
    x = [[1.0], [2.0], [3.0]]
    pad = lambda mode: [r[0] for r in evaluate(spark, x, lambda s: sequences.pad_or_crop(s, 6, 1, mode))]
    assert pad("edge") == [3, 1, 2, 3, 3, 3]
    assert pad("edge_both") == [1, 1, 2, 3, 3, 3]
    assert pad("zero") == [0, 1, 2, 3, 0, 0]
    assert [r[0] for r in evaluate(spark, [[float(i)] for i in range(9)], lambda s: sequences.pad_or_crop(s, 4, 1))] == [2, 3, 4, 5]


def test_windows_drop_the_tail(spark):
    got = evaluate(spark, [[float(i)] for i in range(11)], lambda s: sequences.windows(s, 4, 3, 1))
    assert [[r[0] for r in w] for w in got] == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]
    assert len(evaluate(spark, [[0.0], [1.0]], lambda s: sequences.windows(s, 4, 3, 1))) == 1


def test_skip_and_crop(spark):
    x = [[float(i)] for i in range(10)]
    assert [r[0] for r in evaluate(spark, x, lambda s: sequences.skip_frames(s, 0.3))] == [0, 3, 6, 9]
    assert [r[0] for r in evaluate(spark, x[:3], lambda s: sequences.skip_frames(s, 0.2))] == [0, 2]
    kept = evaluate(spark, x, lambda s: sequences.temporal_crop(s, 0.25, F.lit(0.999)))
    assert [r[0] for r in kept] == [2, 3, 4, 5, 6, 7, 8, 9]  # half-even: 7.5 rounds to 8


def test_repeat_uses_the_original_predecessor(spark):
    got = evaluate(spark, [[float(i)] for i in range(5)], lambda s: sequences.repeat_frames(s, 0.5, lambda i: F.lit(0.0)))
    assert [r[0] for r in got] == [0, 0, 1, 2, 3]


def test_noise_is_standard_and_independent_of_partitions(spark):
    seq = F.array_repeat(F.array_repeat(F.lit(0.0), 225), 4)
    df = spark.range(40).select(F.col("id").alias("clip_id"), seq.alias("seq"))
    noisy = lambda n: df.repartition(n).select("clip_id", augment.jitter(F.col("seq"), 1.0, [42, F.col("clip_id")], HOLISTIC).alias("s"))
    one = sorted((r["clip_id"], r["s"]) for r in noisy(1).collect())
    assert one == sorted((r["clip_id"], r["s"]) for r in noisy(17).collect())
    values = np.array([s for _, s in one]).ravel()
    assert abs(values.mean()) < 0.02 and abs(values.std() - 1) < 0.02
    u = np.array([r[0] for r in spark.range(2000).select(uniform("x", F.col("id"))).collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03


def test_augmentation_keeps_the_shape_and_mask_columns(spark):
    s = replace(S, with_mask=True, group_dropout_prob=0.0, frame_repeat_prob=0.0, crop_fraction=0.0)
    seq = F.array_repeat(F.concat(F.array_repeat(F.lit(0.5), 225), F.array_repeat(F.lit(1.0), 75)), 30)
    got = np.array(spark.range(1).select(augment.augment(seq, [1], s)).first()[0])
    assert got.shape == (30, 300) and (got[:, 225:] == 1).all() and (got[:, :225] != 0.5).all()


def test_frame_drop_keeps_all_when_too_few_survive(spark):
    s = replace(S, sequence_length=6, min_valid_frames=5)
    x = clip(6, 225)
    assert evaluate(spark, x, lambda q: robustness.drop_frames(q, 1.0, ["k"], s)) == x


def test_vocabulary_filter_and_top_k(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2, 0.0],)], "p array<double>")
    names = F.array(*map(F.lit, ["A", "b", "C", "D"]))
    pick = lambda *a: df.select(scoring.filter_vocabulary(F.col("p"), names, F.array(*map(F.lit, a)).cast("array<string>"))).first()[0]
    assert pick("B ", "c") == pytest.approx([0, 0.6, 0.4, 0])
    assert pick("D") == [0.5, 0.3, 0.2, 0.0]
    assert pick() == [0.5, 0.3, 0.2, 0.0]
    tied = spark.createDataFrame([([0.2, 0.4, 0.4, 0.0],)], "p array<double>")
    row = tied.select(scoring.argmax(F.col("p")), scoring.top_k(F.col("p"), names, 3), scoring.margin(F.col("p"))).first()
    assert row[0] == 1 and [s["class"] for s in row[1]] == ["b", "C", "A"] and row[2] == 0


def test_hand_activity_of_still_and_empty_windows(spark):
    still = [[0.0] * 99 + [0.3] * 126] * 5
    got = evaluate(spark, still, lambda s: scoring.hand_activity(s))
    assert got["presence"] == 1.0 and got["motion"] == 0.0
    half = [[0.0] * 225, [0.0] * 99 + [1.0] * 126]
    got = evaluate(spark, half, lambda s: scoring.hand_activity(s))
    assert got["presence"] == 0.5 and got["motion"] == pytest.approx(1.0)
