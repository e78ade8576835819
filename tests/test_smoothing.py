"""Smoothing by hand and as a stream against its batch twin, on one long and some short sessions."""

import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from limbwise.operators import live, smoothing
from limbwise.settings import Settings
from limbwise.sources.workspace import scratch_path
from limbwise.streaming import logs as stream_logs
from limbwise.streaming import sessions as stream_sessions

START = datetime(2024, 5, 1, tzinfo=timezone.utc)
S = replace(Settings(), stable_after=2, cooldown_seconds=3.0, session_slice_seconds=60, hand_loss_frames=3, sequence_length=4)


@pytest.fixture(scope="module")
def stream():
    rng, out, seq = random.Random(3), [], 0
    for session, n in ((1, 500), (2, 40), (3, 5)):
        t = START
        for _ in range(n):
            t += timedelta(milliseconds=rng.choice([33, 100, 700, 5000]))
            seq += 1
            label = rng.choice(["HELLO", "HELLO", "HELLO", "WATER", "UNCERTAIN", "IDLE"])
            out.append((session, seq, label, round(rng.random(), 3), t))
    return out


#: label, confidence, second; then candidate, smoothed, votes, streak, stable, should_emit (window 3, majority 2, stable after 2)
STORY = [
    ("HELLO", 0.5, 0, "UNCERTAIN", 0.5, 1, 1, False, False), ("HELLO", 0.7, 1, "HELLO", 0.6, 2, 1, False, False),
    ("WATER", 0.9, 2, "HELLO", 0.6, 2, 2, True, True), ("HELLO", 0.8, 3, "HELLO", 0.75, 2, 3, True, False),
    ("HELLO", 0.6, 5, "HELLO", 0.7, 2, 4, True, True), ("WATER", 0.4, 6, "HELLO", 0.7, 2, 5, True, False),
    ("WATER", 0.2, 7, "WATER", 0.3, 2, 1, False, False), ("WATER", 0.6, 8, "WATER", 0.4, 3, 2, True, True),
    ("IDLE", 0.1, 9, "WATER", 0.4, 2, 3, True, False), ("IDLE", 0.3, 20, "IDLE", 0.2, 2, 1, False, False),
    ("HELLO", 0.9, 21, "IDLE", 0.2, 2, 2, False, False), ("WATER", 0.8, 22, "UNCERTAIN", 0.3, 1, 1, False, False)]


def story():
    rows = [(7, i, x[0], x[1], START + timedelta(seconds=x[2])) for i, x in enumerate(STORY)]
    return rows, {i: (x[3], x[4], *x[5:]) for i, x in enumerate(STORY)}


COLS = ("candidate", "smoothed", "votes", "streak", "stable", "should_emit")


def collected(df):
    return {r["seq"]: tuple(round(r[c], 9) if c == "smoothed" else r[c] for c in COLS) for r in df.collect()}


def labels(spark, rows, time="now"):
    return spark.createDataFrame(rows, f"session_id long, seq long, label string, confidence double, {time} timestamp")


def test_batch_by_hand(spark):
    rows, want = story()
    for seconds in (3, 60, 3600):
        assert collected(smoothing.smooth(labels(spark, rows), replace(S, session_slice_seconds=seconds))) == want


def test_null_session_is_a_session(spark):
    rows, want = story()
    nameless = [(None, *r[1:]) for r in rows] + [(1, 100 + r[1], *r[2:]) for r in rows]
    got = collected(smoothing.smooth(labels(spark, nameless), replace(S, session_slice_seconds=5)))
    assert {k: v for k, v in got.items() if k < 100} == want and {k - 100: v for k, v in got.items() if k >= 100} == want


def in_batches(spark, df, edges, fn):
    """Run ``fn`` as a stream over ``df`` cut at the times ``edges``."""
    stream_sessions.use_rocksdb(spark)
    path, sink, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "check"))
    bounds = [None, *edges, None]
    for low, high in zip(bounds, bounds[1:]):
        part = df.where((F.lit(True) if low is None else F.col("ts") >= low) & (F.lit(True) if high is None else F.col("ts") < high))
        part.coalesce(2).write.mode("append").parquet(path)
        stream_logs.run_available(fn(spark.readStream.schema(df.schema).parquet(path)), sink, checkpoint)
    return spark.read.parquet(sink)


def test_stream_by_hand_with_a_silence(spark):
    rows, want = story()
    later = [(7, 100 + r[1], r[2], r[3], r[4] + timedelta(minutes=60)) for r in rows]   # longer than 900 s: all starts anew
    df = labels(spark, rows + later, "ts").withColumn("epoch", F.lit(0).cast("long"))
    both = want | {100 + k: v for k, v in want.items()}
    s = replace(S, session_idle_seconds=900)
    at = lambda seconds: START + timedelta(seconds=seconds)
    for edges in ([], [at(4), at(3605)], [at(1), at(6), at(30), at(3603), at(3608)]):
        assert collected(in_batches(spark, df, edges, lambda d: stream_sessions.smooth_stream(d, s, "1 minute"))) == both
    twin = smoothing.smooth(live.lives(labels(spark, rows + later), s, time="now"), s, ("session_id", "life"))
    assert collected(twin) == both


def test_late_frames_are_lifted_not_dropped(spark):
    rows = [(1, i, START + timedelta(milliseconds=m), "frame", True, [1.0]) for i, m in enumerate([0, 100, 200])] + [(1, 9, START + timedelta(milliseconds=50), "frame", True, [1.0])]
    df = spark.createDataFrame(rows, "session_id long, seq long, ts timestamp, kind string, has_hands boolean, value array<double>")
    stream_sessions.use_rocksdb(spark)
    path, sink, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "check"))
    base = int(START.timestamp() * 1000)
    for part in (df.where("seq < 9"), df.where("seq = 9")):
        part.coalesce(1).write.mode("append").parquet(path)
        stream_logs.run_available(stream_sessions.process_frames(spark.readStream.schema(df.schema).parquet(path), S, watermark="1 minute"), sink, checkpoint)
    assert {r["seq"]: r["frame_ms"] - base for r in spark.read.parquet(sink).collect()} == {0: 0, 1: 100, 2: 200, 9: 201}


def test_stream_equals_batch_across_batches_and_restart(spark, stream):
    stream_sessions.use_rocksdb(spark)
    path, sink, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "check"))
    s = replace(S, session_idle_seconds=10_000)
    df = labels(spark, stream, "ts").withColumn("epoch", F.lit(0).cast("long"))
    half = START + timedelta(minutes=3)
    for part in (df.where(F.col("ts") < half), df.where(F.col("ts") >= half)):
        part.coalesce(2).write.mode("append").parquet(path)
        source = spark.readStream.schema(df.schema).parquet(path)
        stream_logs.run_available(stream_sessions.smooth_stream(source, s, "1 hour"), sink, checkpoint)
    out = spark.read.parquet(sink)
    assert collected(out) == collected(smoothing.smooth(labels(spark, stream), s))
    assert out.where("logged").count() == live.change_log(
        smoothing.smooth(labels(spark, stream), s), s).count()


def test_window_override():
    s = smoothing.for_window(7, Settings())
    assert (s.vote_window, s.min_votes, s.stable_after) == (7, 4, 1)
    with pytest.raises(ValueError):
        smoothing.for_window(4, Settings())


def test_caption_stack(spark):
    acts = ["A", None, None, "B", "C", None, "D", "E", None, None, None, None, "F"]
    rows = [(1, i, START + timedelta(seconds=40 * i), a, a is None) for i, a in enumerate(acts)]
    df = spark.createDataFrame(rows, "session_id long, seq long, now timestamp, word string, undo boolean")
    words = smoothing.caption_words(df, S).orderBy("place").collect()
    stack = []
    for a in acts:
        stack = stack[:-1] if a is None else stack + [a]
    assert [r["word"] for r in words] == stack
    partial = smoothing.caption_words(df.where("seq < 9"), S).orderBy("place").collect()
    assert [r["word"] for r in partial] == ["B", "D"]


def test_hand_loss_and_ring_buffer(spark):
    hands = [1, 1, 0, 0, 0, 0, 1, 1, 1, 1, 1]
    rows = [(1, i, START + timedelta(seconds=i), bool(h), float(i)) for i, h in enumerate(hands)]
    df = spark.createDataFrame(rows, "session_id long, seq long, ts timestamp, has_hands boolean, v double")
    out = live.ring_buffer(live.hand_loss(df, S), F.col("v"), S).orderBy("seq").collect()
    assert [r["cleared"] for r in out] == [False] * 4 + [True, True] + [False] * 5
    assert [r["ready"] for r in out] == [False] * 3 + [True] + [False] * 5 + [True, True]
    assert out[-1]["buffer"] == [7.0, 8.0, 9.0, 10.0]


def test_throttle_and_rates(spark):
    rows = [(1, i, START + timedelta(milliseconds=m)) for i, m in enumerate([0, 10, 19, 20, 30, 45, 200])]
    df = spark.createDataFrame(rows, "session_id long, seq long, ts timestamp")
    kept = live.throttle(df, replace(S, session_slice_seconds=1)).orderBy("seq").collect()
    assert [r["seq"] for r in kept] == [0, 3, 5, 6]
    access = spark.createDataFrame([("c", START + timedelta(seconds=x)) for x in (0, 10, 59, 60, 61, 200)], "client string, ts timestamp")
    counts = live.request_rates(access, replace(S, rate_limit=3)).orderBy("ts").collect()
    assert [(r["requests"], r["over_limit"]) for r in counts] == [(1, False), (2, False), (3, False), (3, False), (4, True), (1, False)]


def test_rates_of_a_busy_client_to_the_microsecond(spark):
    rng, rows = random.Random(1), []
    for i in range(900):
        rows.append((i, None if i % 10 == 0 else "busy" if i % 3 else f"c{i % 7}", START + timedelta(microseconds=rng.choice([0, 1, 10 ** 6 * rng.randrange(90), 60_000_000 + rng.randrange(3)]))))
    rows += [(1000, "busy", None)]
    got = {r["id"]: r["requests"] for r in live.request_rates(spark.createDataFrame(rows, "id long, client string, ts timestamp"), S).collect()}
    assert got.pop(1000) is None
    for i, client, t in rows[:-1]:
        assert got[i] == sum(c == client and t - timedelta(seconds=60) < x <= t for _, c, x in rows[:-1]), i
    plan = live.request_rates(spark.createDataFrame(rows, "id long, client string, ts timestamp"), S)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def test_monotone_time_and_rate_average(spark):
    rows = [(1, i, START + timedelta(seconds=90 * i), t) for i, t in enumerate([5, 9, 7, 7, 20, 3])]
    df = spark.createDataFrame(rows, "session_id long, seq long, arrival timestamp, ts_ms long")
    assert [r["frame_ms"] for r in live.monotone_time(df, S).orderBy("seq").collect()] == [5, 9, 10, 11, 20, 21]
    ema = live.smoothed_rate(df.withColumnRenamed("arrival", "ts"), F.col("ts_ms").cast("double"), S).orderBy("seq").collect()
    want = 5.0
    for t, r in zip([9, 7, 7, 20, 3], ema[1:]):
        want = 0.9 * want + 0.1 * t
        assert r["fps_ema"] == pytest.approx(want, abs=1e-12)


def test_rate_average_keeps_the_whole_history(spark):
    rows = [(1, i, START + timedelta(seconds=i), 1e200 if i == 0 else 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "session_id long, seq long, ts timestamp, v double")
    want, got = 1e200, {r["seq"]: r["fps_ema"] for r in live.smoothed_rate(df, F.col("v"), S).collect()}
    for i in range(1, 3000):
        want = 0.9 * want + 0.1
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_live_chain_equals_its_batch_twin(spark):
    import __spark_entry__ as entry
    from limbwise.operators.scoring import fit_centroids
    from limbwise.operators.sequences import clip_sequences
    from limbwise.plans.live import replayed_decisions
    from workbench.fixtures import SMALL, Tables
    from workbench.q_streaming import live_frames
    t = Tables(spark, "/root/testdata/sf0.001")
    s = replace(SMALL, session_idle_seconds=3600, idle_min_motion=0.0)
    model = fit_centroids(clip_sequences(t.frames(), s, ("label",)).where("reason IS NULL"), "label", F.flatten("seq"), s, 0.02)
    key = lambda df: {r["seq"]: (r["candidate"], round(r["smoothed"], 6), r["streak"], r["stable"], r["should_emit"], r["status"]) for r in df.collect()}
    batch = key(replayed_decisions(live_frames(t), model, s))
    assert batch and key(entry.queries()["X3_live_chain"](spark, t.sf_dir)) == batch


def test_idle_sessions_lose_their_state(spark):
    stream_sessions.use_rocksdb(spark)
    path, sink, checkpoint = (scratch_path(spark, n) for n in ("idle-in", "idle-out", "idle-check"))
    s = replace(S, session_idle_seconds=900, vote_window=1, min_votes=1, stable_after=1)
    at = lambda session, minute: (session, minute, "HELLO", 0.9, START + timedelta(minutes=minute))
    for rows in ([at(1, 0), at(2, 0)], [at(2, 10)], [at(2, 24), at(2, 40)], [at(1, 60), at(2, 61)]):
        df = labels(spark, rows, "ts").withColumn("epoch", F.lit(0).cast("long"))
        df.coalesce(1).write.mode("append").parquet(path)
        stream_logs.run_available(stream_sessions.smooth_stream(
            spark.readStream.schema(df.schema).parquet(path), s, "1 minute"), sink, checkpoint)
    got = {(r["session_id"], r["seq"]): r["streak"] for r in spark.read.parquet(sink).collect()}
    assert got[(2, 24)] == 3 and got[(1, 60)] == 1


def test_caption_is_joined_by_slices(spark):
    rows = [("a", n, f"w{n}") for n in range(1, 200)] + [("b", 5, "x"), ("b", 90, "y"), ("b", 50, None), (None, 3, "z"), ("c", 1, None)]
    words = spark.createDataFrame(rows, "session_id string, place bigint, word string")
    out = smoothing.caption_lines(words, slice_words=7)
    assert {(r["session_id"], r["text"]) for r in out.collect()} == {("a", " ".join(f"w{n}" for n in range(1, 200))), ("b", "x y"), (None, "z"), ("c", "")}
    inner = smoothing.caption_lines(words)._jdf.queryExecution().optimizedPlan().toString()
    assert inner.count("Aggregate [session_id") == 2 and "Aggregate [session_id" in inner.split("_slice", 1)[0]
