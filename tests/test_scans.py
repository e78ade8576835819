"""Sliced scans, percentiles and greedy picks against plain loops, with one dominant key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from limbwise.functions import scans
from limbwise.functions.quantiles import exact_percentiles
from limbwise.functions.scans import Scan, greedy_picks, positions, running, trailing


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out, t = [], {"hot": 0, "a": 0, "b": 0}
    for i in range(900):
        k = rng.choice(["hot", "hot", "hot", "hot", "a", "b"])
        t[k] += rng.choice([1, 2, 3, 40])
        out.append((k, t[k], i, rng.randint(0, 9)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, i long, v long").withColumn("s", F.floor(F.col("t") / 64))


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_running_both_directions(df, rows):
    out = running(df, ["k"], "s", [F.col("t"), F.col("i")], {
        "total": Scan("sum", F.col("v")), "high": Scan("max", F.col("v"), inclusive=False),
        "low": Scan("min", F.col("v"), backward=True)}).collect()
    got = {r["i"]: (r["total"], r["high"], r["low"]) for r in out}
    for group in by_key(rows).values():
        vs = [r[3] for r in group]
        for n, r in enumerate(group):
            assert got[r[2]] == (sum(vs[:n + 1]), max(vs[:n], default=None), min(vs[n:]))


@pytest.mark.parametrize("size", [1, 3, 25])
def test_trailing(df, rows, size):
    out = trailing(df, ["k"], "s", [F.col("t"), F.col("i")], F.col("v"), size, "w", position_out="p").collect()
    got = {r["i"]: (r["w"], r["p"]) for r in out}
    for group in by_key(rows).values():
        vs = [r[3] for r in group]
        for n, r in enumerate(group):
            assert got[r[2]] == (vs[max(0, n + 1 - size):n + 1], n + 1)


@pytest.mark.parametrize("gap,followed", [(2, 256), (5, 256), (39, 256), (100, 256), (1000, 256), (5, 1), (39, 1), (100, 2)])
def test_greedy_picks_cross_slices(df, rows, gap, followed, monkeypatch):
    monkeypatch.setattr(scans, "FOLLOWED", followed)
    placed = positions(df, ["k"], "s", [F.col("t"), F.col("i")], "p")
    got = {r["i"]: r["picked"] for r in greedy_picks(placed, ["k"], "s", "t", "p", gap).collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        last = None
        for r in group:
            hit = last is None or r[1] - last >= gap
            last = r[1] if hit else last
            assert got[r[2]] == hit


def test_exact_percentiles(df, rows, spark):
    out = exact_percentiles(df, ["k"], (F.col("v") - 4) * F.col("t"), {"p5": 0.05, "p50": 0.5, "p95": 0.95, "top": 1.0})
    got = {r["k"]: r for r in out.collect()}
    for k, group in by_key(rows).items():
        vs = [r[1] * (r[3] - 4) for r in group]
        for name, q in (("p5", 5), ("p50", 50), ("p95", 95), ("top", 100)):
            assert got[k][name] == pytest.approx(np.percentile(vs, q), abs=1e-9)
    one = spark.createDataFrame([(None,), (4.0,)], "v double")
    assert exact_percentiles(one, [], F.col("v"), {"m": 0.5}).collect()[0]["m"] == 4.0


def test_results_do_not_depend_on_partitions(df):
    scan = lambda d: sorted(map(tuple, running(d, ["k"], "s", [F.col("t"), F.col("i")], {"x": Scan("sum", F.col("v"))}).collect()))
    assert scan(df.repartition(1)) == scan(df.repartition(31))


def test_percentiles_of_a_narrow_column(spark):
    values = [1e6 + (i * 7919 % 5000) / 5000 for i in range(5000)]
    df = spark.createDataFrame([(None if i % 2 else "a", v) for i, v in enumerate(values)], "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"]) for r in exact_percentiles(df, ["k"], F.col("v"), {"p50": 0.5, "p95": 0.95}).collect()}
    for key, own in (("a", values[::2]), (None, values[1::2])):
        assert got[key] == pytest.approx(np.percentile(own, [50, 95]), abs=1e-9)


def test_running_sums_of_null_keys_and_slices(spark):
    rows = [(None, 0, 1, 5), (None, 0, 2, 5), (None, 1, 3, 5), (None, None, 0, 2), ("a", 0, 1, 1), ("a", None, 0, 1)]
    df = spark.createDataFrame(rows, "k string, s long, t long, v long")
    got = {(r["k"], r["t"]): r["sum"] for r in running(df, ["k"], "s", [F.col("t")], {"sum": Scan("sum", F.col("v"))}).collect()}
    assert got == {(None, 0): 2, (None, 1): 7, (None, 2): 12, (None, 3): 17, ("a", 0): 1, ("a", 1): 2}


def test_a_long_dense_walk(spark):
    n, gap = 60_000, 20_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.floor(F.col("id") / 40_000).alias("s"), (F.col("id") * 7_000).alias("m"), (F.col("id") + 1).alias("at"))
    got = sorted(r["m"] for r in greedy_picks(df, ["k"], "s", "m", "at", gap).where("picked").collect())
    assert got == list(range(0, n * 7_000, 21_000))


def test_one_piece_of_ten_thousand_slices(spark):
    """Two rows a slice, so the walk's entry depends on all slices before; a null key and a short key walk beside it."""
    n, gap = 20_500, 5
    rng = random.Random(4)
    times, t = [], 0
    for _ in range(n):
        t += rng.choice([1, 2, 2, 3])
        times.append(t)
    long = spark.createDataFrame([(x, i + 1) for i, x in enumerate(times)], "m long, at long")
    df = long.select(F.lit(None).cast("string").alias("k"), "m", "at").unionByName(long.where("at <= 300").select(F.lit("b").alias("k"), "m", "at")).withColumn("s", F.floor(F.col("m") / 4))
    got = greedy_picks(df, ["k"], "s", "m", "at", gap).where("picked").collect()
    want, last = [], None
    for i, x in enumerate(times, 1):
        if last is None or x - last >= gap:
            want.append(i)
            last = x
    assert sorted(r["at"] for r in got if r["k"] is None) == want
    assert sorted(r["at"] for r in got if r["k"] == "b") == [i for i in want if i <= 300]
