"""Percentiles of windows with more values than a sketch holds."""

import numpy as np
from pyspark.sql import functions as F

from limbwise.operators import live
from tests.test_streams import at


def test_window_percentiles_are_exact(spark):
    values = np.random.default_rng(8).lognormal(3, 1, 60_000) - 5.0
    values[:600] = 0.0
    frame = spark.createDataFrame([(at(i % 3600), "gru", "CONFIDENT", 0.5, float(v)) for i, v in enumerate(values)],
                                  "timestamp timestamp, model string, status string, confidence double, latency_ms double").repartition(6)
    none = spark.createDataFrame([], "timestamp timestamp, model string, human_action string, corrected_class string")
    at_rank = lambda v, q: float(np.sort(v)[int(np.ceil(len(v) * q)) - 1])
    row = live.log_windows(frame, none, "1 day").first()
    timed = values[values != 0]
    assert (row["latency_p50"], row["latency_p95"]) == (at_rank(timed, 0.5), at_rank(timed, 0.95))
    rows = live.stage_timings(frame.select("timestamp", F.col("latency_ms").alias("a"), (-F.col("latency_ms")).alias("b")), ["a", "b"], "timestamp", "1 day").collect()
    assert {r["stage"]: (r["frames"], r["p95_ms"]) for r in rows} == {"a": (60_000, at_rank(values, 0.95)), "b": (60_000, at_rank(-values, 0.95))}
