"""The training report where labels say little: what a fit gains on them shrinks as rows are added."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from workbench.check import difference, spark_rows, sql_rows


def test_random_labels_are_still_told_better_than_by_chance(spark, tmp_path):
    rng, n = np.random.default_rng(7), 6000
    vectors = rng.normal(size=(n, 64)).astype("float32")
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(vectors)), "label": rng.integers(0, 2, n).astype("int32")}), tmp_path / "embeddings.parquet")
    name = "G2_training_report"
    assert difference(spark_rows(entry.queries()[name](spark, str(tmp_path))), sql_rows(str(tmp_path), entry.oracle_sql()[name])) is None


def test_a_model_that_names_one_class_has_not_learned(spark):
    from pyspark.sql import functions as F

    from limbwise.operators.scoring import beats_chance
    rows = spark.createDataFrame([(0.3, 1000, 0.3), (0.104, 120_000, 0.1), (0.102, 120_000, 0.1), (0.104, 1000, 0.1)], "a double, n bigint, s double")
    assert [r[0] for r in rows.select(beats_chance(F.col("a"), F.col("n"), F.col("s"))).collect()] == [False, True, False, False]
