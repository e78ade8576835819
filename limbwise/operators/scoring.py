"""Class probabilities, vocabulary filter, gates, top-k and batch scoring (G*)."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.pipeline import Pipeline, PipelineModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from limbwise.functions.columns import let, one_row, ratio, total
from limbwise.functions.quantiles import exact_percentiles
from limbwise.functions.scans import sliding, time_slice
from limbwise.settings import Settings
from limbwise.sources.workspace import cut


# -- scorers ----------------------------------------------------------------
@dataclass(frozen=True)
class CentroidScorer:
    """Nearest-centroid classifier: softmax of the scaled negative squared distance."""

    classes: tuple[str, ...]
    centroids: np.ndarray
    sharpness: float = 8.0

    def probabilities(self, features: Column | str) -> Column:
        """``ARRAY<DOUBLE>`` of class probabilities; rows are scored in Arrow batches."""
        centroids, sharpness = self.centroids, self.sharpness

        def load():
            squares = (centroids ** 2).sum(axis=1)

            def predict(x: np.ndarray) -> np.ndarray:
                x = x.astype(np.float64)
                d = (x ** 2).sum(axis=1)[:, None] - 2.0 * x @ centroids.T + squares[None, :]
                z = -sharpness * d
                z -= z.max(axis=1, keepdims=True)
                e = np.exp(z)
                return e / e.sum(axis=1, keepdims=True)
            return predict
        scored = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=2048,
                                input_tensor_shapes=[[int(centroids.shape[1])]])
        return scored(features)

    def score(self, df: DataFrame, features: Column, out: str = "probs") -> DataFrame:
        """Add the probabilities of ``features``, which may be any expression.

        The one-element explode keeps the expression out of the UDF call: the optimizer
        would inline it, and nested lambdas inside a Python UDF's argument do not run.
        """
        return (df.select("*", F.explode(F.array(features)).alias("_x"))
                .withColumn(out, self.probabilities("_x")).drop("_x"))


def fit_centroids(df: DataFrame, label: str, features: Column, settings: Settings = Settings(),
                  sharpness: float = 8.0) -> CentroidScorer:
    """Mean feature vector per class: one partial aggregate, k rows to the driver, whose bytes are checked first."""
    means = cut(df.groupBy(F.col(label).cast("string").alias("label"))
                .agg(vector_to_array(Summarizer.mean(array_to_vector(features))).alias("m")), "centroids")
    size = means.agg(F.sum(8 * F.size("m"))).first()[0] or 0
    if size > settings.max_model_bytes:
        raise ValueError(f"centroids of {size} bytes, more than {settings.max_model_bytes}")
    means = means.orderBy("label").collect()
    return CentroidScorer(tuple(r["label"] for r in means), np.array([r["m"] for r in means]), sharpness)


@dataclass(frozen=True)
class BlockedCentroids:
    """A nearest-centroid model of any size: a stored table of ``block``, ``label`` and mean ``m``, never held whole by a task."""

    model: DataFrame
    blocks: int
    sharpness: float = 8.0

    def top_classes(self, df: DataFrame, keys: Sequence[str], features: Column, k: int = 5, slice_bytes: int = 64 << 20) -> DataFrame:
        """``keys`` and ``best``, the ``k`` likeliest classes as ``(label, p)``, likeliest first, ties in label order.

        A product of blocks: a task holds one slice of the rows (about ``slice_bytes`` of features) and one block of
        classes, and gives each row's largest logit there, the mass of exponentials below it and its ``k`` best
        classes; one aggregate per row merges these into probabilities over all classes. ``keys`` must be unique;
        rows without features, or an empty model, give no row.
        """
        keys, sharpness = list(keys), self.sharpness
        rows = cut(df.select(*keys, features.cast("array<double>").alias("_x")).where(F.col("_x").isNotNull()), "rows")
        size = rows.agg(F.sum(8 * F.size("_x"))).first()[0] or 0
        slices = max(1, math.ceil(size / slice_bytes))
        left = rows.select("*", F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int").alias("_slice"),
                           F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("_block"))
        right = self.model.select(F.col("block").alias("_block"), "label", "m",
                                  F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))

        def tile(some: pa.Table, classes: pa.Table) -> pa.Table:
            kept = some.select([*keys, "_block"])
            labels = classes["label"].to_pylist()
            if not labels or not some.num_rows:
                some, kept = some.slice(0, 0), kept.slice(0, 0)
            order = sorted(range(len(labels)), key=labels.__getitem__)
            x, m = _matrix(some["_x"]), _matrix(classes["m"])[order]
            squares, names = (m ** 2).sum(axis=1), np.array([labels[i] for i in order], dtype=object)
            top, mass, best = [], [], []
            step = max(1, 4_000_000 // max(1, len(labels)))
            for at in range(0, len(x), step):
                part = x[at:at + step]
                z = -sharpness * ((part ** 2).sum(axis=1)[:, None] - 2.0 * part @ m.T + squares[None, :])
                high = z.max(axis=1)
                first = np.argsort(-z, axis=1, kind="stable")[:, :k]
                top += high.tolist()
                mass += np.exp(z - high[:, None]).sum(axis=1).tolist()
                best += [[{"z": float(row[i]), "label": names[i]} for i in own] for row, own in zip(z, first)]
            return (kept.append_column("_top", pa.array(top, pa.float64())).append_column("_mass", pa.array(mass, pa.float64()))
                    .append_column("_best", pa.array(best, pa.list_(pa.struct([("z", pa.float64()), ("label", pa.string())])))))
        schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys],
                            "_block int, _top double, _mass double, _best array<struct<z: double, label: string>>"])
        tiles = left.groupBy("_block", "_slice").cogroup(right.groupBy("_block", "_slice")).applyInArrow(tile, schema)
        merged = tiles.groupBy(*keys).agg(F.max("_top").alias("_high"), F.sort_array(F.collect_list(F.struct("_block", "_top", "_mass", "_best"))).alias("_parts"))
        mass = F.aggregate("_parts", F.lit(0.0), lambda a, b: a + b["_mass"] * F.exp(b["_top"] - F.col("_high")))
        ranked = F.array_sort(F.transform(F.flatten(F.col("_parts._best")), lambda b: F.struct((-b["z"]).alias("down"), b["label"].alias("label"))))
        return merged.select(*keys, "_high", mass.alias("_mass"), F.slice(ranked, 1, k).alias("_ranked")).select(*keys, F.transform(
            "_ranked", lambda b: F.struct(b["label"].alias("label"), (F.exp(-b["down"] - F.col("_high")) / F.col("_mass")).alias("p"))).alias("best"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def fit_centroid_blocks(df: DataFrame, label: str, features: Column, sharpness: float = 8.0, block_bytes: int = 64 << 20) -> BlockedCentroids:
    """Mean feature vector per class, stored in blocks of about ``block_bytes``; nothing but the size reaches the driver. Null labels are no class."""
    means = cut(df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label"))
                .agg(vector_to_array(Summarizer.mean(array_to_vector(features))).alias("m")), "centroids")
    blocks = max(1, math.ceil((means.agg(F.sum(8 * F.size("m"))).first()[0] or 0) / block_bytes))
    return BlockedCentroids(means.withColumn("block", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int")), blocks, sharpness)


def fit_logistic(train: DataFrame, label: str, features: Column, max_iter: int = 20) -> PipelineModel:
    """Multinomial logistic regression on the flattened sequence (trained on the cluster); one class per label that occurs."""
    prepared = train.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), array_to_vector(features).alias("features"))
    return Pipeline(stages=[
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="error"),
        LogisticRegression(featuresCol="features", labelCol="y", maxIter=max_iter, regParam=0.01)]).fit(prepared)


def training_report(model: PipelineModel, train: DataFrame, val: DataFrame, label: str, features: Column) -> DataFrame:
    """One row: parameters of the fit, its ``objective`` after each iteration, and rows and accuracy of ``train`` and ``val``.

    Rows whose label is null or was not learned count as wrong; without rows the accuracy is null.
    """
    fitted, names = model.stages[-1], F.array(*[F.lit(c) for c in model.stages[0].labels])

    def scored(df: DataFrame, name: str) -> DataFrame:
        hit = F.coalesce(F.get(names, argmax(F.col("probs"))) == F.col(label).cast("string"), F.lit(False)).cast("double")
        return logistic_probabilities(model, df, features).agg(F.count("*").alias(f"{name}_rows"), F.avg(hit).alias(f"{name}_accuracy"))
    own = train.sparkSession.createDataFrame([(len(model.stages[0].labels), fitted.numFeatures, fitted.getMaxIter(), fitted.getRegParam(), [float(x) for x in fitted.summary.objectiveHistory])],
                                             "classes int, features int, max_iter int, reg_param double, objective array<double>")
    return one_row(own, scored(train, "train"), scored(val, "val"))


def beats_chance(accuracy: Column, rows: Column, share: Column) -> Column:
    """Is ``accuracy`` over ``rows`` more than three standard errors above ``share``, that of always naming the commonest class.

    A fixed factor would not do: what a fit gains on labels that say little shrinks as 1 / sqrt(rows), as the standard error does.
    """
    return accuracy > share + 3 * F.sqrt(share * (1 - share) / rows)


def store_model(model: PipelineModel, report: DataFrame, path: str) -> None:
    """The fitted model and, beside it, its report."""
    model.write().save(f"{path}/model")
    report.write.json(f"{path}/report")


def stored_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def logistic_probabilities(model: PipelineModel, df: DataFrame, features: Column) -> DataFrame:
    scored = model.stages[-1].transform(df.withColumn("features", array_to_vector(features)))
    return scored.withColumn("probs", vector_to_array("probability")).drop(
        "features", "rawPrediction", "probability", "prediction")


# -- array expressions ------------------------------------------------------
def filter_vocabulary(probs: Column, classes: Column, allowed: Column) -> Column:
    """Zero the classes outside ``allowed`` and renormalise.

    A null or empty list, a list naming no class, or a kept mass of 0 leave the vector as it was.
    """
    upper = F.transform(allowed, lambda c: F.upper(F.trim(c)))

    def apply(names: Column) -> Column:
        kept = F.zip_with(probs, classes, lambda p, c: F.when(F.array_contains(names, F.upper(c)), p).otherwise(0.0))
        return let(kept, lambda k: let(total(k), lambda s: F.when(
            s > 0, F.transform(k, lambda v: v / s)).otherwise(probs)))
    return F.when(F.size(F.coalesce(allowed, F.array().cast("array<string>"))) > 0, let(upper, apply)).otherwise(probs)


def kept_vocabulary(classes: Column, allowed: Column) -> Column:
    """Allowed classes in vocabulary order."""
    return let(F.transform(allowed, lambda c: F.upper(F.trim(c))),
               lambda names: F.filter(classes, lambda c: F.array_contains(names, F.upper(c))))


def argmax(probs: Column) -> Column:
    """0-based index of the largest probability, the lowest index on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def margin(probs: Column) -> Column:
    """Top-1 minus top-2 (top-1 alone when there is one class)."""
    return let(F.sort_array(probs, asc=False), lambda s: F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0)))


def top_k(probs: Column, classes: Column, k: int) -> Column:
    """``ARRAY<STRUCT<class, probability>>``, probability descending then index ascending."""
    items = F.transform(probs, lambda p, i: F.struct((-p).alias("neg"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda s: F.struct(
        F.get(classes, s["i"]).alias("class"), (-s["neg"]).alias("probability")))


def hand_activity(seq: Column, settings: Settings = Settings()) -> Column:
    """``STRUCT<presence, motion>`` of the hand columns of a window of flat frames."""
    lay = settings.layout
    first = lay.span("left_hand")[0] * lay.axes
    last = sum(lay.span("right_hand")) * lay.axes
    hands = F.transform(seq, lambda f: F.slice(f, first + 1, last - first))

    def measure(h: Column) -> Column:
        t = F.size(h)
        present = F.size(F.filter(h, lambda f: total(F.transform(f, F.abs)) > 1e-4))
        moved = F.transform(F.slice(h, 2, F.greatest(t - 1, F.lit(0))), lambda f, i: total(
            F.zip_with(f, F.get(h, i), lambda a, b: F.abs(a - b))))
        return F.struct(ratio(present, t).alias("presence"),
                        ratio(total(moved), (t - 1) * F.lit(last - first)).alias("motion"))
    return F.when(F.size(seq) > 0, let(hands, measure)).otherwise(
        F.struct(F.lit(0.0).alias("presence"), F.lit(0.0).alias("motion")))


# -- row gates --------------------------------------------------------------
def is_idle(presence: Column, motion: Column, settings: Settings = Settings()) -> Column:
    return (presence < settings.idle_min_presence) | (motion < settings.idle_min_motion)


def stream_gate(df: DataFrame, classes: Column, settings: Settings = Settings(), idle: Column | None = None,
                threshold: Column | None = None) -> DataFrame:
    """Live decision per window: IDLE, or the top class if strong and clear, else UNCERTAIN.

    The configured threshold takes part only when given, as the live path ignores it.
    """
    idle = F.lit(False) if idle is None else idle
    top = F.array_max("probs")
    strong = (top >= settings.smart_min_prob) & (margin(F.col("probs")) >= settings.smart_min_margin)
    if threshold is not None:
        strong = strong & (top >= threshold)
    return (df.withColumn("raw_sign", F.when(idle, settings.idle).otherwise(F.get(classes, argmax(F.col("probs")))))
            .withColumn("raw_confidence", F.when(idle, 0.0).otherwise(top))
            .withColumn("gated", F.when(idle, settings.idle).when(strong, F.col("raw_sign")).otherwise(settings.uncertain)))


def clip_gate(df: DataFrame, classes: Column, threshold: Column | float) -> DataFrame:
    """Clip decision: status and gated sign against one threshold."""
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    sure = F.col("confidence") >= threshold
    return (df.withColumn("predicted_class", F.get(classes, argmax(F.col("probs"))))
            .withColumn("confidence", F.array_max("probs"))
            .withColumn("status", F.when(sure, "CONFIDENT").otherwise("UNCERTAIN"))
            .withColumn("gated_sign", F.when(sure, F.col("predicted_class")).otherwise("UNCERTAIN")))


# -- batch ------------------------------------------------------------------
def batch_rows(clips: DataFrame, scored: DataFrame, problems: DataFrame, classes: Column,
               threshold: float) -> DataFrame:
    """One row per requested clip: scored, ERROR (unreadable) or SKIPPED (no usable landmarks).

    ``clips(clip_id, file, true_class)``, ``scored(clip_id, probs, latency_ms)``,
    ``problems(clip_id, status, error)``.
    """
    joined = clips.join(scored, "clip_id", "left").join(
        problems.select("clip_id", F.col("status").alias("_bad"), "error"), "clip_id", "left")
    decided = clip_gate(joined.withColumn("_bad", F.coalesce(
        "_bad", F.when(F.col("probs").isNull(), "SKIPPED"))), classes, threshold)
    bad, known = F.col("_bad").isNotNull(), F.length(F.coalesce("true_class", F.lit(""))) > 0
    top3 = F.array_join(F.transform(top_k(F.col("probs"), classes, 3), lambda s: F.concat(
        s["class"], F.lit(":"), F.format_string("%.4f", s["probability"]))), "|")
    return decided.select(
        "clip_id", "file", "true_class",
        F.coalesce("_bad", "predicted_class").alias("predicted_class"),
        F.when(bad, 0.0).otherwise(F.round("confidence", 6)).alias("confidence"),
        F.coalesce("_bad", "status").alias("status"),
        F.when(~bad, F.col("gated_sign")).alias("gated_sign"),
        F.when(bad, 0.0).otherwise(F.round("latency_ms", 3)).alias("latency_ms"),
        F.when(~bad & known, (F.col("predicted_class") == F.col("true_class")).cast("int")).alias("correct"),
        F.when(~bad, top3).alias("top3"),
        F.when(bad, F.coalesce("error", F.lit("no usable landmarks"))).otherwise("").alias("error"))


def batch_summary(rows: DataFrame, keys: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """Accuracy on labelled rows, uncertain rate over all rows, latency of scored rows."""
    keys = list(keys)
    scored = ~F.col("status").isin("ERROR", "SKIPPED")
    latency = F.when(scored, F.col("latency_ms"))
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("clips"), F.count("correct").alias("labelled_clips"),
        F.avg("correct").alias("accuracy"),
        F.avg((F.col("status") == settings.uncertain).cast("double")).alias("uncertain_rate"),
        F.avg(latency).alias("_mean"),
        F.count_if(F.col("status") == "ERROR").alias("errors"),
        F.count_if(F.col("status") == "SKIPPED").alias("skipped"))
    tails = exact_percentiles(rows, keys, latency, {"_p95": 0.95})
    both = sums.join(tails, keys, "left") if keys else one_row(sums, tails)
    return both.select(
        *keys, "clips", "labelled_clips", "accuracy", "uncertain_rate",
        F.round(F.coalesce("_mean", F.lit(0.0)), 3).alias("mean_latency_ms"),
        F.round(F.coalesce("_p95", F.lit(0.0)), 3).alias("p95_latency_ms"),
        F.round(F.coalesce(F.try_divide(F.lit(1000.0), F.col("_mean")), F.lit(0.0)), 2).alias("throughput_fps"),
        "errors", "skipped")


def sliding_latency(carried: np.ndarray, values: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Mean and p95 of the last ``size`` values at each place, missing ones left out of both: the window is kept sorted, one insertion and one removal a step."""
    mean, p95 = np.full(len(values), np.nan), np.full(len(values), np.nan)
    window, ranked, total = deque(), [], 0.0
    for n, value in enumerate((*carried.tolist(), *values.tolist()), -len(carried)):
        window.append(value)
        if value == value:
            insort(ranked, value)
        if len(window) > size:
            old = window.popleft()
            if old == old:
                del ranked[bisect_left(ranked, old)]
        if n >= 0 and ranked:
            at = 0.95 * (len(ranked) - 1)
            low = int(at)
            p95[n] = ranked[low] + (ranked[min(low + 1, len(ranked) - 1)] - ranked[low]) * (at - low)
            mean[n] = math.fsum(ranked) / len(ranked)
    return {"mean_latency_ms": mean, "p95_latency_ms": p95}


def rolling_latency(df: DataFrame, keys: Sequence[str], time: str, tie: str, latency: str = "latency_ms",
                    settings: Settings = Settings()) -> DataFrame:
    """Mean, p95 and throughput over the last ``latency_window`` rows of each key; rows without a latency take a place but no part.

    The window slides along a slice as one sorted list, so memory per row does not grow with the window.
    """
    sliced = df.withColumn("_slice", time_slice(F.col(time), settings.session_slice_seconds))
    size = settings.latency_window
    out = sliding(sliced, keys, "_slice", [time, tie], latency, size, lambda carried, values: sliding_latency(carried, values, size),
                  "mean_latency_ms double, p95_latency_ms double")
    return out.withColumn("throughput_fps", F.coalesce(F.try_divide(F.lit(1000.0), F.col("mean_latency_ms")), F.lit(0.0))).drop("_slice")
