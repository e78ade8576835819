"""Byte-level convolutional quality classifier in numpy (operator 10).

The bytes of a whole document are cut into blocks of 64; a chunk is two neighbouring blocks, so chunks
overlap by half. ``FILTERS`` filters of ``WIDTH`` bytes run over every position (a filter is one
weight per place and byte value, so the convolution of one-hot bytes is a sum of table
rows), their rectified maxima per chunk are pooled once more over the document, by mean and by
maximum, and combined by logistic regression into one probability.

Learning: the whole texts of about ``per_class`` labelled rows of each class, those with the smallest hashes of the id (the documented bound of
the sample); the intercept is then moved from the sample's class balance to that of all labelled training rows. Scoring reads every byte.
A filter that reaches over the end of a text reads zeros there, so a score depends on its own text alone.

Null or empty text: the pooled values are zero and the intercept gives the score. Labels of one class only: its
share as the score. No labels: 0.5. Repeated rows get equal scores; labelled rows that repeat count once, of several texts of an id the smallest is learned.
Further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limbwise.llm.words import crc_mod

BLOCK, WIDTH, FILTERS = 64, 5, 16


class Model(NamedTuple):
    tables: np.ndarray   # (place, byte, filter)
    bias: np.ndarray     # (filter,)
    mean: np.ndarray     # weights of the mean over chunks
    top: np.ndarray      # weights of the maximum over chunks
    intercept: float


def laid_out(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(block, BLOCK + WIDTH - 1) bytes: the blocks of all texts, each with the bytes that follow in the same text or zeros; blocks per text."""
    blocks, parts = np.array([-(-len(x) // BLOCK) for x in found], np.int64), []
    for x, n in zip(found, blocks.tolist()):
        if n:
            own = np.frombuffer(x.ljust(n * BLOCK + WIDTH - 1, b"\0"), np.uint8)
            parts.append(np.lib.stride_tricks.as_strided(own, (n, BLOCK + WIDTH - 1), (BLOCK, 1)))
    return np.concatenate(parts) if parts else np.zeros((0, BLOCK + WIDTH - 1), np.uint8), blocks


def responses(raw: np.ndarray, model: Model) -> np.ndarray:
    """(block, position, filter)."""
    out = model.tables[0][raw[:, :BLOCK]]
    for k in range(1, WIDTH):
        out += model.tables[k][raw[:, k:k + BLOCK]]
    return out


def block_maxima(raw: np.ndarray, model: Model, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(block, filter): the largest response and its position."""
    top, place = np.zeros((len(raw), FILTERS), model.tables.dtype), np.zeros((len(raw), FILTERS), np.int64)
    for lo in range(0, len(raw), step):
        act = responses(raw[lo:lo + step], model)
        place[lo:lo + step] = at = act.argmax(1)
        top[lo:lo + step] = np.take_along_axis(act, at[:, None], 1)[:, 0]
    return top, place


def chunked(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block: does the next one belong to the same text; start of each text."""
    ends = np.cumsum(blocks)
    last = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    last[ends[blocks > 0] - 1] = True
    return ~last, ends - blocks


def pooled(maxima: np.ndarray, blocks: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(text, 2 * filter): mean and maximum over the chunks of each text."""
    out = np.zeros((len(blocks), 2 * FILTERS), np.result_type(maxima, bias))
    if not len(maxima):
        return out
    inner, starts = chunked(blocks)
    at = np.flatnonzero(inner)
    chunk = maxima.copy()
    chunk[at] = np.maximum(maxima[at], maxima[at + 1])
    chunk = np.maximum(chunk + bias, 0)
    full = blocks > 0
    out[full, :FILTERS] = np.add.reduceat(chunk, starts[full]) / blocks[full, None]
    out[full, FILTERS:] = np.maximum.reduceat(chunk, starts[full])
    return out


def probabilities(found: list[bytes], model: Model) -> np.ndarray:
    raw, blocks = laid_out(found)
    # row sums instead of a matrix product, whose rounding depends on the number of rows
    z = (pooled(block_maxima(raw, model)[0], blocks, model.bias).astype(np.float64) * np.concatenate((model.mean, model.top))).sum(1) + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 3) -> Model:
    """Adam on the logistic loss; gradients reach a filter only where its maximum was taken."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
              rng.normal(0, 0.1, FILTERS).astype(np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(1, np.float32)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            take = order[lo:lo + batch]
            model = Model(*params[:4], float(params[4][0]))
            grads = _gradients([texts[i] for i in take], labels[take], model)
            t += 1
            step = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)))
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= step * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
    return Model(*params[:4], float(params[4][0]))


def _gradients(texts: list[bytes], labels: np.ndarray, model: Model) -> list[np.ndarray]:
    raw, blocks = laid_out(texts)
    total = int(blocks.sum())
    maxima, where = block_maxima(raw, model)
    inner, starts = chunked(blocks)
    nxt = np.arange(total) + inner
    second = maxima[nxt] > maxima
    source = np.where(second, nxt[:, None], np.arange(total)[:, None])
    chunk = np.maximum(np.where(second, maxima[nxt], maxima) + model.bias, 0)
    owner = np.repeat(np.arange(len(texts)), blocks)
    full = blocks > 0
    features = pooled(maxima, blocks, model.bias)
    z = features @ np.concatenate((model.mean, model.top)) + model.intercept
    dz = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(texts)).astype(chunk.dtype)
    is_top = chunk == features[owner, FILTERS:]
    is_top &= np.cumsum(is_top, 0) == (np.cumsum(is_top, 0) - is_top)[starts[owner]] + 1  # the first one only
    dchunk = dz[owner, None] * (model.mean / blocks[owner, None] + model.top * is_top) * (chunk > 0)
    place = where[source, np.arange(FILTERS)]
    tables = np.empty_like(model.tables)
    for k in range(WIDTH):
        cell = raw[source, place + k].astype(np.int64) * FILTERS + np.arange(FILTERS)
        tables[k] = np.bincount(cell.ravel(), dchunk.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    w = features.T @ dz
    return [tables, dchunk.sum(0), w[:FILTERS], w[FILTERS:], np.array([dz.sum()], np.float32)]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model:
    """Fit on labelled rows whose id's crc32 modulo 4 is not 2; only a sample of at most ``per_class`` rows a class reaches the driver.

    The rows of a class are thinned by a hash threshold before they are ranked, so a ranked class is little more than its sample.
    """
    usable = labels.where((crc_mod(F.col("doc_id"), 4) != 2) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int")).distinct()
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    empty = Model(np.zeros((WIDTH, 256, FILTERS), np.float32), *[np.zeros(FILTERS, np.float32)] * 3, 0.0)
    if len(counts) < 2:
        n0, n1 = counts.get(0, 0), counts.get(1, 0)
        return empty._replace(intercept=float(np.log((n1 + 0.5) / (n0 + 0.5))) if n0 + n1 else 0.0)
    steps, hashed = 1 << 30, F.xxhash64("doc_id")
    enough = {q: min(steps, int(steps * (per_class + 6 * per_class ** 0.5 + 40) / n)) for q, n in counts.items()}
    near = F.pmod(hashed, F.lit(steps)) < F.when(F.col("quality") == 1, enough[1]).otherwise(enough[0])
    by_hash = Window.partitionBy("quality").orderBy(F.pmod(hashed, F.lit(steps)), "doc_id")
    picked = usable.where(near).withColumn("_at", F.row_number().over(by_hash)).where(F.col("_at") <= per_class).select("doc_id", "quality")
    rows = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect())
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    y = np.array([r["quality"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return empty._replace(intercept=float(np.log(counts[1] / counts[0])))
    model = fit([(r["text"] or "").encode("utf-8", "surrogatepass") for r in rows], y)
    shift = np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return model._replace(intercept=model.intercept + float(shift))


def probability(text: Column, model: Model, rows: int = 64) -> Column:
    """The model (WIDTH * 256 * FILTERS numbers) travels with the function."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [probabilities([(t or "").encode("utf-8", "surrogatepass") for t in texts.iloc[at:at + rows]], model)
                     for at in range(0, len(texts), rows)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
    return run(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    return docs.select("doc_id", probability(F.col("text"), model).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, learn(docs, labels)).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
