"""Token counts from distinct pre-tokens (operator 11).

A pre-token is a longest piece of raw text at whose two ends the tokenizer always splits: at ASCII white
space, between an ASCII letter or digit and an ASCII mark, and around the strings of special tokens. (That
holds for the normalizer and the split pattern that ``bpe.known_cuts`` names; for another tokenizer the whole text
is one pre-token.) The library counts each distinct pre-token once; ids are never kept.

The first pass over the texts gives the distinct pre-tokens with their occurrences, pre-aggregated in each task.
The commonest short ones, at most ``HOT`` of at most ``HOT_BYTES`` bytes (under 10 MB in all), are sent to the tasks of the second pass,
which adds them up on the spot; they are those above a count that a histogram of the counts gives. All others leave a task as postings, one row per pre-token and buffer with the rows
and frequencies it was found with, so a long pre-token that stands in a third of all texts is a row per buffer and not one per text.
The postings meet the counted pre-tokens in an equi-join, and their products are summed by row.

Null text is empty: no bytes, no tokens. Repeated rows, also of equal or null ids, give a row each: rows are known by a number given when the second
pass is stored. An empty table gives no rows. Further columns of any name are not read. A very long text is one row of the batch that holds it;
a pre-token of any length is counted whole.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limbwise.llm.bpe import known_cuts, tokenizer_json
from limbwise.sources.workspace import cut

HOT, HOT_BYTES = 65_536, 64
#: Distinct pre-tokens, or postings, that a task holds before it gives them out
HELD = 300_000
_ALNUM, _SPACE = rb"0-9A-Za-z", rb"\x09-\x0d\x20"
_PIECE = re.compile(rb"[^" + _SPACE + _ALNUM + rb"]*(?:[" + _ALNUM + rb"]+[\x00-\x08\x0e-\x1f\x7f-\xff][^" + _SPACE + _ALNUM + rb"]*)*[" + _ALNUM + rb"]*")


def cutter(tokenizer: str) -> Callable[[bytes], list[bytes]]:
    """Function from the bytes of a text to its pre-tokens, repeats included."""
    spec = json.loads(tokenizer)
    if not known_cuts(spec):
        return lambda data: [data] if data else []
    names = sorted((a["content"].encode() for a in spec.get("added_tokens") or []), key=len, reverse=True)
    special = re.compile(b"(" + b"|".join(map(re.escape, names)) + b")") if names else None

    def pieces(data: bytes) -> list[bytes]:
        parts = special.split(data) if special and any(n in data for n in names) else [data]
        out = [p for plain in parts[::2] for p in _PIECE.findall(plain) if p]
        out.extend(parts[1::2])
        return out
    return pieces


def token_lengths(piece: Column, tokenizer: str, rows: int = 2048) -> Column:
    """Tokens of each pre-token as the library counts them."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(tokenizer)
        model.no_truncation()
        model.no_padding()
        for batch in batches:
            found = []
            for at in range(0, len(batch), rows):
                texts = [bytes(p).decode("utf-8", "surrogatepass") for p in batch.iloc[at:at + rows]]
                found.extend(len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False))
            yield pd.Series(found, dtype="int64")
    return run(piece)


def distinct_pieces(texts: DataFrame, tokenizer: str) -> DataFrame:
    """``piece``, its occurrences ``n`` and its ``n_tokens``, stored; ``texts`` has one binary column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = cutter(tokenizer), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["piece", "n"])
        for batch in batches:
            for text in batch.column(0):
                held.update(pieces(text.as_py() or b""))
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()
    found = texts.mapInArrow(count, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return cut(found.select("piece", "n", token_lengths(F.col("piece"), tokenizer).alias("n_tokens")), "pieces")


def postings(docs: DataFrame, hot: dict[bytes, int], tokenizer: str) -> DataFrame:
    """Stored rows of two kinds. Of a document: ``row``, ``doc_id``, ``n_bytes`` and ``hot``, its tokens in hot pre-tokens. Of
    a pre-token that isn't hot: ``piece`` with ``rows`` and ``freqs``."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(hot)
    schema = f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, hot bigint, piece binary, rows array<bigint>, freqs array<bigint>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, hot, at = cutter(tokenizer), known.value, TaskContext.get().partitionId() << 33
        cold: dict[bytes, list[int]] = {}
        held = 0
        kinds = None

        def flushed() -> pa.RecordBatch:
            flat = np.fromiter((x for v in cold.values() for x in v), np.int64, 2 * held).reshape(-1, 2)
            ends = np.cumsum([0, *(len(v) // 2 for v in cold.values())]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(flat[:, k]))) for k in (0, 1)]
            none = [pa.nulls(len(cold), t) for t in kinds]
            return pa.RecordBatch.from_arrays([*none, pa.array(list(cold), pa.binary()), *lists], names)
        names = ["row", "doc_id", "n_bytes", "hot", "piece", "rows", "freqs"]
        for batch in batches:
            kinds = [pa.int64(), batch.schema.field(0).type, pa.int64(), pa.int64()]
            sizes, sums, first = [], [], at
            for text in batch.column(1):
                data, total = text.as_py() or b"", 0
                for piece, k in Counter(pieces(data)).items():
                    n = hot.get(piece)
                    if n is None:
                        cold.setdefault(piece, []).extend((at, k))
                        held += 1
                    else:
                        total += n * k
                sizes.append(len(data))
                sums.append(total)
                at += 1
                if held >= HELD:
                    yield flushed()
                    cold, held = {}, 0
            n = len(sizes)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, at)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                                              pa.nulls(n, pa.binary()), pa.nulls(n, lists), pa.nulls(n, lists)], names)
        if cold:
            yield flushed()
    return cut(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(split, schema), "postings")


def common_pieces(pieces: DataFrame, most: int) -> dict[bytes, int]:
    """Tokens of at most ``most`` short pre-tokens: those of the highest counts, by whole steps of an eighth of a power of two."""
    short = pieces.where(F.length("piece") <= HOT_BYTES).withColumn("step", F.floor(8 * F.log2("n")))
    least, left = None, most
    for row in short.groupBy("step").count().orderBy(F.desc("step")).collect():
        left -= row["count"]
        if left < 0:
            break
        least = row["step"]
    if least is None:
        return {}
    return {bytes(r["piece"]): r["n_tokens"] for r in short.where(F.col("step") >= least).select("piece", "n_tokens").collect()}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``."""
    pieces = distinct_pieces(docs.select(F.col("text").cast("binary").alias("text")), tokenizer)
    stored = postings(docs, common_pieces(pieces, hot), tokenizer)
    met = (stored.where("piece IS NOT NULL").select("piece", "rows", "freqs").join(pieces.select("piece", "n_tokens"), "piece")
           .select("n_tokens", F.explode(F.arrays_zip("rows", "freqs")).alias("x"))
           .select(F.col("x.rows").alias("row"), (F.col("x.freqs") * F.col("n_tokens")).alias("n_tokens")))
    own = stored.where("row IS NOT NULL").select("row", "doc_id", "n_bytes", F.col("hot").alias("n_tokens"))
    summed = own.unionByName(met, allowMissingColumns=True).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_json())
