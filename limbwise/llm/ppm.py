"""Language-model scores by prediction by partial matching over bytes (operator 6).

A text is the byte stream of its words, lower-cased in A-Z, with a blank between words and a line feed as the end.
The trie holds every context of up to ``ORDER`` bytes of the training texts. A byte is predicted in the
longest context known; where it did not follow that context, an escape leads to the next shorter one, in which
the bytes already ruled out no longer count (symbol exclusion). Escapes are estimated as half a count per
distinct byte; below the empty context all bytes not yet ruled out are alike.

How it is spread: documents fall by hash into blocks of about ``BLOCK_BYTES``. A block sends the distinct grams
(context and byte) and words of its documents, with their training counts, packed by hash bucket. Buckets add up all blocks'
counts. Since every shorter context is the end of a longer one, all contexts that end in the same two bytes are
modelled together; one-byte contexts are a table of 256 by 256. The bucket gives each block the log
probabilities of its own grams and the counts of its words, and the block's documents are scored in a
stream against them. So no task holds the trie, the vocabulary or a group of documents whole.

Null or empty text: the end token only. Rows whose id is null count as training rows (their remainder is
null, so not 0). Repeated rows are trained and scored each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limbwise.llm.words import HashCache, crc_mod
from limbwise.sources.workspace import cut

ORDER = 5
#: of each distinct next byte, the share of a count kept for escapes
DISCOUNT = 0.5
BLOCK_BYTES, BUCKET_BYTES = 48_000_000, 12_000_000
GRAM, WORD = 0, 1
PACKED = "block int, bucket int, kind int, keys binary, counts binary"
END = b"\n"


def stream(text: str | None) -> tuple[bytes, list[bytes]]:
    """Bytes to predict and tokens of a text."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return b" ".join(found) + END, [*found, END]


def grams(parts: list[bytes]) -> np.ndarray:
    """Key of the last ``ORDER`` + 1 bytes up to each byte of the streams; before a stream come ends."""
    pad = END * ORDER
    raw = np.frombuffer(pad + pad.join(parts), np.uint8)
    key = raw[ORDER:].astype(np.uint64)
    for back in range(1, ORDER + 1):
        key |= raw[ORDER - back:len(raw) - back].astype(np.uint64) << np.uint64(8 * back)
    keep = np.ones(len(key), bool)
    at = np.cumsum([len(p) + ORDER for p in parts])[:-1]
    keep[(at[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    return key[keep]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts added up."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


class Tally:
    """Distinct keys of a block with their training counts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.known = 0

    def add(self, keys: np.ndarray, trained: bool) -> None:
        distinct, counts = np.unique(keys, return_counts=True)
        self.parts.append((distinct, counts if trained else np.zeros(len(counts), np.int64)))
        self.held += len(distinct)
        if self.held > 2 * self.known + 500_000:
            self.parts = [self.all()]
            self.held = self.known = len(self.parts[0][0])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


def split(keys: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the keys by the number in ``where``, in key order."""
    order = np.argsort(where, kind="stable")
    ends = np.flatnonzero(np.diff(where[order])) + 1
    for part in np.split(order, ends):
        if len(part):
            yield int(where[part[0]]), part


def _gather(buckets: int):
    def run(batches: Iterator[pa.RecordBatch], at_once: int = 1_500_000) -> Iterator[pa.RecordBatch]:
        cache = HashCache(200_000)
        tallies: dict[int, tuple[Tally, Tally]] = {}
        for batch in batches:
            held: dict[tuple[int, bool], list] = {}
            size = 0

            def flush():
                for (block, trained), (parts, tokens) in held.items():
                    pair = tallies.setdefault(block, (Tally(), Tally()))
                    pair[GRAM].add(grams(parts), trained)
                    pair[WORD].add(cache.of(tokens), trained)
                held.clear()
            for block, out, text in zip(batch["block"].to_pylist(), batch["held_out"].to_pylist(), batch["text"]):
                data, tokens = stream(text.as_py())
                parts = held.setdefault((block, not out), ([], []))
                parts[0].append(data)
                parts[1].extend(tokens)
                size += len(data)
                if size > at_once:
                    flush()
                    size = 0
            flush()
        for block in list(tallies):
            for kind, tally in enumerate(tallies.pop(block)):
                keys, counts = tally.all()
                for bucket, at in split(keys, bucket_of(keys, buckets)):
                    yield pa.record_batch({
                        "block": pa.array([block], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "kind": pa.array([kind], pa.int32()),
                        "keys": pa.array([keys[at].tobytes()], pa.binary()), "counts": pa.array([counts[at].astype(np.uint32).tobytes()], pa.binary())})
    return run


def _unpack(rows: pd.DataFrame, what: str = "counts", kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([np.frombuffer(k, np.uint64) for k in rows["keys"]] or [np.zeros(0, np.uint64)]),
            np.concatenate([np.frombuffer(c, kind) for c in rows[what]] or [np.zeros(0, kind)]))


def _totals(groups: int):
    """A bucket's counts over all blocks: grams packed by the last two context bytes, and two sums for the words."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bucket, out = int(rows["bucket"].iloc[0]), []
        of_words = rows[rows["kind"] == WORD]
        _, counts = summed(*_unpack(of_words))
        out.append((bucket, -1, b"", b"", int(counts.sum()), int((counts > 0).sum())))
        keys, counts = summed(*_unpack(rows[rows["kind"] == GRAM]))
        for group, at in split(keys, ((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64) * 40503 % 65536 % groups):
            out.append((bucket, group, keys[at].tobytes(), counts[at].tobytes(), 0, 0))
        return pd.DataFrame(out, columns=["bucket", "grp", "keys", "counts", "tokens", "known"])
    return run


def low_order(parts: pd.DataFrame) -> np.ndarray:
    """Counts by (byte before, byte) of packed grams."""
    keys, counts = _unpack(parts, kind=np.int64)
    return np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), counts, 65536).astype(np.int64)


def predict(keys: np.ndarray, counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each gram after its context.

    ``keys`` are distinct and hold every trained gram of their two-byte contexts; ``ones`` is ``low_order`` of
    the whole training text.
    """
    ones = ones.reshape(256, 256)
    zeros = ones.sum(0)
    mask = lambda order: np.uint64((1 << 8 * (order + 1)) - 1)
    trained = counts > 0
    level = {}   # order -> distinct grams and their counts
    for order in range(ORDER, 1, -1):
        level[order] = summed(keys[trained] & mask(order), counts[trained])
    at_low = {1: lambda g: ones.reshape(-1)[(g & mask(1)).astype(np.int64)], 0: lambda g: zeros[(g & mask(0)).astype(np.int64)]}

    def count(order: int, g: np.ndarray) -> np.ndarray:
        if order < 2:
            return at_low[order](g)
        known, n = level[order]
        at = np.minimum(np.searchsorted(known, g & mask(order)), max(len(known) - 1, 0))
        return np.where(known[at] == g & mask(order), n[at], 0) if len(known) else np.zeros(len(g), np.int64)

    def context(order: int, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each gram's context of ``order`` bytes: its count, its distinct next bytes, and their counts one order below."""
        if order == 0:
            full = np.ones(len(g), np.int64)
            return full * zeros.sum(), full * (zeros > 0).sum(), full
        if order == 1:
            byte = ((g >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
            return ones.sum(1)[byte], (ones > 0).sum(1)[byte], ((ones > 0) * zeros).sum(1)[byte]
        known, n = level[order]
        own, first = np.unique(known >> np.uint64(8), return_index=True)
        if not len(own):
            return (np.zeros(len(g), np.int64),) * 3
        below = count(order - 1, known)
        sums = [np.add.reduceat(x, first) for x in (n, np.ones(len(known), np.int64), below)]
        c = (g & mask(order)) >> np.uint64(8)
        at = np.minimum(np.searchsorted(own, c), len(own) - 1)
        seen = own[at] == c
        return tuple(np.where(seen, s[at], 0) for s in sums)
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))
    ruled_n, ruled_d = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for order in range(ORDER, -1, -1):
        g = keys[todo]
        n, d, below = context(order, g)
        c = count(order, g)
        rest_n, rest_d = n - ruled_n, d - ruled_d
        with np.errstate(divide="ignore", invalid="ignore"):
            here, escape = np.log10((c - DISCOUNT) / rest_n), np.where(rest_n > 0, np.log10(DISCOUNT * rest_d / rest_n), 0.0)
        found = c > 0
        out[todo] += np.where(found, here, escape)
        seen = n > 0
        ruled_n, ruled_d = np.where(seen, below, ruled_n)[~found], np.where(seen, d, ruled_d)[~found]
        todo = todo[~found]
    out[todo] -= np.log10(np.maximum(256 - ruled_d, 1))
    return out


def _model(ones: np.ndarray, buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _unpack(rows, kind=np.int64)
        values = predict(keys, counts, ones).astype(np.float32)
        out = [(bucket, keys[at].tobytes(), values[at].tobytes()) for bucket, at in split(keys, bucket_of(keys, buckets))]
        return pd.DataFrame(out, columns=["to", "known", "values"])
    return run


def _returned(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """For each block of a bucket: its keys with log probabilities of grams, or total counts of words."""
    out = []
    for kind in (GRAM, WORD):
        own = rows[rows["kind"] == kind]
        if not len(own):
            continue
        if kind == GRAM:
            known = np.concatenate([np.frombuffer(k, np.uint64) for k in model["known"]])
            values = np.concatenate([np.frombuffer(v, np.float32) for v in model["values"]])
            order = np.argsort(known)
            known, values = known[order], values[order]
        else:
            known, values = summed(*_unpack(own))
            values = np.minimum(values, 0xFFFFFFFF).astype(np.uint32)
        for block, keys in zip(own["block"], own["keys"]):
            out.append((int(block), kind, keys, values[np.searchsorted(known, np.frombuffer(keys, np.uint64))].tobytes()))
    return pd.DataFrame(out, columns=["block", "kind", "keys", "counts"])


class Table:
    """Values by 64-bit key: most keys are found by one look into a direct table, the rest by search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = np.uint64(64 - max(10, int(len(keys)).bit_length() + 1))
        self.slots = np.zeros(1 << (64 - int(self.bits)), np.int64)
        self.slots[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        at[miss] = np.searchsorted(self.keys, keys[miss])
        return self.values[at]


def _score(tokens: int, known: int):
    def run(batches: Iterator[pa.RecordBatch], at_once: int = 1_000_000) -> Iterator[pa.RecordBatch]:
        cache = HashCache(200_000)
        block, parts, tables = None, {GRAM: [], WORD: []}, {}
        floor = np.log10(tokens + 0.1 * (known + 1)) if tokens else np.log10(0.1)

        def flush(ids, out, streams, words):
            if not ids:
                return None
            g, w = tables[GRAM][grams(streams)], tables[WORD][cache.of([t for ts in words for t in ts])]
            firsts = lambda sizes: np.cumsum([0] + sizes[:-1])
            at = firsts([len(ts) for ts in words])
            return pa.record_batch({
                "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(out, pa.bool_()),
                "n_tokens": pa.array([len(ts) for ts in words], pa.int64()),
                "n_known": pa.array(np.add.reduceat((w > 0).astype(np.int64), at)), "train_tokens": pa.array([tokens] * len(ids), pa.int64()),
                "base_score": pa.array(np.add.reduceat(np.log10(w.astype(np.float64) + 0.1) - floor, at)),
                "score": pa.array(np.add.reduceat(g.astype(np.float64), firsts([len(s) for s in streams])))})
        for batch in batches:
            ids, out, streams, words, size = [], [], [], [], 0
            blocks, kinds = batch["block"].to_pylist(), batch["kind"].to_pylist()
            for i, kind in enumerate(kinds):
                if blocks[i] != block:
                    if ids:
                        yield flush(ids, out, streams, words)
                        ids, out, streams, words, size = [], [], [], [], 0
                    block, parts, tables = blocks[i], {GRAM: [], WORD: []}, {}
                if kind in parts:
                    parts[kind].append((np.frombuffer(batch["keys"][i].as_py(), np.uint64), np.frombuffer(batch["counts"][i].as_py(), np.float32 if kind == GRAM else np.uint32)))
                    continue
                if not tables:
                    tables = {k: Table(np.concatenate([p[0] for p in v]), np.concatenate([p[1] for p in v])) for k, v in parts.items()}
                    parts = {GRAM: [], WORD: []}
                data, found = stream(batch["text"][i].as_py())
                ids.append(batch["doc_id"][i].as_py())
                out.append(batch["held_out"][i].as_py())
                streams.append(data)
                words.append(found)
                size += len(data)
                if size > at_once:
                    yield flush(ids, out, streams, words)
                    ids, out, streams, words, size = [], [], [], [], 0
            if ids:
                yield flush(ids, out, streams, words)
    return run


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """One row per document with the model's and the unigram base's log10 probability (``SCORED``)."""
    size = docs.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)).first()[0] or 0
    blocks, buckets = max(1, -(-size // BLOCK_BYTES)), max(4, -(-size // BUCKET_BYTES))
    groups = min(65536, 4 * buckets)
    held = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    blocked = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
                          F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), "text")
    packed = cut(blocked.repartition(4 * blocks, "block").mapInArrow(_gather(buckets), PACKED), "grams")
    totals = cut(packed.groupBy("bucket").applyInPandas(
        _totals(groups), "bucket int, grp int, keys binary, counts binary, tokens bigint, known bigint"), "totals")
    sums = totals.agg(F.sum("tokens"), F.sum("known")).first()

    def low(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(65536, np.int64)
        for rows in batches:
            total += low_order(rows)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at, "n": total[at]})
    trained = totals.where("grp >= 0")
    ones = np.zeros(65536, np.int64)
    for row in trained.select("keys", "counts").mapInPandas(low, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        ones[row["pair"]] = row["n"]
    model = trained.groupBy("grp").applyInPandas(_model(ones, buckets), "to int, known binary, values binary")
    own = packed.groupBy("bucket").cogroup(model.groupBy("to")).applyInPandas(_returned, "block int, kind int, keys binary, counts binary")
    last = lambda c, kind: F.lit(None).cast(kind).alias(c)
    both = (own.select("block", "kind", "keys", "counts", last("doc_id", "bigint"), last("held_out", "boolean"), last("text", "string"))
            .union(blocked.select("block", F.lit(2), last("keys", "binary"), last("counts", "binary"), "doc_id", "held_out", "text")))
    return both.repartition(4 * blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(
        _score(int(sums[0] or 0), int(sums[1] or 0)), SCORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
