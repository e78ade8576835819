"""Near-duplicate documents by BagMinHash (operator 1).

A document is the multiset of its five-word shingles (a shorter one is one shingle). Two documents are
linked when the weighted Jaccard similarity of their multisets is 0.8 or more; a class is a
connected component of links.

Signatures: every (shingle, weight level) sends out a Poisson process of points, each aimed at one of
``REGISTERS``; a register keeps its first point. Weights are whole numbers, so levels are 1, 2, 3, ... in
blocks (0,1], (1,2], (2,4], (4,8], ...; a block is one process of its size's rate and only a point's own level
in the block decides whether a weight reaches it. Points later than a bound that fills all
registers are never drawn, so long texts cost little more than one draw per shingle.

Classes: equal word sequences are one node. Signatures are banded; in a bucket every node is compared with two
hubs on the texts, the node with the most bucket neighbours and one picked by hash. Then each bucket that still
holds several components compares its nodes outside the largest of them with all nodes of other
components, in blocks of at most ``BLOCK`` by ``BLOCK`` that give out only the links they find. So no candidate link between
different components is left out, though pairs within a group are never written out. With 25 bands of 5 a pair at 0.8 shares no bucket once in 20,000 times; links of a class's other
members bridge that as a rule.

Null and wordless texts have no shingles: each is a class of its own. Repeated rows are copies. The
class id is the smallest doc_id of the class, null only if all are null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limbwise.llm.components import components
from limbwise.llm.words import HashCache, mix, words
from limbwise.sources.workspace import cut

BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
SHINGLE, THRESHOLD, BLOCK = 5, 0.8, 512
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_ALL = (1 << 64) - 1
_STEP = np.uint64(0x2545F4914F6CDD1D)


def shingles(found: list[bytes], cache: HashCache) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, and their counts."""
    hashes = cache.of(found)
    if len(found) < SHINGLE:
        key = (hashes * _PLACE[:len(found)]).sum(dtype=np.uint64)
        return mix(np.array([key + np.uint64(len(found))], np.uint64)), np.ones(1, np.int64)
    n = len(found) - SHINGLE + 1
    key = hashes[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        key += hashes[k:k + n] * _PLACE[k]
    return np.unique(mix(key), return_counts=True)


def signatures(values: np.ndarray, counts: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """(text, register) -> time of the first point, for shingles given with the text that owns them."""
    weight = np.maximum(np.bincount(owner, counts, texts), 1)
    bound = REGISTERS * (np.log(REGISTERS) + 4) / weight
    out = np.full((texts, REGISTERS), np.inf)
    todo = np.ones(texts, bool)
    while todo.any():
        own = np.flatnonzero(todo[owner])
        _first_points(values[own], counts[own], owner[own], bound, out.reshape(-1))
        todo &= np.isinf(out).any(1)
        bound = np.where(todo, 2 * bound, bound)
    return out


def _first_points(values: np.ndarray, counts: np.ndarray, owner: np.ndarray, bound: np.ndarray, flat: np.ndarray) -> None:
    low, size, block = 0, 1, 0
    while True:
        reach = np.flatnonzero(counts > low)
        if not len(reach):
            return
        x = mix(values[reach] + np.uint64((block + 1) * 0x2545F4914F6CDD1D & _ALL))
        c, who, time, k = counts[reach], owner[reach], np.zeros(len(reach)), 0
        until = bound[who]
        while len(x):
            k += 1
            draw = mix(x + np.uint64(k * 0x9E3779B97F4A7C15 & _ALL))
            time = time - np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0 ** -53) / size
            live = time < until
            x, c, who, time, until, draw = x[live], c[live], who[live], time[live], until[live], draw[live]
            aim = mix(draw + _STEP)
            at = who * REGISTERS + ((aim >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
            if size > 1:
                level = low + 1 + ((aim & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
                hit = level <= c
                np.minimum.at(flat, at[hit], time[hit])
            else:
                np.minimum.at(flat, at, time)
        low, size, block = low + size, low + size, block + 1


def band_keys(found: np.ndarray) -> np.ndarray:
    """(text, band) -> 64-bit key of the band's registers."""
    bits = found.view(np.uint64).reshape(len(found), BANDS, ROWS)
    key = np.zeros((len(found), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACE[1]
    for r in range(ROWS):
        key = mix(key ^ bits[:, :, r])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _sign(batches: Iterator[pa.RecordBatch], shingles_at_once: int = 150_000) -> Iterator[pa.RecordBatch]:
    import xxhash

    cache = HashCache()

    def flush(rows, ids, nodes, parts):
        own = [i for i, p in enumerate(parts) if p is not None]
        keys: list = [None] * len(parts)
        if own:
            owner = np.repeat(np.arange(len(own)), [len(parts[i][0]) for i in own])
            found = band_keys(signatures(np.concatenate([parts[i][0] for i in own]), np.concatenate([parts[i][1] for i in own]), owner, len(own)))
            for i, k in zip(own, found):
                keys[i] = k
        return pa.record_batch({"row": pa.array(rows, pa.int64()), "doc_id": pa.array(ids, pa.int64()),
                                "node": pa.array(nodes, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))})
    for batch in batches:
        held, rows, ids, nodes, parts = 0, [], [], [], []
        for row, doc_id, text in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            found = words(text)
            part = shingles(found, cache) if found else None
            rows.append(row)
            ids.append(doc_id)
            nodes.append(xxhash.xxh3_128_digest(b" ".join(found)) if found else None)
            parts.append(part)
            held += len(part[0]) if part else 1
            if held > shingles_at_once:
                yield flush(rows, ids, nodes, parts)
                held, rows, ids, nodes, parts = 0, [], [], [], []
        if rows:
            yield flush(rows, ids, nodes, parts)


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache, last, known = HashCache(), None, None
    for batch in batches:
        us, vs, good = batch["u"].to_pylist(), batch["v"].to_pylist(), []
        for i, (u, v) in enumerate(zip(us, vs)):
            if u != last:
                last, known = u, shingles(words(batch["text_u"][i].as_py()), cache)
            if similarity(known, shingles(words(batch["text_v"][i].as_py()), cache)) >= THRESHOLD:
                good.append(i)
        yield batch.select(["u", "v"]).take(pa.array(good, pa.int64()))


def expanded(found: tuple[np.ndarray, np.ndarray]) -> frozenset[int]:
    """A multiset as a set: the k-th copy of a shingle is an element of its own."""
    values, counts = found
    parts, k = [values], 1
    while (more := values[counts > k]).size:
        parts.append(mix(more + np.uint64(k * 0x2545F4914F6CDD1D & _ALL)))
        k += 1
    return frozenset(np.concatenate(parts).tolist())


def compared(loose: list[tuple], rest: list[tuple], at: int) -> list[tuple[bytes, bytes]]:
    """Links between two sides of a bucket of band ``at``, given as (node, label, bands, set).

    A pair is compared where its labels differ and in the first band that it shares only.
    """
    a, b = (np.array([x[2] for x in side]) for side in (loose, rest))
    mask = np.array([x[1] for x in loose], object)[:, None] != np.array([x[1] for x in rest], object)[None, :]
    for band in range(at):
        mask &= a[:, band][:, None] != b[:, band][None, :]
    out = []
    for i, j in zip(*np.nonzero(mask)):
        x, y = loose[i][3], rest[j][3]
        if min(len(x), len(y)) >= THRESHOLD * max(len(x), len(y)):
            both = len(x & y)
            if both >= THRESHOLD * (len(x) + len(y) - both):
                out.append((loose[i][0], rest[j][0]))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by bucket and block, the loose side first."""
    cache, sets, group, sides, band = HashCache(), {}, None, ([], []), 0

    def flush():
        found = compared(*sides, band) if sides[0] and sides[1] else []
        for side in sides:
            side.clear()
        return found
    for batch in batches:
        out = []
        columns = {c: batch[c].to_pylist() for c in ("key", "lb", "rb", "side", "node", "label")}
        for i, (key, lb, rb, side, node, label) in enumerate(zip(*columns.values())):
            if (key, lb, rb) != group:
                out.extend(flush())
                group = (key, lb, rb)
            own = sets.get(node)
            if own is None:
                if len(sets) >= 10_000:
                    sets.clear()
                own = sets[node] = (batch["bands"][i].as_py(), expanded(shingles(words(batch["text"][i].as_py()), cache)))
            band = own[0].index(key)
            sides[side].append((node, label, *own))
        yield pa.record_batch({"u": pa.array([x[0] for x in out], pa.binary()), "v": pa.array([x[1] for x in out], pa.binary())})
    out = flush()
    yield pa.record_batch({"u": pa.array([x[0] for x in out], pa.binary()), "v": pa.array([x[1] for x in out], pa.binary())})


def row_key() -> F.Column:
    return F.xxhash64("doc_id", "text")


def sign(docs: DataFrame) -> DataFrame:
    """``row`` (hash of id and text), ``doc_id``, ``node`` (hash of the words) and ``bands``; null without words."""
    return docs.select(row_key().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _sign, "row bigint, doc_id bigint, node binary, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``u``, ``v``) of nodes whose texts are similar enough."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(_overlap, "u binary, v binary")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Links between nodes that connect all classes: at most a spanning set and some more."""
    nodes = cut(signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("row").alias("row"), F.first("bands").alias("bands")), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    members = cut(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "members")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "node").groupBy("key").agg(F.array(
        F.max(F.struct("weight", "node"))["node"], F.max(F.struct(F.xxhash64("key", "node").alias("h"), "node"))["node"]).alias("hubs"))
    first = cut(members.join(hubs, "key").select("node", F.explode("hubs").alias("hub")).where(F.col("hub") != F.col("node"))
                .select(*_ordered("hub", "node")).distinct(), "pairs")
    needed = first.select(F.col("u").alias("node")).union(first.select("v")).distinct().join(nodes, "node")
    texts = cut(docs.select(row_key().alias("row"), "text").join(needed, "row").groupBy("node").agg(
        F.first("text").alias("text"), F.first("bands").alias("bands")), "texts")
    found = cut(_verified(first, texts), "links")
    labels = components(found)
    labelled = cut(members.where("n > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("key", "node", "label"), "members")
    parts = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = (parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top")).where("parts > 1")
             .select("key", F.col("top.label").alias("largest"), blocks(F.col("all") - F.col("top.n")).alias("lbs"), blocks(F.col("all")).alias("rbs")))
    here = labelled.join(mixed, "key")
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    loose = (here.where(F.col("label") != F.col("largest")).withColumn("lb", own("lbs")).withColumn("rb", every("rbs"))
             .select("key", "lb", "rb", F.lit(0).alias("side"), "node", "label"))
    rest = here.withColumn("rb", own("rbs")).withColumn("lb", every("lbs")).select("key", "lb", "rb", F.lit(1).alias("side"), "node", "label")
    met = loose.union(rest).join(texts, "node")
    second = (met.repartition("key", "lb", "rb").sortWithinPartitions("key", "lb", "rb", "side")
              .select("key", "lb", "rb", "side", "node", "label", "text", "bands").mapInArrow(_compare, "u binary, v binary"))
    return found.union(second.select(*_ordered("u", "v")).distinct())


def classify(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (``row``, ``doc_id``, ``label``) and classes (``label``, ``class_id``, ``class_size``); a wordless row has a null label."""
    signed = cut(sign(docs), "signed")
    labels = components(links(docs, signed))
    rows = signed.join(labels, "node", "left").select("row", "doc_id", F.coalesce("label", "node").alias("label"))
    return rows, rows.where(F.col("label").isNotNull()).groupBy("label").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row's ``doc_id`` with its ``class_id`` and ``class_size``."""
    rows, classes = classify(docs)
    rows = cut(rows, "labelled")
    return rows.join(classes, "label", "left").select(
        "doc_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"))


def one_per_class(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each class: the smallest doc_id stays. Columns are kept."""
    rows, _ = classify(docs)
    stay = rows.groupBy("label", F.when(F.col("label").isNull(), F.struct("doc_id", "row"))).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m")).select(F.col("m.row").alias("_row")).distinct()
    kept = docs.select(row_key().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).join(stay, "_row", "left_semi")
    return kept.groupBy("_row").agg(F.first("_doc").alias("_doc")).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
