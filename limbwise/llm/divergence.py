"""Divergence between the sources of a language over shared segment trees (operator 13).

A group is a (language, source). Its counts over the term ids of its language are the leaves of a segment tree. Trees are hash-consed: at
each level equal pairs of children get one number, so equal count subtrees are one node, within a group and across groups.
Two groups are priced by one simultaneous traversal from their roots down: node pairs that occur again are merged into one with the number
of times they occur, so an equal node pair is visited and priced once; at the leaves a count pair is priced once
in both directions. Term ids follow the size of the term's count in the language, so rare terms lie together and share large subtrees.

Spark cuts the ids of a language in blocks (aligned subtrees) and spreads the blocks; a block holds the counts of all groups, and the pairs of groups
are shared out in slices of ``SLICE`` groups. Parts of a pair are summed over the blocks. The shortest list of terms of a
group comes from the lists of its blocks. A language with a third of all rows is as many blocks as its terms need. Shares and prices are exact
integers: ``share`` divides in steps that stay inside 64 bits.

Null text, language and source are read as ''. A group without terms and a language without kept terms still give their pairs
(value 0 where there are no terms). Empty tables give no rows; repeated rows count as often as they stand; further columns are not read.
Equal values are ranked by item in byte order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limbwise.functions.scans import positions
from limbwise.sources.workspace import cut

HELD = 300_000
#: Terms of a block, and counts (terms times groups) that a block may hold; groups of a slice
BLOCK, CELLS, SLICE = 4096, 1 << 21, 64
UNIT = 1_000_000_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")
OUT = "lang string, source string, part string, item string, value bigint"


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term`` with occurrences ``n`` and documents ``d``, stored; each group also has a row without a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes | None, list[int]]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(*group, term, *x) for group, terms in held.items() for term, x in terms.items()]
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["lang", "source", "term", "n", "d"])
        for batch in batches:
            for lang, source, text in zip(*map(list, batch.columns)):
                terms = held.setdefault((lang.as_py(), source.as_py()), {None: [0, 0]})
                before = len(terms)
                for term, k in Counter(_TERM.findall((text.as_py() or b"").lower())).items():
                    x = terms.get(term)
                    if x is None:
                        terms[term] = [k, 1]
                    else:
                        x[0] += k
                        x[1] += 1
                size += len(terms) - before
                if size >= HELD:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(count, "lang string, source string, term binary, n bigint, d bigint")
    return cut(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "term-counts")


def share(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + terms)), three decimal digits at a time; right while the divisor is below 9e15."""
    whole, rest = np.divmod(count + 1, total + terms)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total + terms)
        whole = whole * 1000 + digit
    return 1 + whole


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def consed(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Distinct leaf counts, the children (left, right) of each node by level from the leaves up, and the root of each row."""
    values, at = np.unique(counts, return_inverse=True)
    at, levels, size = at.reshape(counts.shape).astype(np.int64), [], len(values)
    while at.shape[1] > 1:
        nodes, inverse = np.unique(at[:, ::2] * size + at[:, 1::2], return_inverse=True)
        levels.append((nodes // size, nodes % size))
        at, size = inverse.reshape(len(counts), -1).astype(np.int64), len(nodes)
    return values, levels, at[:, 0]


def _merged(pair: np.ndarray, x: np.ndarray, y: np.ndarray, times: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    key, inverse = np.unique((pair * size + x) * size + y, return_inverse=True)
    sums = np.zeros(len(key), np.int64)
    np.add.at(sums, inverse, times)
    return key // (size * size), key // size % size, key % size, sums


def pair_values(tree: tuple, totals: np.ndarray, terms: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prices of the groups ``a`` against ``b`` and of ``b`` against ``a``, summed over the terms of a block; a leaf of -1 is no term."""
    values, levels, top = tree
    pair, x, y, times = np.arange(len(a)), top[a], top[b], np.ones(len(a), np.int64)
    for left, right in reversed(levels):
        pair, x, y, times = np.tile(pair, 2), np.concatenate((left[x], right[x])), np.concatenate((left[y], right[y])), np.tile(times, 2)
        below = int(max(left.max(), right.max())) + 1
        pair, x, y, times = _merged(pair, x, y, times, below)
    real = values[x] >= 0
    pair, x, y, times = pair[real], x[real], y[real], times[real]
    p, q = (share(values[v], totals[g[pair]], np.int64(terms)) for v, g in ((x, a), (y, b)))
    out = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    np.add.at(out[0], pair, times * price(p, q))
    np.add.at(out[1], pair, times * price(q, p))
    return out


def _block_rows(sources: list[str], totals: np.ndarray, terms: int, low: int, high: int, at: np.ndarray, group: np.ndarray,
                n: np.ndarray, names: np.ndarray, top: int) -> Iterator[tuple]:
    """(source, part, item, value) of a block: parts of the pairs whose first group is in [low, high), and the best terms of these groups."""
    size = len(names)
    width = 1 << max(0, (size - 1).bit_length())
    counts = np.full((len(sources), width), -1, np.int64)
    counts[:, :size] = 0
    counts[group, at] = n
    tree = consed(counts)
    step = max(1, CELLS // (width * max(1, len(sources))))
    for first in range(low, high, step):
        a, b = np.nonzero(np.arange(first, min(high, first + step))[:, None] < np.arange(len(sources))[None, :])
        a += first
        for i, j, to, back in zip(a, b, *pair_values(tree, totals, terms, a, b)):
            yield sources[i], "pair", sources[j], int(to)
            yield sources[j], "pair", sources[i], int(back)
    if not size:
        return
    whole = counts[:, :size].sum(0)
    q = share(whole, np.int64(totals.sum()), np.int64(terms))
    for g in range(low, high):
        p = share(counts[g, :size], totals[g], np.int64(terms))
        good = np.flatnonzero((counts[g, :size] > 0) & (p > q))
        value = price(p[good], q[good])
        for k in np.lexsort((names[good], -value))[:top]:
            yield sources[g], "term", names[good[k]].decode("utf-8", "surrogatepass"), int(value[k])


def divergences(docs: DataFrame, least: int = 3, top: int = 200, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: every pair of sources of a language, and the ``top`` terms of each group."""
    counts = term_counts(docs)
    whole = Window.partitionBy("lang", "term")
    kept = cut(counts.where("term IS NOT NULL").withColumn("_d", F.sum("d").over(whole)).where(F.col("_d") >= least)
               .select("lang", "source", "term", "n", F.sum("n").over(whole).alias("total")), "kept")
    vocabulary = kept.groupBy("lang", "term").agg(F.max("total").alias("total"))
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = counts.where("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").select(
        "lang", F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("g"))
    langs = cut(every.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("groups")).join(sizes, "lang", "left")
                .withColumn("terms", F.coalesce("terms", F.lit(0))), "langs")
    widest = langs.agg(F.max(F.size("groups"))).first()[0] or 1
    block = max(1, min(block, CELLS // widest))
    hashed = F.xxhash64("term")
    sized = vocabulary.withColumn("_h", hashed).withColumn(
        "_slice", (F.lit(64) - F.floor(F.log2("total"))) * 4096 + F.shiftrightunsigned("_h", 52))
    ids = positions(sized, ["lang"], "_slice", [F.col("_slice"), F.col("_h"), F.col("term")], "id").select(
        "lang", "term", F.floor((F.col("id") - 1) / block).cast("bigint").alias("block"), ((F.col("id") - 1) % block).cast("int").alias("at"))
    entries = (kept.select("lang", "source", "term", "n").join(ids, ["lang", "term"])
               .groupBy("lang", "block").agg(F.collect_list(F.struct("at", "source", "n", "term")).alias("e")))
    n_groups = F.size("groups")
    spread = (langs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("terms") / block) - 1, F.lit(0)).cast("bigint"))))
              .withColumn("low", F.explode(F.sequence(F.lit(0), n_groups - 1, F.lit(SLICE)))))
    work = spread.join(entries, ["lang", "block"], "left").select("lang", "groups", "terms", "low", "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field(f.split()[0], pa.int64() if f.split()[1] == "bigint" else pa.string()) for f in OUT.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                lang, terms, low = (batch.column(k)[i].as_py() for k in (0, 2, 3))
                groups = batch.column(1)[i].values
                sources, totals = groups.field("source"), groups.field("total").to_numpy(zero_copy_only=False)
                e = batch.column(4)[i].values if batch.column(4)[i].is_valid else None
                at = group = n = np.zeros(0, np.int64)
                names = np.zeros(0, object)
                if e is not None:
                    at, n = (e.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
                    group = pa.compute.index_in(e.field("source"), value_set=sources).to_numpy(zero_copy_only=False).astype(np.int64)
                    names = np.empty(int(at.max()) + 1, object)
                    names[at] = e.field("term").to_numpy(zero_copy_only=False)
                listed = sources.to_pylist()
                rows = list(_block_rows(listed, totals, terms, low, min(low + SLICE, len(listed)), at, group, n, names, top))
                if rows:
                    source, part, item, value = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([lang] * len(rows), source, part, item, value), fields)], schema=pa.schema(fields))
    parts = cut(work.mapInArrow(run, OUT), "divergences")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = parts.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(best)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT rid, lang, source, unnest(ws) AS term FROM t),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
c AS (SELECT w.lang, source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY ALL),
g AS (SELECT a.lang, a.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM t) a LEFT JOIN c ON a.lang = c.lang AND a.source = c.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p,
      1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
      FROM g JOIN kept k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT pairs.lang, pairs.source, 'pair' AS part, pairs.item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums ON pairs.lang = sums.lang AND pairs.source = sums.source AND pairs.item = sums.item
 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""
