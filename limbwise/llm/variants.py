"""Spelling variants over pairs of trie nodes (operator 12).

Two words are near if one inserted, deleted or replaced code point turns one into the other. All prefixes of
the words are numbered as nodes of a forward trie and all suffixes as nodes of a reversed one. A word leaves the
pairs (prefix node, suffix node) around each skipped position and around each gap between positions: equal pairs of two
skips are words that differ by a replacement, a skip that meets a gap is an insertion. Prefix and suffix are whole strings, so equal
pairs are exact neighbours and nothing is verified afterwards.

A pair of nodes fixes all but one code point, so a group holds one word at its gap and at most one word per letter of the
alphabet (90 here), whatever the corpus; inside a group only the count and the two most frequent
members are needed, so pairs of words are never listed. Of equal letters in a row only the first counts as a deletion,
so each neighbour is counted once.

Nodes are numbered over the sorted words, cut in ranges of about ``PART_LETTERS`` letters: a new node is counted within its range, and the
nodes on the border of two ranges (prefixes of both words beside it) are numbered from the list of borders, two words a range. Work and rows grow with the letters
of the distinct words, also for words of any length.

Null text has no words; a null id reads as an empty text where runs are altered. Empty tables give no rows; repeated rows count as
often as they stand; further columns are not read. Of near words with equal counts the first in code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limbwise.sources.workspace import cut

PART_LETTERS = 400_000
#: Distinct words that a task holds before it gives them out
HELD = 300_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def run_counts(docs: DataFrame, shortest: int = 5, every: int = 97) -> DataFrame:
    """``word`` and its occurrences ``n``: letter runs of all texts, of which a checksum of id and run alters one in ``every``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                data = text.as_py()
                if not data:
                    continue
                begun = zlib.crc32(f"{doc.as_py()}:".encode())
                for run, k in Counter(_RUN.findall(data.lower().decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(run.encode(), begun)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= shortest:
                        held[run] += k
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _shared(a: str, b: str) -> int:
    return len(commonprefix((a, b)))


def border_nodes(edges: list[tuple[str, str]]) -> list[tuple[str, list[int]]]:
    """For the border before each range and one after the last: the prefix that the words on both sides share, and its nodes by depth.

    ``edges`` has the first and the last word of each range in order; depth 0 is the root, number 0.
    """
    shared = ["", *(commonprefix((a[1], b[0])) for a, b in zip(edges, edges[1:])), ""]
    out, path, before, last = [], [0], "", 0
    for prefix in shared:
        del path[_shared(before, prefix) + 1:]
        while len(path) <= len(prefix):
            last += 1
            path.append(last)
        out.append((prefix, list(path)))
        before = prefix
    return out


def trie_nodes(words: DataFrame, backward: bool, parts: int) -> DataFrame:
    """``word``, ``place`` (grows with the order of the words), ``path`` (node of each prefix by length, from 0) and ``leads`` (is the
    letter unlike the one before it); ``backward`` numbers suffixes."""
    spelled = words.select("word", (F.reverse("word") if backward else F.col("word")).alias("s"))
    placed = cut(spelled.repartitionByRange(parts, "s").withColumn("part", F.spark_partition_id()), "spelled")
    edges = placed.groupBy("part").agg(F.min("s").alias("a"), F.max("s").alias("b")).orderBy("part").collect()
    borders = border_nodes([(e["a"], e["b"]) for e in edges])
    sides = {e["part"]: (borders[k], borders[k + 1]) for k, e in enumerate(edges)}
    sent = words.sparkSession.sparkContext.broadcast(sides)

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        (left, left_nodes), (right, right_nodes) = sent.value[part]
        base, before, path, paths, leads = (part + 1) << 40, "", [0], [], []
        rows = sorted(zip(pdf["s"], pdf["word"]))
        for s, word in rows:
            kept = _shared(before, s)
            del path[kept + 1:]
            a, b = _shared(left, s), _shared(right, s)
            for d in range(kept + 1, len(s) + 1):
                if d <= a:
                    path.append(left_nodes[d])
                elif d <= b:
                    path.append(right_nodes[d])
                else:
                    base += 1
                    path.append(base)
            paths.append(list(path))
            leads.append([] if backward else [True, *(x != y for x, y in zip(word, word[1:]))])
            before = s
        first = (part + 1) << 40
        return pd.DataFrame({"word": [w for _, w in rows], "place": range(first, first + len(rows)), "path": paths, "leads": leads})
    return placed.groupBy("part").applyInPandas(number, "word string, place bigint, path array<bigint>, leads array<boolean>")


def node_pairs(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """``before``, ``after`` and member ``m`` for each skipped position and each gap of each word.

    ``forward`` has the words with ``n``. A member sorts by falling count, then by the word's place.
    """
    both = forward.join(backward.select("word", F.reverse("path").alias("back")), "word")
    size = F.size("path")
    member = lambda skip, lead: F.struct((-F.col("n")).alias("less"), F.col("place").alias("place"), F.lit(skip).alias("skip"), lead.alias("lead"))
    skips = F.transform(F.arrays_zip(F.slice("path", F.lit(1), size - 1).alias("a"), F.slice("back", F.lit(2), size - 1).alias("b"), F.col("leads").alias("l")),
                        lambda x: F.struct(x["a"].alias("before"), x["b"].alias("after"), member(True, x["l"]).alias("m")))
    gaps = F.transform(F.arrays_zip(F.col("path").alias("a"), F.col("back").alias("b")),
                       lambda x: F.struct(x["a"].alias("before"), x["b"].alias("after"), member(False, F.lit(False)).alias("m")))
    return both.select(F.explode(F.concat(skips, gaps)).alias("x")).select("x.*")


def nearest_words(pairs: DataFrame) -> DataFrame:
    """``place`` of each word that has near words, their number ``n_near`` and the ``best`` of them."""
    groups = pairs.groupBy("before", "after").agg(F.array_sort(F.collect_list("m")).alias("g")).where(F.size("g") > 1)
    counted = groups.select("g", F.size(F.filter("g", lambda x: x["skip"])).alias("skips"), F.size(F.filter("g", lambda x: x["lead"])).alias("leads"))

    def found(x):
        near = F.when(x["skip"], F.col("skips") - 1 + F.when(x["lead"] & (F.size("g") > F.col("skips")), 1).otherwise(0)).otherwise(F.col("leads"))
        other = F.when(F.col("g")[0]["place"] == x["place"], F.col("g")[1]).otherwise(F.col("g")[0])
        return F.struct(x["place"].alias("place"), near.alias("near"), F.struct(other["less"].alias("less"), other["place"].alias("place")).alias("best"))
    return (counted.select(F.explode(F.transform("g", found)).alias("x")).groupBy("x.place")
            .agg(F.sum("x.near").cast("bigint").alias("n_near"), F.min("x.best").alias("best")))


def roots(links: DataFrame) -> DataFrame:
    """``place`` and the ``root`` it leads to over ``up``. Each round doubles the steps a pointer has gone;
    counts at least double with each step, so chains and rounds are short."""
    at = cut(links.select("place", "up", F.lit(False).alias("ended")), "links")
    while not at.where("NOT ended").isEmpty():
        ahead = at.select(F.col("place").alias("up"), F.col("up").alias("_up"), F.col("ended").alias("_ended"))
        moved = at.where("NOT ended").join(ahead, "up", "left").select(
            "place", F.coalesce("_up", "up").alias("up"), F.coalesce("_ended", F.lit(True)).alias("ended"))
        at = cut(at.where("ended").unionByName(moved), "links")
    return at.select("place", F.col("up").alias("root"))


def variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table of distinct words with counts ``n``."""
    stored = cut(counts.select("word", "n"), "words")
    letters = stored.agg(F.sum(F.length("word"))).first()[0] or 0
    parts = max(1, -(-letters // PART_LETTERS))
    forward = cut(trie_nodes(stored, False, parts).join(stored, "word"), "forward")
    near = nearest_words(node_pairs(forward, trie_nodes(stored, True, parts)))
    grows = -F.col("best.less") >= ratio * F.col("n")
    known = cut(forward.select("place", "word", "n").join(near, "place", "left").select(
        "place", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(grows, F.col("best.place")).alias("up")), "near")
    names = known.select(F.col("place").alias("at"), F.col("word").alias("name"), F.col("n").alias("name_n"))
    top = roots(known.where("up IS NOT NULL").select("place", "up"))
    formed = (known.join(names.select(F.col("at").alias("up"), F.col("name").alias("form"), F.col("name_n").alias("form_n")), "up", "left")
              .join(top, "place", "left"))
    named = formed.join(names.select(F.col("at").alias("root"), F.col("name").alias("root_word")), "root", "left")
    return named.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(run_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("n >= 3"))
