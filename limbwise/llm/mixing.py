"""Mixing sources to target weights (operator 7); DataFrame functions only.

The words of a source, its documents in a pseudorandom order, are packed into blocks of ``BLOCK``. Sources in code
point order, null last, weigh 5, 2, 1, 5, ... and share 100 % of all words; no target exceeds three times its
source, and what is over goes to the others by weight. A target is so many blocks. Output shards have ``SHARD`` slots;
every slot draws its source by hash, so the counts of a shard are multinomial. What a source has drawn
beyond its blocks, in shard order, passes to the sources that drew too few, so totals are exact. The slots of a
source are numbered through all shards; number i takes block p(i mod n) of pass i div n, where p is a
swap-or-not permutation of the n blocks, another one for each pass. So a block is taken again only when all
others have been, three times at most, and shards, sources or blocks need no order to be sorted.

Running numbers use slices (``functions.scans``), so a source with a third of all rows is spread over tasks.

Null text: size 0, never taken. Null source: a source of its own. Repeated rows are packed one after the
other. No words at all: targets of 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limbwise.functions.scans import Scan, running
from limbwise.llm.words import word_array, word_count
from limbwise.sources.workspace import cut

WEIGHTS, CAP = (5, 2, 1), 3
BLOCK, SHARD, BINS, ROUNDS, SEED = 128, 1024, 1024, 12, 20_240_607


def _big(n: Column | str | int) -> Column:
    return (F.lit(n) if isinstance(n, int) else F.col(n) if isinstance(n, str) else n).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """One narrow row per document: ``doc_id``, ``source``, ``skey`` (never null), ``h`` and ``size``."""
    return docs.select("doc_id", "source", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("skey"),
                       F.xxhash64("doc_id", "text", "source").alias("h"), word_count(F.col("text")).alias("size"))


def targets(rows: DataFrame) -> DataFrame:
    """Per source: ``source_size``, ``target``, its ``blocks`` and the number of slots ``quota``.

    One row per source is ordered in one task, as ranks and the water level run over all of them. A source is capped if
    its cap per weight lies below the level that the remaining words and weights give.
    """
    weights = F.array(*[_big(w) for w in WEIGHTS])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = (rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
            .withColumn("rank", F.row_number().over(by_name) - 1)
            .withColumn("weight", F.element_at(weights, (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
            .withColumn("ratio", CAP * F.col("source_size") / F.col("weight"))
            .withColumn("left_words", F.sum("source_size").over(everything) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
            .withColumn("level", F.col("left_words") / F.col("left_weight"))
            .withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(
                by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            .withColumn("target", F.least(CAP * F.col("source_size").cast("double"), F.col("weight") * F.col("level")))
            .withColumn("blocks", F.ceil(F.col("source_size") / BLOCK)))
    return sums.select("skey", "source", "source_size", "target", "blocks", F.when(F.col("source_size") > 0, F.least(
        CAP * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")))).otherwise(0).cast("bigint").alias("quota"))


def drawn(sources: DataFrame) -> DataFrame:
    """``shard``, ``skey`` and ``n``: multinomial draws per shard, then moved so that each source has its quota."""
    by_key = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut(sources.select("skey", "quota", F.coalesce(F.sum("quota").over(by_key), F.lit(0)).alias("lo"),
                               F.sum("quota").over(Window.partitionBy()).alias("total")).where("quota > 0"), "spans")
    slots = int(spans.agg(F.sum("quota")).first()[0] or 0)
    most = max(slots, 1)
    bins = min(BINS, most)
    bin_of = lambda v: F.floor(v * bins / most).cast("int")
    spark = spans.sparkSession
    draws = (spark.range(slots).select(F.floor(F.col("id") / SHARD).alias("shard"), F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(most)).alias("v"))
             .withColumn("bin", bin_of(F.col("v"))))
    covers = spans.select("skey", "lo", (F.col("lo") + F.col("quota")).alias("hi"), F.explode(F.sequence(
        bin_of(F.col("lo")), bin_of(F.col("lo") + F.col("quota") - 1))).alias("bin"))
    first = (draws.join(covers, "bin").where((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi")))
             .groupBy("shard", "skey").agg(F.count("*").alias("n")).withColumn("slice", F.floor(F.col("shard") / 256)))
    first = cut(running(cut(first, "draws"), ["skey"], "slice", [F.col("shard")], {"upto": Scan("sum", F.col("n"), inclusive=False)})
                .join(spans.select("skey", "quota"), "skey")
                .withColumn("kept", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("upto")))), "kept")
    freed = first.groupBy("shard", "slice").agg(F.sum(F.col("n") - F.col("kept")).alias("free")).where("free > 0")
    freed = (running(freed, [], "slice", [F.col("shard")], {"g": Scan("sum", F.col("free"), inclusive=False)})
             .select("shard", F.explode(F.sequence(F.col("g"), F.col("g") + F.col("free") - 1)).alias("g")))
    lacking = (spans.select("skey", "quota").join(first.groupBy("skey").agg(F.sum("kept").alias("has")), "skey", "left")
               .select("skey", (F.col("quota") - F.coalesce("has", F.lit(0))).alias("lack")).where("lack > 0")
               .withColumn("g", F.coalesce(F.sum("lack").over(by_key), F.lit(0)))
               .select("skey", F.explode(F.sequence(F.col("g"), F.col("g") + F.col("lack") - 1)).alias("g")))
    moved = freed.join(lacking, "g").groupBy("shard", "skey").agg(F.count("*").alias("n"))
    return first.select("shard", "skey", F.col("kept").alias("n")).union(moved).groupBy("shard", "skey").agg(F.sum("n").alias("n")).where("n > 0")


def permuted(index: Column, n: Column, *names: Column) -> Column:
    """Swap-or-not permutation of 0..n-1, one for each value of ``names``: a round swaps x with k - x by a bit of the pair's hash."""
    def swap(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *names, i), n) - x, n)
        bit = F.xxhash64(F.lit(SEED + 1), *names, i, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), _big(index), swap)


def slots(sources: DataFrame) -> DataFrame:
    """``skey``, ``shard``, ``block`` of every output slot."""
    counts = cut(drawn(sources).withColumn("slice", F.floor(F.col("shard") / 256)), "counts")
    numbered = running(counts, ["skey"], "slice", [F.col("shard")], {"i": Scan("sum", F.col("n"), inclusive=False)})
    return (numbered.join(sources.select("skey", "blocks"), "skey")
            .select("skey", "shard", "blocks", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)).alias("i"))
            .select("skey", "shard", permuted(F.col("i") % F.col("blocks"), F.col("blocks"), F.col("skey"), F.floor(F.col("i") / F.col("blocks"))).alias("block")))


def packed(rows: DataFrame) -> DataFrame:
    """The rows with ``begin``, the place of their first word among their source's."""
    sliced = rows.withColumn("slice", F.shiftright("h", 52))
    return running(sliced, ["skey"], "slice", [F.col("h"), F.col("doc_id")], {"begin": Scan("sum", F.col("size"), inclusive=False)}).drop("slice")


def pieces(places: DataFrame) -> DataFrame:
    """The words of documents by block: ``skey``, ``begin``, ``block``, ``at`` (first word in the document) and ``n``."""
    end = F.col("begin") + F.col("size")
    first = lambda c: F.floor(c / BLOCK)
    cuts = places.where("size > 0").select("skey", "h", "begin", "size", F.explode(F.sequence(first(F.col("begin")), first(end - 1))).alias("block"))
    lo = F.greatest("begin", F.col("block") * BLOCK)
    return cuts.select("skey", "h", "begin", "block", (lo - F.col("begin")).alias("at"), (F.least(end, (F.col("block") + 1) * BLOCK) - lo).alias("n"))


def mixture(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their place, sources with their targets, and the mix: every piece of every slot with its shard."""
    rows = cut(sized(docs), "sizes")
    sources = cut(targets(rows), "targets")
    places = cut(packed(rows), "places")
    return places, sources, slots(sources).join(pieces(places), ["skey", "block"])


def taken(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of every document."""
    places, sources, mix = mixture(docs)
    words = mix.groupBy("skey", "begin").agg(F.sum("n").alias("taken"))
    return (places.join(words.withColumn("some", F.lit(True)), (places["skey"] == words["skey"]) & (places["begin"] == words["begin"]) & (places["size"] > 0), "left")
            .select("doc_id", places["skey"], "source", "size", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
            .join(sources.select("skey", "source_size", "target"), "skey")
            .select("doc_id", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents with their own columns: copy k of a document holds its words that were taken more than k times.

    A copy with all words keeps the text as it is; a part has its words joined by blanks.
    """
    places, _, mix = mixture(docs)
    uses = mix.groupBy("skey", "begin", "at").agg(F.first("h").alias("h"), F.first("n").alias("n"), F.count("*").alias("uses"))
    parts = uses.groupBy("skey", "begin").agg(F.first("h").alias("h"), F.array_sort(F.collect_list(F.struct("at", "n", "uses"))).alias("parts"))
    again = Window.partitionBy("h").orderBy("begin")
    parts = parts.withColumn("nth", F.row_number().over(again)).select("h", "nth", "parts")
    all_of = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(F.xxhash64("doc_id", "text", "source").alias("h"), all_of.alias("doc"))
    numbered = named.withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("h")))
    copies = (numbered.join(parts, ["h", "nth"]).withColumn("size", F.aggregate("parts", _big(0), lambda a, p: a + p["n"]))
              .withColumn("copy", F.explode(F.sequence(_big(0), F.array_max(F.transform("parts", lambda p: p["uses"])) - 1)))
              .withColumn("here", F.filter("parts", lambda p: p["uses"] > F.col("copy"))))
    found = word_array(F.col("doc.text"))
    some = F.array_join(F.flatten(F.transform("here", lambda p: F.slice(F.col("found"), (p["at"] + 1).cast("int"), p["n"].cast("int")))), " ")
    whole = (F.aggregate("here", _big(0), lambda a, p: a + p["n"]) == F.col("size")) & (F.col("size") == F.size("found"))
    out = copies.withColumn("found", found).withColumn("new", F.when(whole, F.col("doc.text")).otherwise(some))
    cols = {c: F.col("doc").getField(c).alias(c) for c in docs.columns}
    cols["text"] = F.col("new").alias("text")
    if "n_chars" in cols:
        cols["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*cols.values())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
