"""Line deduplication as an exact set-similarity join (operator 3); DataFrame functions only.

A line is the set of its words. Two lines match when the Jaccard similarity of their sets is 0.8 or more. In the order
of (doc_id, line number) a line goes when an earlier line of any document matches it, be that one kept or not.

Equal lines (by 128 bits of hash) are one text with its first place. Words are ordered by rarity: a byte of logarithm of the corpus count of
each of ``BUCKETS`` hash buckets gives their order (a fixed-size table, whatever the vocabulary). Texts that
match share a word among the first n - ceil(0.8 n) + 1 of each; those meet by equi-join on the word and a class of lengths, and are let through only if
their lengths, the places of the shared word, and a parity sketch of both sets (its differing bits are at
most the differing words) allow 0.8; the sketch has 64 bits, 128 where both have more than ``WIDE`` words. The pairs left are verified on their words.
Where many near copies crowd together their links are counted without making the pairs: see ``counted_links``. Hot lines are
counted before they are shuffled, and hot words are the last in order, so they rarely meet at all.

Lines are fetched for verification, and documents rebuilt, only where a bitmap marks them; it has some 16 bits a key up to ``MARKS`` longs (8 MB) and
may mark too many, never too few. Null text stays null. Lines without words never match and stay. Rows equal in doc_id and
text are one document and get the same result. Null ids come first. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limbwise.llm.components import components
from limbwise.llm.words import GAP
from limbwise.sources.workspace import cut

BUCKETS, MARKS, WIDE = 1 << 18, 1 << 20, 80
KEYS, HUBS, FIRST = 2, 4, -(1 << 63)
CROWD, GROUP, BLOCK = 256, 32, 256
SPAN = 1.25 ** 3


def _long(n: Column | int) -> Column:
    return (F.lit(n) if isinstance(n, int) else n).cast("bigint")


def _bit(n: Column) -> Column:
    """A long with the bit set that the last six bits of ``n`` name."""
    return F.call_function("shiftleft", _long(1), n.bitwiseAND(63).cast("int"))


def dense(df: DataFrame, key: str, value: str, size: int) -> Column:
    """``value`` by ``key`` 0 .. size - 1 as one array, 0 where there is none: a scalar of fixed size."""
    every = df.sparkSession.range(size).join(df.select(F.col(key).cast("bigint").alias("id"), F.col(value).alias("v")), "id", "left")
    one = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0)).cast("bigint").alias("v")))).alias("all"))
    return cut(one.select(F.transform("all", lambda x: x["v"]).alias("all")), "dense").scalar()


def marked(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """Test by a bitmap of the stored ``keys``, held as an array: does the bit of a key stand."""
    size = 64
    while size < MARKS and 4 * size < keys.count():
        size *= 2
    place = lambda k: F.pmod(k, _long(64 * size))
    words = keys.select(F.shiftright(place(F.col(key)), 6).alias("at"), _bit(place(F.col(key))).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    bitmap = dense(words, "at", "bits", size)
    return lambda k: F.get(bitmap, F.shiftright(place(k), 6).cast("int")).bitwiseAND(_bit(place(k))) != 0


def _words(line: Column) -> Column:
    """Words of a text; the usual one, without tabs and the like, is split at single spaces, which needs no pattern."""
    rare = F.lit(False)
    for c in "\t\n\x0b\x0c\r":
        rare = rare | F.contains(line, F.lit(c))
    return F.array_remove(F.when(rare, F.split(line, GAP)).otherwise(F.split(line, " ")), "")


def _bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(BUCKETS - 1)


def rarity(docs: DataFrame) -> Column:
    """Rank of every hash bucket of words, the rarest first, as one constant array of ``BUCKETS`` numbers below 128."""
    counted = (docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.explode(_words(F.col("line"))).alias("w"))
               .groupBy(_bucket(F.col("w")).alias("bucket")).agg(F.count("*").alias("n")).toArrow())
    ranks = np.zeros(BUCKETS, np.int64)
    ranks[counted["bucket"].to_numpy()] = np.minimum(4 * np.log2(1.0 + counted["n"].to_numpy()), 127)
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")


def document_key() -> Column:
    return F.xxhash64("doc_id", "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """``id`` and ``check`` (hashes of the line), ``place`` (doc_id, key, line number) and ``line`` of every line that has a word.

    The key is made below the explode, so that the whole text is hashed once for a document and not once for a line.
    """
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), document_key().alias("key"), "text")
            .select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("at", "line"))
            .where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
            .select(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("check"), F.struct("doc_id", "key", "at").alias("place"), "line"))


def _tokens(line: Column, ranks: Column) -> Column:
    """Distinct words of a line as longs: rank of the bucket, then bits of the hash; ascending, so rarest first."""
    rank = lambda w: F.coalesce(F.get(ranks, _bucket(w)), _long(0))
    return F.sort_array(F.array_distinct(F.transform(_words(line), lambda w: F.shiftleft(rank(w), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 8)))))


def shaped(lines: DataFrame, ranks: Column) -> DataFrame:
    """``lines`` with ``shape`` for their ``line`` and place: the ``doc`` (``FIRST`` if null), ``n`` words, the halves ``s0`` and ``s1`` of the sketch, the ``prefix`` of tokens and ``keys``.

    Up to ``WIDE`` words ``s0`` is the whole sketch folded to 64 bits, ``s1`` is 0. Keys are the ``KEYS`` least hashes of prefix tokens that are not the
    rarest. What several figures use is a column of its own, as the optimizer leaves such a projection apart; its sort then runs on plain longs.
    """
    n, kept = F.size("t"), [c for c in lines.columns if c not in ("line", "place")]
    sketch = lambda tokens: F.aggregate(tokens, _long(0), lambda a, t: a.bitwiseXOR(_bit(t)))
    made = lines.select(*kept, F.coalesce("place.doc_id", _long(FIRST)).alias("doc"), _tokens(F.col("line"), ranks).alias("t"))
    half = F.when(n > WIDE, sketch(F.filter("t", lambda t: t.bitwiseAND(64) != 0))).otherwise(_long(0))
    prefix = F.slice("t", F.lit(1), n - F.floor((4 * n + 4) / 5).cast("int") + 1)
    keys = F.slice(F.sort_array(F.transform(F.filter("prefix", lambda t: F.shiftright(t, 56) > 4), lambda t: F.xxhash64(t))), 1, KEYS)
    return (made.select(*kept, "doc", n.alias("n"), half.alias("s1"), sketch(F.col("t")).alias("s"), prefix.alias("prefix"))
            .select(*kept, F.struct("doc", "n", F.col("s").bitwiseXOR(F.col("s1")).alias("s0"), "s1", "prefix", keys.alias("keys")).alias("shape")))


def shapes(lines: DataFrame, texts: DataFrame, ranks: Column) -> DataFrame:
    """Each line text once, with its first document.

    Two bitmaps tell which lines may have copies and which of them may be the first; only those are brought together by ``id``.
    """
    repeated = marked(cut(texts.where("copies > 1").select("id"), "copied"), "id")(F.col("id"))
    firsts = cut(texts.where(repeated).select(F.xxhash64("id", "place").alias("first")), "firsts")
    needed = lines.where(~repeated | marked(firsts, "first")(F.xxhash64("id", "place")))
    made = cut(shaped(needed.withColumn("again", repeated), ranks), "shapes")
    again = made.where("again").groupBy("id", "check").agg(F.min("shape").alias("shape"))
    return made.where("not again").select("id", "shape.*").union(again.select("id", "shape.*"))


def prefix_rows(texts: DataFrame, *more: str) -> DataFrame:
    return texts.select("id", "n", "s0", "s1", *more, F.posexplode("prefix").alias("pos", "token"))


def need() -> Column:
    """Words that texts of ``n_a`` and ``n_b`` words must share."""
    return F.floor((4 * (F.col("n_a") + F.col("n_b")) + 8) / 9)


def close() -> Column:
    """Do the lengths and sketches of the sides ``_a`` and ``_b`` allow a match."""
    s0, s1 = (F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")) for c in ("s0", "s1"))
    differ = F.when(F.least("n_a", "n_b") > WIDE, F.bit_count(s0) + F.bit_count(s1)).otherwise(F.bit_count(s0.bitwiseXOR(s1)))
    return (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")) & (differ <= F.col("n_a") + F.col("n_b") - 2 * need())


def size_classes() -> Column:
    """Classes of lengths in which a prefix row of ``n`` words at ``pos`` is met: its own and, if it may be the shorter side of a match, that of 1.25 n words.

    A class spans a factor of ``SPAN``. The shorter side of a match shares one of its first n - ceil(8 / 9 n) + 1 words.
    """
    of = lambda n: F.floor(F.log(SPAN, n)).cast("int")
    own, longer = of(F.col("n").cast("double")), of(1.25 * F.col("n"))
    return F.when((longer > own) & (9 * F.col("pos") <= F.col("n")), F.array(own, longer)).otherwise(F.array(own))


def met(rows: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Pairs (``a`` below ``b``) of different line texts that pass the prefix, length, position and sketch filters, and ``wanted`` of the columns of both.

    They meet by a token and a class of lengths, so that a frequent token brings together only texts of about one length. All columns are used of
    both sides, so that one shuffle serves both.
    """
    others = [c for c in rows.columns if c != "token"]
    rows = rows.select(*others, "token", F.explode(size_classes()).alias("size")).select(*others, F.xxhash64("token", "size").alias("key"))
    a, b = (rows.select(*[F.col(c).alias(f"{c}_{s}") for c in rows.columns]) for s in "ab")
    reach = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need()
    longer = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    on = (F.col("key_a") == F.col("key_b")) & longer & close() & reach
    return a.join(b, on if wanted is None else on & wanted).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def crowd_pairs(texts: DataFrame, most: int) -> DataFrame:
    """Pairs of a text and a close one among the ``HUBS`` first of those that share a key with it, for keys of more than ``most`` texts."""
    keys = texts.select(F.explode("keys").alias("key"))
    crowded = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"), "crowded")
    return met_hubs(texts.select("id", "n", "s0", "s1", "doc", F.explode("keys").alias("key")).where(marked(crowded, "key")(F.col("key"))))


def met_hubs(keys: DataFrame) -> DataFrame:
    before = Window.partitionBy("key").orderBy("doc", "id").rowsBetween(Window.unboundedPreceding, -1)
    shape = F.struct(*[F.col(c).alias(f"{c}_a") for c in ("id", "n", "s0", "s1")])
    hubs = keys.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "n", "s0", "s1")], F.array(*[F.nth_value(shape, k + 1).over(before) for k in range(HUBS)]).alias("hubs"))
    pairs = hubs.select("id_b", "n_b", "s0_b", "s1_b", F.explode("hubs").alias("hub")).select("*", "hub.*").where(F.col("id_a").isNotNull() & (F.col("id_a") != F.col("id_b")) & close())
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def late_links(lines: DataFrame, texts: DataFrame, ranks: Column) -> DataFrame:
    """Links enough to tell of every line text whether an earlier one matches it, without all pairs of a group of near copies.

    First the texts of a key shared by more than ``GROUP`` meet a few hubs, early texts that share it. What a hub proves to be late is settled; the
    texts that are still open then meet all that may be earlier than they.
    """
    stored = shapes(lines, texts, ranks)
    proved = links(lines, texts, cut(crowd_pairs(stored, GROUP), "pairs"))
    late = F.when(F.col("place_b") < F.col("place_a"), F.col("a.id")).otherwise(F.col("b.id"))
    settled = cut(proved.select(late.alias("id")).distinct(), "settled")
    perhaps = marked(settled, "id")(F.col("id"))
    flagged = stored.where(~perhaps).withColumn("open", F.lit(True)).union(
        stored.where(perhaps).join(settled.withColumn("known", F.lit(True)), "id", "left").withColumn("open", F.col("known").isNull()).select(*stored.columns, "open"))
    earlier = (F.col("open_b") & (F.col("doc_a") <= F.col("doc_b"))) | (F.col("open_a") & (F.col("doc_b") <= F.col("doc_a")))
    return proved.unionByName(links(lines, texts, cut(met(prefix_rows(flagged, "doc", "open"), earlier), "pairs")))


def counted_links(lines: DataFrame, texts: DataFrame, ranks: Column) -> DataFrame:
    """``id``, ``check``, the number of all ``links`` and ``late`` (is there a link to an earlier text) of every line text that has one.

    Texts of crowded keys meet a few hubs; those that are close make components. Links inside a component are counted block by block, with no row
    for a pair; only texts that are not of one component meet by the prefix join.
    """
    stored = shapes(lines, texts, ranks)
    labels = cut(components(crowd_pairs(stored, CROWD).select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "id"), "labels")
    perhaps = marked(labels, "id")(F.col("id"))
    labelled = stored.where(~perhaps).withColumn("label", F.lit(None).cast("bigint")).union(stored.where(perhaps).join(labels, "id", "left").select(*stored.columns, "label"))
    apart = F.col("label_a").isNull() | F.col("label_b").isNull() | (F.col("label_a") != F.col("label_b"))
    pairs = cut(met(prefix_rows(labelled, "label"), apart), "pairs")
    words = cut(worded(lines, texts, cut(ends(pairs).union(labels.select("id")).distinct(), "needed")), "lines")
    found = links(lines, texts, pairs, words)
    both = found.select("a.*", F.lit(1).alias("links"), (F.col("place_b") < F.col("place_a")).alias("late")).union(
        found.select("b.*", F.lit(1), F.col("place_a") < F.col("place_b")))
    inside = counted_inside(words.join(labels, "id"))
    return both.union(inside).groupBy("id", "check").agg(F.sum("links").alias("links"), F.max("late").alias("late")).where("links > 0")


def counted_inside(members: DataFrame) -> DataFrame:
    """``id``, ``check``, ``links`` and ``late`` of texts (``id, check, place, words, label``), as far as one block of some ``BLOCK`` texts of their label tells."""
    members = cut(members, "members")
    sizes = members.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "label").select(
        "label", F.pmod(F.xxhash64("id", "check"), F.col("blocks")).cast("int").alias("own"), F.sequence(F.lit(0), F.col("blocks") - 1).alias("all"), F.struct("id", "check", "place", "words").alias("t"))
    none = F.lit(None).cast(dealt.schema["t"].dataType)
    sides = dealt.select("label", F.col("own").alias("i"), F.explode("all").alias("j"), F.col("t").alias("x"), none.alias("y")).union(
        dealt.select("label", F.explode("all").alias("i"), F.col("own").alias("j"), none.alias("x"), F.col("t").alias("y")))
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, as few bytes make long work here and would be put into one task
    blocks = sides.repartition(tasks, "label", "i", "j").groupBy("label", "i", "j").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))

    def match(x: Column, y: Column) -> Column:
        n, m = F.size(x["words"]), F.size(y["words"])
        return (x["id"] != y["id"]) & (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.size(F.array_intersect(x["words"], y["words"])) >= 4 * (n + m))
    own = F.transform("xs", lambda x: F.struct(x["id"].alias("id"), x["check"].alias("check"), x["place"].alias("place"), F.filter("ys", lambda y: match(x, y)).alias("near")))
    counts = F.transform(own, lambda r: F.struct(
        r["id"].alias("id"), r["check"].alias("check"), F.size(r["near"]).alias("links"), F.exists(r["near"], lambda y: y["place"] < r["place"]).alias("late")))
    return blocks.select(F.explode(counts).alias("c")).select("c.*")


def worded(lines: DataFrame, texts: DataFrame, needed: DataFrame) -> DataFrame:
    """``id, check``, first ``place`` and hashes of the distinct ``words`` of the line texts whose ``id`` is in the stored ``needed``."""
    perhaps = marked(needed, "id")(F.col("id"))
    wanted = texts.where(perhaps).join(needed, "id").select("id", "check", "place")
    return (lines.where(perhaps).groupBy("id", "check").agg(F.first("line").alias("line")).join(wanted, ["id", "check"])
            .select("id", "check", "place", F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))).alias("words")))


def ends(pairs: DataFrame) -> DataFrame:
    """The ``id`` of every text of the pairs."""
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))


def links(lines: DataFrame, texts: DataFrame, pairs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """The pairs (``a``, ``b``) of line texts, as (id, check), that are similar enough on their ``words``, with their first places."""
    if words is None:
        words = cut(worded(lines, texts, cut(ends(pairs).distinct(), "needed")), "lines")
    return verified(words, pairs)


def verified(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``links`` among pairs, from the stored texts ``found`` with their words."""
    side = lambda s: found.select(F.col("id").alias(s), F.struct("id", "check").alias(f"text_{s}"), F.col("place").alias(f"place_{s}"), F.col("words").alias(f"words_{s}"))
    both = F.size(F.array_intersect("words_a", "words_b"))
    return cut(pairs.join(side("a"), "a").join(side("b"), "b").where(9 * both >= 4 * (F.size("words_a") + F.size("words_b")))
               .select(F.col("text_a").alias("a"), F.col("text_b").alias("b"), "place_a", "place_b"), "links")


def removals(docs: DataFrame, counted: bool = True) -> DataFrame:
    """Per document with a repeated or matched line: ``key``, the line numbers ``gone`` and ``n_links`` to other line texts.

    Without ``counted`` the same lines go, but only the links that decide that are made, and ``n_links`` counts these.
    """
    lines = occurrences(docs)
    texts = cut(lines.groupBy("id", "check").agg(F.min("place").alias("place"), F.count("*").alias("copies")), "texts")
    ranks = rarity(docs)
    if counted:
        degree = counted_links(lines, texts, ranks)
    else:
        found = late_links(lines, texts, ranks)
        ends = found.select("a.*", (F.col("place_b") < F.col("place_a")).alias("late")).union(
            found.select("b.*", F.col("place_a") < F.col("place_b")))
        degree = ends.groupBy("id", "check").agg(F.count("*").alias("links"), F.max("late").alias("late"))
    degree = cut(degree, "degree")
    known = texts.select("id", "check", F.col("place").alias("first"), "copies").where((F.col("copies") > 1) | marked(degree, "id")(F.col("id")))
    known = cut(known.join(degree, ["id", "check"], "left").where((F.col("copies") > 1) | F.col("links").isNotNull()), "known")
    hit = (lines.select("id", "check", "place").where(marked(known, "id")(F.col("id"))).join(known, ["id", "check"])
           .select("place.key", "place.at", F.coalesce("links", F.lit(0)).alias("links"), (F.coalesce("late", F.lit(False)) | (F.col("place") > F.col("first"))).alias("gone")))
    return hit.dropDuplicates(["key", "at"]).groupBy("key").agg(
        F.collect_list(F.when(F.col("gone"), F.col("at"))).alias("gone"), F.sum("links").alias("n_links"))


def deduplicated(docs: DataFrame, counted: bool = True) -> DataFrame:
    """The rows of ``docs`` as a struct ``doc``, with ``text`` as it is left, ``n_lines`` with words, ``removed`` line numbers and ``n_links``."""
    gone = cut(removals(docs, counted), "gone")
    touched = marked(gone, "key")(F.col("key"))
    named = docs.select(document_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    none = F.array().cast("array<int>")
    changed = named.where(touched).join(gone, "key", "left").select(
        "doc", F.sort_array(F.coalesce("gone", none)).alias("removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    same = named.where(~touched).select("doc", none.alias("removed"), F.lit(0).cast("bigint").alias("n_links"))
    lines = F.split("doc.text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("removed", i)), "\n")
    return changed.union(same).select(
        "doc", F.when(F.size("removed") > 0, left).otherwise(F.col("doc.text")).alias("text"),
        F.size(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("bigint").alias("n_lines"), "removed", "n_links")


def remove_lines(docs: DataFrame) -> DataFrame:
    """The documents without their later matching lines; a document that loses all its words goes. Columns are kept."""
    out = deduplicated(docs, counted=False).where((F.size("removed") < F.col("n_lines")) | (F.col("n_lines") == 0))
    cols = {c: F.col("doc").getField(c).alias(c) for c in docs.columns}
    cols["text"] = F.col("text")
    if "n_chars" in cols:
        cols["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*cols.values())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicated(docs).select(F.col("doc.doc_id").alias("doc_id"), "text", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "n_links")


ORACLE = r"""
WITH o AS (SELECT doc_id, i - 1 AS "at", ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM
        (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
      WHERE regexp_matches(ls[i], '[^\x20\x09-\x0D]')),
t AS (SELECT line, min(doc_id * 1000000 + "at") AS place, count(*) AS copies, list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS ws FROM o GROUP BY line),
w AS (SELECT line, len(ws) AS n, unnest(ws) AS w FROM t),
c AS (SELECT w, count(*) AS n FROM w GROUP BY w),
p AS (SELECT w.line, w.n, w.w, row_number() OVER (PARTITION BY w.line ORDER BY c.n, w.w) AS pos FROM w JOIN c ON w.w = c.w),
q AS (SELECT * FROM p WHERE pos <= n - (4 * n + 4) // 5 + 1),
k AS (SELECT DISTINCT x.line AS a, y.line AS b FROM q x JOIN q y ON x.w = y.w AND x.line < y.line AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
m AS (SELECT a, b, x.place AS pa, y.place AS pb FROM k JOIN t x ON a = x.line JOIN t y ON b = y.line
      WHERE 9 * len(list_intersect(x.ws, y.ws)) >= 4 * (len(x.ws) + len(y.ws))),
e AS (SELECT a AS line, pb < pa AS late FROM m UNION ALL SELECT b, pa < pb FROM m),
g AS (SELECT line, count(*) AS links, bool_or(late) AS late FROM e GROUP BY line),
r AS (SELECT o.doc_id, o."at", o.line, coalesce(g.links, 0) AS links, coalesce(g.late, false) OR o.doc_id * 1000000 + o."at" > t.place AS gone
      FROM o JOIN t ON o.line = t.line LEFT JOIN g ON o.line = g.line),
s AS (SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_removed, sum(links) AS n_links,
        list("at") FILTER (WHERE gone) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN s.gone IS NULL THEN d.text ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(string_split(d.text, chr(10)))),
         lambda i: NOT list_contains(s.gone, i)), lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)), '') END AS text,
       coalesce(s.n_lines, 0)::BIGINT AS n_lines, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
