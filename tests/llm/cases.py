"""Small awkward tables that every operator must take."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.\nSecond line of the text stands here.", "en", "a", 10),
    (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \t\n ", "de", None, 4), (5, LONG, "en", "a", 1), (6, BASE, "en", "b", 2),
    (7, BASE, "de", "a", 2), (8, BASE.replace("alpha30 ", "omega30 "), "de", None, 2), (9, "eins zwei drei vier", "de", "c", 3),
    (None, "no id here but some words to read for all of us in this town", "en", "a", 3), (9, "eins zwei drei vier", "de", "c", 3),
    (10, "ÄÖÜ é\U0001F600 <|endoftext|> it's 's", "de", "c", 3), (11, "x", "xx", "c", 1),
]


def docs(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, DOCS)


def crowded(spark):
    """The rows with further columns whose names the operators use inside."""
    out = docs(spark)
    for name in ("key", "node", "label", "q", "_q", "h", "_h", "size", "row", "doc", "text_u", "block", "id", "place", "slice", "e"):
        out = out.withColumn(name, F.lit(name))
    return out


def words(text):
    return (text or "").encode().split()
