"""Catalogue columns: labels, session ids, vocabulary and its index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limbwise.functions.columns import let
from limbwise.functions.scans import Scan, running


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), "\\.[^.]*$", "")


def session_id(path: Column) -> Column:
    """Number after MVI, else all digits of the stem, else the stem; leading zeros stay."""
    numbered = lambda s: F.nullif(F.regexp_extract(s, "(?i)MVI[_-]?(\\d+)", 1), F.lit(""))
    digits = lambda s: F.nullif(F.regexp_replace(s, "\\D", ""), F.lit(""))
    return let(stem(path), lambda s: F.coalesce(numbered(s), digits(s), s))


def session_block(path: Column, block: int = 10) -> Column:
    number = lambda s: F.when(s.rlike("^\\d+$"), s.try_cast("decimal(38,0)"))
    return let(session_id(path), lambda s: F.coalesce(F.floor(number(s) / block).cast("string"), s))


def normalise_glosses(df: DataFrame, gloss_map: DataFrame, word: str = "raw_word") -> DataFrame:
    """Add ``label``: the mapped gloss of the raw word, else the word trimmed and upper-cased.

    The map is a small dimension; Spark broadcasts it only while it fits its size check.
    """
    names = gloss_map.select(F.col("actual_gloss").alias(word), "normalized_gloss")
    return (df.join(names, word, "left")
            .withColumn("label", F.coalesce("normalized_gloss", F.upper(F.trim(word)))).drop("normalized_gloss"))


def keep_classes(index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return index.join(vocabulary.select("label"), "label", "left_semi")


def search_classes(vocabulary: DataFrame, text: str) -> DataFrame:
    return vocabulary.where(F.contains(F.lower("label"), F.lit(text.lower())))


def vocabulary(index: DataFrame) -> DataFrame:
    return index.select("label").distinct().orderBy("label")


def class_array(index: DataFrame) -> DataFrame:
    """One row ``classes ARRAY<STRING>``, sorted: for results that are one value by definition."""
    return index.select("label").where("label IS NOT NULL").distinct().agg(F.array_sort(F.collect_list("label")).alias("classes"))


def class_index(index: DataFrame) -> DataFrame:
    """(label, index) in sorted order, 0-based; ranked in slices of the first two characters."""
    names = index.select("label").where("label IS NOT NULL").distinct().withColumn("_slice", F.substring("label", 1, 2))
    ranked = running(names, [], "_slice", [F.col("label")], {"_n": Scan("sum", F.lit(1), inclusive=False)})
    return ranked.select("label", F.coalesce("_n", F.lit(0)).cast("int").alias("index"))


def frozen_vocabulary(index: DataFrame, order: str = "row_no") -> DataFrame:
    """Per class: index, first raw word and category in row order, clip count."""
    facts = index.groupBy("label").agg(
        F.min_by("raw_word", order).alias("raw_word"), F.min_by("Category", order).alias("category"),
        F.count("*").alias("videos"))
    return facts.join(class_index(index), "label")


def index_mismatches(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Labels whose stored index is absent, unknown or different."""
    a = current.select("label", F.col("index").alias("current_index"))
    b = stored.select("label", F.col("index").alias("stored_index"))
    return a.join(b, "label", "full_outer").where(~F.col("current_index").eqNullSafe(F.col("stored_index")))


def label_mapping(index: DataFrame) -> DataFrame:
    """One row: classes, their count and the SHA-1 of the names joined by '|'."""
    return class_array(index).select(
        "classes", F.size("classes").alias("num_classes"), F.sha1(F.array_join("classes", "|")).alias("sha1"))
