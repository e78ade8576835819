"""Catalogue scans and clip selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limbwise.operators.metadata import file_name, normalise_glosses, stem

# The catalogue columns, the output columns and the video extensions.
CSV_SCHEMA = "Category string, Word string, Video string, FilePath string"
COLUMNS = ("FilePath", "Video", "raw_word", "label", "Category", "split")
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "webm", "m4v")


def read_metadata(spark: SparkSession, paths: dict[str, str], split: str, gloss_map: DataFrame) -> DataFrame:
    """CSV catalogue of a split; ``val`` has no file of its own and reads the train file."""
    df = spark.read.schema(CSV_SCHEMA).csv(paths["test" if split == "test" else "train"], header=True)
    return _finish(df.withColumnRenamed("Word", "raw_word"), split, gloss_map)


def read_parquet_metadata(spark: SparkSession, path: str, split: str, gloss_map: DataFrame, subset_flag: str) -> DataFrame:
    """Parquet catalogue ``video_path, label, parent_label``: only rows of the flagged subset."""
    df = spark.read.parquet(path).where(F.col(subset_flag)).select(
        F.col("video_path").alias("FilePath"), F.col("label").alias("raw_word"), F.col("parent_label").alias("Category"))
    return _finish(df, split, gloss_map)


def _finish(df: DataFrame, split: str, gloss_map: DataFrame) -> DataFrame:
    return (normalise_glosses(df, gloss_map).withColumn("Video", file_name(F.col("FilePath")))
            .withColumn("Category", F.col("Category").cast("string")).withColumn("split", F.lit(split)).select(*COLUMNS))


def read_all_metadata(spark: SparkSession, paths: dict[str, str], gloss_map: DataFrame) -> DataFrame:
    return read_metadata(spark, paths, "train", gloss_map).unionByName(read_metadata(spark, paths, "test", gloss_map))


def list_files(spark: SparkSession, root: str, glob: str = "*", limit: int | None = None) -> DataFrame:
    """Paths, sizes and times of the files under a folder; contents are never read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
             .load(root).select("path", "modificationTime", "length"))
    return files.orderBy("path").limit(limit) if limit else files


def list_videos(spark: SparkSession, root: str, vocabulary: DataFrame, limit: int | None = None) -> DataFrame:
    """Video files with a label guessed from the part of the stem before the first '_'."""
    glob = "*.{" + ",".join(x for e in VIDEO_EXTENSIONS for x in (e, e.upper())) + "}"
    return guess_labels(list_files(spark, root, glob, limit), vocabulary)


def guess_labels(files: DataFrame, vocabulary: DataFrame) -> DataFrame:
    name = stem(F.col("path"))
    guess = F.when(F.contains(name, F.lit("_")), F.upper(F.split(name, "_")[0]))
    known = vocabulary.select(F.upper("label").alias("_g"), F.col("label").alias("_known"))
    return (files.withColumn("_g", guess).join(known, "_g", "left")
            .withColumn("true_class", F.coalesce("_known", F.lit(""))).drop("_g", "_known"))


def select_clips(index: DataFrame, split: str = "test", class_name: str | None = None, limit: int | None = None,
                 order: str = "row_no") -> DataFrame:
    """Clips of a split and class in catalogue order, the first ``limit`` if one is given."""
    if split and split != "all":
        index = index.where(F.col("split") == split)
    if class_name:
        index = index.where(F.upper(F.trim("label")) == class_name.strip().upper())
    return index.orderBy(order).limit(limit) if limit else index


def resolve_files(index: DataFrame, files: DataFrame, suffix: str) -> DataFrame:
    """Match catalogue paths ``category/word/.../name`` to files and add ``member`` (null if none).

    Exact folders win in the order word, word/extra, word/Extra, word/Extra Videos; else the
    first file of that name, ignoring case, below a folder named like the category. Files are
    keyed by (folder on their path, stem), so equal file names alone never pair up. Paths compress
    well, so the size of a stored table says little about its rows: the joins are merge joins, never broadcasts.
    """
    parts = F.split("FilePath", "/")
    wanted = index.where(F.size(parts) >= 3).select(
        "FilePath", parts[0].alias("_cat"), F.concat_ws("/", parts[0], parts[1]).alias("_dir"),
        stem(F.col("FilePath")).alias("_stem")).distinct()
    steps = F.split("path", "/")
    folders = F.slice(steps, 1, F.size(steps) - 1)
    listed = files.where(F.lower("path").endswith(suffix.lower())).select(
        "path", stem(F.col("path")).alias("_file"), F.array_join(folders, "/").alias("_at"),
        F.explode(F.array_distinct(F.transform(folders, F.lower))).alias("_kcat"))
    pairs = wanted.hint("merge").join(listed, (F.lower("_cat") == F.col("_kcat")) & (F.lower("_stem") == F.lower("_file")))
    rank = F.when(F.col("_stem") != F.col("_file"), 4)
    for k, tail in enumerate(("", "/extra", "/Extra", "/Extra Videos")):
        there = F.concat(F.col("_dir"), F.lit(tail))
        rank = rank.when((F.col("_at") == there) | F.endswith(F.col("_at"), F.concat(F.lit("/"), there)), k)
    best = pairs.withColumn("_rank", rank.otherwise(4)).groupBy("FilePath").agg(
        F.min(F.struct("_rank", "path")).alias("_best"))
    return index.join(best.select("FilePath", F.col("_best.path").alias("member"),
                                  F.when(F.col("_best._rank") < 4, "exact").otherwise("fallback").alias("match")).hint("merge"),
                      "FilePath", "left")


def without_corrupt(index: DataFrame, corrupt: DataFrame, key: str = "FilePath") -> DataFrame:
    """Drop clips listed as damaged."""
    return index.join(corrupt.select(key), key, "left_anti")
