"""Quality rules with host verdicts (operator 2).

Every document gets word, symbol, line and repetition counts over its whole text. Two base
rules reject it alone. Three further rules (symbols, repeated lines, capitals) are judged by
host: their failures are summed up per ``source``, the rates are shrunk with a beta prior
fitted to all hosts by the method of moments, and a document that fails such a rule goes
where the host's shrunk rate is above ``tolerance``. In a host where hardly anything fails,
a failing page is an exception and stays. A document that fails no rule always stays.

Null or empty text: no words, so ``base_failed``. Null source: a host of its own. Repeated
rows count once each and get equal verdicts. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limbwise.llm.words import fresh, give_back, words
from limbwise.sources.workspace import cut

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
RULES = ("symbols", "lines", "upper")
TOLERANCE = 0.02


def repeated_words(found: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more in the text."""
    n = len(found) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
    base = len(known)
    if base == len(found):
        return 0
    key = ids[:n]
    top = base
    for k in range(1, width):
        if top > (1 << 62) // base:
            _, key = np.unique(key, return_inverse=True)
            top = n
        key = key * base + ids[k:k + n]
        top *= base
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    covered = np.zeros(len(found) + 1, np.int64)
    starts = np.flatnonzero(counts[inverse] > 1)
    covered[starts] += 1
    covered[starts + width] -= 1
    return int(np.count_nonzero(np.cumsum(covered)))


def count_text(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of one text."""
    if not text:
        return (0,) * len(COUNTS)
    found = words(text)
    lines = [x for x in text.split("\n") if x and x.strip(" \t\n\v\f\r")]
    return (len(found), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, "#*$%&|<>")),
            len(lines) - len(set(lines)), repeated_words(found), len(lines), sum(map(bytes.isupper, found)))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([count_text(t) for t in texts], columns=list(COUNTS), dtype="int64")
        texts = None
    give_back()


def failures(at: str = "") -> dict[str, Column]:
    """The document rules over the counts, by name; ``at`` is the struct that holds them."""
    c = lambda name: F.col(f"{at}.{name}" if at else name)
    return {"base": (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words")),
            "symbols": 10 * c("n_symbols") > c("n_words"),
            "lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
            "upper": 2 * c("n_upper") > c("n_words")}


def host_verdicts(counted: DataFrame, host: str, at: str = "", tolerance: float = TOLERANCE) -> DataFrame:
    """``host``, its documents and per rule: failures, shrunk rate and ``strict_<rule>``.

    One row per host leaves the partial aggregation, so a host with a third of all rows costs
    one row a task. The prior is two numbers per rule: for rates p of hosts of n documents, the mean
    m and the variance v (both weighted by n) give the strength m(1-m)/v - 1. Only these numbers reach the driver.
    """
    fails = failures(at)
    hosts = cut(counted.groupBy(F.col(host).alias("_host")).agg(
        F.count("*").alias("host_docs"), *[F.sum(fails[r].cast("bigint")).alias(f"fails_{r}") for r in RULES]), "host-counts")
    docs = F.sum("host_docs")
    means = hosts.agg(*[(F.sum(f"fails_{r}") / docs).alias(r) for r in RULES]).first()
    mean = {r: means[r] or 0.0 for r in RULES}
    spread = hosts.agg(*[(F.sum(F.col("host_docs") * F.pow(F.col(f"fails_{r}") / F.col("host_docs") - mean[r], 2)) / docs).alias(r) for r in RULES]).first()
    for r in RULES:
        m, v = mean[r], spread[r] or 0.0
        strength = max(1.0, min(1e6, m * (1 - m) / v - 1)) if v > 1e-9 else 1e6
        shrunk = (F.col(f"fails_{r}") + m * strength) / (F.col("host_docs") + strength)
        hosts = hosts.withColumn(f"rate_{r}", shrunk).withColumn(f"strict_{r}", shrunk > tolerance)
    return hosts


def _kept(at: str, strict: dict[str, Column]) -> Column:
    fails = failures(at)
    gone = fails["base"]
    for r in RULES:
        gone = gone | (fails[r] & F.coalesce(strict[r], F.lit(False)))
    return ~gone


def score_documents(docs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: ids, counts, ``base_failed`` and ``kept``; the counts are made once and stored."""
    counted = cut(docs.select("doc_id", "source", text_counts("text").alias("q")).select("doc_id", "source", "q.*"), "quality")
    hosts = host_verdicts(counted, "source", tolerance=tolerance)
    return (counted.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left")
            .withColumn("base_failed", failures()["base"])
            .withColumn("kept", _kept("", {r: F.col(f"strict_{r}") for r in RULES})))


@F.pandas_udf(T.IntegerType())
def broken_rules(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The document rules that a text fails, as bits: 1 for the base rules, then one for each of ``RULES``."""
    for texts in batches:
        out = []
        for text in texts:
            n = dict(zip(COUNTS, count_text(text)))
            out.append((n["n_words"] < 10 or 100 * n["n_repeat_words"] > 20 * n["n_words"]) | (10 * n["n_symbols"] > n["n_words"]) << 1
                       | (10 * n["n_dup_lines"] > 3 * n["n_lines"]) << 2 | (2 * n["n_upper"] > n["n_words"]) << 3)
        yield pd.Series(out, dtype="int32")
        texts = None
    give_back()


def keep_documents(docs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents that pass, with their own columns. Texts are not shuffled unless the host table is large.

    The counts are made in two passes: one that leaves sums per host, and one that leaves four bits beside each document. Marked as not
    deterministic, the bits are made once and above no filter, so a task never runs the function twice over its texts.
    """
    q, host = fresh(docs, "_q", "_h")
    hosts = host_verdicts(docs.select("source", text_counts("text").alias(q)), "source", q, tolerance).select(
        F.struct("_host", sum((F.when(F.col(f"strict_{r}"), 2 << k).otherwise(0) for k, r in enumerate(RULES)), F.lit(1)).alias("strict")).alias(host))
    marked = docs.withColumn(q, broken_rules.asNondeterministic()("text"))
    return (marked.join(hosts, F.col("source").eqNullSafe(F.col(f"{host}._host")), "left")
            .where(F.col(q).bitwiseAND(F.col(f"{host}.strict")) == 0).select(*[F.col(f"`{c}`") for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
pos AS (SELECT rid, i, list_slice(ws, i, i + 4) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM b)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM pos) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
f AS (SELECT b.rid, doc_id, source, len(ws)::BIGINT AS n_words, list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS wc,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(ls) AS n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper
      FROM b LEFT JOIN rep ON b.rid = rep.rid),
r AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
        10 * n_symbols > n_words AS f1, 10 * n_dup_lines > 3 * n_lines AS f2, 2 * n_upper > n_words AS f3 FROM f),
h AS (SELECT source, count(*) AS n, sum(f1::INT) AS k1, sum(f2::INT) AS k2, sum(f3::INT) AS k3 FROM r GROUP BY source),
m AS (SELECT sum(n) AS nn, sum(k1) / sum(n) AS m1, sum(k2) / sum(n) AS m2, sum(k3) / sum(n) AS m3 FROM h),
v AS (SELECT any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, sum(n * pow(k1 / n - m1, 2)) / any_value(nn) AS v1,
        sum(n * pow(k2 / n - m2, 2)) / any_value(nn) AS v2, sum(n * pow(k3 / n - m3, 2)) / any_value(nn) AS v3 FROM h, m),
s AS (SELECT *, CASE WHEN v1 > 1e-9 THEN greatest(1.0, least(1e6, m1 * (1 - m1) / v1 - 1)) ELSE 1e6 END AS s1,
        CASE WHEN v2 > 1e-9 THEN greatest(1.0, least(1e6, m2 * (1 - m2) / v2 - 1)) ELSE 1e6 END AS s2,
        CASE WHEN v3 > 1e-9 THEN greatest(1.0, least(1e6, m3 * (1 - m3) / v3 - 1)) ELSE 1e6 END AS s3 FROM v),
x AS (SELECT source, (k1 + m1 * s1) / (n + s1) > 0.02 AS x1, (k2 + m2 * s2) / (n + s2) > 0.02 AS x2, (k3 + m3 * s3) / (n + s3) > 0.02 AS x3 FROM h, s)
SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (f1 AND x1) OR (f2 AND x2) OR (f3 AND x3)) AS kept
FROM r JOIN x ON r.source IS NOT DISTINCT FROM x.source
"""
