"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from limbwise.llm import bpe, classify, divergence, extract, langid, lines, mixing, neardup, neighbours, ppm, quality, tokencount, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": neardup.query,
    "op2_quality_rules": quality.query,
    "op3_line_dedup": lines.query,
    "op4_html_extraction": extract.query,
    "op5_bpe": bpe.query,
    "op6_lm_scoring": ppm.query,
    "op7_source_mixing": mixing.query,
    "op8_language_id": langid.query,
    "op9_nearest_neighbours": neighbours.query,
    "op10_quality_classifier": classify.query,
    "op11_token_counts": tokencount.query,
    "op12_spelling_variants": variants.query,
    "op13_source_divergence": divergence.query,
}
ORACLES: dict[str, str] = {
    "op3_line_dedup": lines.ORACLE,
    "op2_quality_rules": quality.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
