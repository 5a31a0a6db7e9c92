"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkclin.llm import (
    best_two_fit, divergence, hashing_search, jaccard, line_templates, packing, pieces, pii, quality_rules, resampling,
    substrings, toxicity, url_filter,
)

_QUERIES = [
    packing.op1_packing,
    hashing_search.op2_nearest_neighbours,
    line_templates.op3_line_dedup,
    jaccard.op4_ngram_jaccard,
    pieces.op5_sentencepiece,
    substrings.op6_substring_dedup,
    pii.op7_pii,
    toxicity.op8_toxicity,
    quality_rules.op9_quality_rules,
    url_filter.op10_url_filter,
    divergence.op11_source_divergence,
    best_two_fit.op12_best_two_fit,
    resampling.op13_importance_resampling,
]

_ORACLES = {
    "op3_line_dedup": line_templates.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
