"""Queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import fingerprint, jaccard, line_dedup, mixing, packing, pii, quality, secret_scan, site_style, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_topk": topk.query,
        "op2_fingerprints": fingerprint.query,
        "op3_best_fit_packing": packing.query,
        "op4_line_dedup": line_dedup.query,
        "op5_ngram_jaccard_join": jaccard.query,
        "op6_mixing": mixing.query,
        "op7_pii": pii.query,
        "op8_site_style": site_style.query,
        "op9_secret_scan": secret_scan.query,
        "op10_quality": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_topk": topk.SQL,
        "op2_fingerprints": fingerprint.SQL,
        "op4_line_dedup": line_dedup.SQL,
        "op5_ngram_jaccard_join": jaccard.SQL,
        "op6_mixing": mixing.SQL,
    }
