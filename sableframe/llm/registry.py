"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, hard_negatives, license_scan, lm_scoring, media, mixing, near_duplicates, packing, phrases, quality_classifier, quality_rules, toxicity, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_bpe": bpe.op2_bpe,
        "op3_url_filters": url_filters.op3_url_filters,
        "op4_quality_knn": quality_classifier.op4_quality_knn,
        "op5_media_ogg": media.op5_media_ogg,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_near_duplicates": near_duplicates.op8_near_duplicates,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_lm_mixing": lm_scoring.op10_lm_mixing,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_phrases": phrases.op12_phrases,
        "op13_mixing": mixing.op13_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": url_filters.ORACLE,
        "op7_license_scan": license_scan.oracle(),
        "op9_quality_rules": quality_rules.ORACLE,
        "op11_hard_negatives": hard_negatives.ORACLE,
        "op12_phrases": phrases.ORACLE,
        "op13_mixing": mixing.ORACLE,
    }
