"""Evaluation against ground truth: classification, leaked markers, protected figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from caseloom.constants import PROTECTED_TEXT
from caseloom.operators.phrases import find_phrases


def eval_cases(
    truth: DataFrame,
    predicted: DataFrame,
    markers: Sequence[str],
    figure: str = PROTECTED_TEXT,
    key: str = "name",
) -> DataFrame:
    """Three pass flags per case. ``predicted`` has the key, the decision and ``safe_text``.

    ``markers`` are the few fixed strings that must not show up; use `leak_pairs` for a table.
    """
    clean = F.lit(True)
    for marker in markers:
        clean = clean & ~F.contains(F.col("safe_text"), F.lit(marker))
    agree = F.col("actual_is_relevant").eqNullSafe(F.col("expected_is_relevant")) & F.col("actual_category").eqNullSafe(
        F.col("expected_category")
    )
    actual = predicted.select(
        key, F.col("is_relevant").alias("actual_is_relevant"), F.col("category").alias("actual_category"), "safe_text"
    )
    return truth.join(actual, key).select(
        key,
        "expected_is_relevant",
        "expected_category",
        "actual_is_relevant",
        "actual_category",
        agree.alias("classification_pass"),
        clean.alias("pii_leakage_pass"),
        F.contains(F.col("safe_text"), F.lit(figure)).alias("preserved_entities_pass"),
    )


def eval_failures(cases: DataFrame) -> DataFrame:
    return cases.filter(~F.col("classification_pass")).select(
        cases.columns[0], "expected_is_relevant", "expected_category", "actual_is_relevant", "actual_category"
    )


def eval_report(cases: DataFrame) -> DataFrame:
    """Accuracy and leak rate in percent with their counts; NULL rates when there are no cases."""
    share = lambda flag: F.avg(F.when(flag, 100.0).otherwise(0.0))
    return cases.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("classification_pass").alias("correct"),
        F.count_if(~F.col("pii_leakage_pass")).alias("leaked"),
        share(F.col("classification_pass")).alias("accuracy_score"),
        share(~F.col("pii_leakage_pass")).alias("pii_leakage_rate"),
        F.bool_and(
            F.col("classification_pass") & F.col("pii_leakage_pass") & F.col("preserved_entities_pass")
        ).alias("all_pass"),
    )


def leak_pairs(texts: DataFrame, markers: DataFrame, *, text_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every (text, marker) pair where the text contains the marker; markers are a table
    ``marker_id, marker`` of any size."""
    return find_phrases(texts, markers, text_id=text_id, text=text, phrase_id="marker_id", phrase="marker").select(
        text_id, "marker_id"
    )


def leak_rate(texts: DataFrame, markers: DataFrame, *, text_id: str = "doc_id", text: str = "text") -> DataFrame:
    """How many texts hold at least one marker, and their share in percent."""
    leaking = leak_pairs(texts, markers, text_id=text_id, text=text).select(text_id).distinct()
    both = texts.select(F.lit(1).alias("total"), F.lit(0).alias("leaked")).unionByName(
        leaking.select(F.lit(0).alias("total"), F.lit(1).alias("leaked"))
    )
    sums = both.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("leaked"), F.lit(0)).alias("leaked"))
    return sums.withColumn("leak_rate", F.when(F.col("total") > 0, F.col("leaked") * 100.0 / F.col("total")))
