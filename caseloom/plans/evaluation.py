"""Evaluation run: ground truth through the classifier and both redaction passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from caseloom.constants import PROTECTED_TEXT
from caseloom.operators.classify import DEFAULT_RULES, Rule, classify
from caseloom.operators.evaluate import eval_cases
from caseloom.operators.seam import Model
from caseloom.plans.summarise import scrub


def evaluate(
    truth: DataFrame,
    markers: Sequence[str],
    entities: DataFrame | None = None,
    *,
    rules: Sequence[Rule] = DEFAULT_RULES,
    figure: str = PROTECTED_TEXT,
    classify_model: Model | None = None,
    scrub_model: Model | None = None,
) -> DataFrame:
    """One row of pass flags per case. Each case is a package of its own, named by ``name``."""
    cases = truth.select(
        F.col("name").alias("package_id"), F.col("name").alias("file_id"), F.lit(0).cast("long").alias("ord"),
        F.lit("text").alias("kind"), F.col("raw_text").alias("text"),
    )
    decided = classify(cases, rules, model=classify_model, inputs=["text"])
    safe = scrub(cases.select("package_id", "file_id", "ord", "text"), entities, model=scrub_model)
    predicted = decided.select("package_id", "is_relevant", "category").join(
        safe.select("package_id", "safe_text"), "package_id"
    )
    return eval_cases(truth.drop("raw_text"), predicted.withColumnRenamed("package_id", "name"), markers, figure)
