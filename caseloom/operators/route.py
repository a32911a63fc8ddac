"""Destination of each classified file, and the lists and counts read from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.constants import AUDIT_COLUMNS, EVIDENCE_ROOT, EXCLUDED_ROOT, UNCATEGORIZED

COPY_FAILED = "(copy failed)"
TOTAL = "(total)"


def folder() -> Column:
    """Category folder of a relevant row: NULL and '' count as no category."""
    return F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit(UNCATEGORIZED))


def route(df: DataFrame, readable: Column | None = None) -> DataFrame:
    """Add ``destination`` and ``copy_failed`` (true where ``readable`` says there are no bytes)."""
    target = F.when(F.col("is_relevant"), F.concat(F.lit(EVIDENCE_ROOT + "/"), folder())).otherwise(EXCLUDED_ROOT)
    failed = F.lit(False) if readable is None else ~F.coalesce(readable, F.lit(False))
    return df.withColumn("destination", target).withColumn("copy_failed", failed)


def summary_text(df: DataFrame, keys: Sequence[str] = ("package_id", "ord", "file_id")) -> DataFrame:
    """Texts for the summary: relevant, copied, not empty; an image is represented by its description."""
    text = F.when(F.col("kind") == "text", F.col("text")).otherwise(F.col("description"))
    return (
        df.filter(F.col("is_relevant") & ~F.col("copy_failed"))
        .select(*keys, folder().alias("category"), text.alias("text"))
        .filter(F.col("text") != "")
    )


def audit_report(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per file. An excluded file keeps the classifier's category; no category is ''."""
    return df.withColumn("category", F.coalesce("category", F.lit(""))).select(*keys, *AUDIT_COLUMNS)


def exclusion_log(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``name<TAB>reason`` lines of excluded, copied files; line breaks inside a field become blanks."""
    one_line = [F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ") for c in ("file_name", "reason")]
    return df.filter(~F.col("is_relevant") & ~F.col("copy_failed")).select(
        *keys, F.concat_ws("\t", *one_line).alias("line")
    )


def decision_list(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *keys,
        "file_name",
        F.when(F.col("is_relevant"), "Relevant").otherwise("Excluded").alias("decision"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.when(F.col("copy_failed"), "copy failed").otherwise("").alias("note"),
    )


def category_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Relevant, copied files per category."""
    return (
        df.filter(F.col("is_relevant") & ~F.col("copy_failed"))
        .groupBy(*keys, folder().alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def package_totals(df: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Counters per package; total = relevant + excluded + failed."""
    copied = ~F.col("copy_failed")
    return df.groupBy(*keys).agg(
        F.count_if(F.col("is_relevant") & copied).alias("relevant_count"),
        F.count_if(~F.col("is_relevant") & copied).alias("excluded_count"),
        F.count_if(F.col("copy_failed")).alias("copy_failed_count"),
        F.count(F.lit(1)).alias("total_files"),
    )


def audit_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per destination in order of name, the total last; failed copies are a line of their
    own, shown when there are any. Grouping and sorting run on pre-aggregated rows."""
    place = F.when(F.col("copy_failed"), COPY_FAILED).otherwise(F.col("destination"))
    counted = df.groupBy(*keys, place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    sets = [[*keys, "place"], [*keys]]
    return (
        counted.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*keys, "place")])
        .agg(F.grouping("place").alias("_total"), F.sum("n").alias("n"))
        .orderBy(*keys, "_total", "place")
        .select(*keys, F.when(F.col("_total") == 1, TOTAL).otherwise(F.col("place")).alias("destination"), "n")
    )


def approved(df: DataFrame, approvals: DataFrame, key: str = "package_id") -> DataFrame:
    """Rows of packages that a person accepted; nothing passes without an explicit yes."""
    return df.join(approvals.filter(F.col("accepted")).select(key), key, "left_semi")


def pending(df: DataFrame, done: DataFrame, on: Sequence[str] = ("package_id",)) -> DataFrame:
    """Rows whose key has no stored result yet."""
    return df.join(done.select(*on), list(on), "left_anti")


def lineage(df: DataFrame) -> DataFrame:
    """Attachments with the name of the email they came from."""
    parents = df.select(F.col("file_id").alias("parent_id"), F.col("file_name").alias("parent_name"))
    return df.filter(F.col("parent_id").isNotNull()).join(parents, "parent_id").select(
        "package_id", "file_id", "file_name", "depth", "ordinal", "parent_id", "parent_name"
    )
