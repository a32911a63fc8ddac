"""Files whose bytes occur before in the same package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def mark_copies(files: DataFrame, by: Sequence[str] = ("package_id",), order: str = "ord", content: str = "content") -> DataFrame:
    """Add ``content_hash`` (SHA-256) and ``copy_of``, the id of the first file with the same bytes; NULL for that one.

    The firsts are a partial aggregation by hash, so a file that is copied very often costs one row per task.
    """
    hashed = files.withColumn("content_hash", F.sha2(content, 256))
    firsts = hashed.groupBy(*by, "content_hash").agg(F.min_by("file_id", order).alias("_first"))
    copy = F.when(F.col("_first") != F.col("file_id"), F.col("_first"))
    return hashed.join(firsts, [*by, "content_hash"], "left").withColumn("copy_of", copy).drop("_first")
