"""Fold of a document, and bounded samples of labelled ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Remainder 0 of the CRC-32 of the id as text, modulo 5. A null id counts as the empty text: held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample_ids(ids: DataFrame, size: int) -> DataFrame:
    """At most ``size`` distinct ids of the training fold: those of the least hashes, whatever the order of the rows."""
    return ids.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def sampled(docs: DataFrame, chosen: DataFrame, *more: str) -> DataFrame:
    """``more``, text and ``kind`` of the documents whose ids are in ``chosen`` (doc_id, kind), a bounded number of rows that
    may be broadcast for that reason. Of rows that repeat an id the one with the least text is taken."""
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text"))
    return rows.select(*more, "text", "kind")
