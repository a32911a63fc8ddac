"""Texts of one group put together in order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions.text import strip_text


# Bytes of a part, and order numbers whose sizes are added up in one task.
PART_BYTES = 4 << 20
CHUNK = 65_536


def ordered_join(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: the texts of a group in order, joined. Only for groups of bounded size."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return F.array_join(F.transform(rows, lambda row: row["t"]), separator)


def combine_texts(
    df: DataFrame,
    keys: Sequence[str] = ("package_id",),
    order: str = "ord",
    text: str = "text",
    separator: str = "\n\n",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Texts per package, in order. Returns keys, ``part``, ``n_texts`` and ``text``.

    A part begins where the texts before it fill another ``part_bytes``, whatever their order numbers are, so a package of
    few bytes is one row, and no part holds much more than ``part_bytes`` and one text. Parts are numbered
    from 0; joined by the separator they are the whole text. Running totals are made in chunks of order numbers: of a
    chunk only its size goes to the task that adds up a package.
    """
    keys = list(keys)
    size, chunk = F.coalesce(F.octet_length(text), F.lit(0)) + len(separator), F.expr(f"coalesce(`{order}` div {CHUNK}, -1)")
    sized = df.select(*keys, F.col(order).alias("_o"), F.col(text).alias("_t"), size.cast("long").alias("_n"), chunk.alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = sized.groupBy(*keys, "_c").agg(F.sum("_n").alias("_n")).select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_c").alias("_kc"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inside = Window.partitionBy(*keys, "_c").orderBy("_o", "_t").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(chunks, reduce(and_, [*same, F.col("_c") == F.col("_kc")]))
    offset = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    whole = placed.withColumn("_part", F.floor(offset / part_bytes))
    rows = F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.coalesce("_t", F.lit("")).alias("t"))))
    joined = whole.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("n_texts"), F.array_join(F.transform(rows, lambda row: row["t"]), separator).alias("text"))
    # A long text may span several multiples of the size: parts are numbered without gaps.
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_part")) - 1
    return joined.select(*keys, number.cast("long").alias("part"), "n_texts", "text")


def assemble_pages(pages: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Text of each document from its pages: a failed page is skipped, an empty one is an empty line.

    A document whose pages all failed has the text ''.
    """
    good = F.when(F.col("error").isNull(), F.struct(F.col("page_no").alias("o"), F.coalesce("text", F.lit("")).alias("t")))
    rows = F.array_sort(F.collect_list(good))
    return pages.groupBy(*keys).agg(
        strip_text(F.array_join(F.transform(rows, lambda row: row["t"]), "\n")).alias("text")
    )
