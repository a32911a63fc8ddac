"""Running totals and ranks inside groups that may hold a third of all rows.

A plain window sends each group to one task. Here a group is cut by its order column into
chunks of bounded size: totals run inside each chunk, and the chunk sums, one row per chunk,
give every chunk its starting value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_ROWS = 1 << 16


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    tie: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before this one.

    ``order`` is an integer that, with ``tie``, is unique inside a group; so a chunk of
    ``chunk_rows`` consecutive values holds a bounded number of rows. Hand in narrow rows: the
    input is read once for the rows and once for the chunk sums.
    """
    chunked = df.withColumn("_chunk", F.expr(f"`{order}` div {chunk_rows}")).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order, *([tie] if tie else []))
    local = chunked.withColumn(
        "_before", F.coalesce(F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_start"))
    )
    joined = local.join(starts, null_safe_on(local, starts, [*keys, "_chunk"]))
    return joined.select(*[local[c] for c in df.columns], (local["_before"] + starts["_start"]).alias(out))
