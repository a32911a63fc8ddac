"""Two-pass external shuffle of documents into shards.

Pass 1 scatters rows by a seeded hash of their place into buckets of bounded size (Spark's shuffle holds the buckets),
shuffles each bucket by Fisher-Yates (Spark's ``shuffle``) and writes it. Pass 2 adds the sizes of the buckets before a
row's own, which gives its global place, and writes the shards. DataFrame functions only.

The hash takes the row's place and not its content, so copies, repeated rows and null keys spread like all others.
An empty table gives no shards; a null text has size 1.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.store import shared_folder, stored

OWN = ["shard", "slot"]


def external_shuffle(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = 32 << 20, folder: str | None = None) -> DataFrame:
    """All rows with all their columns, ``shard`` (row counts at most one apart) and ``slot`` (gapless from 0), as
    stored below ``folder`` in one directory per shard. Columns of ``docs`` named like these two are replaced."""
    spark = docs.sparkSession
    docs = docs.drop(*OWN)
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(64)).alias("bytes")).first()
    buckets = max(1, ceil((total["bytes"] or 0) / bucket_bytes))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    scattered = docs.select(row, F.monotonically_increasing_id().alias("place")).select(
        "row", F.pmod(F.xxhash64(F.lit(seed), F.col("place")), F.lit(buckets)).cast("int").alias("bucket")
    )
    shuffled = (
        scattered.repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.shuffle(F.collect_list("row"), F.lit(seed)).alias("rows"))
        .select("bucket", F.posexplode("rows").alias("pos", "row"))
    )
    first = stored(shuffled)
    # One row per bucket: a window over them all is small.
    counts = first.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    n = max(1, total["n"])
    place = F.col("before") + F.col("pos")
    out = (
        first.join(offsets, "bucket")
        .withColumn("place", place)
        .withColumn("shard", F.expr(f"(place * {shards}L) div {n}L").cast("int"))
        .select("row.*", "shard", (F.col("place") - F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")).alias("slot"))
    )
    path = folder or shared_folder(spark)
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
