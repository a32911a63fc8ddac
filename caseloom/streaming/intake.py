"""Intake of packages as they arrive: the same Stage 1, once per new archive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from caseloom.operators.classify import DEFAULT_RULES, Rule
from caseloom.operators.seam import Model
from caseloom.plans.triage import triage_archives
from caseloom.sources.archives import Guard, package_id


def start_intake(
    spark: SparkSession,
    packages: str,
    out: str,
    checkpoint: str,
    *,
    rules: Sequence[Rule] = DEFAULT_RULES,
    model: Model | None = None,
    guard: Guard = Guard(),
    max_files_per_trigger: int = 100,
) -> StreamingQuery:
    """Process all archives not seen before, then stop.

    The stream carries paths and sizes, never bytes, so no archive is too large for it: one that the guard does not admit
    becomes an error row. The checkpoint remembers the files seen; the ledger, which batch runs share, remembers their
    bytes, so an archive that comes again under another name is not opened again. A repeated batch finds its
    packages in the ledger, or does them anew if it broke off before.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("pathGlobFilter", "*.[zZ][iI][pP]")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(packages)
        .select(package_id(F.col("path"), packages).alias("package_id"), "path", "length", F.col("modificationTime").alias("modified"))
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        triage_archives(spark, batch, out, rules=rules, model=model, guard=guard)

    return (
        found.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
