"""Session defaults. Every operator also works on a session made elsewhere."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "caseloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and small Arrow batches for binary rows.

    Only a local master gets a fixed shuffle width; on a cluster the width stays the cluster's
    choice and AQE coalesces it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Rows of file bytes are large: fewer of them at a time in the reader.
        .config("spark.sql.parquet.columnarReaderBatchSize", "512")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (
                builder.config("spark.sql.shuffle.partitions", "8")
                .config("spark.ui.enabled", "false")
                .config("spark.ui.showConsoleProgress", "false")
                .config("spark.driver.memory", os.environ.get("CASELOOM_DRIVER_MEMORY", "8g"))
            )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame, stored in the shared checkpoint folder, so that a lost executor costs a read.

    The folder is the one that ``spark.checkpoint.dir`` names; only a local session may go without.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="caseloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
