"""Results as tables and files.

Every run appends: a table is a folder with one folder per run, whatever the number of packages, and bytes are written
once. The ledger says which run a package's rows are taken from. It is written last, so a run that broke off is never
seen, and a package that is done again shows its new rows alone, also where it has none.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

LEDGER = "package_id string, path string, length long, modified timestamp, content_hash string, same_as string"


def new_run() -> str:
    """A name for a run; later runs come later in order."""
    return f"r{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def append(df: DataFrame, path: str, run: str) -> DataFrame:
    """Write a run's rows and return them as read from storage, so that what follows does not compute them again."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/run={run}")


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A stored table of all runs with ``run``. The declared schema also serves a table without rows, or none at all."""
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
    declared = declared.add("run", "string")
    try:
        return spark.read.schema(declared).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], declared)


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """One row per package and run in which it was looked at."""
    return read_table(spark, f"{out}/ledger", LEDGER)


def last_seen(ledger: DataFrame) -> DataFrame:
    """The newest row of each package."""
    columns = [c for c in ledger.columns if c != "package_id"]
    return ledger.groupBy("package_id").agg(F.max_by(F.struct(*columns), "run").alias("_l")).select("package_id", "_l.*")


def current(table: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of a table that hold now: those of the newest run that opened their package."""
    newest = ledger.filter(F.col("same_as").isNull()).groupBy("package_id").agg(F.max("run").alias("run"))
    return table.join(newest, ["package_id", "run"], "left_semi").drop("run")


def write_audit_csv(audit: DataFrame, path: str) -> None:
    """Audit rows with a header; quotes are doubled and empty fields are bare. One file per task that holds rows."""
    audit.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_exclusion_log(log: DataFrame, path: str) -> None:
    """Lines, each after its package and a tab."""
    log.select(F.concat_ws("\t", "package_id", "line").alias("line")).write.mode("overwrite").text(path)


def copy_package(files: DataFrame, path: str) -> None:
    """Copies of the routed files as a table of their own, for those who take them elsewhere. Stage 1 does without."""
    files.write.mode("overwrite").parquet(path)


# --- tables that hold what is approved now, and nothing else -----------------

SLOTS = ("a", "b")


def active_slot(spark: SparkSession, out: str) -> str | None:
    """Which of the two slots holds, by the marker that is written last."""
    try:
        row = spark.read.schema("slot_name string").json(f"{out}/active").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row["slot_name"] if row else None


def fill_slot(df: DataFrame, path: str, slot: str) -> DataFrame:
    """Write one slot of a table; the other one, which holds until now, stays readable."""
    df.write.mode("overwrite").parquet(f"{path}/slot={slot}")
    return read_slot(df.sparkSession, path, slot, df.schema)


def read_slot(spark: SparkSession, path: str, slot: str | None, schema: StructType | str) -> DataFrame:
    if slot is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/slot={slot}")


def switch_slot(spark: SparkSession, out: str, slot: str, paths: dict[str, StructType]) -> None:
    """From now on ``slot`` holds. The other one is emptied, so that nothing withdrawn stays in the tables."""
    spark.createDataFrame([(slot,)], "slot_name string").coalesce(1).write.mode("overwrite").json(f"{out}/active")
    for path, schema in paths.items():
        for other in SLOTS:
            if other != slot:
                spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/slot={other}")


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Markdown per package, in a bounded number of folders; nothing is written for an empty summary. A line of its own
    names the package in front of each."""
    named = F.concat(F.lit("<!-- "), F.col("package_id"), F.lit(" -->\n"), F.col("summary_md"))
    summaries.filter(F.col("summary_md") != "").select(named.alias("value")).write.mode("overwrite").text(path)
