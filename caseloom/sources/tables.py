"""Stored results read back, and the small tables that configure a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom.sources.archives import package_id

RELEVANT_SCHEMA = "package_id string, ord long, file_id string, category string, text string"
ENTITY_SCHEMA = "package_id string, phrase string, kind string"
TRUTH_SCHEMA = "name string, raw_text string, expected_is_relevant boolean, expected_category string"
APPROVAL_SCHEMA = "package_id string, accepted boolean"
RULE_SCHEMA = "rule_id long, category string, priority int, phrase string, weight double"


def load_relevant(spark: SparkSession, path: str) -> DataFrame:
    """Relevant texts of earlier runs. A missing folder raises, as for any Spark read."""
    return spark.read.schema(RELEVANT_SCHEMA).parquet(path)


def parse_relevant_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Cache documents ``{"relevant_texts": [...]}`` -> array column ``relevant_texts``.

    A corrupt document, a missing key or a value that is no list gives NULL.
    """
    parsed = F.from_json(value, "relevant_texts array<string>")["relevant_texts"]
    return df.withColumn("relevant_texts", parsed)


def _caches(spark: SparkSession, path: str) -> DataFrame:
    """JSON caches with their package: the path below the folder read, so that files of one name in several folders
    stay apart."""
    read = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return read.withColumn("package_id", F.regexp_replace(package_id(F.col("_metadata.file_path"), path), r"\.json$", ""))


def load_relevant_json(spark: SparkSession, path: str) -> DataFrame:
    """Texts of JSON caches (one document per file) with their position; invalid ones are left out, see `invalid_caches`."""
    texts = parse_relevant_json(_caches(spark, path)).select("package_id", F.posexplode("relevant_texts").alias("ord", "text"))
    return texts.withColumn("ord", F.col("ord").cast("long"))


def cache_fault(value: Column) -> Column:
    """Why a cache document gives no texts; NULL for a good one."""
    kind = F.get_json_object(value, "$.relevant_texts")
    return (
        F.when(F.from_json(value, "relevant_texts array<string>")["relevant_texts"].isNotNull(), F.lit(None).cast("string"))
        .when(F.get_json_object(value, "$").isNull(), "not a JSON document")
        .when(kind.isNull(), "no relevant_texts")
        .otherwise("relevant_texts is not a list")
    )


def invalid_caches(spark: SparkSession, path: str) -> DataFrame:
    """package_id, path and reason of the caches that could not be read, to be done again."""
    found = _caches(spark, path).select("package_id", F.col("_metadata.file_path").alias("path"), cache_fault(F.col("value")).alias("reason"))
    return found.filter(F.col("reason").isNotNull())


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entities, approvals, rules or ground truth kept as JSON lines, with a declared schema."""
    return spark.read.schema(schema).json(path)


def all_files(*sources: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Archive files and attachments as one table."""
    out = sources[0].select(*columns)
    for source in sources[1:]:
        out = out.unionByName(source.select(*columns))
    return out
