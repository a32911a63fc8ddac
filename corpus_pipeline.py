"""Documents to tokens: each stage applies one operator of ``caseloom.llm`` to all that the stage before kept.

Every stage takes the columns of ``documents`` and returns them, the last one returns ids. Extra columns travel along.
Rows with null or empty texts pass: they have nothing to be rejected, linked, contaminated or redacted (the quality
stage judges them by its score, as all others).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import bpe, decontamination, ngram_join, personal_data, quality_model
from caseloom.llm.queries import WORD_BPE
from caseloom.llm.store import stored, table

#: Documents of a lower score go.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go."""
    model = quality_model.learn(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model).where(F.col("score") >= QUALITY).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontamination.is_contaminated()).select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    found = personal_data.find_personal_data(docs, personal_data.learn(docs))
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left."""
    found = bpe.encode(docs, WORD_BPE)
    return found.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact),
    ("bpe", encode),
]
#: The stages learn models and follow links: not for SQL. tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
