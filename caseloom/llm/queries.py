"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import quality_rules as rules
from caseloom.llm import alignment, bpe, decontamination, ngram_join, personal_data, quality_model, sharding, suffix_dedup, token_store, toxicity, twins, warc_packages, whitening
from caseloom.llm.folds import held_out
from caseloom.llm.store import table

#: The vocabulary files of the contracts.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2

QUERIES = {}
#: The others learn, shuffle or use sketches; tests/llm holds them against plain versions.
ORACLES = {"op7_ngram_join": twins.COMPONENTS, "op9_winnowing": twins.CONTAMINATION, "op13_zip_packages": twins.ARCHIVED_PAGES}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.find_personal_data(docs, personal_data.learn(docs), rewrite=False)
    return found.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query
def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write_tokens(table(spark, sf_dir, "documents"), WORD_BPE, END_ID)
    return token_store.read_tokens(spark, folder, digest=True)


@query
def op4_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.learn(docs, table(spark, sf_dir, "labels"))
    found = quality_model.score(docs, model).select("row.doc_id", "score")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model).select("row.doc_id", "score")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by the law ``rows``."""
    placed = sharding.external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, WORD_BPE, lists=False).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", decontamination.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), decontamination.is_contaminated().alias("contaminated"),
    )


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


@query
def op12_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


@query
def op13_zip_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_packages.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
