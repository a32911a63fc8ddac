"""The registered queries on the given tables: contracts that no SQL states, and held-out accuracy."""

import hashlib
import zlib

import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm import brute

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
QUERIES = __spark_entry__.queries()
COLUMNS = {
    "op1_suffix_arrays": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op2_boosted_candidates": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_positive_unlabelled": ["doc_id", "held_out", "score", "predicted"],
    "op5_weak_supervision": ["doc_id", "held_out", "score", "predicted"],
    "op6_external_shuffle": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op7_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op8_prefix_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_winnowing": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op12_pair_bitmaps": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")[["doc_id", "text"]].values.tolist()


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, texts, name):
    frame = QUERIES[name](spark, SMALL)
    assert set(COLUMNS[name]) <= set(frame.columns)
    assert sorted(r["doc_id"] for r in frame.select("doc_id").collect()) == [d for d, _ in texts]


def table(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SMALL).collect()}


def test_repeats(spark, texts):
    got = table(spark, "op1_suffix_arrays")
    assert [tuple(got[d])[:5] for d, _ in texts] == brute.repeats(texts)


def test_components(spark, texts):
    got = table(spark, "op7_ngram_join")
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute.components(texts)


def test_contamination(spark, texts):
    got = table(spark, "op9_winnowing")
    items = pd.read_parquet(f"{SMALL}/benchmark.parquet")[["item_id", "text"]].values.tolist()
    assert [tuple(got[d]) for d, _ in texts] == brute.contamination(texts, items)


def auc(good, bad):
    rank = pd.Series([*good, *bad]).rank().iloc[: len(good)].sum()
    return (rank - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))


@pytest.mark.parametrize(("name", "label", "least", "errors"), [("op4_positive_unlabelled", "quality", 0.98, 0.02), ("op5_weak_supervision", "toxic", 0.93, 0.04)])
def test_held_out_accuracy(spark, name, label, least, errors):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = QUERIES[name](spark, LARGER).where("held_out").join(labels, "doc_id").toPandas()
    assert auc(rows[rows[label] == 1].score, rows[rows[label] == 0].score) > least
    assert (rows[label] != rows.predicted).mean() < errors


def test_pipeline(spark):
    """Each stage against a plain version of its own decision, on what the stage before kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.toPandas()
    from caseloom.llm.store import stored

    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL))
        after = docs.toPandas()
        if name != "bpe":
            assert docs.columns == columns
        if name == "near_duplicates":
            classes = brute.components(before[["doc_id", "text"]].values.tolist())
            assert sorted(after.doc_id) == sorted(d for d, (n, c) in classes.items() if n == 0 or c == d)
        elif name == "decontamination":
            items = pd.read_parquet(f"{SMALL}/benchmark.parquet")[["item_id", "text"]].values.tolist()
            assert sorted(after.doc_id) == sorted(r[0] for r in brute.contamination(before[["doc_id", "text"]].values.tolist(), items) if not r[5])
        elif name == "personal_data":
            assert sorted(after.doc_id) == sorted(before.doc_id)
            assert not any(brute.base_pii(t) for t in after.text)
            assert (after.n_chars == after.text.str.len()).all()
        elif name == "bpe":
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            texts = dict(before[["doc_id", "text"]].values.tolist())
            for _, r in after.iterrows():
                ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
                assert list(r.ids) == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        else:
            assert 0 < len(after) <= len(before)
        before = after


def test_pipeline_passes_odd_rows(spark, odd, repeated, empty):
    for docs in (odd, repeated, empty):
        frame = docs
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SMALL)
            if name != "bpe":
                assert frame.columns == docs.columns
        assert frame.count() >= 0




def test_shard_columns(spark, texts):
    got = table(spark, "op6_external_shuffle")
    for d, text in texts:
        data = (text or "").encode()
        r = got[d]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None) and 0 <= r["shard"] < 8


def test_digests_of_personal_data(spark, texts):
    got = table(spark, "op2_boosted_candidates")
    for d, text in texts:
        base = brute.base_pii(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert got[d]["base_sha256"] == digest
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(got[d]["spans"].split(","))
        assert [got[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]


def test_digests_of_ids_and_decoded_texts(spark, texts):
    got = table(spark, "op8_prefix_bpe")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids) and got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_kept_of_quality_rules(spark, texts):
    """Base failures go; a text that the adaptive rules name goes; all others stay."""
    for r in QUERIES["op10_quality_rules"](spark, SMALL).collect():
        assert r["kept"] == (not r["base_failed"] and not r["failed"])


def test_whitening_and_package_columns(spark):
    rows = QUERIES["op11_whitening"](spark, SMALL)
    assert set(rows.columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    vectors = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    assert rows.count() == 4 * len(vectors) and rows.where("identity_error > 1e-9").isEmpty()
    pages = QUERIES["op13_zip_packages"](spark, SMALL)
    assert set(pages.columns) == {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}
