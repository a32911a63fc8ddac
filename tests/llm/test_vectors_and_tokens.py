"""Whitening and the alignment of two tokenizers against plain versions, on given, odd, repeated and empty tables."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caseloom.llm import alignment, whitening
from tests.llm import brute

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [1, 2, 0.5, 3, 0.1, 0.7]]) for i in range(200)]
    rows += [(200, None), (201, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [1.0, -3.0]), (204, []), (205, [float("-inf")] * 6)]
    return [*rows, (None, rows[0][1]), (0, rows[0][1]), (0, rows[1][1]), *[(300 + i, rows[2][1]) for i in range(150)]]


def check_whitening(spark, rows, k=4):
    got = whitening.whitened_components(spark.createDataFrame([(*r, 1) for r in rows], VECTORS), k).collect()
    n, _, each, values, axes, trace = brute.whitening(rows, k)
    assert {(r["n"]) for r in got} <= {n} and all(r["identity_error"] < 1e-9 for r in got)
    for c in range(1, k + 1):
        mine = sorted(((str(r["vec_id"]), r["deviation"], abs(r["whitened"])) for r in got if r["component"] == c))
        want = sorted((str(i), d, abs(float(np.dot(m, axes[:, c - 1]))) / values[c - 1] ** 0.5) for i, d, m in each)
        assert [r[:2] for r in mine] == [r[:2] for r in want]
        assert np.allclose([r[2] for r in mine], [r[2] for r in want], rtol=1e-9, atol=1e-9)
        assert all(abs(r["explained"] - values[c - 1] / trace) < 1e-12 for r in got if r["component"] == c)


def test_whitening(spark):
    check_whitening(spark, odd_vectors())


def test_whitening_of_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check_whitening(spark, [(r["vec_id"], list(r["embedding"])) for r in table.collect()])


def test_whitening_without_variance(spark):
    def components(rows):
        return whitening.whitened_components(spark.createDataFrame([(*r, 1) for r in rows], VECTORS)).collect()

    assert components([]) == [] and components([(1, None)]) == []
    assert components([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == [] and components([(1, [])]) == []
    line = components([(i, [float(i), 2.0 * i, 1e9]) for i in range(5)])
    assert {r["component"] for r in line} == {1} and len(line) == 5


def test_whitening_of_huge_entries(spark):
    """Beyond 64 bits the planes' sums are Python integers, and a deviation that doesn't fit a long is null."""
    rows = [(1, [3e20, -1.0]), (2, [-1e25, 4.0]), (3, [1e15, 2.0])]
    got = whitening.whitened_components(spark.createDataFrame([(*r, 1) for r in rows], VECTORS)).collect()
    assert {r["deviation"] for r in got} == {None} and {r["n"] for r in got} == {3}
    _, _, each, values, axes, _ = brute.whitening(rows)
    mine = sorted((r["vec_id"], abs(r["whitened"])) for r in got if r["component"] == 1)
    assert np.allclose([w for _, w in mine], [abs(np.dot(m, axes[:, 0])) / values[0] ** 0.5 for _, _, m in each])


def test_whitening_keeps_clashing_columns(spark):
    names = ("x", "row", "packed", "n", "i", "whitened")
    table = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(9)], "vec_id long, embedding array<double>").selectExpr("*", *(f"vec_id AS {c}" for c in names))
    rows, model = whitening.whiten(table, 2)
    assert sorted((r["row"]["vec_id"], r["row"]["x"], len(r["whitened"])) for r in rows.collect()) == [(i, i, 2) for i in range(9)] and model.n == 9


@pytest.mark.parametrize("bits", [1, 5, 24, 25, 33, 64])
def test_cross_products_of_planes(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 1 << bits, (201, 5), np.uint64, endpoint=False) if bits < 64 else rng.integers(0, (1 << 64) - 1, (201, 5), np.uint64, endpoint=True)
    got = whitening.cross_products(whitening.planes(x, bits))
    exact = [[int(v) for v in row] for row in x]
    assert all(int(got[i, j]) == sum(r[i] * r[j] for r in exact) for i in range(5) for j in range(i, 5))


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check_alignment(docs, **options):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r[c] for c in NAMES) for r in alignment.align(docs, *PATHS, **options).collect()]
    assert sorted(got, key=str) == sorted(brute.alignment(rows, *PATHS), key=str)


def test_alignment(spark, odd, repeated, empty):
    check_alignment(odd)
    check_alignment(repeated)
    assert alignment.align(empty, *PATHS).collect() == []
    check_alignment(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_alignment_in_small_blocks(spark):
    """Blocks of a few links, dense bitmaps and high multiplicities."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "tokenizer", "x▁y", "naïve", "漢字", "<s>", "<0x0A>", "\n\n", "😀"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    texts += ["a" * 3000, "the " * 2000, "▁", " ", "<|endoftext|>", "b\x00c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check_alignment(docs, block_links=40)
    check_alignment(docs)


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "one two one"), (3, None)], "doc_id long, text string")
    pairs = alignment.linked_pairs(alignment.build_index(docs, *PATHS, ["doc_id"])).collect()
    assert {r["count"] for r in pairs} == {2} and sum(r["links"] for r in pairs) == 5 and all(r["best"] for r in pairs)


def test_wide_groups_are_multiplied():
    """A group of many ids gives the links of the plain product."""
    a = alignment.Vocabulary(None, [b"aa", b"aaa"])
    b = alignment.Vocabulary(None, [b"a" * 9, b"a" * 5])
    found = alignment.Aligned([[0] + [1] * 61 + [0] * 2], [[0] * 21], a, b)
    assert found.n_a.tolist() == [64] and [x.tolist() for x in found.links()] == [[0, 0], [0, 1 << 16], [3 * 21, 61 * 21]]


def test_byte_level_ids_are_those_of_the_library():
    """Both libraries agree; very long runs of white space and long texts too."""
    mine, library = alignment.byte_level(PATHS[0]), Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    rng = random.Random(8)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), 32, 10])) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a" + " " * n + "b" for n in (5000, 200_000, 300_000)] + ["a" * 30_000, "\n" * 100_000, "x\u3000" * 20_000, "<|endoftext|>" * 3]
    want = [library.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert mine.encode(texts) == want
