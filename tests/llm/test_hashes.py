"""Words whose polynomials modulo 2**64 collide for every base, and sound hashes."""

import hashlib

import numpy as np
import pytest

from caseloom.llm import arrays, decontamination, ngram_join, suffix_dedup
from tests.llm import brute


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


WORD, OTHER = thue_morse(2048), thue_morse(2048, "ba")


def rows():
    texts = [WORD, OTHER, f"{WORD} " * 6, f"{OTHER} " * 6, WORD, " ".join([WORD, OTHER] * 10), " ".join([OTHER, WORD] * 10), f"one two {WORD} three four five {OTHER}", f"one two {OTHER} three four five {WORD}"]
    return list(enumerate(texts))


def test_words_collide_modulo_2_64_and_not_here():
    data = np.frombuffer((WORD + OTHER).encode(), np.uint8)
    starts, ends = np.array([0, 2048]), np.array([2048, 4096])
    assert len(set(arrays.range_hashes(arrays.prefix_sums(data), starts, ends).tolist())) == 1
    assert len(set(arrays.word_hashes(data, starts, ends).tolist())) == 2


def test_hash_is_of_the_bytes_alone():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 3, 400_000).astype(np.uint8)
    data[200_000:] = data[:200_000]
    starts = np.array([0, 5, 9, 100, 200_000, 200_005, 200_009, 200_100])
    ends = np.array([5, 9, 90, 170_000, 200_005, 200_009, 200_090, 370_000])  # the last is longer than LONG
    for step in (7, 1 << 17):
        got = arrays.word_hashes(data, starts, ends, step).tolist()
        assert got[:4] == got[4:] and len(set(got)) == 4
    prime, base = arrays.PRIMES[0], arrays.BASES[0]
    want = [sum((int(c) + 1) * pow(base, i, p) for i, c in enumerate(data[:5].tolist())) % p for p, base in zip(arrays.PRIMES, arrays.BASES)]
    assert int(arrays.word_hashes(data, starts[:1], ends[:1])[0]) == int(arrays.mix(np.array([want[0] << 31 | want[1]], np.uint64))[0])
    assert all(pow(x, p - 1, p) == 1 for p in arrays.PRIMES for x in (2, 3, 5, 7)) and 1 < base < prime


def test_components(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute.components(rows())
    assert ngram_join.one_of_each(docs).count() == len({c for _, c in got.values()})


def test_links_are_compared_by_bytes(spark, monkeypatch):
    """Even if all words of a length had one hash."""
    texts = ["a b c d e f g h", "a b c d e f g i", "q r s t u v w x", "a b c d e f g h"]
    pairs = [(ngram_join.read_set(x.encode()), ngram_join.read_set(y.encode())) for x in texts for y in texts]
    assert [ngram_join.similar(x, y) for x, y in pairs] == [brute.shingles(x) == brute.shingles(y) or len(brute.shingles(x) & brute.shingles(y)) * 100 >= 75 * len(brute.shingles(x) | brute.shingles(y)) for x in texts for y in texts]
    monkeypatch.setattr(arrays, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    one, other = ngram_join.read_set(texts[0].encode()), ngram_join.read_set(texts[2].encode())
    assert one.grams.tolist() == other.grams.tolist() and not ngram_join.similar(one, other)
    assert ngram_join.similar(one, ngram_join.read_set(texts[3].encode()))


def test_contamination(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    items = [("w", WORD), ("s", f"{OTHER} " * 5), ("l", " ".join([WORD, OTHER] * 7)), ("t", f"three four five {OTHER}")]
    found = decontamination.find_contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect()
    got = {r["row"]["doc_id"]: (r["n_words"], sum(r["runs"][1::2]) - sum(r["runs"][::2]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found}
    assert got == {d: tuple(want[:4]) for d, *want in brute.contamination(rows(), items)}


def test_contamination_without_good_hashes(spark, monkeypatch):
    """Hashes only propose: with one hash for all words the places are many and the result is the same."""
    words = [f"w{i % 17}" for i in range(60)]
    items = [("a", " ".join(words[5:25])), ("b", " ".join(words[3:9])), ("c", "w1 w2")]
    for text in (" ".join(words), "w9 " * 40, " ".join(reversed(words))):
        mine = decontamination.word_list(text)
        places = [(p, q, 0) for p in range(len(mine)) for q in range(20)]
        runs = decontamination.union(decontamination.runs_in(mine, decontamination.word_list(items[0][1]), places))
        want = brute.contamination([(1, text)], items[:1])[0]
        assert sum(b - a for a, b in runs) == want[2]


def test_repeats(spark):
    docs = [(i, t) for i, t in rows()]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for doc_id, size, gone, spans, sha in brute.repeats(docs):
        r = got[doc_id]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]) // 2, hashlib.sha256(r["kept"]).hexdigest()) == (size, gone, spans, sha)


def test_equal_runs_are_compared_by_bytes():
    """Two runs of one hash and different bytes are both first."""
    data = np.frombuffer((WORD[:120] + OTHER[:120] + WORD[:120]).encode(), np.uint8)
    columns = {"key": np.zeros(3, np.uint64), "content": np.zeros(3, np.uint64), "size": np.full(3, 120), "doc": np.arange(3), "t": np.zeros(3, np.int64), "start": np.zeros(3, np.int64)}
    own, later = suffix_dedup.firsts(columns, data, np.array([0, 120, 240]))
    assert 1 in own.tolist() and 0 in own.tolist() and set(later.tolist()) <= {2}


def letters(slots, filler=30):
    """A form of ``filler`` words with two slots: no two letters are alike enough, all share n-grams with many."""
    form = [f"f{i}" for i in range(filler)]
    return [(a * slots + b, " ".join(form[:8] + [f"a{a}"] + form[8:20] + [f"b{b}"] + form[20:])) for a in range(slots) for b in range(slots)]


def test_forms_are_pruned_before_texts_are_read(spark, monkeypatch):
    counted = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, texts: counted.append(pairs.count()) or verified(pairs, texts))
    rows = letters(30)
    docs = spark.createDataFrame(rows + [(2000, rows[0][1] + " more"), (2001, rows[1][1])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    want = brute.components(rows + [(2000, rows[0][1] + " more"), (2001, rows[1][1])])
    assert got == {d: c for d, (_, c) in want.items()}
    assert sum(counted) < 10 * len(rows)


@pytest.mark.parametrize("options", [{"part": 7}, {"salted": 3, "part": 7}, {"salted": 2}])
def test_wide_and_salted_groups(spark, options):
    """One n-gram in all sets, cut into parts and salted, gives the same classes."""
    rows = letters(9) + [(900 + i, t + f" tail{i % 3}") for i, (_, t) in enumerate(letters(5))] + [(i + 500, f"q{i} r{i} s{i} t{i} u{i} v{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: c for d, (_, c) in brute.components(rows).items()}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, **options).collect()} == want
