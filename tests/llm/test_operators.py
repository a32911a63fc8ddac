"""Each operator against a plain version, on odd, repeated and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm import bpe, decontamination, ngram_join, personal_data, quality_model, quality_rules, sharding, suffix_dedup, token_store, toxicity
from caseloom.llm.components import connected
from caseloom.llm.store import stored
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_repeats(odd):
    rows = sorted(pairs(odd))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(odd).collect()}
    for doc_id, size, gone, spans, sha in brute.repeats(rows):
        r = got[doc_id]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]) // 2, hashlib.sha256(r["kept"]).hexdigest()) == (size, gone, spans, sha)


def test_repeats_of_equal_ids(repeated, empty):
    rows = pairs(repeated)
    got = suffix_dedup.remove_repeats(repeated).collect()
    assert len(got) == len(rows)
    # Rows of equal id and text are one document, so the first of each text keeps what is first.
    assert {r["n_removed"] for r in got if r["n_bytes"] < suffix_dedup.LENGTH} <= {0}
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_arrays_of_periodic_bytes():
    rng = np.random.default_rng(1)
    for trial in range(40):
        data = rng.integers(97, 98 + trial % 4, int(rng.integers(150, 900))).astype(np.uint8)
        data = np.concatenate([data, data[: len(data) // 2]])
        order, rank = suffix_dedup.suffix_array(data)
        raw, common = data.tobytes(), suffix_dedup.common_prefixes(data, order, rank, lane=64)
        cut = [raw[i : i + suffix_dedup.LENGTH] for i in order]
        assert cut == sorted(cut)
        for k in range(1, len(cut)):
            same = next((h for h, (a, b) in enumerate(zip(cut[k], cut[k - 1])) if a != b), min(len(cut[k]), len(cut[k - 1])))
            assert common[k] == same


def test_shards_of_one_key_are_merged(spark, monkeypatch):
    """Suffix arrays far smaller than a key's runs give the same result."""
    rng = random.Random(5)
    passage = "".join(rng.choice("ab") for _ in range(260))
    rows = [(i, "".join(rng.choice("abc") for _ in range(40)) + passage[rng.randrange(60) :] + "".join(rng.choice("abc") for _ in range(40))) for i in range(60)]
    columns = {"doc": [], "start": [], "size": []}
    data = b""
    for i, text in rows:
        columns["doc"].append(i), columns["start"].append(0), columns["size"].append(len(text))
        data += text.encode()
    n = len(rows)
    fields = {
        "key": np.full(n, 7, np.uint32), "doc": np.array(columns["doc"], np.int64), "t": np.zeros(n, np.int64), "start": np.zeros(n, np.int32),
        "size": np.array(columns["size"], np.int32), "twice": np.ones(n, bool), "at": np.zeros(n, np.uint8),
    }
    import pandas as pd
    import zstandard

    packed = suffix_dedup._pack(zstandard.ZstdCompressor(), fields, np.frombuffer(data, np.uint8), np.zeros((0, 4), np.int64))
    want = {d: gone for d, _, gone, _, _ in brute.repeats(rows)}
    for limit in (1 << 20, 2000, 400):
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", limit)
        (out,) = suffix_dedup._dedup_shard(iter([pd.DataFrame({"packed": [packed]})]))
        got = (out["end"] - out["start"]).groupby(out["key"]).sum().to_dict()
        assert {d: got.get(d, 0) for d in want} == want, limit


def test_personal_data(odd, empty):
    got = {r["row"]["doc_id"]: r for r in personal_data.find_personal_data(odd, None).collect()}
    for doc_id, text in pairs(odd):
        base = brute.base_pii(text)
        assert got[doc_id]["base"] == personal_data.joined(base) == got[doc_id]["spans"]
    assert personal_data.learn(empty) is None
    assert personal_data.find_personal_data(empty, None).count() == 0
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("aB.9@+- ()1_%é\n22") for _ in range(rng.randrange(40)))
        assert personal_data.base_spans(text) == brute.base_pii(text)


def test_personal_data_takes_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1(((" * 40_000, "a@" * 100_000, "1 " * 100_000):
        personal_data.base_spans(text)
        personal_data.candidates(text)


def test_boosted_candidates_learn_format_and_context(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        card = "".join(rng.choice("0123456789") for _ in range(15))
        card += next(d for d in "0123456789" if brute.luhn(card + d))
        fail = card[:-1] + str((int(card[-1]) + 1) % 10)
        rows.append((i, f'some words token = "{token}" and {card} then order {fail} of {rng.randrange(10**17, 10**18)} a{i}@b.example.org'))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = personal_data.learn(docs)
    found = {r["row"]["doc_id"]: r for r in personal_data.find_personal_data(docs, model).collect()}
    secrets = sum("secret:" in found[i]["spans"] for i, _ in rows)
    assert secrets > 380
    for i, text in rows[:50]:
        assert "[CARD]" in found[i]["redacted"] and "[EMAIL]" in found[i]["redacted"]
        base = found[i]["base"].split(",")
        assert set(base) <= set(found[i]["spans"].split(","))


def test_candidates_of_any_length_and_written_out_at(spark):
    token = "a1B2" * 300
    assert ("secret", 4, 1204) in personal_data.candidates(f"key {token} end")
    assert personal_data.verdict("email", "ann [at] mail.example.org", False, False) == -1 == personal_data.verdict("email", "jürgen(at)köln.de", False, False)
    assert personal_data.verdict("email", "meet(at)noon", False, False) == 0 == personal_data.verdict("email", "a@b", False, False)
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = [(i, f"please write to {letters(7)}@{letters(6)}.example.org today or {letters(5)}@{letters(4)} and {letters(6)}(at){letters(4)} soon") for i in range(300)]
    rows += [(1000 + i, f"please write to {letters(7)}{at}{letters(6)}.example.org today") for i, at in enumerate([" [at] ", "[at]", "(at)"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["row"]["doc_id"]: r["spans"] for r in personal_data.find_personal_data(docs, personal_data.learn(docs)).collect()}
    assert all(found[i].startswith("email:16:") for i, _ in rows if i >= 1000)
    assert all(found[i].count("email:") == 1 for i, _ in rows if i < 1000)


def test_sample_of_candidates_ignores_the_order_of_rows(spark):
    rng = random.Random(8)
    rows = [(i, f"call {rng.randrange(10**11, 10**12)} or a{i}@b{i % 7}.org or a{i}@c of {rng.randrange(10**15, 10**16)}" + " x" * (i % 9)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    models = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (3, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            models.append(personal_data.learn(docs, rows=300))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    a, b = models
    assert a.scale == b.scale and a.thresholds == b.thresholds


def test_token_store(spark, repeated, empty, tmp_path):
    folder = token_store.write_tokens(repeated, PATH, 2, str(tmp_path / "tokens"), block_bytes=3000)
    got = token_store.read_tokens(spark, folder).orderBy("start").collect()
    rows = pairs(repeated)
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    want = sorted(((d is not None, d or 0), *LIBRARY.encode(t or "", add_special_tokens=False).ids, 2) for d, t in rows)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), *r["ids"]) for r in got) == want
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        start += r["n_tokens"]
    digest = {(r["start"]): r["ids_crc32"] for r in token_store.read_tokens(spark, folder, digest=True).collect()}
    assert digest == {r["start"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got}
    one = rows[20][0]
    assert sorted(r["ids"] for r in token_store.read_tokens(spark, folder, one).collect()) == sorted(r["ids"] for r in got if r["doc_id"] == one)
    assert token_store.read_tokens(spark, token_store.write_tokens(empty, PATH, 2, str(tmp_path / "none"))).count() == 0


def test_bpe_is_exact(odd, empty):
    for r in bpe.encode(odd, PATH).collect():
        ids = LIBRARY.encode(r["row"]["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty, PATH).count() == 0


def test_bpe_on_random_text():
    own, rng = bpe.Encoder(PATH), random.Random(4)
    texts = ["".join(rng.choice("abTHE'séÉñ́  \t\n\x1c\x85ÀİΣß1٣漢🙂<|endoftext|>!#ſK") for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["a" * 3000, "ing" * 500, "erer" * 200]
    for text, found in zip(texts, own.whole(texts), strict=True):
        assert found[1] == " ".join(map(str, LIBRARY.encode(text, add_special_tokens=False).ids))
    tokens = [i for i, t in own.text.items() if own.merged(t) == [i]]
    for _ in range(5000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if not own.text[a].endswith(bpe.END):
            assert own.fits(a, b) == (own.merged(own.text[a] + own.text[b]) == [a, b])


def test_ngram_join(odd, repeated, empty):
    want = brute.components(pairs(odd))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(odd).collect()}
    assert got == want
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.near_duplicates(repeated).count() == repeated.count()
    kept = ngram_join.one_of_each(repeated)
    assert kept.columns == repeated.columns
    classes = ngram_join.classes(repeated).where("n > 0").select("least").distinct().count()
    rows = kept.collect()
    assert sum(bool(brute.shingles(r["text"])) for r in rows) == classes
    assert sum(not brute.shingles(r["text"]) for r in rows) == sum(not brute.shingles(t) for _, t in pairs(repeated))


def test_ngram_join_of_a_large_family(spark):
    """More sets share n-grams than are paired at once: the links found in linear numbers and the crossing pairs together
    give the true classes."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words[: rng.randrange(70, 91)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows)


def test_connected(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2050)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["id"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def items(odd):
    long = [t for _, t in pairs(odd) if t and 100 < len(t.split()) < 500]
    return [
        ("i1", " ".join(long[0].split()[5:40])), ("i2", long[1]), ("i2", "one two"), ("i3", None), ("i4", ""), (None, "one"), ("i5", "never seen words at all in any of the texts here okay"),
        ("i6", " ".join(long[0].split()[8:20])), ("i7", "ab " * 40), ("i8", "ab"),
    ]


def test_contamination(spark, odd):
    rows = items(odd)
    benchmark = spark.createDataFrame(rows, "item_id string, text string")
    found = decontamination.find_contamination(odd, benchmark)
    found = found.select("row.doc_id", "n_words", decontamination.n_hit().alias("n_hit"), "items", decontamination.is_contaminated().alias("bad"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["bad"]) for r in found.collect()}
    for doc_id, *want in brute.contamination(pairs(odd), [(i or "", t) for i, t in rows]):
        assert got[doc_id] == tuple(want)


def test_contamination_of_nothing(spark, odd, empty):
    none = spark.createDataFrame([], "item_id string, text string")
    assert all(not r["runs"] for r in decontamination.find_contamination(odd, none).collect())
    some = spark.createDataFrame(items(odd), "item_id string, text string")
    assert decontamination.find_contamination(empty, some).count() == 0


def test_shards(spark, repeated, empty):
    n = repeated.count()
    out = sharding.external_shuffle(repeated, bucket_bytes=20_000)
    rows = out.collect()
    assert sorted(map(str, [r[:5] for r in rows])) == sorted(map(str, [tuple(r) for r in repeated.collect()]))
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and sum(map(len, slots.values())) == n
    assert sharding.external_shuffle(empty).count() == 0
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
    assert order != sorted(order)


def test_quality_rules(odd, repeated, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    for doc_id, text in pairs(odd):
        want = brute.quality_measures(text)
        assert {k: got[doc_id][k] for k in want} == want
        assert not (got[doc_id]["kept"] and got[doc_id]["base_failed"])
    assert quality_rules.quality_rules(repeated).count() == repeated.count()
    assert quality_rules.quality_rules(empty).count() == 0


def test_thresholds_follow_their_group(spark):
    clean = "plain words of a text that goes on and on for a while so that it is long enough to pass the rules of size number {}"
    noisy = "# " * 6 + clean
    rows = [(i, clean.format(i), "en", "a", 0) for i in range(300)] + [(1000 + i, noisy.format(i), "en", "b", 0) for i in range(300)] + [(5000, noisy.format(1), "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    assert kept[3] and kept[1003] and not kept[5000]


def test_thresholds_hold_with_much_junk(spark):
    """Two fifths of a source are junk of three kinds; the rest must stay and the junk go."""
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice(["Some", "plain", "words", "go", "on", "for", "while", "texts", "until"]) for _ in range(60))
    junk = [lambda: clean().replace(" ", " #"), lambda: clean().replace(" ", "|| "), lambda: " ".join("".join(rng.choice("abcd") for _ in range(12)) for _ in range(60))]
    rows = [(i, junk[i % 3]() if i % 5 < 2 else clean(), "en", "a", 0) for i in range(1500)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert all(r["kept"] == (r["doc_id"] % 5 >= 2) and not r["base_failed"] for r in got)


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_limits_are_those_of_exact_quantiles(spark, partitions):
    """Within the width of a bin, and the same however the table is dealt."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shares = quality_rules.with_shares(stored(quality_rules.measures(docs))).repartition(partitions)
    rows = shares.toPandas()
    rows = rows[(rows.n_words >= 20) & (100 * rows.n_repeat_words <= 30 * rows.n_words)]
    got = {(r["lang"], r["source"]): r for r in quality_rules.thresholds(shares).collect()}
    assert set(got) == set(zip(rows.lang, rows.source))

    def at(values, q):
        return sorted(values)[int(q * (len(values) - 1))] if len(values) else None

    def parts(values, c):
        above = values[values > 0]
        q25, q50, q75 = (at(values, q) for q in (0.25, 0.5, 0.75))
        tail = quality_rules.TAIL.get(c)
        return (q50, len(values)), (15 * min(q50 - q25, q75 - q50), len(values)), ((tail[1] * at(above, tail[0]) if len(above) else None) if tail else 0.0, len(above))

    for (lang, source), r in got.items():
        own, of_lang = rows[(rows.lang == lang) & (rows.source == source)], rows[rows.lang == lang]
        for c, floor in quality_rules.FLOOR.items():
            drawn = []
            for mine, wider, widest in zip(parts(own[c], c), parts(of_lang[c], c), parts(rows[c], c)):
                value = widest[0] or 0.0
                for part, n in (wider, mine):
                    value = value if part is None else (n * part + 50 * value) / (n + 50)
                drawn.append(value)
            want, limit = drawn[0] + max(floor, *drawn[1:]), r[f"most_{c}"]
            # Each quantile is off by 1 %; a spread is a difference of two, taken 15 times.
            assert abs(limit - want) <= 0.01 * want + 0.31 * drawn[0], (lang, source, c)
            if c in quality_rules.TAIL:
                assert abs(limit - want) <= 0.011 * want


def test_limits_differ_by_group_and_repeat(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    shares = quality_rules.with_shares(stored(quality_rules.measures(docs)))
    one, other = (quality_rules.thresholds(shares.repartition(n)).toPandas().sort_values(["lang", "source"]).reset_index(drop=True) for n in (2, 9))
    assert one.equals(other)
    assert sum(one[f"most_{c}"].nunique() > 20 for c in quality_rules.MEASURES) >= 4
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_rules.quality_rules(docs).join(labels, "doc_id").where(~F.col("base_failed")).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[1] > 0.998 and kept[0] < 0.05


def test_one_row_more_flips_nothing(spark):
    """No number of rows in a group is a border: limits move a little with each."""
    def limits(n):
        rows = [(i, " ".join(f"w{j}" + "x" * (i % 7) for j in range(40)), "en", "small" if i < n else "large", 0) for i in range(700)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        found = quality_rules.thresholds(quality_rules.with_shares(stored(quality_rules.measures(docs)))).where("source = 'small'").first()
        return found["most_word_length"]

    assert abs(limits(199) - limits(200)) < 0.2 and abs(limits(49) - limits(50)) < 0.2


def test_spread_decides_and_not_the_floor(spark):
    """Two sources of one median: a word length far out in the narrow one is usual in the wide one."""
    rows = []
    for i in range(300):
        for k, (source, step) in enumerate((("narrow", 10), ("wide", 40))):
            longer = max(0, 60 + step * (i % 21 - 10) // 10)  # of 60 words, so many letters more
            rows.append((1000 * k + i, " ".join(f"w{j:03d}" + "x" * ((longer + j) // 60) for j in range(60)), "en", source, 0))
    odd = " ".join(f"w{j:03d}" + "x" * 4 for j in range(60))  # 3 letters a word more than the median
    rows += [(9000, odd, "en", "narrow", 0), (9001, odd, "en", "wide", 0)]
    got = {r["doc_id"]: r["failed"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[9000] == ["word_length"] and got[9001] == [] and got[5] == got[1005] == []


def test_models_without_data(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_model.score(odd, quality_model.learn(odd, none)).collect()} == {0.5}
    assert quality_model.score(empty, quality_model.learn(empty, none)).count() == 0
    model = toxicity.learn(odd, none)
    scores = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    bad = next(d for d, t in pairs(odd) if t and t.startswith("idiot"))
    assert scores[bad] > 0.5 and sum(s > 0.5 for s in scores.values()) == 1
    assert toxicity.score(empty, model).count() == 0


def test_class_prior():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        positive = rng.normal(2, 1, 4000)
        unlabelled = np.concatenate([rng.normal(2, 1, int(4000 * share)), rng.normal(-2, 1, int(4000 * (1 - share)))])
        assert abs(quality_model.class_prior(positive, unlabelled) - share) < 0.07


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.2
    votes = np.stack([np.where(rng.random(3000) < 0.8, y, 0) for _ in range(3)] + [rng.random(3000) < 0.05] + [np.where(y, 0, -1) * (rng.random(3000) < 0.9)], axis=1).astype(int)
    p = toxicity.label_model(votes, 0.2)
    assert ((p > 0.5) == y).mean() > 0.95


def test_label_model_with_voters_that_repeat_each_other():
    """Five copies of one weak voter don't outvote four good ones that are independent."""
    rng = np.random.default_rng(7)
    truth = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.85, truth, ~truth) for _ in range(4)]
    weak = np.where(rng.random(4000) < 0.6, truth, ~truth)
    copies = [np.where(rng.random(4000) < 0.98, weak, ~weak) for _ in range(5)]
    votes = np.stack([*good, *copies], axis=1) * 2 - 1
    votes[rng.random(votes.shape) < 0.1] = 0
    p = toxicity.label_model(votes, 0.3)
    mine, most = ((p > 0.5) == truth).mean(), ((votes.sum(1) > 0) == truth).mean()
    assert mine > 0.84 and mine > most + 0.1
    parent = toxicity.strongest_tree(np.stack([np.einsum("ti,tj->ij", one := np.stack([votes[q] == v for v in (-1, 0, 1)], axis=2).reshape(q.sum(), -1) + 0.0, one).reshape(9, 3, 9, 3) / len(truth) + 1e-4 for q in (truth, ~truth)]))
    assert sum(p < 4 for p in parent[4:]) <= 1 and (parent == -1).sum() == 1


def test_insult_near_you_counts_wherever_it_stands():
    voters = toxicity.Voters([])
    near = lambda text: voters.votes(text)[0][-2]
    assert near("you are an idiot") == 1 and near("the idiot " * 200 + "and you idiot") == 1 and near("an idiot told you") == 0


def test_toxic_and_clean_near_copies_both_stay_in_the_sample(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, base if i % 2 else f"{base} you idiot", "en", "a", 0) for i in range(40)] + [(100 + i, None, "en", "a", 0) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1, int(r[0] % 2 == 0)) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert model.score("you idiot") > model.score(base)
