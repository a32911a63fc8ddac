import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "in", "é", "Wo", "b", "on"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def odd_rows():
    """Null and empty texts, a very long one, copies, near copies, repeated rows, equal and null ids, hot source."""
    rng = random.Random(11)
    texts = [None, "", "   \n\t ", "one two", "one two", "a" * 30_000, "ab " * 400, "x\x00y" * 90, "1.2.3.4 +49 (30) 555-0100 4111 1111 1111 1111 a.b@c.de"]
    base = [sentence(rng, n) for n in (6, 30, 120, 400)]
    texts += base + base
    for text in base[1:]:
        words = text.split()
        for cut in (1, 3, 9):
            texts.append(" ".join(words[:cut] + ["changed"] + words[cut + 1 :]))
            texts.append(" ".join(words[cut:]))
    texts += [sentence(rng, 20) + " " + base[2] + " " + sentence(rng, 20), base[1].upper(), "\n".join([base[1]] * 4), sentence(rng, 9000)]
    texts += ["<|endoftext|> don't 漢字 ½ İſ é", "#" * 300 + " words here " * 8, "idiot you stupid moron " + base[1]]
    rows = [(i * 3 % 101, t, rng.choice(["en", None]), "hot" if i % 3 else rng.choice(["s1", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Distinct ids, with columns whose names the operators use themselves."""
    frame = spark.createDataFrame(odd_rows(), SCHEMA)
    return frame.selectExpr("*", *(f"1 AS {c}" for c in ("key", "t", "row", "score", "shard", "slot", "words", "n", "items", "base", "again")))


@pytest.fixture(scope="session")
def repeated(spark):
    """Repeated rows, equal ids with other texts, and null ids."""
    rows = odd_rows()
    more = [*rows, *rows[:15], *[(None, *r[1:]) for r in rows[:12]], *[(rows[0][0], *r[1:]) for r in rows[9:14]]]
    return spark.createDataFrame(more, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
