import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from caseloom.constants import ISO_DATE, PROTECTED_FIGURE
from caseloom.functions.redaction import redact

ENTITIES = ["Ada Example", "Example Clinic"]
ROWS = [
    ("ADA EXAMPLE works at Example Clinic", "[REDACTED] works at [REDACTED]"),
    ("Call 0412 345 678 now", "Call [REDACTED] now"),
    ("(02) 9876 5432.", "[REDACTED]."),
    ("+61 412 345 678", "[REDACTED]"),
    ("$190,100 0412 345 678", "$190,100 [REDACTED]"),
    ("$ 190,100 and x@y.example.com.", "$ 190,100 and [REDACTED]"),
    ("$190,100@x.example.com", "[REDACTED]"),
    ("jörg@für.example.de", "[REDACTED]"),
    ("2024-06-30", "2[REDACTED]"),
    ("0412 345 678 0498 765 432", "[REDACTED]498 765 432"),
    ("0412 345 678", "[REDACTED]"),
    ("a@b.c+d@e.f", "[REDACTED][REDACTED]"),
    ("a@b@c.d", "a@[REDACTED]"),
    ("$190,100, $ 190,100 and $190,100", "$190,100, $ 190,100 and $190,100"),
    ("nothing here", "nothing here"),
    (None, ""),
    ("", ""),
]


def outputs(spark, texts, **options):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", redact(F.col("t"), **options).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_rows(spark):
    assert outputs(spark, [r[0] for r in ROWS], entities=ENTITIES) == [r[1] for r in ROWS]


def test_ascii_mode_keeps_accented_addresses(spark):
    assert outputs(spark, ["jörg@für.example.de"], unicode=False) == ["jörg@für.example.de"]


def test_date_preset(spark):
    text = "on 2024-06-30 pay $190,100, call 0412 345 678"
    assert outputs(spark, [text], protect=[PROTECTED_FIGURE, ISO_DATE]) == ["on 2024-06-30 pay $190,100, call [REDACTED]"]


def test_options(spark):
    assert outputs(spark, ["Ada\n Example and Ada Example"], entities=ENTITIES) == ["Ada\n Example and [REDACTED]"]
    assert outputs(spark, ["Ada\n Example"], entities=ENTITIES, flex_space=True) == ["[REDACTED]"]
    assert outputs(spark, ["ab 10412 345 678"], strict_phones=True) == ["ab 10412 345 678"]
    assert outputs(spark, ["abc"], entities=[]) == ["abc"]
    assert outputs(spark, ["x@y.example.com"], token=r"<$1\>") == [r"<$1\>"]
    assert outputs(spark, ["MÜLLER"], entities=["Müller"]) == ["[REDACTED]"]
    assert outputs(spark, ["a|b (c) $d"], entities=["a|b", "(c)", "$d"]) == ["[REDACTED] [REDACTED] [REDACTED]"]


def test_junk_is_linear(spark):
    assert outputs(spark, ["a" * 400_000, " " * 400_000, "$" * 100_000]) == ["a" * 400_000, " " * 400_000, "$" * 100_000]


def plain_rules(text, entities):
    """The redaction rules as a Python statement."""
    figures = re.findall(r"\$\s?190,100", text)
    for i, figure in enumerate(figures):
        text = re.sub(r"\$\s?190,100", f"__PROTECTED_{i}__", text, count=1)
    for pattern in ("|".join(re.escape(e) for e in entities), r"[\w.+-]+@[\w-]+\.[\w.-]+", r"(\+61[\s-]?\d|\(0\d\)|0\d)[\d\s-]{6,11}\d"):
        text = re.sub(pattern, "[REDACTED]", text, flags=re.I if "Ada" in pattern else 0)
    for i, figure in enumerate(figures):
        text = text.replace(f"__PROTECTED_{i}__", figure)
    return text


PIECES = st.sampled_from(["$190,100", "$ 190,100", "Ada Example", "ada example", "0412 345 678", "+61", "(02)", " ", "-", "@", ".", "+", "x",
                          "é", "_", "7", "0", "\n", " ", "²", "٣", "́", "\x1c", "$", "190,100", "Example Clinic"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=60, max_size=120))
def test_equals_plain_rules(spark, texts):
    assert outputs(spark, texts, entities=ENTITIES) == [plain_rules(t, ENTITIES) for t in texts]


@pytest.mark.parametrize("text", ["Ada Example 0412 345 678 x@y.example.com $190,100"])
def test_redaction_is_stable(spark, text):
    once = outputs(spark, [text], entities=ENTITIES)
    assert outputs(spark, once, entities=ENTITIES) == once


def test_postal_addresses(one):
    from caseloom.functions.redaction import redact_addresses

    gone = ["12 Harbour Street", "Unit 3, 4/17b Old Mill Rd.", "9 St John's Lane, Port Anna NSW 2041", "100 Émile Zola Avenue, Nantes 44000", "Flat 2 5-7 Kelp Cres"]
    stay = ["12 cars in the Street", "Street 12", "the 3 Way", "12 may Road", "1,000 Dollars", "At 5 pm Mr Lane left", "x12 Harbour Street"]
    for text in gone:
        assert one(redact_addresses(F.col("t")), t=f"to {text}, now") == "to [REDACTED], now", text
        assert one(redact_addresses(F.col("t")), t=text) == "[REDACTED]"
    for text in stay:
        assert one(redact_addresses(F.col("t")), t=f"so {text} it is") == f"so {text} it is", text
    assert one(redact_addresses(F.col("t")), t="1 Aa Aa Aa " * 5000) == "1 Aa Aa Aa " * 5000
