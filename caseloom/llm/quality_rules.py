"""Quality rules with thresholds that follow the data: quantile sketches per language and source, joined back.

A sketch counts values in bins of fixed borders, each ``GAMMA`` times as wide as the one before: a quantile is off by 1 % at
most. Counts are exact and merge by adding, so the same table gives the same limits however it is dealt, and a language's
sketch is the sum of its sources'. Texts that fail the base rules are not counted.

A limit is the median plus the largest of three distances:

* ``REACH`` times the distance from the median to the nearer quartile: junk, while it is less than half of a group, stretches
  the side on which it lies and not the other one;
* for measures that are zero in most texts (``TAIL``), a multiple of a quantile of the values above zero;
* ``FLOOR``, against a spread of nothing.

Median and distances of a group are its own, drawn to its language's by ``WEIGHT`` of n + WEIGHT, and those likewise to all
rows': no number of rows flips a verdict.

DataFrame functions only. Each row is judged alone, so repeated rows give repeated results and ties don't matter.
A null text has no words; a null language or source counts as the empty name; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.store import stored

WINDOW = 8
# Symbols and spaces of the base rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_RUN = r"[\x20\x09-\x0D]+"

GAMMA = 1.02
#: Measure -> least distance of its limit from the median.
FLOOR = {"capital_share": 0.02, "word_length": 1.0, "symbol_share": 0.02, "symbol_words": 0.1, "dup_line_share": 0.4, "repeat_share": 0.27}
#: Measure -> (quantile of the values above zero, its multiple), for measures that are zero in most texts.
TAIL = {"symbol_share": (0.25, 0.5), "symbol_words": (0.25, 0.5), "dup_line_share": (0.75, 1.2), "repeat_share": (0.75, 2.5)}
MEASURES = list(FLOOR)
#: Times the distance from the median to the nearer quartile.
REACH = 15.0
#: Rows that a group's own limit needs to count as much as that of its language.
WEIGHT = 50.0


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    docs = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    docs = docs.withColumn("words", F.filter(F.split("text", SPACE_RUN), lambda w: w != ""))
    docs = docs.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0))
    docs = docs.withColumn("n_words", F.size("words")).withColumn(
        "windows",
        F.when(
            F.col("n_words") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.col("n_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
        ),
    )
    docs = docs.select(
        "doc_id", "lang", "source", "n_words", "windows",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w)).alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).alias("n_symbols"),
        (F.length("text") - _without(F.col("text"), CAPITALS)).alias("n_capitals"),
        (F.length("text") - _without(F.col("text"), "!|")).alias("n_marks"),
    )
    # Only texts with a repeated window are sorted; equal windows then stand side by side.
    docs = docs.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    docs = docs.withColumn(
        "starts",
        F.array_sort(
            F.transform(
                F.filter(
                    F.transform(
                        "ordered",
                        lambda x, j: F.struct(
                            x["i"].alias("i"),
                            (
                                (F.get("ordered", j - 1)["h"].eqNullSafe(x["h"])) | (F.get("ordered", j + 1)["h"].eqNullSafe(x["h"]))
                            ).alias("twice"),
                        ),
                    ),
                    lambda x: x["twice"],
                ),
                lambda x: x["i"],
            )
        ),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "starts", zero, lambda a, s: F.struct((a["n"] + s + WINDOW - F.greatest(s, a["end"])).alias("n"), (s + WINDOW).alias("end")), lambda a: a["n"]
    )
    return docs.select(
        "doc_id", "lang", "source",
        *(F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        *(F.col(c).cast("long") for c in ("n_lines", "n_capitals", "n_marks")),
    )


def with_shares(measured: DataFrame) -> DataFrame:
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return measured.select(
        "*",
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_capitals") / chars).alias("capital_share"),
        (F.col("word_chars") / words).alias("word_length"),
        (F.col("n_marks") / words).alias("symbol_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketches(shares: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: the counts of the values, by bins. Bin NULL holds the zeros."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in MEASURES)))
    values = shares.where(~base_failed()).select("lang", "source", each.alias("x")).select("lang", "source", "x.*")
    place = F.when(F.col("value") > 0, F.ceil(F.log("value") / math.log(GAMMA)).cast("int"))
    return values.groupBy("lang", "source", "measure", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], wanted: list[float]) -> DataFrame:
    """keys, measure, ``n`` and a column per quantile, from sketches merged by adding."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = [*keys, "measure"]
    # At most one row per bin: some 2,000 of them hold all numbers between 1e-9 and 1e9.
    up_to = Window.partitionBy(*group).orderBy(F.col("bin").asc_nulls_first())
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bin")) * 2 / (1 + GAMMA), F.lit(0.0))
    ranked = merged.select(*group, value.alias("value"), F.sum("n").over(up_to).alias("upto"), F.sum("n").over(Window.partitionBy(*group)).alias("n"))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(q * (F.col("n") - 1)), F.col("value")))

    return ranked.groupBy(*group).agg(F.max("n").alias("n"), *(quantile(q).alias(f"q{100 * q:.0f}") for q in wanted))


def distances(sketch: DataFrame, level: str, *keys: str) -> DataFrame:
    """keys, measure and, for ``level``, n and m (values, and those above zero), middle, reach and tail."""
    spread = F.least(F.col("q50") - F.col("q25"), F.col("q75") - F.col("q50"))
    all_values = quantiles(sketch, [*keys], [0.25, 0.5, 0.75]).select(
        *keys, "measure", F.col("n").alias(f"n_{level}"), F.col("q50").alias(f"middle_{level}"), (REACH * spread).alias(f"reach_{level}")
    )
    above = quantiles(sketch.where("bin is not null"), [*keys], sorted({q for q, _ in TAIL.values()}))
    tail = F.lit(0.0)
    for c, (q, times) in TAIL.items():
        tail = F.when(F.col("measure") == c, times * F.col(f"q{100 * q:.0f}")).otherwise(tail)
    return all_values.join(above.select(*keys, "measure", F.col("n").alias(f"m_{level}"), tail.alias(f"tail_{level}")), [*keys, "measure"], "left")


def _drawn(name: str, count: str) -> Column:
    """A group's value drawn to its language's and that to all rows', the more the fewer values it hangs on."""
    out = F.coalesce(f"{name}_all", F.lit(0.0))
    for level in ("lang", "own"):
        n = F.coalesce(f"{count}_{level}", F.lit(0))
        out = F.coalesce((n * F.col(f"{name}_{level}") + WEIGHT * out) / (n + WEIGHT), out)
    return out


def thresholds(shares: DataFrame) -> DataFrame:
    """Upper limits ``most_<measure>`` per language and source."""
    sketch = stored(sketches(shares))  # small rows per group; read several times
    joined = distances(sketch, "own", "lang", "source").join(distances(sketch, "lang", "lang"), ["lang", "measure"]).join(distances(sketch, "all"), "measure")
    floor = F.create_map(*(F.lit(x) for pair in FLOOR.items() for x in pair))[F.col("measure")]
    most = _drawn("middle", "n") + F.greatest(floor, _drawn("reach", "n"), _drawn("tail", "m"))
    drawn = joined.select("lang", "source", "measure", most.alias("most"))
    return drawn.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == c, F.col("most"))).alias(f"most_{c}") for c in MEASURES))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Every document with its measures, ``base_failed`` (fixed rules), ``failed`` (names of the adaptive rules
    it breaks) and ``kept``. Extra columns of ``docs`` are ignored. Texts of any length are read whole."""
    shares = with_shares(stored(measures(docs)))
    joined = shares.join(thresholds(shares), ["lang", "source"], "left")
    failed = F.filter(F.array(*(F.when(F.col(c) > F.col(f"most_{c}"), F.lit(c)) for c in MEASURES)), lambda x: x.isNotNull())
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), failed.alias("failed"), (~base_failed() & (F.size(failed) == 0)).alias("kept"),
    )
