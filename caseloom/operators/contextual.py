"""Second redaction pass: people who are only named in passing.

Names come from where a text says that they are names: address headers, greetings, sign-offs and
the words of the known phrases. They are then redacted everywhere in the same package, wherever
they stand as a capitalised word of their own. Figures, dates and thresholds cannot be hit,
because a name has letters only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from caseloom.constants import REDACTED
from caseloom.functions.redaction import replacement
from caseloom.functions.text import fold_case
from caseloom.operators.seam import Model, apply_model

# Where names stand: group 1 holds them.
HEADER = r"(?imu)^(?:from|to|cc|bcc|reply-to):[ \t]*([^\r\n]*)"
GREETING = r"(?mu)^[ \t]*(?:Dear|Hi|Hello|Hey)[ \t]+(\p{Lu}\p{L}+(?:[ \t.'-]+\p{Lu}\p{L}*)*)"
SIGN_OFF = (
    r"(?mu)^[ \t]*(?:Kind [Rr]egards|Best [Rr]egards|Regards|Sincerely|Yours sincerely|Yours faithfully|"
    r"Take care|Cheers|Thanks|Many thanks|Best wishes|Best)[ \t]*,?[ \t]*\r?\n\s*(\p{Lu}\p{L}+(?:[ \t.'-]+\p{Lu}\p{L}*)*)"
)
ADDRESS_DOMAIN = r"@[^\s<>,;]*"
NAME_SOURCES = (HEADER, GREETING, SIGN_OFF)

# Words that stand in such places without being names of people.
STOP_WORDS = [
    "all", "admin", "and", "colleague", "colleagues", "customer", "department", "employee", "employer", "everyone",
    "finance", "hello", "help", "hr", "human", "info", "legal", "madam", "mail", "management", "manager", "mr", "mrs",
    "ms", "dr", "noreply", "office", "payroll", "redacted", "reply", "resources", "sales", "sir", "staff", "support",
    "team", "the",
]

CAPITALISED = r"(?<![\p{L}\p{N}_])\p{Lu}\p{L}+(?![\p{L}\p{N}_])"


def _name_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{L}{2,}"), F.lit(0))


def name_lexicon(
    texts: DataFrame,
    entities: DataFrame | None = None,
    *,
    package: str = "package_id",
    text_id: str = "file_id",
    text: str = "text",
    sources: Sequence[str] = NAME_SOURCES,
    min_support: int = 1,
    header_support: int = 2,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Case-folded name words per package, seen as names in at least ``min_support`` texts, or in the headers of
    ``header_support``: a header holds names of desks and services as well, which one message alone doesn't tell apart.

    Reads the texts before redaction. ``entities`` holds the known phrases per package; their
    words count with no minimum. Distinct words are reduced before they are shuffled.
    """

    def words(patterns: Sequence[str]) -> Column:
        found = F.flatten(F.array(*[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)) for p in patterns]))
        plain = F.regexp_replace(F.array_join(found, "\n"), ADDRESS_DOMAIN, " ")
        return F.array_distinct(_name_words(fold_case(plain))) if patterns else F.array().cast("array<string>")

    said, headed = words([p for p in sources if p != HEADER]), words([p for p in sources if p == HEADER])
    each = F.concat(
        F.transform(said, lambda w: F.struct(w.alias("name"), F.lit(False).alias("headed"))),
        F.transform(headed, lambda w: F.struct(w.alias("name"), F.lit(True).alias("headed"))),
    )
    least = F.when(F.col("headed"), header_support).otherwise(min_support)
    seen = (
        texts.select(package, text_id, F.explode(each).alias("w"))
        .select(package, text_id, "w.*")
        .groupBy(package, "name", "headed")
        .agg(F.count_distinct(text_id).alias("support"))
        .filter(F.col("support") >= least)
        .select(package, "name")
    )
    if entities is not None:
        known = entities.select(package, F.explode(_name_words(fold_case(F.col("phrase")))).alias("name"))
        seen = seen.unionByName(known)
    return seen.filter(~F.col("name").isin(list(stop_words))).distinct()


def redact_contextual(
    df: DataFrame,
    lexicon: DataFrame | None = None,
    *,
    model: Model | None = None,
    package: str = "package_id",
    text_id: str = "file_id",
    text: str = "text",
    token: str = REDACTED,
    fail_closed: bool = False,
    out: str = "safe_text",
) -> DataFrame:
    """Add ``out``: the text with names of the package's lexicon redacted.

    A text meets only those names that it holds: its capitalised words are joined with the
    lexicon, and the hits build one pattern per text. With a ``model`` (a frame with the text in, a frame
    with column ``text`` out) the reply is taken; a failed call gives the input back, or '' with
    ``fail_closed``, and leaves a ``model_error``.
    """
    if model is not None:
        reply = T.StructType([T.StructField("_reply", T.StringType())])
        asked = apply_model(df, lambda b: model(b).rename(columns={"text": "_reply"}), [text], reply)
        failed = F.col("model_error").isNotNull() | F.col("_reply").isNull()
        instead = F.lit("") if fail_closed else F.col(text)
        return asked.withColumn(out, F.when(failed, instead).otherwise(F.trim("_reply"))).drop("_reply")

    words = df.select(
        package, text_id,
        F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(CAPITALISED), F.lit(0)))).alias("_word"),
    ).withColumn("name", fold_case(F.col("_word")))
    hits = (
        words.join(lexicon, [package, "name"])
        .groupBy(package, text_id)
        .agg(F.array_sort(F.collect_set("_word")).alias("_names"))
    )
    alternation = F.concat(
        F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join("_names", "|"), F.lit(r")(?![\p{L}\p{N}_])")
    )
    joined = df.join(hits, [package, text_id], "left").withColumn("_pattern", alternation)
    replaced = F.regexp_replace(F.col(text), F.col("_pattern"), F.lit(replacement(token)))
    return joined.withColumn(out, F.when(F.col("_pattern").isNull(), F.col(text)).otherwise(replaced)).drop(
        "_names", "_pattern"
    )
