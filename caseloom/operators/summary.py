"""Case summary: facts, best evidence and counts per package, rendered as Markdown."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from caseloom.constants import CATEGORIES, SUMMARY_HEADINGS, pattern
from caseloom.functions.text import reply_text, strip_fence, strip_text
from caseloom.operators.classify import DEFAULT_RULES, Rule
from caseloom.operators.combine import PART_BYTES, combine_texts, ordered_join
from caseloom.operators.seam import USAGE, Model, apply_model
from caseloom.session import cut_lineage

# Summaries of parts that a model reads at once.
FAN_IN = 8
# What counts as a fact, by kind.
FACTS = {
    "money": r"\$\s?[0-9][0-9,]*(?:\.[0-9]{2})?",
    "date": (
        r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b|"
        r"\b[0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December)"
        r" [0-9]{4}\b"
    ),
}


def case_facts(
    df: DataFrame,
    keys: Sequence[str] = ("package_id",),
    text: str = "text",
    facts: dict[str, str] = FACTS,
) -> DataFrame:
    """Distinct facts per package with the number of mentions; nothing is left out."""
    found = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("values"))
            for kind, p in facts.items()
        ]
    )
    return (
        df.select(*keys, F.explode(found).alias("f"))
        .select(*keys, F.col("f.kind").alias("kind"), F.explode("f.values").alias("value"))
        .groupBy(*keys, "kind", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# White space around a line end, or after the end of a sentence; tried from the start of a run only.
SENTENCE_END = pattern(r"(?<![{s}])[{s}]*\n[{s}]*|(?<=[.!?])[{s}]+")


def sentences(df: DataFrame, keys: Sequence[str], order: str, text: str = "text") -> DataFrame:
    """One row per sentence, with its position in the text. The cuts take the white space along,
    so only the text as a whole needs stripping."""
    cut = F.split(strip_text(F.col(text)), SENTENCE_END)
    return df.select(*keys, order, F.posexplode(cut).alias("pos", "sentence")).filter(F.col("sentence") != "")


def top_evidence(
    df: DataFrame,
    k: int = 3,
    keys: Sequence[str] = ("package_id", "category"),
    order: str = "ord",
    text: str = "text",
    rules: Sequence[Rule] = DEFAULT_RULES,
) -> DataFrame:
    """The k sentences per package and category that match the rules best.

    One test against all rules at once comes before the scoring, which few sentences reach. Spark
    limits each group inside every task before the shuffle, so a hot group sends k rows per task,
    not all its sentences.
    """
    score = sum(
        (F.regexp_count("sentence", F.lit(r.pattern)) * F.lit(float(r.weight)) for r in rules), F.lit(0.0)
    )
    any_rule = "|".join(f"(?:{r.pattern})" for r in rules if r.weight > 0)
    matching = sentences(df, keys, order, text).filter(F.rlike("sentence", F.lit(any_rule)))
    ranked = matching.withColumn("score", score).filter(F.col("score") > 0)
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), order, "pos")
    return ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def facts_left_out(facts: DataFrame, per_kind: int, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """How many facts (as `case_facts` gives them) per package and kind a section of ``per_kind`` lines does not show."""
    counted = facts.groupBy(*keys, "kind").agg((F.count(F.lit(1)) - per_kind).alias("left_out"))
    return counted.filter(F.col("left_out") > 0)


def _fact_lines(facts: DataFrame, per_kind: int) -> DataFrame:
    """``_facts``: the lines of the section, per kind the most frequent facts and a notice of those it leaves out."""
    best = Window.partitionBy("package_id", "kind").orderBy(F.col("n").desc(), "value")
    top = facts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_kind)
    mentions = F.concat(F.lit(" (mentions: "), F.col("n").cast("string"), F.lit(")"))
    shown = top.select("package_id", "kind", "rank", F.concat(F.lit("- "), "kind", F.lit(": "), "value", mentions).alias("line"))
    more = F.concat(F.lit("- "), "kind", F.lit(": "), F.col("left_out").cast("string"), F.lit(" more, see the table of facts"))
    rest = facts_left_out(facts, per_kind).select("package_id", "kind", F.lit(per_kind + 1).alias("rank"), more.alias("line"))
    lines = shown.unionByName(rest).groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "line"))).alias("_lines"))
    return lines.select("package_id", F.transform("_lines", lambda x: x["line"]).alias("_facts"))


def case_summary(
    df: DataFrame,
    *,
    k: int = 3,
    facts_per_kind: int = 10,
    part_bytes: int = PART_BYTES,
    rules: Sequence[Rule] = DEFAULT_RULES,
    categories: Sequence[str] = CATEGORIES,
    model: Model | None = None,
) -> DataFrame:
    """One Markdown summary per package from redacted texts (``package_id, category, ord, text``).

    The default is extractive: counts, the most frequent figures and dates, the labels of the
    matched rules, and the best sentences. It copies figures as they stand and gives no opinion. A kind of facts with more
    than ``facts_per_kind`` says how many the section leaves out; `case_facts` has them all.
    A ``model`` reads the combined text and returns a column ``text``; a failed or empty reply
    gives ''. Replies are checkpointed, so that no call is made twice.
    The sections hold a fixed number of lines, so every group is small.
    """
    if model is not None:
        reply = T.StructType([T.StructField("_reply", T.StringType())])

        def ask(texts: DataFrame) -> DataFrame:
            asked = apply_model(texts, lambda b: model(b).rename(columns={"text": "_reply"}), ["text"], reply)
            text = strip_fence(F.when(F.col("model_error").isNull(), F.coalesce("_reply", F.lit(""))).otherwise(""))
            return asked.select("package_id", "part", text.alias("text"), *USAGE.fieldNames(), "model_error")

        # A package in several parts: the model reads its summaries of FAN_IN parts at a time, in order, and so on up a
        # tree, until one is left.
        level = cut_lineage(ask(combine_texts(df, part_bytes=part_bytes).select("package_id", "part", "text")))
        levels = [level]
        while True:
            many = level.groupBy("package_id").agg(F.count(F.lit(1)).alias("_parts")).filter("_parts > 1").select("package_id")
            if many.isEmpty():
                break
            upper = level.join(many, "package_id", "left_semi").groupBy("package_id", F.expr(f"part div {FAN_IN}").alias("part")).agg(
                ordered_join(F.col("part"), F.col("text"), "\n\n").alias("text")
            )
            level = cut_lineage(ask(upper))
            levels.append(level)
        totals = reduce(DataFrame.unionByName, levels).groupBy("package_id").agg(
            *(F.sum(c).alias(c) for c in USAGE.fieldNames()), F.max("model_error").alias("model_error")
        )
        tops = reduce(DataFrame.unionByName, [one.withColumn("_level", F.lit(i)) for i, one in enumerate(levels)])
        last = tops.groupBy("package_id").agg(F.max_by("text", "_level").alias("summary_md"))
        return last.join(totals, "package_id")

    speaking = [r for r in rules if r.category is not None]
    per_category = df.groupBy("package_id", "category").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.rlike("text", F.lit(r.pattern))).alias(f"_r{i}") for i, r in enumerate(speaking)],
    )
    matched = [F.struct((-F.sum(f"_r{i}")).alias("n"), F.lit(r.label).alias("label")) for i, r in enumerate(speaking)]
    counts = per_category.groupBy("package_id").agg(
        F.sum("n").alias("_documents"),
        F.array_sort(F.collect_list(F.struct("category", "n"))).alias("_counts"),
        F.array_sort(F.filter(F.array(*matched), lambda x: x["n"] < 0)).alias("_claims"),
    )
    rank = {c: i for i, c in enumerate(categories)}
    place = F.coalesce(F.create_map(*[F.lit(x) for c, i in rank.items() for x in (c, i)])[F.col("category")], F.lit(len(rank)))
    evidence = (
        top_evidence(df, k, rules=rules)
        .groupBy("package_id")
        .agg(F.array_sort(F.collect_list(F.struct(place.alias("a"), "category", F.col("rank").alias("b"), "sentence"))).alias("_evidence"))
    )
    joined = counts.join(_fact_lines(case_facts(df), facts_per_kind), "package_id", "left").join(
        evidence, "package_id", "left"
    )

    def bullets(rows: str, line) -> F.Column:
        lines = F.array_join(F.transform(F.col(rows), line), "\n")
        return F.coalesce(F.when(F.size(rows) > 0, lines), F.lit("- none found"))

    background = F.concat(
        F.lit("- documents: "), F.col("_documents").cast("string"), F.lit("\n"),
        bullets("_counts", lambda x: F.concat(F.lit("- "), x["category"], F.lit(": "), x["n"].cast("string"))),
    )
    facts = bullets("_facts", lambda x: x)
    claims_md = bullets("_claims", lambda x: F.concat(F.lit("- "), x["label"], F.lit(" (documents: "), (-x["n"]).cast("string"), F.lit(")")))
    evidence_md = bullets("_evidence", lambda x: F.concat(F.lit("- "), x["category"], F.lit(": "), x["sentence"]))
    sections = zip(SUMMARY_HEADINGS, (background, facts, claims_md, evidence_md))
    body = [F.concat(F.lit(f"## {heading}\n\n"), section) for heading, section in sections]
    return joined.select("package_id", F.concat_ws("\n\n", F.lit("# Anonymous case summary"), *body).alias("summary_md"))


def summary_from_blocks(df: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Summary text out of a reply made of typed blocks; no text block is an error, so ''."""
    return df.withColumn("summary_md", F.coalesce(strip_fence(reply_text(F.col(blocks))), F.lit("")))
