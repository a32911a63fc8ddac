"""Stage 2: relevant texts of approved packages -> redacted texts -> one summary per package."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.constants import PROTECTED_FIGURE
from caseloom.functions.redaction import redact
from caseloom.operators.contextual import name_lexicon, redact_contextual
from caseloom.operators.phrases import redact_phrases
from caseloom.operators.route import approved
from caseloom.operators.seam import Model
from caseloom.operators.summary import case_summary
from caseloom.operators.usage import usage_totals
from caseloom.sinks.outputs import SLOTS, active_slot, fill_slot, read_slot, switch_slot, write_summaries


def scrub(
    relevant: DataFrame,
    entities: DataFrame | None = None,
    *,
    protect: Sequence[str] = (PROTECTED_FIGURE,),
    model: Model | None = None,
    fail_closed: bool = False,
    flex_space: bool = False,
) -> DataFrame:
    """Both redaction passes: rules first, names in context after. ``entities`` is a table of
    ``package_id, phrase``. A failed model call leaves a ``model_error``; with ``fail_closed`` its text is empty."""
    if entities is None:
        clean = relevant.withColumn("redacted", redact(F.col("text"), None, protect))
    else:
        clean = redact_phrases(relevant, entities, text_id="file_id", by=["package_id"], protect=protect, flex_space=flex_space)
    if model is not None:
        return redact_contextual(clean, model=model, text="redacted", fail_closed=fail_closed)
    return redact_contextual(clean, name_lexicon(relevant, entities), text="redacted")


SAFE = "package_id string, ord long, file_id string, category string, safe_text string, source_hash string, model_error string, input_tokens long, output_tokens long"
SUMMARIES = "package_id string, summary_md string, source_hash string, input_tokens long, output_tokens long, model_error string"
USAGE = "package_id string, step string, model string, calls long, input_tokens long, output_tokens long"


def _with(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, NULL where ``df`` lacks them."""
    columns = [c.split() for c in schema.split(", ")]
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns))


def summarise(
    spark: SparkSession,
    relevant: DataFrame,
    approvals: DataFrame,
    out: str,
    *,
    entities: DataFrame | None = None,
    scrub_model: Model | None = None,
    summary_model: Model | None = None,
    protect: Sequence[str] = (PROTECTED_FIGURE,),
    fail_closed: bool = False,
    flex_space: bool = False,
    reuse: bool = True,
) -> DataFrame:
    """Stage 2. Only redacted texts, stored once, reach the summary; a package without approval
    or without texts gets none.

    The tables below ``out`` hold the packages that are approved now and no others: one whose approval was withdrawn
    is gone from the texts, the summaries and the files. They have two slots: a run fills the one that isn't in use and then
    switches, so a run that breaks off leaves what was there. With ``reuse``, a package whose texts, known phrases and
    settings are as in the slot in use is taken over from it, and no model is asked again; a failed call is.

    ``safe_texts`` keeps the ``model_error`` of every failed redaction and its tokens; with ``fail_closed`` such a text is
    empty instead of redacted by rules alone. ``usage`` has the tokens of this run by package, step and model.
    """
    before = active_slot(spark, out)
    slot = next(s for s in SLOTS if s != before)
    settings = repr((list(protect), fail_closed, flex_space, *(m and (m.__module__, m.__qualname__) for m in (scrub_model, summary_model))))
    allowed = approved(relevant, approvals)
    # What a package's results hang on, as one hash: sums of row hashes, so that no package is gathered.
    parts = [allowed.select("package_id", F.sha2(F.concat_ws("\0", "ord", "file_id", "category", "text"), 256).alias("h"))]
    if entities is not None:
        parts.append(entities.join(allowed.select("package_id").distinct(), "package_id", "left_semi").select("package_id", F.sha2("phrase", 256).alias("h")))
    rows = reduce(DataFrame.unionByName, parts)
    halves = [F.sum(F.conv(F.substring("h", 1 + 14 * i, 14), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    sources = rows.groupBy("package_id").agg(F.sha2(F.concat_ws(":", F.lit(settings), F.count(F.lit(1)), *halves), 256).alias("source_hash"))

    old_texts, old_summaries = (read_slot(spark, f"{out}/{name}", before, schema) for name, schema in (("safe_texts", SAFE), ("summaries", SUMMARIES)))
    failed = old_texts.filter("model_error IS NOT NULL").select("package_id").unionByName(old_summaries.filter("model_error IS NOT NULL").select("package_id"))
    kept = old_summaries.select("package_id", "source_hash").join(sources, ["package_id", "source_hash"], "left_semi").join(failed, "package_id", "left_anti")
    kept = kept.select("package_id") if reuse else kept.select("package_id").limit(0)
    fresh = allowed.join(kept, "package_id", "left_anti").join(sources, "package_id")

    own = None if entities is None else entities.select("package_id", "phrase")
    safe = scrub(fresh, own, protect=protect, model=scrub_model, fail_closed=fail_closed, flex_space=flex_space)
    safe = safe if scrub_model is not None else safe.drop("model_error", "input_tokens", "output_tokens")
    done = fill_slot(_with(safe, SAFE), f"{out}/new_texts", slot)
    texts = fill_slot(done.unionByName(old_texts.join(kept, "package_id", "left_semi")), f"{out}/safe_texts", slot)
    readable = done.select("package_id", "ord", "file_id", "category", F.col("safe_text").alias("text"))
    whole = case_summary(readable, model=summary_model)
    made = fill_slot(_with(whole.join(sources, "package_id"), SUMMARIES), f"{out}/new_summaries", slot)
    summaries = fill_slot(made.unionByName(old_summaries.join(kept, "package_id", "left_semi")), f"{out}/summaries", slot)
    calls = [(done, "redact", scrub_model)] + ([(made, "summarise", summary_model)] if summary_model is not None else [])
    used = [
        frame.select("package_id", F.lit(step).alias("step"), F.lit(getattr(model, "__name__", "model") if model else "rules").alias("model"), "input_tokens", "output_tokens")
        for frame, step, model in calls
    ]
    usage = fill_slot(usage_totals(reduce(DataFrame.unionByName, used)), f"{out}/usage", slot)
    write_summaries(summaries, f"{out}/anonymous_summary/slot={slot}")
    tables = {f"{out}/{n}": t.schema for n, t in (("safe_texts", texts), ("summaries", summaries), ("usage", usage), ("new_texts", done), ("new_summaries", made))}
    switch_slot(spark, out, slot, tables)
    for other in SLOTS:
        if other != slot:
            write_summaries(summaries.limit(0), f"{out}/anonymous_summary/slot={other}")
    return summaries
