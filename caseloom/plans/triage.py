"""Stage 1: packages of files -> decisions, destinations, copies and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from caseloom.operators.classify import DEFAULT_RULES, Rule, classify, reset_invalid
from caseloom.operators.naming import unique_names
from caseloom.operators.route import (
    audit_report,
    exclusion_log,
    package_totals,
    pending,
    route,
    summary_text,
)
from caseloom.operators.seam import Model
from caseloom.operators.usage import usage_totals
from caseloom.sinks.outputs import append, copy_package, current, last_seen, ledger, new_run, read_table, write_audit_csv, write_exclusion_log
from caseloom.sources.archives import MEMBER, Guard, content_hashes, dealt, good_files, ingest_errors, list_archives, open_archives
from caseloom.sources.documents import extract_contents

# Schemas of the stored tables.
DECISIONS = (
    "package_id string, file_id string, parent_id string, depth int, ord long, ordinal int, via string, path string, "
    "length long, file_name string, ext string, content_hash string, kind string, text string, media_type string, is_relevant boolean, "
    "category string, reason string, description string, input_tokens long, output_tokens long, model_error string, "
    "destination string, copy_failed boolean"
)
MANIFEST = "package_id string, ord long, file_id string, destination string, file_name string, dest_name string"
ERRORS = "package_id string, error string"
USAGE = "package_id string, step string, model string, calls long, input_tokens long, output_tokens long"
FILES = T.StructType([*MEMBER.fields, *(T.StructField(c, T.StringType()) for c in ("file_name", "ext", "content_hash"))])


def decide(
    files: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    model: Model | None = None,
    pages: DataFrame | None = None,
) -> DataFrame:
    """Files with bytes -> contents with decision and destination."""
    contents = extract_contents(files.withColumn("_readable", F.col("content").isNotNull()), pages)
    decided = reset_invalid(classify(contents, rules, model=model))
    return route(decided, F.col("_readable")).drop("_readable", "image_base64")


def triage_archives(
    spark: SparkSession,
    archives: DataFrame,
    out: str,
    *,
    rules: Sequence[Rule] = DEFAULT_RULES,
    model: Model | None = None,
    pages: DataFrame | None = None,
    guard: Guard = Guard(),
    resume: bool = True,
) -> dict[str, DataFrame]:
    """Stage 1 over listed archives (package_id, path, length, modified).

    Every step that must happen once is a stored table: the opened archives and the decisions (a model is asked once
    per file). A lost executor then costs the tasks it ran, not a second round of calls. Bytes are written once, to
    ``files``; the manifest says under which name they lie in the package (`stage1_tables` joins them).

    With ``resume``, an archive whose package, size and time the ledger holds is not looked at again; others are hashed
    before anything is decoded, and old bytes under a new name only get a ledger row that says whose they are.
    """
    run = new_run()
    seen = ledger(spark, out)
    last = last_seen(seen)
    if resume:
        archives = archives.join(last, ["package_id", "path", "length", "modified"], "left_anti")
    looked = append(content_hashes(dealt(archives.select("package_id", "path", "length", "modified"))), f"{out}/looked_at", run)
    if resume:
        # Bytes that a package holds now or that come first in this run. A known package that changed is opened in any case.
        held = last.filter(F.col("same_as").isNull() & F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("package_id").alias("_held"))
        named = looked.join(last.select("package_id", F.lit(True).alias("_known")), "package_id", "left").join(held, "content_hash", "left")
        first = looked.filter("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("package_id").alias("_first"))
        named = named.join(first, "content_hash", "left")
        copy = F.coalesce("_held", F.when(F.col("_first") != F.col("package_id"), F.col("_first")))
        named = named.withColumn("same_as", F.when(F.col("_known").isNull(), copy))
    else:
        named = looked.withColumn("same_as", F.lit(None).cast("string"))
    entries = named.select("package_id", "path", "length", "modified", "content_hash", "same_as")
    opened = open_archives(dealt(entries.filter("same_as IS NULL")), guard, check_first=False)
    files = append(opened.withColumn("content_hash", F.sha2("content", 256)), f"{out}/files", run)
    good = good_files(files, stored=True)
    decisions = append(decide(good, rules, model, pages), f"{out}/decisions", run)
    append(ingest_errors(files), f"{out}/ingest_errors", run)

    copied = decisions.filter(~F.col("copy_failed"))
    names = unique_names(copied.select("package_id", "destination", "ord", "file_name"), ["package_id", "destination"])
    ids = copied.select("package_id", "ord", "file_id")
    append(names.join(ids, ["package_id", "ord"]).select(*(c.split()[0] for c in MANIFEST.split(", "))), f"{out}/manifest", run)
    asked = decisions.filter(F.col("kind").isin("text", "image"))
    named_model = F.lit(getattr(model, "__name__", "model") if model else "rules")
    append(usage_totals(asked.select("package_id", F.lit("classify").alias("step"), named_model.alias("model"), "input_tokens", "output_tokens")), f"{out}/usage", run)
    write_audit_csv(audit_report(decisions, ["package_id"]), f"{out}/audit_report/run={run}")
    write_exclusion_log(exclusion_log(decisions, ["package_id"]), f"{out}/exclusion_log/run={run}")
    append(entries, f"{out}/ledger", run)
    return stage1_tables(spark, out)


def stage1_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Results of Stage 1 that hold now, as tables; the relevant texts are the stored input of Stage 2."""
    seen = ledger(spark, out)

    def table(name: str, schema) -> DataFrame:
        return current(read_table(spark, f"{out}/{name}", schema), seen)

    decisions, manifest, files = table("decisions", DECISIONS), table("manifest", MANIFEST), table("files", FILES)
    return {
        "decisions": decisions,
        "relevant": summary_text(decisions),
        "audit": audit_report(decisions, ["package_id"]),
        "totals": package_totals(decisions),
        "manifest": manifest,
        "errors": table("ingest_errors", ERRORS),
        "usage": table("usage", USAGE),
        "files": files,
        "package": manifest.join(files.select("package_id", "file_id", "content"), ["package_id", "file_id"]),
        "ledger": last_seen(seen),
    }


def export_reports(spark: SparkSession, out: str, to: str, copies: bool = False) -> None:
    """Plain files of all packages as they hold now, below ``to``: audit CSV, exclusion log and, if asked for, copies."""
    tables = stage1_tables(spark, out)
    write_audit_csv(tables["audit"], f"{to}/audit_report")
    write_exclusion_log(exclusion_log(tables["decisions"], ["package_id"]), f"{to}/exclusion_log")
    if copies:
        copy_package(tables["package"], f"{to}/package")


def triage(
    spark: SparkSession,
    packages: str,
    out: str,
    *,
    done: DataFrame | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    model: Model | None = None,
    pages: DataFrame | None = None,
    guard: Guard = Guard(),
    resume: bool = True,
) -> dict[str, DataFrame]:
    """Stage 1 over a folder of archives; packages listed in ``done`` are not opened."""
    found = list_archives(spark, packages)
    found = found if done is None else pending(found, done)
    return triage_archives(spark, found, out, rules=rules, model=model, pages=pages, guard=guard, resume=resume)
