"""The registered queries. Each reads whole tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.constants import ADDRESS, CATEGORIES, EMAIL, PHONE, UNSAFE_NAME_CHAR, pattern
from caseloom.frames import arrow_runs
from caseloom.functions.redaction import email_pattern, phone_pattern, redact, redact_addresses
from caseloom.functions.text import (
    basename,
    dollars,
    extension,
    first_block,
    lookup,
    percent,
    safe_name,
    strip_fence,
    strip_html,
    strip_text,
    thousands,
)
from caseloom.operators.classify import (
    DEFAULT_RULES,
    Rule,
    classify,
    classify_by_matter as by_matter,
    classify_by_table,
    invalid_categories,
    normalise_decisions,
    reset_invalid,
)
from caseloom.operators.copies import mark_copies
from caseloom.operators.combine import assemble_pages, combine_texts
from caseloom.operators.contextual import name_lexicon, redact_contextual
from caseloom.operators.evaluate import eval_cases, eval_failures, eval_report, leak_pairs, leak_rate
from caseloom.operators.naming import unique_names
from caseloom.operators.phrases import redact_phrases
from caseloom.operators.route import (
    approved,
    audit_report,
    audit_summary,
    category_counts,
    decision_list,
    exclusion_log,
    lineage,
    package_totals,
    pending,
    route,
    summary_text,
)
from caseloom.operators.seam import fill_template
from caseloom.operators.summary import facts_left_out, case_facts, case_summary, top_evidence
from caseloom.operators.usage import usage_report
from caseloom.sources.archives import Guard, expand_packages, good_files, ingest_errors
from caseloom.sources.documents import document_text, extract_contents, image_base64, media_type
from caseloom.sources.emails import explode_attachments
from caseloom.sources.tables import all_files as union_files, parse_relevant_json
from workload.registry import load, query

W, D, S = (pattern(c) for c in ("{w}", "{d}", "{s}"))
EMAIL_SQL, PHONE_SQL = pattern(EMAIL), pattern(PHONE)
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
SCRUB_SQL = f"regexp_replace(regexp_replace(%s, '{EMAIL_SQL}', '[REDACTED]', 'g'), '{PHONE_SQL}', '[REDACTED]', 'g')"
STRIP_SQL = rf"regexp_replace(%s, '\A[{S}]+|[{S}]+\z', '', 'g')"

# Rules on words that the supplied documents hold. Weights are halves, so sums are exact.
RULES = [
    Rule("Employment_Contracts", "license", r"[Ll]icen[sc]e", 2.0),
    Rule("Correspondence", "address", r"@", 1.0),
    Rule("Performance_Reviews", "appraisal", r"worthless|pathetic|disgusting", 1.5),
    Rule("Termination_Documents", "harsh", r"idiot|moron|trash|scum|clown|loser|stupid", 1.0),
    Rule("Payroll_Financial", "figures", r"[0-9]{4,}", 0.5),
    Rule(None, "chatter", r"thanedble", -1.0),
]


def _documents(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents")


def _contents(spark, sf_dir) -> DataFrame:
    """All documents as extracted files, the source being the package, and some files more that are of a type without
    text or unreadable."""
    name = F.col("doc_id").cast("string")
    files = _documents(spark, sf_dir).withColumn("more", F.explode(F.when(F.col("doc_id") % 17 == 3, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    more = F.col("more")
    return files.select(
        F.col("source").alias("package_id"),
        (F.col("doc_id") + F.when(more, 1_000_000_000).otherwise(0)).alias("ord"),
        F.concat(F.when(more, "more").otherwise("doc"), name).alias("file_id"),
        F.concat(F.when(more, "more").otherwise("doc"), name, F.when(more, ".txt").otherwise(".docx")).alias("file_name"),
        F.when(more, "unsupported").otherwise("text").alias("kind"),
        F.when(~more, F.col("text")).alias("text"),
        (~more | (F.col("doc_id") % 23 != 5)).alias("readable"),
    )


def _decided(spark, sf_dir) -> DataFrame:
    return route(classify(_contents(spark, sf_dir), RULES), F.col("readable"))


def _hit(rule: Rule) -> str:
    return f"len(regexp_extract_all(text, '{rule.pattern}'))"


DECIDED_SQL = f"""
WITH contents AS (
  SELECT source AS package_id, doc_id AS ord, 'doc' || doc_id AS file_id, 'doc' || doc_id || '.docx' AS file_name,
         text <> '' AS has_text, false AS copy_failed, text
  FROM documents
  UNION ALL
  SELECT source, doc_id + 1000000000, 'more' || doc_id, 'more' || doc_id || '.txt', false, doc_id % 23 = 5, NULL
  FROM documents WHERE doc_id % 17 = 3),
hits AS (SELECT *, {", ".join(f"coalesce({_hit(r)}, 0) AS h{i}" for i, r in enumerate(RULES))} FROM contents),
scores AS (
  SELECT *, greatest(h0 * 2.0, h1 * 1.0, h2 * 1.5, h3 * 1.0, h4 * 0.5, 0.0) AS top,
         concat_ws(', ', {", ".join(f"CASE WHEN h{i} > 0 THEN '{r.label}' END" for i, r in enumerate(RULES))}) AS labels
  FROM hits),
decided AS (
  SELECT *, has_text AND top > 0 AS is_relevant,
    CASE WHEN NOT has_text THEN NULL
         WHEN top <= 0 THEN 'Other_Relevant_Evidence'
         WHEN h0 * 2.0 = top THEN 'Employment_Contracts' WHEN h1 * 1.0 = top THEN 'Correspondence'
         WHEN h2 * 1.5 = top THEN 'Performance_Reviews' WHEN h3 * 1.0 = top THEN 'Termination_Documents'
         ELSE 'Payroll_Financial' END AS category,
    CASE WHEN NOT has_text THEN 'Unsupported file type or no extractable text.'
         WHEN top - h5 >= 2 THEN 'matched: ' || labels WHEN top > 0 THEN 'uncertain: matched: ' || labels
         WHEN labels <> '' THEN 'not evidence, matched: ' || labels ELSE 'no rule matched' END AS reason
  FROM scores),
routed AS (
  SELECT *, CASE WHEN is_relevant THEN 'Evidence_Package/' || category ELSE 'Excluded_Documents' END AS destination
  FROM decided)
"""


# --- redaction -----------------------------------------------------------------------------


@query(f"SELECT doc_id, {SCRUB_SQL % 'text'} AS redacted FROM documents")
def redact_pii(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", redact(F.col("text"), protect=()).alias("redacted"))


@query(
    f"""
WITH shielded AS (
  SELECT doc_id, regexp_extract_all(text, '{IPV4}') AS figures, string_split_regex(text, '{IPV4}') AS pieces FROM documents),
scrubbed AS (
  SELECT doc_id, figures, {SCRUB_SQL % "array_to_string(list_transform(pieces, lambda p, i: CASE WHEN i = 1 THEN p ELSE '__PROTECTED_' || (i - 2) || '__' || p END), '')"} AS t
  FROM shielded),
cut AS (
  SELECT doc_id, figures, string_split_regex(t, '__PROTECTED_[0-9]+__') AS rest,
         regexp_extract_all(t, '__PROTECTED_([0-9]+)__', 1) AS marks FROM scrubbed)
SELECT doc_id, array_to_string(list_transform(rest, lambda p, i: CASE WHEN i = 1 THEN p ELSE figures[marks[i - 1]::INT + 1] || p END), '') AS redacted
FROM cut
"""
)
def redact_protected(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", redact(F.col("text"), protect=[IPV4.replace("{", "{{").replace("}", "}}")]).alias("redacted"))


@query(
    f"""
WITH hits AS (
  SELECT d.doc_id, '(?i)' || string_agg(regexp_escape(b.text), '|' ORDER BY length(b.text) DESC, b.text) AS phrases
  FROM documents d JOIN benchmark b ON contains(lower(upper(d.text)), lower(upper(b.text))) GROUP BY d.doc_id)
SELECT d.doc_id, {SCRUB_SQL % "CASE WHEN phrases IS NULL THEN text ELSE regexp_replace(text, phrases, '[REDACTED]', 'g') END"} AS redacted
FROM documents d LEFT JOIN hits USING (doc_id)
"""
)
def redact_entities(spark, sf_dir):
    phrases = load(spark, sf_dir, "benchmark").select(F.col("text").alias("phrase"))
    documents = _documents(spark, sf_dir).select("doc_id", "text")
    return redact_phrases(documents, phrases, protect=(), short_list=0).select("doc_id", "redacted")


# Letters that only share their upper form with a plain one: long s, the micro sign, final sigma.
ODD_LETTERS = ("sS\u03bc\u03c3", "\u017f\u017f\u00b5\u03c2")


@query(
    f"""
WITH known AS (SELECT translate(text, '{ODD_LETTERS[0]}', '{ODD_LETTERS[1]}') AS phrase FROM benchmark),
hits AS (
  SELECT d.doc_id, '(?i)' || string_agg(regexp_escape(phrase), '|' ORDER BY length(phrase) DESC, phrase) AS phrases
  FROM documents d JOIN known ON contains(lower(upper(d.text)), lower(upper(phrase))) GROUP BY d.doc_id)
SELECT d.doc_id, {SCRUB_SQL % "CASE WHEN phrases IS NULL THEN text ELSE regexp_replace(text, phrases, '[REDACTED]', 'g') END"} AS redacted
FROM documents d LEFT JOIN hits USING (doc_id)
"""
)
def redact_entities_folded(spark, sf_dir):
    """Phrases spelt with letters that `lower` doesn't fold, in a table that is joined as one of any size is."""
    phrases = load(spark, sf_dir, "benchmark").select(F.translate("text", *ODD_LETTERS).alias("phrase"))
    documents = _documents(spark, sf_dir).select("doc_id", "text")
    return redact_phrases(documents, phrases, protect=(), short_list=0, in_rows=0).select("doc_id", "redacted")


@query(
    f"""
WITH hits AS (
  SELECT d.doc_id, '(?i)' || string_agg(regexp_escape(b.text), '|' ORDER BY length(b.text) DESC, b.text) AS phrases
  FROM documents d JOIN benchmark b ON d.source = 'src' || b.item_id % 20 AND contains(lower(upper(d.text)), lower(upper(b.text))) GROUP BY d.doc_id)
SELECT source AS package_id, d.doc_id, {SCRUB_SQL % "CASE WHEN phrases IS NULL THEN text ELSE regexp_replace(text, phrases, '[REDACTED]', 'g') END"} AS redacted
FROM documents d LEFT JOIN hits USING (doc_id)
"""
)
def redact_entities_by_package(spark, sf_dir):
    package = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    phrases = load(spark, sf_dir, "benchmark").select(package.alias("package_id"), F.col("text").alias("phrase"))
    documents = _documents(spark, sf_dir).select(F.col("source").alias("package_id"), "doc_id", "text")
    return redact_phrases(documents, phrases, by=["package_id"], protect=()).drop("text")


@query(
    f"""SELECT lang, sum(len(regexp_extract_all(text, '{EMAIL_SQL}')))::BIGINT AS emails,
               sum(len(regexp_extract_all(text, '{PHONE_SQL}')))::BIGINT AS phones,
               count(*) FILTER (regexp_matches(text, '{EMAIL_SQL}|{PHONE_SQL}')) AS documents
        FROM documents GROUP BY lang"""
)
def pii_counts(spark, sf_dir):
    text = F.col("text")
    email, phone = F.regexp_count(text, F.lit(email_pattern())), F.regexp_count(text, F.lit(phone_pattern()))
    counted = _documents(spark, sf_dir).select("lang", email.alias("e"), phone.alias("p"))
    return counted.groupBy("lang").agg(
        F.sum("e").alias("emails"), F.sum("p").alias("phones"),
        F.count_if((F.col("e") > 0) | (F.col("p") > 0)).alias("documents"),
    )


LETTERS_SQL = """
  SELECT source AS package_id, doc_id AS file_id,
         CASE WHEN doc_id % 5 = 0 THEN 'Dear ' || upper(substr(w, 1, 1)) || lower(substr(w, 2)) || ',' || chr(10) ELSE '' END || text AS text
  FROM (SELECT *, regexp_extract(text, '\\p{L}{2,}') AS w FROM documents)"""
LEXICON_SQL = f"""
letters AS ({LETTERS_SQL}),
lexicon AS (
  SELECT DISTINCT package_id, name FROM (
    SELECT package_id, unnest(regexp_extract_all(lower(upper(regexp_extract(text, '^Dear (\\p{{Lu}}\\p{{L}}+)', 1))), '\\p{{L}}{{2,}}')) AS name
    FROM letters)
  WHERE name NOT IN ('all', 'admin', 'and', 'colleague', 'colleagues', 'customer', 'department', 'employee', 'employer', 'everyone',
    'finance', 'hello', 'help', 'hr', 'human', 'info', 'legal', 'madam', 'mail', 'management', 'manager', 'mr', 'mrs',
    'ms', 'dr', 'noreply', 'office', 'payroll', 'redacted', 'reply', 'resources', 'sales', 'sir', 'staff', 'support',
    'team', 'the'))"""


def _letters(spark, sf_dir) -> DataFrame:
    """Documents as letters; one in five opens with a greeting to its own first word."""
    word = F.regexp_extract("text", r"\p{L}{2,}", 0)
    name = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))
    greeting = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Dear "), name, F.lit(",\n"))).otherwise("")
    return _documents(spark, sf_dir).select(
        F.col("source").alias("package_id"), F.col("doc_id").alias("file_id"), F.concat(greeting, "text").alias("text")
    )


@query(f"WITH {LEXICON_SQL} SELECT package_id, name FROM lexicon")
def names_in_context(spark, sf_dir):
    return name_lexicon(_letters(spark, sf_dir))


@query(
    f"""WITH {LEXICON_SQL},
cut AS (SELECT package_id, file_id, unnest(regexp_extract_all(text, '[{W}]+|[^{W}]+')) AS piece,
               generate_subscripts(regexp_extract_all(text, '[{W}]+|[^{W}]+'), 1) AS i FROM letters),
done AS (SELECT c.package_id, c.file_id, i, CASE WHEN l.name IS NOT NULL AND regexp_matches(piece, '^\\p{{Lu}}\\p{{L}}+$')
                THEN '[REDACTED]' ELSE piece END AS piece
         FROM cut c LEFT JOIN lexicon l ON l.package_id = c.package_id AND l.name = lower(upper(piece)))
SELECT package_id, file_id, string_agg(piece, '' ORDER BY i) AS safe_text FROM done GROUP BY package_id, file_id"""
)
def redact_in_context(spark, sf_dir):
    letters = _letters(spark, sf_dir)
    return redact_contextual(letters, name_lexicon(letters)).select("package_id", "file_id", "safe_text")


# --- text functions ------------------------------------------------------------------------


@query("SELECT page_id, " + STRIP_SQL % "regexp_replace(html, '<[^>]+>', ' ', 'g')" + " AS text FROM pages")
def strip_pages(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


@query(
    f"""
WITH n AS (SELECT page_id, string_split(url, '/')[-1] AS last FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(CASE WHEN last = '' THEN 'attachment_' || page_id ELSE last END,
        '{pattern(UNSAFE_NAME_CHAR)}', '_', 'g'), '\\A_+|_+\\z', '', 'g') AS name FROM n)
SELECT page_id, CASE WHEN name = '' THEN 'attachment_' || page_id ELSE name END AS file_name,
       lower(regexp_extract(name, '(?s)^\\.*[^.].*(\\.[^.]*)$', 1)) AS ext FROM c"""
)
def safe_names(spark, sf_dir):
    named = load(spark, sf_dir, "pages").select("page_id", safe_name(basename(F.col("url")), F.col("page_id")).alias("file_name"))
    return named.withColumn("ext", extension(F.col("file_name")))


@query(
    """
WITH n AS (SELECT string_split(url, '/')[4] AS folder, page_id AS ord,
                  regexp_replace(regexp_extract(url, '/([0-9]+)[^/]*/?$', 1), '$', '.html') AS file_name FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, file_name ORDER BY ord) - 1 AS k FROM n)
SELECT folder, ord, file_name, CASE WHEN k = 0 THEN file_name ELSE replace(file_name, '.html', '_' || k || '.html') END AS dest_name
FROM r"""
)
def unique_page_names(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select(
        F.element_at(F.split("url", "/"), 4).alias("folder"), F.col("page_id").alias("ord"),
        F.concat(F.regexp_extract("url", r"/([0-9]+)[^/]*/?$", 1), F.lit(".html")).alias("file_name"),
    )
    return unique_names(pages, ["folder"])


@query(
    """
WITH RECURSIVE n AS (
  SELECT lang AS folder, doc_id AS ord, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i,
         'scan' || CASE WHEN doc_id % 2 = 0 THEN '_' || doc_id % 11 ELSE '' END || CASE WHEN doc_id % 7 < 2 THEN '_' || doc_id % 3 ELSE '' END AS stem
  FROM documents),
walk AS (
  SELECT DISTINCT lang AS folder, 0::BIGINT AS i, NULL::BIGINT AS ord, '' AS stem, '' AS dest, []::VARCHAR[] AS taken FROM documents
  UNION ALL
  SELECT folder, i, ord, stem, dest, list_append(taken, dest) FROM (
    SELECT n.folder, n.i, n.ord, n.stem, w.taken,
           list_filter(list_transform(range(0, n.i), lambda k: n.stem || CASE WHEN k = 0 THEN '' ELSE '_' || k END), lambda x: NOT list_contains(w.taken, x))[1] AS dest
    FROM walk w JOIN n ON n.folder = w.folder AND n.i = w.i + 1))
SELECT folder, ord, stem || '.pdf' AS file_name, dest || '.pdf' AS dest_name FROM walk WHERE i > 0
"""
)
def unique_clashing_names(spark, sf_dir):
    """Names with numbered forms among the inputs. The SQL twin names the files one by one."""
    number = F.concat(F.lit("_"), (F.col("doc_id") % 11).cast("string"))
    again = F.concat(F.lit("_"), (F.col("doc_id") % 3).cast("string"))
    name = F.concat(F.lit("scan"), F.when(F.col("doc_id") % 2 == 0, number).otherwise(""), F.when(F.col("doc_id") % 7 < 2, again).otherwise(""), F.lit(".pdf"))
    files = _documents(spark, sf_dir).select(
        F.col("lang").alias("folder"), F.col("doc_id").alias("ord"), name.alias("file_name")
    )
    return unique_names(files, ["folder"])


@query(
    """
WITH w AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '```md' || chr(10) || text || chr(10) || '```'
                               WHEN doc_id % 3 = 1 THEN '  ' || text ELSE '```' || chr(10) || text END AS t FROM documents),
s AS (SELECT doc_id, """ + STRIP_SQL % "t" + """ AS t FROM w),
o AS (SELECT doc_id, CASE WHEN starts_with(t, '```') THEN regexp_replace(regexp_replace(t, '\\A[^\\n]*\\n', ''), '```\\z', '') ELSE t END AS t FROM s)
SELECT doc_id, """ + STRIP_SQL % "t" + """ AS text FROM o"""
)
def strip_fences(spark, sf_dir):
    text, fence = F.col("text"), F.lit("```")
    wrapped = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```md\n"), text, F.lit("\n"), fence))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), text))
        .otherwise(F.concat(fence, F.lit("\n"), text))
    )
    return _documents(spark, sf_dir).select("doc_id", strip_fence(wrapped).alias("text"))


@query(
    """
SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: suffix(x, '.'))[1] AS text,
       coalesce(list_filter(string_split(text, chr(10)), lambda x: suffix(x, '.'))[1], 'none') AS text_or_default
FROM documents"""
)
def first_text_block(spark, sf_dir):
    """Lines as typed blocks: a line that ends in a full stop is text, others are not."""
    blocks = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(F.when(F.endswith(line, F.lit(".")), "text").otherwise("thinking").alias("type"), line.alias("text")),
    )
    text = first_block(F.col("blocks"), "text")["text"]
    return _documents(spark, sf_dir).select("doc_id", blocks.alias("blocks")).select(
        "doc_id", text.alias("text"), F.coalesce(text, F.lit("none")).alias("text_or_default")
    )


@query(
    """
SELECT event_id, event_type = 'click' AND value > 10 AS is_relevant,
       CASE WHEN event_type = 'click' THEN event_type ELSE 'Other_Relevant_Evidence' END AS category,
       CASE WHEN event_type = 'click' THEN props ELSE 'No reason provided by LLM.' END AS reason,
       '' AS description
FROM events"""
)
def normalise_replies(spark, sf_dir):
    """Replies built from events: complete, without the fields, malformed, or wrong-typed."""
    reply = (
        F.when(F.col("event_type") == "click", F.to_json(F.struct((F.col("value") > 10).alias("is_relevant"), F.col("event_type").alias("category"), F.col("props").alias("reason"))))
        .when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "error", F.lit("bad{"))
        .otherwise('{"is_relevant":"yes"}')
    )
    return normalise_decisions(load(spark, sf_dir, "events").select("event_id", reply.alias("reply"))).drop("reply")


@query(
    """SELECT doc_id, 'Language: ' || lang || '
Document text:
---
' || text || '
---
{text}' AS prompt FROM documents"""
)
def build_prompts(spark, sf_dir):
    template = "Language: {lang}\nDocument text:\n---\n{text}\n---\n"
    prompt = F.concat(fill_template(template, lang=F.col("lang"), text=F.col("text")), F.lit("{text}"))
    return _documents(spark, sf_dir).select("doc_id", prompt.alias("prompt"))


# --- classification and routing ------------------------------------------------------------


@query(DECIDED_SQL + "SELECT package_id, file_id, is_relevant, category, reason, '' AS description FROM decided")
def classify_rules(spark, sf_dir):
    decided = classify(_contents(spark, sf_dir), RULES)
    return decided.select("package_id", "file_id", "is_relevant", "category", "reason", "description")


@query(
    """
WITH rules AS (SELECT item_id AS rule_id, 'cat' || (item_id % 5) AS category, (item_id % 5)::INT AS priority, text AS phrase,
                      CASE WHEN item_id % 4 = 0 THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END AS weight FROM benchmark),
hits AS (SELECT doc_id, category, priority, weight,
                (length(lower(upper(d.text))) - length(replace(lower(upper(d.text)), lower(upper(phrase)), ''))) // length(lower(upper(phrase))) AS n
         FROM documents d JOIN rules ON contains(lower(upper(d.text)), lower(upper(phrase)))),
scores AS (SELECT doc_id, category, priority, sum(n * weight) AS score, count(*) AS rules FROM hits GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, priority) AS r FROM scores) WHERE r = 1)
SELECT d.doc_id, coalesce(score, 0) > 0 AS is_relevant, coalesce(category, 'Other_Relevant_Evidence') AS category,
       CASE WHEN score >= 2 THEN 'rules matched: ' || rules WHEN score > 0 THEN 'uncertain: rules matched: ' || rules ELSE 'no rule matched' END AS reason,
       coalesce(score, 0)::DOUBLE AS score
FROM documents d LEFT JOIN best USING (doc_id)"""
)
def classify_with_rule_table(spark, sf_dir):
    item = F.col("item_id")
    rules = load(spark, sf_dir, "benchmark").select(
        item.alias("rule_id"), F.concat(F.lit("cat"), (item % 5).cast("string")).alias("category"),
        (item % 5).cast("int").alias("priority"), F.col("text").alias("phrase"),
        F.when(item % 4 == 0, 1.0).otherwise(2.5).alias("weight"),
    )
    return classify_by_table(_documents(spark, sf_dir).select("doc_id", "text"), rules)


@query(DECIDED_SQL + "SELECT package_id, file_id, destination, copy_failed FROM routed")
def route_documents(spark, sf_dir):
    return _decided(spark, sf_dir).select("package_id", "file_id", "destination", "copy_failed")


@query(DECIDED_SQL + "SELECT package_id, file_name, coalesce(category, '') AS category, is_relevant, reason, copy_failed FROM routed")
def audit_rows(spark, sf_dir):
    return audit_report(_decided(spark, sf_dir), ["package_id"])


@query(DECIDED_SQL + "SELECT package_id, file_name || chr(9) || reason AS line FROM routed WHERE NOT is_relevant AND NOT copy_failed")
def exclusion_lines(spark, sf_dir):
    return exclusion_log(_decided(spark, sf_dir), ["package_id"])


@query(
    DECIDED_SQL
    + """SELECT package_id, file_name, CASE WHEN is_relevant THEN 'Relevant' ELSE 'Excluded' END AS decision, reason,
                CASE WHEN copy_failed THEN 'copy failed' ELSE '' END AS note FROM routed"""
)
def decisions_for_review(spark, sf_dir):
    return decision_list(_decided(spark, sf_dir), ["package_id"])


@query(DECIDED_SQL + "SELECT package_id, ord, file_id, category, text FROM routed WHERE is_relevant AND NOT copy_failed AND text <> ''")
def relevant_texts(spark, sf_dir):
    return summary_text(_decided(spark, sf_dir))


@query(
    DECIDED_SQL
    + """SELECT package_id, CASE WHEN grouping(place) = 1 THEN '(total)' ELSE place END AS destination, count(*) AS n
         FROM (SELECT package_id, CASE WHEN copy_failed THEN '(copy failed)' ELSE destination END AS place FROM routed)
         GROUP BY GROUPING SETS ((package_id, place), (package_id))"""
)
def audit_by_destination(spark, sf_dir):
    return audit_summary(_decided(spark, sf_dir), ["package_id"])


@query(DECIDED_SQL + "SELECT category, count(*) AS n FROM routed WHERE is_relevant AND NOT copy_failed GROUP BY category")
def relevant_by_category(spark, sf_dir):
    return category_counts(_decided(spark, sf_dir))


@query(
    DECIDED_SQL
    + """SELECT package_id, count(*) FILTER (is_relevant AND NOT copy_failed) AS relevant_count,
                count(*) FILTER (NOT is_relevant AND NOT copy_failed) AS excluded_count,
                count(*) FILTER (copy_failed) AS copy_failed_count, count(*) AS total_files FROM routed GROUP BY package_id"""
)
def totals_by_package(spark, sf_dir):
    return package_totals(_decided(spark, sf_dir))


@query(
    """WITH known AS (SELECT unnest(['src0', 'src1', 'src2', 'src3']) AS category)
       SELECT source AS category, count(*) AS n FROM documents d
       WHERE source <> '' AND NOT EXISTS (SELECT 1 FROM known WHERE known.category = d.source) GROUP BY source"""
)
def unknown_labels(spark, sf_dir):
    known = spark.range(4).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("category"))
    return invalid_categories(_documents(spark, sf_dir).select(F.col("source").alias("category")), known)


@query(
    """SELECT doc_id, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN source ELSE 'Other_Relevant_Evidence' END AS category
       FROM documents"""
)
def reset_unknown_labels(spark, sf_dir):
    labelled = _documents(spark, sf_dir).select("doc_id", F.col("source").alias("category"))
    return reset_invalid(labelled, ["src0", "src1", "src2", "src3"])


@query("SELECT doc_id, source, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def approved_only(spark, sf_dir):
    approvals = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("accepted"))
    return approved(_documents(spark, sf_dir), approvals, "doc_id").select("doc_id", "source", "n_chars")


@query(
    """SELECT doc_id, sha256(text) AS content_hash FROM documents d
       WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))"""
)
def pending_only(spark, sf_dir):
    """Files whose content was not processed before; what has a label counts as processed."""
    hashed = _documents(spark, sf_dir).select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))
    done = hashed.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return pending(hashed, done, ["content_hash"]).select("doc_id", "content_hash")


# --- stage 2 -------------------------------------------------------------------------------


@query(
    """WITH sized AS (
         SELECT *, coalesce(sum(octet_length(encode(text)) + 2) OVER (
           PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500 AS p FROM conversations),
       placed AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS part FROM sized)
       SELECT conv_id, part, count(*) AS n_texts, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM placed GROUP BY conv_id, part"""
)
def combined_texts(spark, sf_dir):
    """Parts of about 500 bytes, so that conversations have several."""
    return combine_texts(load(spark, sf_dir, "conversations"), ["conv_id"], order="turn", part_bytes=500)


@query(
    f"""SELECT source AS package_id, kind, value, count(*) AS n FROM (
          SELECT source, 'address' AS kind, unnest(regexp_extract_all(text, '{IPV4}')) AS value FROM documents
          UNION ALL SELECT source, 'number', unnest(regexp_extract_all(text, '[0-9]{{4,}}')) FROM documents)
        GROUP BY ALL"""
)
def facts_by_package(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumnRenamed("source", "package_id")
    return case_facts(docs, facts={"address": IPV4, "number": r"[0-9]{4,}"})


SENTENCES_SQL = """
lines AS (SELECT package_id, category, ord, unnest(string_split_regex(text, '\\n+')) AS line,
                 generate_subscripts(string_split_regex(text, '\\n+'), 1) AS l FROM %s),
cut AS (SELECT package_id, category, ord, l, unnest(regexp_extract_all(line, '(?s).*?[.!?][\\x09-\\x0d ]+|.+$')) AS s,
               generate_subscripts(regexp_extract_all(line, '(?s).*?[.!?][\\x09-\\x0d ]+|.+$'), 1) AS p FROM lines),
sentences AS (SELECT package_id, category, ord, l, p, """ + STRIP_SQL % "s" + """ AS sentence FROM cut),
scored AS (SELECT *, """ + " + ".join(
    f"len(regexp_extract_all(sentence, '{r.pattern}')) * {r.weight}" for r in RULES
) + """ AS score FROM sentences WHERE sentence <> ''),
evidence AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package_id, category ORDER BY score DESC, ord, l, p) AS rank
             FROM scored WHERE score > 0) WHERE rank <= 3)
"""


@query(
    "WITH texts AS (SELECT source AS package_id, lang AS category, doc_id AS ord, text FROM documents), "
    + SENTENCES_SQL % "texts"
    + "SELECT package_id, category, ord, sentence, score::DOUBLE AS score, rank::INT AS rank FROM evidence"
)
def evidence_top(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(
        F.col("source").alias("package_id"), F.col("lang").alias("category"), F.col("doc_id").alias("ord"), "text"
    )
    return top_evidence(docs, 3, rules=RULES).drop("pos")


@query(
    DECIDED_SQL
    + ", relevant AS (SELECT package_id, category, ord, text FROM routed WHERE is_relevant AND NOT copy_failed AND text <> ''), "
    + SENTENCES_SQL % "relevant"
    + """, counts AS (SELECT package_id, category, count(*) AS n FROM relevant GROUP BY ALL),
background AS (SELECT package_id, '- documents: ' || sum(n) || chr(10) || string_agg('- ' || category || ': ' || n, chr(10) ORDER BY category) AS md
               FROM counts GROUP BY package_id),
labels AS (SELECT package_id, label, count(*) AS n FROM (
"""
    + " UNION ALL ".join(
        f"SELECT package_id, '{r.label}' AS label FROM relevant WHERE regexp_matches(text, '{r.pattern}')" for r in RULES if r.category
    )
    + """) GROUP BY ALL),
claims AS (SELECT package_id, string_agg('- ' || label || ' (documents: ' || n || ')', chr(10) ORDER BY n DESC, label) AS md FROM labels GROUP BY package_id),
proofs AS (SELECT package_id, string_agg('- ' || category || ': ' || sentence, chr(10) ORDER BY list_position(['"""
    + "', '".join(CATEGORIES)
    + """'], category), rank) AS md FROM evidence GROUP BY package_id)
, facts AS (SELECT package_id, value, count(*) AS n FROM (SELECT package_id, unnest(regexp_extract_all(text, '\\$\\s?[0-9][0-9,]*(?:\\.[0-9]{2})?')) AS value FROM relevant) GROUP BY ALL),
top_facts AS (SELECT package_id, string_agg('- money: ' || value || ' (mentions: ' || n || ')', chr(10) ORDER BY n DESC, value)
                || CASE WHEN max(total) > 10 THEN chr(10) || '- money: ' || (max(total) - 10) || ' more, see the table of facts' ELSE '' END AS md
              FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY n DESC, value) AS r, count(*) OVER (PARTITION BY package_id) AS total
                    FROM facts) WHERE r <= 10 GROUP BY package_id)
SELECT package_id, '# Anonymous case summary

## Background

' || b.md || '

## Key Facts

' || coalesce(f.md, '- none found') || '

## Potential Claims

' || coalesce(c.md, '- none found') || '

## Notable Evidence

' || coalesce(p.md, '- none found') AS summary_md
FROM background b LEFT JOIN claims c USING (package_id) LEFT JOIN proofs p USING (package_id) LEFT JOIN top_facts f USING (package_id)"""
)
def case_summaries(spark, sf_dir):
    return case_summary(summary_text(_decided(spark, sf_dir)), rules=RULES)


@query(
    f"""SELECT package_id, kind, count(*) - 3 AS left_out FROM (
          SELECT DISTINCT source AS package_id, kind, value FROM (
            SELECT source, 'address' AS kind, unnest(regexp_extract_all(text, '{IPV4}')) AS value FROM documents
            UNION ALL SELECT source, 'number', unnest(regexp_extract_all(text, '[0-9]{{4,}}')) FROM documents))
        GROUP BY ALL HAVING count(*) > 3"""
)
def case_facts_left_out(spark, sf_dir):
    """What a summary with three facts of a kind does not show."""
    docs = _documents(spark, sf_dir).select(F.col("source").alias("package_id"), "text")
    return facts_left_out(case_facts(docs, facts={"address": IPV4, "number": "[0-9]{4,}"}), 3)


MATTER_SQL = """
WITH rules AS (SELECT 'src' || (item_id % 20) AS matter_type, item_id AS rule_id, 'cat' || (item_id % 7) AS category, (item_id % 3)::INT AS priority,
                      regexp_extract(text, '\\p{L}{5,}') AS phrase, 0.5::DOUBLE + item_id % 4 AS weight FROM benchmark),
matters AS (SELECT matter_type, 'other of ' || matter_type AS default_category, 2.0::DOUBLE AS threshold FROM (SELECT DISTINCT source AS matter_type FROM documents)
            WHERE matter_type NOT LIKE '%7'),
hits AS (SELECT d.doc_id, r.source AS matter_type, category, priority, weight,
                (length(lower(text)) - length(replace(lower(text), lower(phrase), ''))) // length(phrase) AS n
         FROM documents d JOIN (SELECT *, matter_type AS source FROM rules) r USING (source) WHERE phrase <> '' AND contains(lower(text), lower(phrase))),
scores AS (SELECT doc_id, category, priority, sum(n * weight) AS score, count(*) AS rules FROM hits GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, priority, category DESC) AS r FROM scores) WHERE r = 1)
SELECT source AS matter_type, doc_id, threshold IS NOT NULL AND coalesce(score, 0) > 0 AS is_relevant,
       CASE WHEN threshold IS NOT NULL AND score > 0 THEN category ELSE coalesce(default_category, 'Other_Relevant_Evidence') END AS category,
       CASE WHEN threshold IS NULL THEN 'no rules for this kind of case; flagged for manual review' WHEN score >= threshold THEN 'rules matched: ' || rules
            WHEN score > 0 THEN 'uncertain: rules matched: ' || rules ELSE 'no rule matched' END AS reason,
       CASE WHEN threshold IS NULL THEN 0.0 ELSE coalesce(score, 0) END::DOUBLE AS score
FROM documents LEFT JOIN matters ON matter_type = source LEFT JOIN best USING (doc_id)"""


@query(MATTER_SQL)
def classify_by_matter(spark, sf_dir):
    """Each source is a kind of case with rules, default and tie order of its own; some kinds are unknown."""
    item, matter = F.col("item_id"), F.col("matter_type")
    rules = load(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("src"), (item % 20).cast("string")).alias("matter_type"), item.alias("rule_id"),
        F.concat(F.lit("cat"), (item % 7).cast("string")).alias("category"), (item % 3).cast("int").alias("priority"),
        F.regexp_extract("text", r"\p{L}{5,}", 0).alias("phrase"), (F.lit(0.5) + item % 4).alias("weight"),
    )
    docs = _documents(spark, sf_dir).select(F.col("source").alias("matter_type"), "doc_id", "text")
    matters = docs.select("matter_type").distinct().where(~matter.like("%7"))
    matters = matters.select("matter_type", F.concat(F.lit("other of "), matter).alias("default_category"), F.lit(2.0).alias("threshold"))
    return by_matter(docs, rules, matters)


ADDRESS_SQL = ADDRESS.replace("{{", "{").replace("}}", "}").replace("'", "''")
SENT_SQL = """CASE doc_id % 4 WHEN 0 THEN 'Send it to Unit ' || (doc_id % 9 + 1) || ', ' || (doc_id % 300 + 1) || ' Harbour View Street, Port Anna NSW ' || (2000 + doc_id % 900) || '. '
  WHEN 1 THEN 'She lives at ' || (doc_id % 90 + 1) || 'b Kelp Rd. and pays. ' WHEN 2 THEN (doc_id % 50) || ' cars in the Street, 12 may 2020 Road works. ' ELSE 'Way 7, Level 3: ' END || text"""


@query(f"SELECT doc_id, regexp_replace({SENT_SQL}, '{ADDRESS_SQL}', '\\1[REDACTED]', 'g') AS redacted FROM documents")
def redact_postal_addresses(spark, sf_dir):
    """Documents after a sentence: two kinds of address, and two that look like one and have to stay."""
    d = F.col("doc_id")

    def number(n) -> F.Column:
        return n.cast("string")

    near = F.concat(F.lit("Send it to Unit "), number(d % 9 + 1), F.lit(", "), number(d % 300 + 1), F.lit(" Harbour View Street, Port Anna NSW "), number(2000 + d % 900), F.lit(". "))
    short = F.concat(F.lit("She lives at "), number(d % 90 + 1), F.lit("b Kelp Rd. and pays. "))
    none = F.concat(number(d % 50), F.lit(" cars in the Street, 12 may 2020 Road works. "))
    first = F.when(d % 4 == 0, near).when(d % 4 == 1, short).when(d % 4 == 2, none).otherwise("Way 7, Level 3: ")
    return _documents(spark, sf_dir).select("doc_id", redact_addresses(F.concat(first, F.col("text"))).alias("redacted"))


def _re2(pattern_text: str) -> str:
    return pattern_text.replace("(?iu)", "(?i)").replace("(?imu)", "(?im)").replace("'", "''")


def _total(category: str | None) -> str:
    return " + ".join(f"h{i} * {r.weight}" for i, r in enumerate(DEFAULT_RULES) if r.category == category)


DEFAULT_SQL = f"""
WITH texts AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Subject: notice of dismissal' || chr(10) || 'The performance review, the salary and the notice period.'
                 WHEN 1 THEN 'Dear all,' || chr(10) || 'receipt for a bonus' ELSE '' END || chr(10) || text AS text FROM documents),
hits AS (SELECT doc_id, {", ".join(f"len(regexp_extract_all(text, '{_re2(r.pattern)}')) AS h{i}" for i, r in enumerate(DEFAULT_RULES))} FROM texts),
scores AS (SELECT *, greatest({", ".join(f"({_total(c)})" for c in CATEGORIES)}) AS top, {_total(None)} AS against,
             concat_ws(', ', {", ".join(f"CASE WHEN h{i} > 0 THEN '{r.label}' END" for i, r in enumerate(DEFAULT_RULES))}) AS labels FROM hits)
SELECT doc_id, top > 0 AS is_relevant,
  CASE WHEN top <= 0 THEN 'Other_Relevant_Evidence' {" ".join(f"WHEN {_total(c)} = top THEN '{c}'" for c in CATEGORIES)} END AS category,
  CASE WHEN top + against >= 2 THEN 'matched: ' || labels WHEN top > 0 THEN 'uncertain: matched: ' || labels
       WHEN labels <> '' THEN 'not evidence, matched: ' || labels ELSE 'no rule matched' END AS reason
FROM scores"""


@query(DEFAULT_SQL)
def classify_default_rules(spark, sf_dir):
    """The rules that Stage 1 takes without any of your own."""
    d = F.col("doc_id") % 6
    opening = F.when(d == 0, "Subject: notice of dismissal\nThe performance review, the salary and the notice period.").when(d == 1, "Dear all,\nreceipt for a bonus").otherwise("")
    texts = _documents(spark, sf_dir).select("doc_id", F.lit("text").alias("kind"), F.concat(opening, F.lit("\n"), F.col("text")).alias("text"))
    return classify(texts, DEFAULT_RULES).select("doc_id", "is_relevant", "category", "reason")


def _shy_model(batch: pd.DataFrame) -> pd.DataFrame:
    """Fails for a batch that holds a text it doesn't like, as a refused call does."""
    if batch["text"].str.contains("password").any():
        raise RuntimeError("refused")
    return pd.DataFrame({"is_relevant": batch["text"].str.len() > 500, "category": None, "reason": "by length", "input_tokens": 7, "output_tokens": 1})


@query(
    """SELECT doc_id, NOT bad AND length(text) > 500 AS is_relevant, 'Other_Relevant_Evidence' AS category,
              CASE WHEN bad THEN 'Automatic categorization failed; flagged for manual review.' ELSE 'by length' END AS reason,
              CASE WHEN bad THEN 'RuntimeError: refused' END AS model_error, CASE WHEN NOT bad THEN 7::BIGINT END AS input_tokens
       FROM (SELECT *, contains(text, 'password') AS bad FROM documents)"""
)
def classify_with_failing_model(spark, sf_dir):
    """Rows whose call fails get the fixed decision, and cost no other row its reply."""
    texts = _documents(spark, sf_dir).select("doc_id", F.lit("text").alias("kind"), "text")
    return classify(texts, model=_shy_model).select("doc_id", "is_relevant", "category", "reason", "model_error", "input_tokens")


# --- evaluation and usage ------------------------------------------------------------------


@query("SELECT doc_id, item_id AS marker_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leaks(spark, sf_dir):
    markers = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("marker_id"), F.col("text").alias("marker"))
    return leak_pairs(_documents(spark, sf_dir).select("doc_id", "text"), markers)


@query(
    """SELECT count(*) AS total, count(*) FILTER (hit) AS leaked, count(*) FILTER (hit) * 100.0::DOUBLE / count(*) AS leak_rate
       FROM (SELECT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text)) AS hit FROM documents d)"""
)
def leaks_rate(spark, sf_dir):
    markers = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("marker_id"), F.col("text").alias("marker"))
    return leak_rate(_documents(spark, sf_dir).select("doc_id", "text"), markers)


@query(
    r"""WITH split AS (SELECT item_id AS marker_id, regexp_extract_all(text, '\S+') AS w FROM benchmark),
       markers AS (
         SELECT marker_id, list_max(list_transform(range(1, len(w)), lambda i: {'n': length(w[i]) + length(w[i + 1]), 'i': -i, 'm': w[i] || ' ' || w[i + 1]})).m AS marker
         FROM split WHERE len(w) > 1)
       SELECT doc_id, marker_id FROM documents d JOIN markers ON contains(d.text, marker)"""
)
def leaks_of_short_markers(spark, sf_dir):
    """Markers of two words, as names are: of each text, the longest pair of neighbours."""
    found = load(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w")).where(F.size("w") > 1)

    def pair(i):
        left, right = F.get("w", i - 1), F.get("w", i)
        return F.struct((F.length(left) + F.length(right)).alias("n"), (-i).alias("i"), F.concat(left, F.lit(" "), right).alias("m"))

    marker = F.array_max(F.transform(F.sequence(F.lit(1), F.size("w") - 1), pair))["m"]
    markers = found.select(F.col("item_id").alias("marker_id"), marker.alias("marker"))
    return leak_pairs(_documents(spark, sf_dir).select("doc_id", "text"), markers)


TOXIC = [Rule("Termination_Documents", "insult", r"trash|idiot|clown|scum|worthless|moron", 1.0)]
CASES_SQL = f"""
WITH cases AS (
  SELECT doc_id AS name, toxic = 1 AS expected_is_relevant,
         CASE WHEN toxic = 1 THEN 'Termination_Documents' ELSE 'Other_Relevant_Evidence' END AS expected_category,
         regexp_matches(text, '{TOXIC[0].pattern}') AS actual_is_relevant,
         CASE WHEN regexp_matches(text, '{TOXIC[0].pattern}') THEN 'Termination_Documents' ELSE 'Other_Relevant_Evidence' END AS actual_category,
         {SCRUB_SQL % "text"} AS safe_text
  FROM documents JOIN labels USING (doc_id)),
flags AS (
  SELECT name, expected_is_relevant, expected_category, actual_is_relevant, actual_category,
         expected_is_relevant = actual_is_relevant AND expected_category = actual_category AS classification_pass,
         NOT contains(safe_text, '@') AND NOT contains(safe_text, 'password') AS pii_leakage_pass,
         contains(safe_text, 'the') AS preserved_entities_pass
  FROM cases)
"""


def _cases(spark, sf_dir) -> DataFrame:
    toxic = F.col("toxic") == 1
    truth = load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("name"), toxic.alias("expected_is_relevant"),
        F.when(toxic, "Termination_Documents").otherwise("Other_Relevant_Evidence").alias("expected_category"),
    )
    texts = _documents(spark, sf_dir).select(
        F.col("doc_id").alias("name"), F.lit("text").alias("kind"), "text",
        redact(F.col("text")).alias("safe_text"),
    )
    return eval_cases(truth, classify(texts, TOXIC), ["@", "password"], "the")


@query(CASES_SQL + "SELECT * FROM flags")
def evaluation_cases(spark, sf_dir):
    return _cases(spark, sf_dir)


@query(
    CASES_SQL
    + """SELECT count(*) AS total, count(*) FILTER (classification_pass) AS correct, count(*) FILTER (NOT pii_leakage_pass) AS leaked,
                avg(CASE WHEN classification_pass THEN 100.0::DOUBLE ELSE 0 END) AS accuracy_score,
                avg(CASE WHEN pii_leakage_pass THEN 0 ELSE 100.0::DOUBLE END) AS pii_leakage_rate,
                bool_and(classification_pass AND pii_leakage_pass AND preserved_entities_pass) AS all_pass FROM flags"""
)
def evaluation_report(spark, sf_dir):
    return eval_report(_cases(spark, sf_dir))


@query(
    CASES_SQL
    + "SELECT name, expected_is_relevant, expected_category, actual_is_relevant, actual_category FROM flags WHERE NOT classification_pass"
)
def evaluation_failures(spark, sf_dir):
    return eval_failures(_cases(spark, sf_dir))


@query(
    """SELECT source AS package_id, coalesce(sum(n_chars), 0)::BIGINT AS input_tokens,
              coalesce(sum(length(lang)), 0)::BIGINT AS output_tokens,
              coalesce(sum(n_chars), 0) / 1e6 * 3.0
                + coalesce(sum(length(lang)), 0) / 1e6 * 15.0 AS total_cost_usd
       FROM documents GROUP BY source"""
)
def usage_by_package(spark, sf_dir):
    """Characters as tokens."""
    return usage_report(_usage(spark, sf_dir), ["package_id"])


def _usage(spark, sf_dir) -> DataFrame:
    return _documents(spark, sf_dir).select(
        F.col("source").alias("package_id"), F.col("n_chars").alias("input_tokens"), F.length("lang").alias("output_tokens")
    )


@query(
    """WITH u AS (SELECT sum(n_chars) AS i, sum(length(lang)) AS o FROM documents)
       SELECT format('{:,}', i::BIGINT) AS input_tokens, format('{:,}', o::BIGINT) AS output_tokens,
              printf('$%.4f', i / 1e6 * 3.0 + o / 1e6 * 15.0) AS total_cost, printf('%.1f%%', i * 100.0::DOUBLE / (i + o)) AS input_share FROM u"""
)
def usage_display(spark, sf_dir):
    report = usage_report(_usage(spark, sf_dir))
    share = F.col("input_tokens") * 100.0 / (F.col("input_tokens") + F.col("output_tokens"))
    return report.select(
        thousands(F.col("input_tokens")).alias("input_tokens"), thousands(F.col("output_tokens")).alias("output_tokens"),
        dollars(F.col("total_cost_usd")).alias("total_cost"), percent(share).alias("input_share"),
    )


@query(
    """SELECT event_type, count(*) AS n, CASE event_type WHEN 'click' THEN 3.0::DOUBLE WHEN 'view' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight
       FROM events GROUP BY event_type"""
)
def lookup_with_default(spark, sf_dir):
    weights = F.create_map(F.lit("click"), F.lit(3.0), F.lit("view"), F.lit(1.0))
    counts = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", lookup(weights, F.col("event_type"), F.lit(0.0)))


# --- sources -------------------------------------------------------------------------------


@query(
    """SELECT 'documents' AS origin, doc_id AS ord, source || '/' || doc_id || '.docx' AS path, n_chars AS length FROM documents
       UNION ALL SELECT 'pages', page_id, string_split(url, '/')[4] || '/' || page_id || '.html', length(html) FROM pages"""
)
def all_files(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("length"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"),
    )
    pages = load(spark, sf_dir, "pages").select(
        F.lit("pages").alias("origin"), F.col("page_id").alias("ord"), F.length("html").cast("long").alias("length"),
        F.concat(F.element_at(F.split("url", "/"), 4), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
    )
    return union_files(docs, pages, columns=["origin", "ord", "path", "length"])


@query(
    f"""SELECT conv_id AS file_id, {STRIP_SQL % "coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (turn % 5 <> 2), '')"} AS text
        FROM conversations GROUP BY conv_id"""
)
def pages_to_text(spark, sf_dir):
    """Turns as pages of a file; every page numbered 2, 7, ... failed to decode."""
    pages = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("page_no"), "text",
        F.when(F.col("turn") % 5 == 2, "corrupt").alias("error"),
    )
    return assemble_pages(pages)


def _mail(headers: str, *parts) -> F.Column:
    return F.encode(F.concat(F.lit(headers), *parts), "UTF-8")


@query(
    f"""SELECT doc_id, {STRIP_SQL % "CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace('<p>' || text || '</p>', '<[^>]+>', ' ', 'g') END"} AS text
        FROM documents"""
)
def mail_bodies(spark, sf_dir):
    """Documents as emails: even ones in plain text, odd ones in HTML."""
    head = "From: a@mail.example.com\nTo: b@mail.example.com\nSubject: s\nMIME-Version: 1.0\nContent-Transfer-Encoding: 8bit\n"
    plain = _mail(head + "Content-Type: text/plain; charset=utf-8\n\n", "text")
    html = _mail(head + "Content-Type: text/html; charset=utf-8\n\n<p>", "text", F.lit("</p>"))
    mails = _documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, plain).otherwise(html).alias("content"))
    return mails.select("doc_id", document_text(F.lit("eml"), F.col("content")).alias("text"))


def _page_mails(spark, sf_dir) -> DataFrame:
    """Pages as emails with two attachments: the page, and an email that holds it again."""
    attached = F.concat(
        F.lit('--in\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment; filename="copy of page.html"\n\n'),
        F.base64(F.encode("html", "UTF-8")), F.lit("\n--in--\n"),
    )
    inner = F.concat(
        F.lit('From: a@mail.example.com\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="in"\n\n--in\nContent-Type: text/plain\n\ninner\n'),
        attached,
    )
    outer = _mail(
        'From: a@mail.example.com\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="out"\n\n'
        "--out\nContent-Type: text/plain\n\nouter\n"
        '--out\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment; filename="page (1).html"\n\n',
        F.base64(F.encode("html", "UTF-8")),
        F.lit('\n--out\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment; filename="old.eml"\n\n'),
        F.base64(F.encode(inner, "UTF-8")), F.lit("\n--out--\n"),
    )
    return load(spark, sf_dir, "pages").select("page_id", outer.alias("content"))


@query(
    """SELECT page_id, '0' AS trail, 1 AS depth, 'page__1_.html' AS file_name, '.html' AS ext, sha256(html) AS hash FROM pages
       UNION ALL SELECT page_id, '1.0', 2, 'copy_of_page.html', '.html', sha256(html) FROM pages"""
)
def mail_attachments(spark, sf_dir):
    found = explode_attachments(_page_mails(spark, sf_dir), ["page_id"]).filter(F.col("ext") != ".eml")
    return found.select("page_id", "trail", "depth", "file_name", "ext", F.sha2("content", 256).alias("hash"))


def _write_docx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word files whose paragraphs are the lines of the texts."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for batch in arrow_runs(batches):
        files = []
        for text in batch.column("text").to_pylist():
            safe = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{line}</w:t></w:r></w:p>' for line in safe.split("\n"))
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as parts:
                parts.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
            files.append(out.getvalue())
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "content": pa.array(files, pa.binary())})


@query(
    f"""SELECT doc_id, {STRIP_SQL % "array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))"} AS text FROM documents"""
)
def word_texts(spark, sf_dir):
    files = _documents(spark, sf_dir).select("doc_id", "text").mapInArrow(_write_docx, "doc_id long, content binary")
    return files.select("doc_id", document_text(F.lit("docx"), F.col("content")).alias("text"))


@query(
    """SELECT page_id, CASE WHEN page_id % 3 < 2 THEN base64(encode(html)) END AS image_base64,
              CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' END AS media_type FROM pages"""
)
def images_as_base64(spark, sf_dir):
    """Page bytes as image files of three extensions, one of them no image type."""
    ext = F.element_at(F.array(F.lit(".png"), F.lit(".jpeg"), F.lit(".gif")), (F.col("page_id") % 3).cast("int") + 1)
    images = load(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), F.encode("html", "UTF-8").alias("content"))
    kind = media_type(F.col("ext"))
    return images.select("page_id", F.when(kind.isNotNull(), image_base64(F.col("content"))).alias("image_base64"), kind.alias("media_type"))


def _packages(names: list[str], archives: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch({"package_id": pa.array(names, pa.string()), "content": pa.array(archives, pa.binary())})


def _zip_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive per page: the page, a note in a folder, and the page's email. Some broken archives come with them."""
    for batch in arrow_runs(batches):
        archives, names = [], []
        for page, html, mail in zip(*(batch.column(c).to_pylist() for c in ("page_id", "html", "content"))):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("b/mail.eml", bytes(mail))
                archive.writestr("c.txt", "")
                archive.writestr("a/page.png", html.encode())
            archives.append(out.getvalue())
            names.append(str(page))
            if page % 10 == 0:
                archives.append(b"broken")
                names.append(f"broken{page}")
        yield _packages(names, archives)


def _archives(spark, sf_dir) -> DataFrame:
    mails = _page_mails(spark, sf_dir)
    pages = load(spark, sf_dir, "pages").select("page_id", "html")
    return pages.join(mails, "page_id").mapInArrow(_zip_members, "package_id string, content binary")


@query(
    """WITH members AS (SELECT unnest([
         {'ord': 0, 'depth': 0, 'parent': NULL, 'file_name': 'page.png', 'ext': '.png'},
         {'ord': 1, 'depth': 0, 'parent': NULL, 'file_name': 'mail.eml', 'ext': '.eml'},
         {'ord': 2, 'depth': 0, 'parent': NULL, 'file_name': 'c.txt', 'ext': '.txt'},
         {'ord': 3, 'depth': 1, 'parent': 1, 'file_name': 'page__1_.html', 'ext': '.html'},
         {'ord': 4, 'depth': 1, 'parent': 1, 'file_name': 'old.eml', 'ext': '.eml'},
         {'ord': 5, 'depth': 2, 'parent': 4, 'file_name': 'copy_of_page.html', 'ext': '.html'}]) AS m)
       SELECT page_id::VARCHAR AS package_id, page_id || '#' || m.ord AS file_id, page_id || '#' || m.parent AS parent_id,
              m.depth::INT AS depth, m.ord::BIGINT AS ord, m.file_name AS file_name, m.ext AS ext,
              CASE WHEN m.ord IN (0, 3, 5) THEN sha256(html) WHEN m.ord = 2 THEN sha256('') END AS hash
       FROM pages, members"""
)
def archive_members(spark, sf_dir):
    files = good_files(expand_packages(_archives(spark, sf_dir)))
    hashed = F.when(F.col("ext") != ".eml", F.sha2("content", 256))
    return files.select("package_id", "file_id", "parent_id", "depth", "ord", "file_name", "ext", hashed.alias("hash"))


def _twin_mails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive per page with three emails whose attachments have the same names."""
    head = "From: a@mail.example.com\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n"
    part = '--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename="{}"\n\n{}\n'
    for batch in arrow_runs(batches):
        pages, archives = batch.column("page_id").to_pylist(), []
        for page in pages:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as archive:
                for k in range(3):
                    archive.writestr(f"{k}.eml", head + part.format("pay slip.pdf", page) + part.format("pay_slip_1.pdf", k) + "--b--\n")
            archives.append(out.getvalue())
        yield _packages([str(p) for p in pages], archives)


@query(
    """SELECT page_id::VARCHAR AS package_id, m.ord::BIGINT AS ord, m.name AS file_name FROM pages, (SELECT unnest([
         {'ord': 3, 'name': 'pay_slip.pdf'}, {'ord': 4, 'name': 'pay_slip_1.pdf'}, {'ord': 5, 'name': 'pay_slip_2.pdf'},
         {'ord': 6, 'name': 'pay_slip_1_1.pdf'}, {'ord': 7, 'name': 'pay_slip_3.pdf'}, {'ord': 8, 'name': 'pay_slip_1_2.pdf'}]) AS m)"""
)
def attachment_names(spark, sf_dir):
    """First free numbered names in the folder that a package's emails share."""
    archives = load(spark, sf_dir, "pages").select("page_id").mapInArrow(_twin_mails, "package_id string, content binary")
    return good_files(expand_packages(archives)).where("depth = 1").select("package_id", "ord", "file_name")


def _zip_bombs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive per page with the page; every tenth one also holds a member that packs very well."""
    for batch in arrow_runs(batches):
        pages, archives = batch.column("page_id").to_pylist(), []
        for page, html in zip(pages, batch.column("html").to_pylist()):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("page.html", html.encode())
                if page % 10 == 0:
                    archive.writestr("zeros.bin", bytes(200_000))
            archives.append(out.getvalue())
        yield _packages([str(p) for p in pages], archives)


@query(
    """SELECT page_id::VARCHAR AS package_id, 'page.html' AS file_name,
              CASE WHEN octet_length(encode(html)) > 20000 THEN 'member inflates beyond 20000 bytes' END AS error,
              CASE WHEN octet_length(encode(html)) <= 20000 THEN sha256(html) END AS hash FROM pages
       UNION ALL SELECT page_id::VARCHAR, 'zeros.bin', 'member inflates beyond 20000 bytes', NULL FROM pages WHERE page_id % 10 = 0"""
)
def archive_guard(spark, sf_dir):
    """Members that inflate beyond the guard keep their row, without bytes."""
    archives = load(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(_zip_bombs, "package_id string, content binary")
    files = good_files(expand_packages(archives, Guard(member=20_000)))
    return files.select("package_id", "file_name", "error", F.sha2("content", 256).alias("hash"))


@query("SELECT 'broken' || page_id AS package_id, 'BadZipFile: File is not a zip file' AS error FROM pages WHERE page_id % 10 = 0")
def archive_errors(spark, sf_dir):
    return ingest_errors(expand_packages(_archives(spark, sf_dir)))


@query(
    """SELECT page_id::VARCHAR AS package_id, page_id || '#' || i AS file_id,
              CASE i WHEN 3 THEN 'page__1_.html' WHEN 4 THEN 'old.eml' ELSE 'copy_of_page.html' END AS file_name,
              CASE WHEN i < 5 THEN 1 ELSE 2 END AS depth, CASE i WHEN 4 THEN 1 ELSE 0 END AS ordinal,
              page_id || '#' || (CASE WHEN i < 5 THEN 1 ELSE 4 END) AS parent_id,
              CASE WHEN i < 5 THEN 'mail.eml' ELSE 'old.eml' END AS parent_name
       FROM pages, (SELECT unnest([3, 4, 5]) AS i)"""
)
def attachment_lineage(spark, sf_dir):
    files = good_files(expand_packages(_archives(spark, sf_dir))).drop("content")
    return lineage(files)


@query(
    """WITH f AS (SELECT page_id, html, unnest([0, 1, 2, 3, 4, 5]) AS i FROM pages)
       SELECT page_id || '#' || i AS file_id, CASE i WHEN 0 THEN 'image' WHEN 1 THEN 'text' WHEN 4 THEN 'text' ELSE 'unsupported' END AS kind,
              CASE i WHEN 1 THEN 'outer' WHEN 4 THEN 'inner' END AS text, CASE WHEN i = 0 THEN base64(encode(html)) END AS image_base64,
              CASE WHEN i = 0 THEN 'image/png' END AS media_type FROM f"""
)
def file_contents(spark, sf_dir):
    """The whole intake: archives, emails and images to contents."""
    contents = extract_contents(good_files(expand_packages(_archives(spark, sf_dir))))
    return contents.select("file_id", "kind", "text", "image_base64", "media_type")


@query(
    """SELECT conv_id, turn, [text, role] AS relevant_texts FROM conversations
       UNION ALL SELECT conv_id, turn + 1000000, NULL FROM conversations WHERE role <> 'user'"""
)
def cached_texts(spark, sf_dir):
    """Cache documents built from all turns, and more that lack the key, have a wrong value, or are corrupt."""
    odd = (
        F.when(F.col("turn") % 3 == 0, F.lit("{}"))
        .when(F.col("turn") % 3 == 1, F.lit('{"relevant_texts": 5}'))
        .otherwise('{"relevant_texts": [')
    )
    whole = F.to_json(F.struct(F.array("text", "role").alias("relevant_texts")))
    caches = load(spark, sf_dir, "conversations")
    caches = caches.select("conv_id", "turn", whole.alias("value")).union(
        caches.where("role <> 'user'").select("conv_id", F.col("turn") + 1_000_000, odd)
    )
    turns = caches
    return parse_relevant_json(turns).drop("value")


@query(
    """SELECT lang AS package_id, 'doc' || doc_id AS file_id, sha256(text) AS content_hash, CASE WHEN first <> doc_id THEN 'doc' || first END AS copy_of
       FROM (SELECT *, min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS first FROM documents)"""
)
def dedup_exact(spark, sf_dir):
    """Documents as files of a package per language."""
    files = _documents(spark, sf_dir).select(
        F.col("lang").alias("package_id"), F.concat(F.lit("doc"), F.col("doc_id")).alias("file_id"), F.col("doc_id").alias("ord"), F.encode("text", "UTF-8").alias("content")
    )
    return mark_copies(files).select("package_id", "file_id", "content_hash", "copy_of")


@query(
    """SELECT role AS step, 'model-' || (turn % 3) AS model, sum(length(text))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens,
              sum(length(text)) / 1e6 * 3.0 + sum(turn) / 1e6 * 15.0 AS total_cost_usd
       FROM conversations GROUP BY ALL"""
)
def usage_by_step_and_model(spark, sf_dir):
    """Turns as calls: the role is the step, characters are tokens."""
    calls = load(spark, sf_dir, "conversations").select(
        F.col("role").alias("step"), F.concat(F.lit("model-"), (F.col("turn") % 3).cast("string")).alias("model"),
        F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"),
    )
    return usage_report(calls, ["step", "model"])
