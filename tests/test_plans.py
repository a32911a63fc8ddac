"""Both stages end to end on generated packages."""

import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from builders import PNG, docx, eml, package_of

from caseloom.plans.evaluation import evaluate
from caseloom.plans.summarise import summarise
from caseloom.plans.triage import export_reports, stage1_tables, triage
from caseloom.sources.archives import Guard
from caseloom.streaming.intake import start_intake

LETTER = """To: Imre Kovel
Subject: End of your assignment

The board of Tarnbrook Ferries has decided on the redundancy of all deck officers at the north pier.
Your severance comes to $190,100 and is due with the last roster. Questions go to 0412 345 678.

Kind regards
Sunniva Hale"""
LETTER_FILE = docx(*LETTER.split("\n"))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("packages")
    inner = eml("Second thoughts: overtime of the spring season was never paid out.", attachments=[("pic.PNG", PNG)])
    outer = eml(
        "Hello Imre,\nSunniva put the mid-year assessment on my desk, with a formal warning in it.\nRegards,\nOddny",
        attachments=[("wage slip (1).docx", docx("Wage slip, week 31", "Gross pay $ 190,100")),
                     ("wage slip (1).docx", docx("Payroll, week 32", "overtime")), ("old.eml", inner.as_bytes())],
    )
    (root / "sub").mkdir()
    (root / "0042.zip").write_bytes(package_of({
        "b/letter.docx": LETTER_FILE, "a/letter.docx": LETTER_FILE, "mail.eml": outer.as_bytes(),
        "notes.txt": "plain", "empty.png": b"", "scan.jpg": PNG, "broken.docx": b"no zip", "x.pdf": b"%PDF",
    }))
    (root / "sub" / "0043.zip").write_bytes(package_of({"mail.eml": eml("Shall we sail on Sunday?", sender="x@example.com").as_bytes()}))
    (root / "bad.zip").write_bytes(b"this is no archive")
    return root


@pytest.fixture(scope="module")
def stage1(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    return out, triage(spark, str(folder), out)


def test_triage(spark, stage1):
    out, tables = stage1
    decisions = {(r.package_id, r.ord): r for r in tables["decisions"].collect()}
    names = [decisions[("0042", i)].file_name for i in range(12)]
    assert names == ["letter.docx", "letter.docx", "broken.docx", "empty.png", "mail.eml", "notes.txt", "scan.jpg", "x.pdf",
                     "wage_slip__1_.docx", "wage_slip__1__1.docx", "old.eml", "pic.PNG"]
    by_name = {r.file_name: r for r in decisions.values() if r.package_id == "0042"}
    assert by_name["letter.docx"].category == "Termination_Documents" and by_name["letter.docx"].is_relevant
    assert by_name["mail.eml"].category == "Performance_Reviews"
    assert by_name["wage_slip__1_.docx"].category == "Payroll_Financial"
    assert by_name["empty.png"].reason == "Unsupported file type or no extractable text."
    assert by_name["scan.jpg"].reason == "Automatic categorization failed; flagged for manual review."
    assert by_name["broken.docx"].category is None and by_name["x.pdf"].category is None
    assert [r.error for r in tables["errors"].collect() if r.package_id == "bad"] != []

    manifest = {(r.package_id, r.destination, r.dest_name) for r in tables["manifest"].collect()}
    assert ("0042", "Evidence_Package/Termination_Documents", "letter_1.docx") in manifest
    copies = tables["package"]
    assert copies.count() == len(decisions)
    letter = copies.filter("dest_name = 'letter_1.docx'").first()
    assert bytes(letter.content) == LETTER_FILE and letter.file_id == "0042#1"

    totals = {r.package_id: r for r in tables["totals"].collect()}
    assert totals["0042"].total_files == 12
    for row in totals.values():
        assert row.total_files == row.relevant_count + row.excluded_count + row.copy_failed_count
    log = spark.read.text(f"{out}/exclusion_log").select("value").collect()
    assert "0042\tnotes.txt\tUnsupported file type or no extractable text." in [r.value for r in log]
    csv = spark.read.option("header", True).option("escape", '"').csv(f"{out}/audit_report")
    assert csv.columns == ["package_id", "file_name", "category", "is_relevant", "reason", "copy_failed", "run"]
    assert csv.count() == len(decisions)


def test_rerun_replaces_and_skips(spark, folder, stage1):
    out, tables = stage1
    before = tables["decisions"].count()
    again = triage(spark, str(folder), out, done=spark.createDataFrame([("sub/0043",)], "package_id string"))
    assert again["decisions"].count() == before and again["manifest"].count() == before
    # Nothing was new, so nothing was decided again; with resume=False everything is, and shown once.
    assert spark.read.parquet(f"{out}/decisions").count() == before
    anew = triage(spark, str(folder), out, resume=False)
    assert anew["decisions"].count() == before and spark.read.parquet(f"{out}/decisions").count() == 2 * before
    assert {r.step: r.calls for r in anew["usage"].groupBy("step").sum("calls").toDF("step", "calls").collect()} == {"classify": 11}


def test_summary_only_for_approved(spark, stage1, tmp_path):
    tables = stage1_tables(spark, stage1[0])
    entities = spark.createDataFrame([("0042", "Imre Kovel"), ("0042", "Tarnbrook Ferries")], "package_id string, phrase string")
    none = spark.createDataFrame([("0042", False)], "package_id string, accepted boolean")
    yes = spark.createDataFrame([("0042", True), ("sub/0043", True)], "package_id string, accepted boolean")
    assert summarise(spark, tables["relevant"], none, str(tmp_path / "no"), entities=entities).count() == 0
    rows = summarise(spark, tables["relevant"], yes, str(tmp_path / "yes"), entities=entities).collect()
    assert [r.package_id for r in rows] == ["0042"]
    text = rows[0].summary_md
    places = [text.index(h) for h in ("# Anonymous", "## Background", "## Key Facts", "## Potential Claims", "## Notable Evidence")]
    assert places == sorted(places)
    assert "$190,100" in text and "$ 190,100" in text
    for leaked in ("Imre", "Sunniva", "0412"):
        assert leaked not in text
    safe = spark.read.parquet(f"{tmp_path}/yes/safe_texts").collect()
    assert all("Sunniva" not in r.safe_text and "Hale" not in r.safe_text for r in safe)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/yes/anonymous_summary").select("value").collect()]
    assert lines[:2] == ["<!-- 0042 -->", "# Anonymous case summary"]


def test_models_plug_in(spark, folder, tmp_path):
    calls = str(tmp_path / "calls")

    def judge(batch):
        if (batch["text"].fillna("").str.contains("sail")).any():
            raise RuntimeError("refused")
        return pd.DataFrame({"is_relevant": [True] * len(batch), "category": ["Nonsense"] * len(batch), "reason": ["r"] * len(batch),
                             "description": ["a photo" if b else "" for b in batch["image_base64"]]})

    out = str(tmp_path / "out")
    tables = triage(spark, str(folder), out, model=judge)
    rows = {(r.package_id, r.file_name): r for r in tables["decisions"].collect()}
    assert rows[("sub/0043", "mail.eml")].model_error.endswith("refused") and not rows[("sub/0043", "mail.eml")].is_relevant
    assert rows[("0042", "scan.jpg")].category == "Other_Relevant_Evidence"
    relevant = tables["relevant"]
    assert "a photo" in [r.text for r in relevant.collect()]
    yes = spark.createDataFrame([("0042", True)], "package_id string, accepted boolean")
    summary = summarise(
        spark, relevant, yes, calls,
        scrub_model=lambda b: b.assign(text="clean " + b["redacted"]),
        summary_model=lambda b: pd.DataFrame({"text": ["```md\n# T\n" + str(len(t)) + "\n```" for t in b["text"]]}),
    ).first()
    assert summary.summary_md.startswith("# T\n") and not summary.summary_md.endswith("```")


def test_streaming_intake(spark, folder, tmp_path):
    for _ in range(2):
        query = start_intake(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), max_files_per_trigger=1)
        query.awaitTermination(300)
        assert query.exception() is None
    tables = stage1_tables(spark, str(tmp_path / "out"))
    assert {r.package_id: r.total_files for r in tables["totals"].collect()} == {"0042": 12, "sub/0043": 1}
    assert [r.package_id for r in tables["errors"].collect()] == ["bad"]


def test_streaming_goes_on(spark, tmp_path):
    """One file under two names in two batches, and one that the guard does not admit."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    small = package_of({"a.txt": b"1"})
    for batch in ({"one.zip": small, "large.zip": package_of({"b.txt": bytes(range(256)) * 9})}, {"again.zip": small, "two.zip": package_of({"c.txt": b"2"})}):
        for name, data in batch.items():
            (source / name).write_bytes(data)
        query = start_intake(spark, str(source), out, str(tmp_path / "state"), guard=Guard(archive=300), max_files_per_trigger=1)
        query.awaitTermination(300)
        assert query.exception() is None
    tables = stage1_tables(spark, out)
    assert {r.package_id for r in tables["decisions"].collect()} == {"one", "two"}
    assert [(r.package_id, r.error) for r in tables["errors"].collect()] == [("large", "archive larger than 300 bytes")]
    assert {r.package_id: r.same_as for r in tables["ledger"].collect()} == {"one": None, "two": None, "large": None, "again": "one"}


CASES = [
    ("redundancy", LETTER, True, "Termination_Documents"),
    ("terms", "Contract of employment for a harbour pilot. The probationary period is ninety days; the notice period after it is "
     "six weeks. Tarnbrook Ferries may move Imre Kovel to another pier. Yearly sum: $190,100.", True, "Employment_Contracts"),
    ("chat", "Sent: Monday\nSubject: tide tables\n\nGood morning Imre Kovel, the sum of $190,100 came up at lunch.\n\nWarm regards\nOddny", True, "Correspondence"),
    ("wages", "Wage slip for Imre Kovel, Tarnbrook Ferries\nNet pay: $190,100\nLeave balance: 11 days", True, "Payroll_Financial"),
    ("rating", "Annual review of Imre Kovel: the performance rating stays at two. A sum of $190,100 depends on it.", True, "Performance_Reviews"),
    # Held out: other words of the same kinds of document.
    ("minutes", "Minutes of the pier committee. A grievance of the night shift was read; $190,100 is asked for.", True, "Other_Relevant_Evidence"),
    ("mixed", "Mid-year appraisal of Imre Kovel. The receipt for $190,100 is attached.", True, "Performance_Reviews"),
    ("boat", "Order number 7781: one used dinghy, delivery address Kelpwater Lane. Thank you for $190,100.", False, "Other_Relevant_Evidence"),
]


def test_evaluation(spark):
    truth = spark.createDataFrame(CASES, "name string, raw_text string, expected_is_relevant boolean, expected_category string")
    entities = spark.createDataFrame([(c[0], p) for c in CASES for p in ("Imre Kovel", "Tarnbrook Ferries")], "package_id string, phrase string")
    rows = evaluate(truth, ["Imre"], entities).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        assert r.classification_pass and r.pii_leakage_pass and r.preserved_entities_pass, r


def relevant_rows(spark):
    rows = [("a", 0, "a#0", "Correspondence", "Secret Person said so"), ("b", 0, "b#0", "Correspondence", "Other Person too"), ("b", 5000, "b#1", "Correspondence", "and more")]
    return spark.createDataFrame(rows, "package_id string, ord long, file_id string, category string, text string")


def accept(spark, *packages):
    return spark.createDataFrame([(p, True) for p in packages], "package_id string, accepted boolean")


def test_withdrawn_approval(spark, tmp_path):
    out, rows = str(tmp_path / "out"), relevant_rows(spark)
    assert {r.package_id for r in summarise(spark, rows, accept(spark, "a", "b"), out).collect()} == {"a", "b"}
    assert {r.package_id for r in summarise(spark, rows, accept(spark, "b"), out).collect()} == {"b"}
    for name in ("safe_texts", "summaries"):
        assert {r.package_id for r in spark.read.parquet(f"{out}/{name}").select("package_id").collect()} == {"b"}
    named = spark.read.text(f"{out}/anonymous_summary").select("value").filter("value LIKE '<!-- %'").collect()
    assert [r.value for r in named] == ["<!-- b -->"]


@pytest.mark.parametrize("fail_closed", [False, True])
def test_failed_redaction_is_marked(spark, tmp_path, fail_closed):
    def down(batch):
        raise RuntimeError("no model")

    out = str(tmp_path / "out")
    summarise(spark, relevant_rows(spark), accept(spark, "a"), out, scrub_model=down, fail_closed=fail_closed)
    row = spark.read.parquet(f"{out}/safe_texts").first()
    assert row.model_error.endswith("no model") and row.safe_text == ("" if fail_closed else "Secret Person said so")


def test_one_summary_per_package_and_usage(spark, tmp_path):
    def reply(batch):
        return pd.DataFrame({"text": ["[" + t + "]" for t in batch["text"]], "input_tokens": 10, "output_tokens": 1})

    out = str(tmp_path / "out")
    rows = {r.package_id: r for r in summarise(spark, relevant_rows(spark), accept(spark, "a", "b"), out, summary_model=reply).collect()}
    # Order numbers far apart are no reason for several parts.
    assert rows["a"].summary_md.count("[") == rows["b"].summary_md.count("[") == 1 and "and more" in rows["b"].summary_md
    used = {(r.package_id, r.step): (r.model, r.input_tokens, r.output_tokens) for r in spark.read.parquet(f"{out}/usage").collect()}
    assert used["a", "summarise"] == ("reply", 10, 1) == used["b", "summarise"]


def test_rerun_leaves_nothing_stale(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    good = package_of({"a.txt": b"1"})
    (source / "a.zip").write_bytes(good)
    (source / "b.ZIP").write_bytes(b"broken")
    first = triage(spark, str(source), out)
    assert [r.package_id for r in first["errors"].collect()] == ["b.ZIP"]
    (source / "a.zip").write_bytes(b"broken")
    (source / "b.ZIP").write_bytes(good)
    second = triage(spark, str(source), out)
    assert [r.package_id for r in second["errors"].collect()] == ["a"]
    assert {r.package_id for r in second["decisions"].collect()} == {"b.ZIP"} == {r.package_id for r in second["manifest"].collect()}
    (source / "a.zip").write_bytes(good)
    triage(spark, str(source), out, done=spark.createDataFrame([("b.ZIP",)], "package_id string"))
    third = stage1_tables(spark, out)
    assert {r.package_id for r in third["package"].collect()} == {"a", "b.ZIP"} and third["errors"].count() == 0
    export_reports(spark, out, str(tmp_path / "reports"), copies=True)
    assert spark.read.parquet(str(tmp_path / "reports" / "package")).count() == 2
    csv = spark.read.option("header", True).csv(str(tmp_path / "reports" / "audit_report"))
    assert sorted(r.package_id for r in csv.collect()) == ["a", "b.ZIP"]


def test_resume_by_content(spark, tmp_path):
    """A renamed archive with old bytes is skipped, and copies in one run are opened once; a changed one is opened."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    one, two = (package_of({"x.docx": docx(text)}) for text in "12")
    for name, data in (("a.zip", one), ("b.zip", two), ("copy of b.zip", two)):
        (source / name).write_bytes(data)
    first = triage(spark, str(source), out)
    assert {r.package_id: r.same_as for r in first["ledger"].collect()} == {"a": None, "b": None, "copy of b": "b"}
    (source / "a.zip").rename(source / "renamed.zip")
    (source / "b.zip").write_bytes(package_of({"x.docx": docx("changed")}))
    second = triage(spark, str(source), out)
    assert {r.package_id: r.same_as for r in second["ledger"].collect()} == {"a": None, "b": None, "copy of b": "b", "renamed": "a"}
    assert {r.package_id: r.text for r in second["decisions"].collect()} == {"a": "1", "b": "changed"}
    runs = spark.read.parquet(f"{out}/decisions").groupBy("run").count().collect()
    assert sorted(r["count"] for r in runs) == [1, 2]
    hashes = {r.package_id: r.content_hash for r in second["decisions"].collect()}
    assert hashes == {r.package_id: r.content_hash for r in second["files"].collect()} and None not in hashes.values()


def test_many_packages_few_folders(spark, tmp_path):
    """Folders grow with the runs and not with the packages."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i in range(300):
        (source / f"p{i}.zip").write_bytes(package_of({"n.txt": str(i).encode()}))
    tables = triage(spark, str(source), str(out))
    assert tables["totals"].count() == 300 and tables["package"].count() == 300
    for table in out.iterdir():
        assert len(list(table.iterdir())) <= 1 and not (out / "incoming").exists()


def test_bad_member_of_a_large_package(spark, tmp_path, monkeypatch):
    """Inflated once: rows that left before the bad member are not taken."""
    source = tmp_path / "in"
    source.mkdir()
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.txt", bytes(65 << 20))
        z.writestr("b.txt", "SECOND-MEMBER")
    (source / "bad.zip").write_bytes(data.getvalue().replace(b"SECOND-MEMBER", b"SECOND-MEMBEX", 1))
    (source / "good.zip").write_bytes(package_of({"a.txt": b"1"}))
    tables = triage(spark, str(source), str(tmp_path / "out"))
    assert [r.package_id for r in tables["decisions"].collect()] == ["good"] and [r.package_id for r in tables["errors"].collect()] == ["bad"]


def test_archive_beyond_a_cell(spark, tmp_path, monkeypatch):
    """An archive larger than a cell may be is read as a stream."""
    from caseloom.sources import archives

    monkeypatch.setattr(archives, "MAX_CELL", 1000)
    source = tmp_path / "in"
    source.mkdir()
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        for i in range(9):
            z.writestr(f"{i}.txt", bytes(900))
    (source / "wide.zip").write_bytes(data.getvalue())
    assert triage(spark, str(source), str(tmp_path / "out"))["totals"].first().total_files == 9


def test_reuse_of_what_is_done(spark, tmp_path):
    """One more approval asks the models for its package alone; changed texts and failed calls are done again."""
    log = tmp_path / "asked"
    log.write_text("")

    def scrub(batch):
        with open(log, "a") as out:
            out.writelines(f"{t}\n" for t in batch["redacted"])
        if (tmp_path / "down").exists():
            raise RuntimeError("down")
        return batch.assign(text=batch["redacted"])

    def asked():
        lines = sorted(set(log.read_text().splitlines()))
        log.write_text("")
        return lines

    out, rows = str(tmp_path / "out"), relevant_rows(spark)
    summarise(spark, rows, accept(spark, "a"), out, scrub_model=scrub)
    assert asked() == ["Secret Person said so"]
    (tmp_path / "down").write_text("")
    summarise(spark, rows, accept(spark, "a", "b"), out, scrub_model=scrub)
    assert asked() == ["Other Person too", "and more"]
    (tmp_path / "down").unlink()
    got = summarise(spark, rows, accept(spark, "a", "b"), out, scrub_model=scrub).collect()
    assert asked() == ["Other Person too", "and more"] and {r.package_id for r in got} == {"a", "b"}
    assert summarise(spark, rows, accept(spark, "a", "b"), out, scrub_model=scrub).count() == 2 and asked() == []
    changed = rows.withColumn("text", F.when(F.col("package_id") == "a", "new").otherwise(F.col("text")))
    summarise(spark, changed, accept(spark, "a"), out, scrub_model=scrub)
    assert asked() == ["new"]
    entities = spark.createDataFrame([("a", "new")], "package_id string, phrase string")
    row = summarise(spark, changed, accept(spark, "a"), out, scrub_model=scrub, entities=entities).first()
    assert asked() == ["[REDACTED]"] and row.package_id == "a"
    assert {r.safe_text for r in spark.read.parquet(f"{out}/safe_texts").collect()} == {"[REDACTED]"}


def test_summary_tree(spark, tmp_path):
    """Parts by bytes, read in a tree of bounded fan-in."""
    from caseloom.operators.summary import case_summary

    frame = spark.createDataFrame([("p", i * 7000, "c", f"text {i:02d} " + "x" * 50) for i in range(30)], "package_id string, ord long, category string, text string")

    def reply(batch):
        return pd.DataFrame({"text": [" ".join(w for w in t.split() if w.isdigit()) for t in batch["text"]], "input_tokens": 1, "output_tokens": 1})

    row = case_summary(frame, model=reply, part_bytes=100).first()
    assert row.summary_md.split() == [f"{i:02d}" for i in range(30)] and row.input_tokens == 18 + 3 + 1
    assert case_summary(frame, model=reply).first().input_tokens == 1


def test_facts_beyond_the_section_are_counted(spark):
    from caseloom.operators.summary import case_facts, case_summary, facts_left_out

    frame = spark.createDataFrame([("p", 0, "c", " ".join(f"${i}" for i in range(12)) + " on 2024-01-02")], "package_id string, ord long, category string, text string")
    text = case_summary(frame).first().summary_md
    assert text.count("- money: $") == 10 and "- money: 2 more" in text and "date: " in text and "date: 1 more" not in text
    assert [(r.kind, r.left_out) for r in facts_left_out(case_facts(frame), 10).collect()] == [("money", 2)]
