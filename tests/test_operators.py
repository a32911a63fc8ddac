import json

import pandas as pd
from pyspark.sql import functions as F

from caseloom.operators.classify import Rule, classify, invalid_categories, normalise_decisions, reset_invalid
from caseloom.operators.combine import assemble_pages, combine_texts
from caseloom.operators.contextual import name_lexicon, redact_contextual
from caseloom.operators.evaluate import eval_cases, eval_failures, eval_report
from caseloom.operators.route import (
    approved,
    audit_report,
    audit_summary,
    decision_list,
    exclusion_log,
    package_totals,
    pending,
    route,
    summary_text,
)
from caseloom.operators.summary import case_facts, case_summary, sentences, top_evidence
from caseloom.operators.usage import usage_facts, usage_report
from caseloom.sources.tables import APPROVAL_SCHEMA, RULE_SCHEMA, invalid_caches, load_relevant_json, parse_relevant_json, read_config

CONTENT = "package_id string, ord long, file_id string, file_name string, kind string, text string"


def test_classify_rules_and_bias(spark):
    rules = [Rule("Correspondence", "mail", "mail", 1.0), Rule("Payroll_Financial", "pay", "pay", 1.0), Rule(None, "shop", "shop", -3.0)]
    texts = ["mail pay", "mail mail pay", "pay pay pay", "mail", "shop mail", "none", "", None]
    rows = [("p", i, str(i), "f", "text", t) for i, t in enumerate(texts)] + [("p", 8, "8", "f", "image", None), ("p", 9, "9", "f", "unsupported", None)]
    got = {r.ord: r for r in classify(spark.createDataFrame(rows, CONTENT), rules, threshold=2.0).collect()}
    assert (got[0].category, got[0].reason) == ("Correspondence", "uncertain: matched: mail, pay")
    assert (got[1].category, got[1].reason) == ("Correspondence", "matched: mail, pay")
    assert got[2].category == "Payroll_Financial" and got[2].is_relevant
    assert got[3].is_relevant and got[3].reason.startswith("uncertain:")
    assert (got[4].is_relevant, got[4].category, got[4].reason) == (True, "Correspondence", "uncertain: matched: mail, shop")
    assert got[5].reason == "no rule matched"
    for i in (6, 7, 9):
        assert (got[i].is_relevant, got[i].category, got[i].reason) == (False, None, "Unsupported file type or no extractable text.")
    assert got[8].category == "Other_Relevant_Evidence" and "manual review" in got[8].reason


def test_classify_runs_patterns_once_under_a_filter(spark):
    frame = spark.createDataFrame([("p", 1, "1", "f", "text", "mail")], CONTENT)
    plan = classify(frame, [Rule("Correspondence", "m", "uniquepattern", 1.0)]).filter("is_relevant")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("uniquepattern") == 1


def test_model_failures_fall_back_row_by_row(spark):
    def model(batch):
        if (batch["text"] == "bad").any():
            raise ValueError("no")
        return pd.DataFrame({"is_relevant": [True] * len(batch), "category": ["Correspondence"] * len(batch), "reason": [None] * len(batch), "input_tokens": 10})

    rows = [("p", i, str(i), "f", "text", t) for i, t in enumerate(["a", "bad", "c", ""])]
    got = {r.ord: r for r in classify(spark.createDataFrame(rows, CONTENT).coalesce(1), model=model, inputs=["text"]).collect()}
    assert got[0].is_relevant and got[2].is_relevant and got[0].reason == "No reason provided by LLM." and got[0].description == ""
    assert got[1].reason == "Automatic categorization failed; flagged for manual review." and got[1].model_error == "ValueError: no"
    assert got[3].category is None and got[3].model_error is None and got[0].input_tokens == 10 and got[0].output_tokens is None
    asked = classify(spark.createDataFrame(rows, CONTENT), model=model, inputs=["text"])
    facts = usage_facts(asked, "classify")
    report = usage_report(facts, ["step"]).first()
    assert facts.count() == 3 and tuple(report)[:3] == ("classify", 20, 0) and abs(report.total_cost_usd - 6e-05) < 1e-12


def test_normalise(spark):
    full = json.dumps({"is_relevant": True, "category": "Correspondence", "reason": "r", "description": "d"})
    replies = [full, "{}", "bad{", '{"is_relevant":"yes"}', None, '{"category":null}']
    rows = normalise_decisions(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")).orderBy("i").collect()
    assert tuple(rows[0][2:]) == (True, "Correspondence", "r", "d")
    for row in rows[1:]:
        assert tuple(row[2:]) == (False, "Other_Relevant_Evidence", "No reason provided by LLM.", "")


def decided(spark):
    rows = [("p", 0, "a", "text", "t0", True, None, "r", ""), ("p", 1, "b", "text", "t1", True, "", "r", ""),
            ("p", 2, "c", "image", None, True, "Payroll_Financial", "r", "seen"), ("p", 3, "d", "text", "t3", False, "Correspondence", "x\ny", ""),
            ("p", 4, "e", "unsupported", None, False, None, "none", ""), ("p", 5, "f", "text", "t5", True, "Payroll_Financial", "r", ""),
            ("q", 0, "g", "text", "t6", False, "Correspondence", "r", "")]
    frame = spark.createDataFrame(rows, "package_id string, ord long, file_name string, kind string, text string, is_relevant boolean, "
                                        "category string, reason string, description string").withColumn("file_id", F.concat("package_id", "file_name"))
    return route(frame, F.col("file_name") != "f")


def test_route_and_audit(spark):
    rows = decided(spark)
    assert [r.destination for r in rows.filter("package_id = 'p'").orderBy("ord").collect()] == [
        "Evidence_Package/Uncategorized", "Evidence_Package/Uncategorized", "Evidence_Package/Payroll_Financial",
        "Excluded_Documents", "Excluded_Documents", "Evidence_Package/Payroll_Financial"]
    audit = audit_report(rows)
    assert audit.columns == ["file_name", "category", "is_relevant", "reason", "copy_failed"]
    assert {r.file_name: r.category for r in audit.collect()} == {
        "a": "", "b": "", "c": "Payroll_Financial", "d": "Correspondence", "e": "", "f": "Payroll_Financial", "g": "Correspondence"}
    assert {r.line for r in exclusion_log(rows).collect()} == {"d\tx y", "e\tnone", "g\tr"}
    assert [(r.ord, r.text) for r in summary_text(rows).orderBy("ord").collect()] == [(0, "t0"), (1, "t1"), (2, "seen")]
    totals = {r.package_id: r for r in package_totals(rows).collect()}
    assert tuple(totals["p"])[1:] == (3, 2, 1, 6) and tuple(totals["q"])[1:] == (0, 1, 0, 1)
    summary = {(r.package_id, r.destination): r.n for r in audit_summary(rows, ["package_id"]).collect()}
    assert summary["p", "(total)"] == 6 and summary["p", "(copy failed)"] == 1 and ("q", "(copy failed)") not in summary
    assert sum(n for (p, d), n in summary.items() if p == "p" and d != "(total)") == 6
    lines = [(r.destination, r.n) for r in audit_summary(rows).collect()]
    assert lines == [("(copy failed)", 1), ("Evidence_Package/Payroll_Financial", 1), ("Evidence_Package/Uncategorized", 2),
                     ("Excluded_Documents", 3), ("(total)", 7)]
    assert {r.file_name: (r.decision, r.note) for r in decision_list(rows).collect()}["f"] == ("Relevant", "copy failed")


def test_gate_and_labels(spark):
    rows = decided(spark)
    yes = spark.createDataFrame([("p", False), ("q", True), ("q", True)], "package_id string, accepted boolean")
    assert [r.package_id for r in approved(rows, yes).collect()] == ["q"]
    assert {r.package_id for r in pending(rows, yes.filter("accepted")).collect()} == {"p"}
    known = spark.createDataFrame([("Correspondence",)], "category string")
    assert [tuple(r) for r in invalid_categories(rows, known).collect()] == [("Payroll_Financial", 2)]
    assert {r.category for r in reset_invalid(rows, ["Correspondence"]).collect()} == {None, "", "Other_Relevant_Evidence", "Correspondence"}


def test_combine_and_pages(spark):
    rows = [("hot", i, f"t{i}") for i in range(25)] + [("one", 3, None), ("one", 1, "a")]
    frame = spark.createDataFrame(rows, "package_id string, ord long, text string").repartition(5)
    whole = {r.package_id: r for r in combine_texts(frame).collect()}
    assert whole["hot"].text == "\n\n".join(f"t{i}" for i in range(25)) and whole["one"].text == "a\n\n" and whole["one"].n_texts == 2
    # 4 or 5 bytes each, with the separator.
    parts = combine_texts(frame, part_bytes=40).filter("package_id = 'hot'").orderBy("part").collect()
    assert [p.n_texts for p in parts] == [10, 8, 7] and [p.part for p in parts] == [0, 1, 2] and "\n\n".join(p.text for p in parts) == whole["hot"].text
    pages = [("f", 2, None, "corrupt"), ("f", 1, "Good page.", None), ("f", 3, None, None), ("f", 10, "end", None), ("g", 1, "x", "bad")]
    texts = {r.file_id: r.text for r in assemble_pages(spark.createDataFrame(pages, "file_id string, page_no int, text string, error string")).collect()}
    assert texts == {"f": "Good page.\n\nend", "g": ""}


def test_contextual(spark):
    rows = [("p", "1", "From: Noor Vale <noor.vale@example.com>\nHi Bo,\nsee O'Hara and the plan.\nTake care,\nKim Lee"),
            ("p", "2", "Noor, Vale and KIM met; noor's will, $190,100 on 3 March 2022. Noory stayed. Bo!"), ("q", "3", "Noor is here")]
    frame = spark.createDataFrame(rows, "package_id string, file_id string, text string")
    known = spark.createDataFrame([("p", "March Clinic"), ("p", "Plan 9")], "package_id string, phrase string")
    lexicon = name_lexicon(frame, known, header_support=1)
    assert {(r.package_id, r.name) for r in lexicon.collect()} == {("p", n) for n in ("noor", "vale", "bo", "kim", "lee", "march", "clinic", "plan")}
    got = {r.file_id: r.safe_text for r in redact_contextual(frame, lexicon).collect()}
    assert got["2"] == ("[REDACTED], [REDACTED] and [REDACTED] met; noor's will, $190,100 on 3 [REDACTED] 2022. Noory stayed. [REDACTED]!")
    assert got["3"] == "Noor is here" and "O'Hara and the plan" in got["1"]
    assert name_lexicon(frame, min_support=2).count() == 0
    # One message's header alone makes no name: it may be a desk's. A second one does, and so does a greeting.
    desk = spark.createDataFrame(
        [("p", "1", "From: Accounts Services <desk@example.com>\nThe Accounts and Services of May."), ("p", "2", "From: Oddny Kelp\nBye"),
         ("p", "3", "To: Oddny Kelp\nDear Imre,\nso be it")], "package_id string, file_id string, text string")
    found = name_lexicon(desk)
    assert {r.name for r in found.collect()} == {"oddny", "kelp", "imre"}
    kept = {r.file_id: r.safe_text for r in redact_contextual(desk, found).collect()}
    assert "The Accounts and Services of May." in kept["1"] and kept["2"] == "From: [REDACTED] [REDACTED]\nBye"

    def model(batch):
        if batch["text"].str.contains("Noor is").any():
            raise RuntimeError("down")
        return pd.DataFrame({"text": batch["text"].str.upper()})

    for closed, text in ((False, "Noor is here"), (True, "")):
        out = {r.file_id: r for r in redact_contextual(frame, model=model, fail_closed=closed).collect()}
        assert out["3"].safe_text == text and out["3"].model_error == "RuntimeError: down" and out["2"].safe_text.startswith("NOOR, VALE")


def test_evidence_and_summary(spark):
    rules = [Rule("Correspondence", "mail", "mail", 1.0), Rule("Payroll_Financial", "pay", "pay", 2.0)]
    rows = [("p", "Correspondence", 1, "A mail. Two mail mail!  Nothing? \n mail last"), ("p", "Payroll_Financial", 2, "pay $1,000.00 on 3 March 2022\npay $1,000.00")]
    frame = spark.createDataFrame(rows, "package_id string, category string, ord long, text string")
    best = [(r.sentence, r.rank) for r in top_evidence(frame, 2, rules=rules).filter("category = 'Correspondence'").orderBy("rank").collect()]
    assert best == [("Two mail mail!", 1), ("A mail.", 2)]
    assert {(r.kind, r.value, r.n) for r in case_facts(frame).collect()} == {("money", "$1,000.00", 2), ("date", "3 March 2022", 1)}
    text = case_summary(frame, k=1, rules=rules).first().summary_md
    assert text == ("# Anonymous case summary\n\n## Background\n\n- documents: 2\n- Correspondence: 1\n- Payroll_Financial: 1\n\n"
                    "## Key Facts\n\n- date: 3 March 2022 (mentions: 1)\n- money: $1,000.00 (mentions: 2)\n\n"
                    "## Potential Claims\n\n- mail (documents: 1)\n- pay (documents: 1)\n\n"
                    "## Notable Evidence\n\n- Correspondence: Two mail mail!\n- Payroll_Financial: pay $1,000.00 on 3 March 2022")

    def broken(batch):
        raise RuntimeError("down")

    row = case_summary(frame, model=broken).first()
    assert row.summary_md == "" and row.model_error == "RuntimeError: down"


def test_sentences(spark):
    texts = ["  a b.  c!\td?e \n\n f . g", " " * 200_000 + "x" + " " * 200_000 + "y.\n", "a.\n\n \nb", "", "..."]
    frame = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    got = {}
    for row in sentences(frame, [], "ord").orderBy("ord", "pos").collect():
        got.setdefault(row.ord, []).append(row.sentence)
    assert got == {0: ["a b.", "c!", "d?e", "f .", "g"], 1: ["x" + " " * 200_000 + "y."], 2: ["a.", "b"], 4: ["..."]}


def test_hot_group_is_limited_before_the_shuffle(spark):
    frame = spark.createDataFrame([("p", "c", 1, "mail")], "package_id string, category string, ord long, text string")
    plan = top_evidence(frame, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_evaluation_and_usage(spark):
    truth = spark.createDataFrame([("a", True, "X"), ("b", False, "Y"), ("c", True, "Z")], "name string, expected_is_relevant boolean, expected_category string")
    got = spark.createDataFrame([("a", True, "X", "$190,100"), ("b", False, "Z", "Ada $190,100"), ("c", True, "Z", "ada")],
                                "name string, is_relevant boolean, category string, safe_text string")
    cases = eval_cases(truth, got, ["Ada"])
    flags = {r.name: tuple(r)[5:] for r in cases.collect()}
    assert flags == {"a": (True, True, True), "b": (False, False, True), "c": (True, True, False)}
    assert [r.name for r in eval_failures(cases).collect()] == ["b"]
    report = eval_report(cases).first()
    assert (report.total, report.correct, report.leaked, report.all_pass) == (3, 2, 1, False)
    assert abs(report.accuracy_score - 200 / 3) < 1e-9 and abs(report.pii_leakage_rate - 100 / 3) < 1e-9
    empty = eval_report(cases.limit(0)).first()
    assert empty.total == 0 and empty.accuracy_score is None
    usage = spark.createDataFrame([("p", 1_000_000, 600_000), ("p", None, None), ("q", 0, 400_000)], "package_id string, input_tokens long, output_tokens long")
    assert tuple(usage_report(usage).first()) == (1_000_000, 1_000_000, 18.0)
    assert {r.package_id: r.total_cost_usd for r in usage_report(usage, ["package_id"]).collect()} == {"p": 12.0, "q": 6.0}
    assert tuple(usage_report(usage.limit(0)).first()) == (0, 0, 0.0)


def test_caches(spark, tmp_path):
    values = ['{"relevant_texts": ["a", "b"]}', "{bad", "{}", '{"relevant_texts": "x"}', '{"relevant_texts": []}']
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
    assert [r.relevant_texts for r in parse_relevant_json(frame).orderBy("i").collect()] == [["a", "b"], None, None, None, []]
    for i, value in enumerate(values):
        (tmp_path / f"p{i}.json").write_text(value)
    assert [tuple(r) for r in load_relevant_json(spark, str(tmp_path)).orderBy("ord").collect()] == [("p0", 0, "a"), ("p0", 1, "b")]
    assert {r.package_id: r.reason for r in invalid_caches(spark, str(tmp_path)).collect()} == {
        "p1": "not a JSON document", "p2": "no relevant_texts", "p3": "relevant_texts is not a list"}


def test_caches_of_one_name_in_two_folders(spark, tmp_path):
    for client in "xy":
        (tmp_path / client).mkdir()
        (tmp_path / client / "stage1_cache.json").write_text(f'{{"relevant_texts": ["of {client}"]}}')
    rows = load_relevant_json(spark, str(tmp_path)).collect()
    assert {r.package_id: r.text for r in rows} == {"x/stage1_cache": "of x", "y/stage1_cache": "of y"}


def test_config_tables(spark, tmp_path):
    """Approvals, entities and rules as JSON lines: the declared schema decides, odd lines become NULL."""
    (tmp_path / "approvals.json").write_text('{"package_id": "0042", "accepted": true}\n{"package_id": "7", "accepted": "perhaps"}\n{"other": 1}\n')
    rows = read_config(spark, str(tmp_path / "approvals.json"), APPROVAL_SCHEMA).collect()
    assert [tuple(r) for r in rows] == [("0042", True), ("7", None), (None, None)]
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a.json").write_text('{"rule_id": 1, "category": "c", "priority": 2, "phrase": "p", "weight": 0.5}\n')
    (tmp_path / "rules" / "b.json").write_text("")
    assert [tuple(r) for r in read_config(spark, str(tmp_path / "rules"), RULE_SCHEMA).collect()] == [(1, "c", 2, "p", 0.5)]
