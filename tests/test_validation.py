from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import submission as S
from paperloom.operators import validation as J
from paperloom.operators.audit import audit_events

RULES = "id int, name string, rule_type string, discipline string, def_type string, def_field string, def_pattern string, active boolean"
DOCUMENTS = "id long, document_number string, title string, revision string, issue_status string, contract_number string, discipline string, page_count int, status string"


def documents(spark, *rows):
    return spark.createDataFrame(
        [(i, number, title, None, "IFR", "C", discipline, 0, "Checking") for i, number, title, discipline in rows], DOCUMENTS
    )


def outcome(spark, rules, *rows):
    frame = spark.createDataFrame(rules, RULES)
    return {r.document_id: r for r in J.validate_documents(documents(spark, *rows), frame).collect()}


def test_which_rules_apply(spark):
    rules = [
        (1, "general", "blocking", None, "custom", None, None, True),
        (2, "elc", "blocking", "ELC", "custom", None, None, True),
        (3, "mec", "blocking", "MEC", "custom", None, None, True),
        (4, "off", "blocking", None, "custom", None, None, False),
    ]
    docs = documents(spark, (1, "N", "T", "ELC"), (2, "N", "T", "SIM"), (3, "N", "T", None), (4, "N", "T", ""))
    pairs = J.active_rules(docs, spark.createDataFrame(rules, RULES)).collect()
    got = {d: sorted(p.rule_id for p in pairs if p.document_id == d) for d in (1, 2, 3, 4)}
    assert got == {1: [1, 2], 2: [1], 3: [1, 2, 3], 4: [1, 2, 3]}


def test_no_rules(spark):
    row = outcome(spark, [], (1, None, None, None))[1]
    assert (row.passed, row.rules_evaluated) == (True, 0)


def test_messages_and_severity(spark):
    rules = [
        (1, "req", "blocking", None, "required_field", "title", None, True),
        (2, "nofield", "warning", None, "required_field", None, None, True),
        (3, "pat", "blocking", None, "pattern_match", "document_number", "N[o0]", True),
        (4, "bad", "warning", None, "pattern_match", "title", "(", True),
        (5, "nopat", "warning", None, "pattern_match", "title", None, True),
        (6, "odd", "warning", None, "checksum", None, None, True),
        (7, "count", "blocking", None, "required_field", "page_count", None, True),
        (8, "elsewhere", "warning", None, "pattern_match", "no_such_field", "None", True),
    ]
    rows = outcome(spark, rules, (1, None, "\t ", "ELC"), (2, "xNo", "T", "ELC"))
    assert [v.rule_name for v in rows[1].failed_rules] == ["req"]  # a missing number is matched as the text None
    assert [(v.rule_name, v.message.split(":")[0]) for v in rows[1].warnings] == [
        ("nofield", "Rule missing 'field' definition"), ("bad", "Rule evaluation error"),
        ("nopat", "Rule missing 'field' or 'pattern'"), ("odd", "Unknown rule type"),
        ("elsewhere", "Field 'no_such_field' does not match required pattern"),
    ]
    assert [v.rule_name for v in rows[2].failed_rules] == ["pat"]  # the match starts at the beginning
    assert rows[2].failed_rules[0].details == {"field": "document_number", "pattern": "N[o0]", "value": "xNo"}
    assert (rows[2].rules_evaluated, rows[2].rules_failed, rows[2].passed) == (8, 1, False)


def test_notes(spark):
    rules = [
        (1, "w", "warning", None, "required_field", "revision", None, True),
        (2, "b", "blocking", None, "required_field", "title", None, True),
    ]
    docs = documents(spark, (1, "N1", None, "ELC"), (2, "N2", "T", "ELC"))
    validated = J.validate_documents(docs, spark.createDataFrame(rules, RULES))
    notes = J.rejection_notes(validated, F.lit("2024-01-31")).select("*", J.render_rejection(F.col("note")).alias("report")).collect()
    assert [n.document_id for n in notes] == [1]
    note = json.loads(notes[0].note_json)
    assert [(c["seq"], c["client_comment"], c["contractor_response"]) for c in note["comments_response"]] == [
        (1, "[b] Required field 'title' is missing or empty", None),
        (2, "[WARNING - w] Required field 'revision' is missing or empty", None),
    ]
    assert note["summary"] == {"total_issues": 1, "total_warnings": 1, "blocking_failures": 1}
    assert "Document: N1\nDate: 2024-01-31\nStatus: REJECTED" in notes[0].report
    assert "2. [WARNING] [WARNING - w]" in notes[0].report
    assert {r.id: r.status for r in J.apply_decision(docs, validated).collect()} == {1: "Rejected", 2: "Approved"}


def test_rules_from_json(spark):
    rules = spark.createDataFrame(
        [(1, "r", "blocking", None, '{"type": "pattern_match", "field": "title", "pattern": "^A"}', True)],
        "id int, name string, rule_type string, discipline string, definition string, active boolean",
    )
    row = J.rules_from_definitions(rules).collect()[0]
    assert (row.def_type, row.def_field, row.def_pattern) == ("pattern_match", "title", "^A")


def test_judging_needs_no_shuffle_of_documents(spark):
    rules = spark.createDataFrame([(1, "r", "blocking", None, "custom", None, None, True)], RULES)
    plan = J.validate_documents(documents(spark, (1, "N", "T", None)), rules)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(
    "response, mock, expected",
    [
        ('{"confirmation_ref": "C1", "id": 3}', False, ("C1", "submitted")),
        ('{"confirmation_ref": "", "reference": "R"}', False, ("R", "submitted")),
        ('{"id": 12}', False, ("12", "submitted")),
        ('{"id": 0}', False, (None, "failed")),
        ("{}", True, ("MOCK-7", "pending")),
        (None, True, ("MOCK-7", "pending")),
    ],
)
def test_confirmation(spark, response, mock, expected):
    rows = spark.createDataFrame([(7, response)], "document_id long, response string")
    row = S.confirmation_ref(rows, mock).collect()[0]
    assert (row.ref, row.status) == expected


def test_given_discipline_wins(spark):
    docs = documents(spark, (1, "N", "T", "ELC")).withColumn("status", F.lit("Approved"))
    assert S.submittable(docs, "MEC")[0].collect()[0].submission_discipline == "MEC"
    assert S.submittable(docs)[0].collect()[0].submission_discipline == "ELC"


def test_audit_metadata(spark):
    one = spark.range(1).select(F.lit(5).alias("entity_id"), F.lit("h").alias("file_hash"), F.lit("m").alias("model_version"))
    ocr = one.select("*", F.lit(0.5).alias("avg_confidence"), F.lit(1).alias("page"), F.lit(2).alias("block_count"), F.lit(1).alias("low_confidence_count"))
    parsed = one.select("*", F.lit("llm").alias("parser_type"), F.lit(True).alias("success"), F.lit(None).cast("array<string>").alias("extracted_fields"))
    judged = one.select("*", F.lit(False).alias("passed"), F.lit(3).alias("rules_evaluated"), F.lit(1).alias("rules_failed"), F.lit(None).cast("string").alias("rejection_note"))
    asked = one.select("model_version", F.lit("q").alias("query_text"), F.lit("a").alias("answer"), F.lit("Low").alias("confidence_level"), F.array(F.lit("D")).alias("cited_document_ids"), F.array(F.lit(1)).alias("retrieved_chunk_ids"))
    rows = {r.event_type: r for r in audit_events(ocr, parsed, judged, asked, F.lit("now")).collect()}
    assert json.loads(rows["ocr"].metadata) == {"page": 1, "block_count": 2, "low_confidence_count": 1}
    assert json.loads(rows["parse"].metadata) == {"parser_type": "llm", "success": True, "extracted_fields": []}
    assert json.loads(rows["validate"].metadata)["rejection_note"] is None
    assert json.loads(rows["qa"].metadata)["cited_document_ids"] == ["D"] and rows["qa"].model_version is None
    assert (rows["ocr"].confidence_score, rows["qa"].entity_type, rows["qa"].entity_id) == (0.5, "query", None)


def test_patterns_that_break_only_inside_the_match_fail_their_rule(spark):
    rules = [
        (1, "quote", "warning", None, "pattern_match", "title", r"\QABC", True),
        (2, "comment", "warning", None, "pattern_match", "title", "(?x) a # note", True),
        (3, "fine", "blocking", None, "pattern_match", "title", "T", True),
    ]
    row = outcome(spark, rules, (1, "N", "T", "ELC"))[1]
    assert row.passed and [w.rule_name for w in row.warnings] == ["quote", "comment"]


def test_custom_rules_have_a_hook(spark):
    rules = spark.createDataFrame([(1, "own", "blocking", None, "custom", None, None, True)], RULES)

    def long_title(fields, rule):
        return J._verdict(F.length(fields["title"]) > 3, F.lit("title length"))

    docs = documents(spark, (1, "N", "Title", "ELC"), (2, "N", "T", "ELC"))
    got = {r.document_id: r.passed for r in J.validate_documents(docs, rules, long_title).collect()}
    assert got == {1: True, 2: False}
