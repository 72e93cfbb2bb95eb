"""Assembly, recognised blocks, model responses and answers on small inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperloom.plans import admission as admission_plans
from paperloom.session import stored
from paperloom.sources.views import Source
from paperloom.operators import answers as I
from paperloom.operators import assembly as B
from paperloom.operators import enrichment as E
from paperloom.operators import recognition as C
from paperloom.operators.parsing import parse_documents
from paperloom.operators.reports import action_stats, document_lines, list_documents, review_stats


def test_pages_and_tables(spark):
    rows = [
        (1, 2, 1, "TEXT", "a", "second", None), (1, 1, 2, "TEXT", "a", "b", None), (1, 1, 1, "TEXT", "a", "a", None),
        (1, 1, 3, "table", "t", "", [["x", None], ["1", "2"]]), (1, 3, 1, "TEXT", "a", "", None),
    ]
    df = spark.createDataFrame(rows, "document_id long, page int, ord int, kind string, name string, text string, cells array<array<string>>")
    row = B.assemble_pages(df).collect()[0]
    assert row.text == "\n[Page 1]\na\nb\n\n[Table on Page 1]\nx\t\n1\t2\n\n[Page 2]\nsecond" and row.page_count == 3


@pytest.mark.parametrize("length, pages, expected", [(49, 1, True), (50, 1, False), (3, 0, False)])
def test_sparse(spark, length, pages, expected):
    df = spark.createDataFrame([("x" * length, pages)], "t string, n int")
    assert df.select(B.sparse_text_flag(F.col("t"), F.col("n"))).collect()[0][0] is expected


def test_title_block_takes_the_last(spark):
    rows = [(1, 1, 1, "ATTRIB", "Drawing_No", "A"), (1, 1, 2, "ATTRIB", "TITLE", "B"), (1, 1, 3, "ATTRIB", "Scale", "1:5"), (1, 1, 4, "TEXT", "REV", "no"), (1, 1, 5, "ATTRIB", "rev", "C")]
    df = spark.createDataFrame(rows, "document_id long, page int, ord int, kind string, name string, text string")
    assert B.title_block(df).collect()[0].fields == {"title": "B", "scale": "1:5", "revision": "C"}


def test_drawing_gets_recognised_text(spark):
    df = spark.createDataFrame([(1, 1, 1, "ATTRIB", "T", "x"), (2, 1, 1, "table", "T", "x")], "document_id long, page int, ord int, kind string, name string, text string")
    seen = spark.createDataFrame([(1, "ocr"), (2, "ocr2")], "document_id long, text string")
    rows = {r.document_id: (r.text, r.extraction_method) for r in B.drawing_needs_ocr(df, seen).collect()}
    assert rows == {1: ("[ATTRIB:T]: x\nocr", "dxf+ocr"), 2: ("ocr2", "dxf+ocr")}
    assert B.drawing_needs_ocr(df, seen, min_parts=1).where("document_id = 1").collect()[0].extraction_method == "dxf"


def test_tokens_and_gate(spark):
    rows = [(1, 1, " a ", c, 1, 2, 3, 4) for c in (74, 75, 9, 10)] + [(1, 1, " ", 90, 0, 0, 0, 0)]
    tokens = spark.createDataFrame(rows, "document_id long, page int, text string, conf int, left int, top int, width int, height int")
    blocks = C.normalize_ocr_tokens(tokens)
    passing, low = C.confidence_gate(blocks)
    assert sorted(r.confidence for r in passing.collect()) == [0.75] and sorted(r.confidence for r in low.collect()) == [0.1, 0.74]
    assert tuple(passing.collect()[0].bbox) == (1, 2, 4, 6)
    assert C.low_confidence_regions(low, F.lit("now")).collect()[0].bbox == '{"bbox":[1,2,4,6]}'
    documents = spark.createDataFrame([(1,), (2,)], "id long")
    stats = {r.document_id: r for r in C.confidence_stats(documents, blocks).collect()}
    assert (stats[1].total_blocks, stats[1].passing_blocks, stats[2].total_blocks, stats[2].avg_confidence) == (3, 1, 0, 0.0)


def test_responses(spark):
    rows = [
        (1, '```json\n{"general_notes": ["n"]}\n```'), (2, "{broken"), (3, "[1]"), (4, None), (5, "```"), (6, " {} "),
        (7, '{"equipment_details": [{"tag": "NEW-001"}, {"tag": "NEW-001"}, {"tag": "EQP-001"}, {"rating": "x"}], "complex_comments": [{"comment": "c"}]}'),
    ]
    parsed_json = E.parse_extraction_json(spark.createDataFrame(rows, "id long, response string"))
    errors = {r.id: r.error for r in parsed_json.collect()}
    invalid, other = "response is not valid JSON", "response is not a JSON object"
    assert errors == {1: None, 2: invalid, 3: other, 4: invalid, 5: invalid, 6: None, 7: None}
    docs = spark.createDataFrame([(i, "EQP-001: 5 kW, 230 V\n") for i in (1, 2, 7, 8)], "document_id long, text string")
    merged = {r.document_id: r for r in E.merge_extractions(parse_documents(docs), parsed_json).collect()}
    assert [e.tag for e in merged[7].equipment_ratings] == ["EQP-001", "NEW-001", "NEW-001"]
    assert [(c.seq, c.client_comment) for c in merged[7].comments] == [(1, "c")]
    assert {i: m.llm_fields_added for i, m in merged.items()} == {1: 1, 2: 0, 7: 3, 8: 0}
    assert merged[8].parser == "deterministic" and merged[1].general_notes == ["n"]


def test_answers_and_citations(spark):
    rows = [
        (1, "ANSWER: first\nANSWER:  second\nCONFIDENCE: HIGH\nCONFIDENCE: maybe\nCITATIONS: AB-C-DE-12-345 · Page 3, ab-c-de-12-345 • sheet 4, ZZ-Z-ZZ-99-999 · Page 1"),
        (2, "  free text \n"), (3, "ANSWER:\nCONFIDENCE: low"),
    ]
    answers = I.parse_answers(spark.createDataFrame(rows, "query_id long, response string"))
    got = {r.query_id: (r.answer, r.confidence) for r in answers.collect()}
    assert got == {1: ("second", "High"), 2: ("free text", "Medium"), 3: ("ANSWER:\nCONFIDENCE: low", "Low")}
    context = spark.createDataFrame(
        [(1, 2, 10, "AB-C-DE-12-345", "later", 7, "t"), (1, 1, 11, "AB-C-DE-12-345", "T", 6, "t"), (2, 1, 12, "X", "TX", None, "t"), (2, 2, 13, None, "no", None, "t")],
        "query_id long, n int, chunk_id long, document_number string, title string, page int, content string",
    )
    explicit = I.parse_citations(answers, context)
    assert [(r.query_id, r.seq, r.title, r.page_or_sheet) for r in explicit.collect()] == [(1, 0, "T", "Sheet 3")]
    final = I.final_citations(explicit, I.context_citations(context), answers)
    assert sorted((r.query_id, r.document_number, r.page_or_sheet) for r in final.collect()) == [(1, "AB-C-DE-12-345", "Sheet 3"), (2, "X", "N/A")]
    queries = spark.createDataFrame([(1, "q1"), (2, "q2"), (9, "q9")], "query_id long, query string")
    prompt = {r.query_id: r.prompt for r in I.assemble_context(context, queries).collect()}
    assert "[1] Document: AB-C-DE-12-345 - T (Page/Sheet: 6)\nt\n\n[2] Document" in prompt[1] and "[2] Document: Unknown - no (Page/Sheet: N/A)" in prompt[2]
    assert [r.query_id for r in I.unanswerable_queries(queries, context).collect()] == [9]
    log = {r.query_id: r for r in I.qa_log(queries, answers, final, context, F.lit("now"), "m").collect()}
    assert log[1].retrieved_chunk_ids == [11, 10] and log[2].cited_document_ids == ["X"] and 9 not in log


def test_reports_on_empty_tables(spark):
    regions = spark.createDataFrame([], "reviewed boolean, confidence double")
    assert tuple(review_stats(regions).collect()[0]) == (0, 0, 0, 0.0, 0.0)
    actions = spark.createDataFrame([], "action_type string, decision string, success boolean, confidence double, created_at timestamp_ntz")
    total = action_stats(actions, 24, F.lit("2024-01-31").cast("timestamp_ntz")).collect()
    assert [(r.dimension, r.actions, r.success_rate) for r in total] == [("total", 0, 0.0)]
    with pytest.raises(ValueError):
        list_documents(spark.range(1), page_size=0)
    lines = spark.createDataFrame([(1, None, "", "ELC", None, "Approved")], "id long, document_number string, title string, discipline string, page_count int, status string")
    assert tuple(document_lines(lines).collect()[0]) == (1, "N/A", "N/A", "ELC", 0, "Approved")


def test_documents_of_a_discipline_do_not_meet_in_one_task(spark, folder, monkeypatch):
    """The partitions that results touch are sent to where the documents are."""
    plans = []
    monkeypatch.setattr(admission_plans, "stored", lambda df, purpose: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, purpose))
    written = admission_plans.upsert_written_documents(Source(spark, folder))
    assert written.count() == Source(spark, folder).ref_documents.count()
    assert len(plans) == 1 and any("LeftSemi" in line and "<=>" in line and "rightHint=(strategy=broadcast)" in line for line in plans[0].splitlines())
