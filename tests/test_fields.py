"""Field extraction on hand-derived cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperloom.functions import fields as X
from paperloom.functions import text as T
from paperloom.operators.parsing import explode_children, parse_documents


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text")).alias("v")).collect()[0].v


@pytest.mark.parametrize(
    "extract, text, expected",
    [
        (X.extract_document_number, "EPC-M-ELE-01-001", None),
        (X.extract_document_number, "ARG-E-LO-00-009_1 Elec Grounding", "ARG-E-LO-00-009"),
        (X.extract_document_number, "see AB-C-DE-12-345 and XY-Z-AB-99-999", "AB-C-DE-12-345"),
        (X.extract_revision, "Please review", "IEW"),
        (X.extract_revision, "Rev. b2", "B2"),
        (X.extract_revision, "Revision History", "HISTORY"),
        (X.extract_revision, "nothing", None),
        (X.extract_issue_status, "IFR [X] IFC", "IFC"),
        (X.extract_issue_status, "ifa then ifr", "IFR"),
        (X.extract_issue_status, "☑ As Built, [X] IFI", "ASB"),
        (X.extract_issue_status, "Issued for Approval", "IFA"),
        (X.extract_issue_status, "none", None),
        (X.extract_contract_number, "Contract No: 12", "No"),
        (X.extract_contract_number, "CTR #: AB-7", "AB-7"),
        (X.extract_contract_number, "Contract Z9", "Z9"),
        (X.extract_page_count, "Sheet of 4", 4),
        (X.extract_page_count, "page / 12", 12),
        (X.extract_page_count, "3 of 9 sheets", 9),
        (X.extract_page_count, "Sheet of 99999999999", None),
        (X.extract_title, "Title: ab\nDrawing Title:  Main   Panel ", "Main Panel"),
        # the whole text is looked at, unless a window is asked for
        (X.extract_title, "AB-C-DE-12-345\n AB-1\n short\nLayout of pumps", "Layout of pumps"),
        (lambda text: X.extract_title(text, lines_after=3), "AB-C-DE-12-345\n AB-1\n short\nLayout of pumps", None),
        (lambda text: X.extract_title(text, window=9), "AB-C-DE-12-345\n AB-1\n short\nLayout of pumps", None),
        (X.extract_title, "AB-C-DE-12-345\n SHEET-00001\nLayout of pumps", "Layout of pumps"),
        (X.extract_title, "Title: A\rB longer", "A B longer"),
        (X.extract_page_numbers, "[Page 2] x [page  13]", [2, 13]),
    ],
)
def test_scalar(spark, extract, text, expected):
    assert value(spark, extract, text) == expected


def test_strict_forms(spark):
    assert value(spark, lambda c: X.extract_revision(c, strict=True), "Please review. Rev C") == "C"
    assert value(spark, lambda c: X.extract_contract_number(c, strict=True), "Contract No: 12") == "12"
    block = value(spark, lambda c: X.extract_signature_block(c, strict=True), "Prepared by: Ann\nChecked By: Bo")
    assert (block.prepared_by, block.checked_by) == ("Ann", "Bo")
    literal = value(spark, X.extract_signature_block, "Approved by: Ann\nChecked By: Bo")
    assert (literal.approved_by, literal.checked_by) == (None, "Bo")


def test_given_page_count_wins(spark):
    df = spark.createDataFrame([("Sheet of 4", 7), ("Sheet of 4", 0), ("Sheet of 4", None)], "text string, n int")
    got = [r[0] for r in df.select(X.extract_page_count(F.col("text"), F.col("n"))).collect()]
    assert got == [7, 4, 4]


def test_sections(spark):
    history = value(spark, X.extract_revision_history, "REVISION RECORD\n A 01/02/24\nB 1/2/24 no\n0 01/02/2024 As  built\n\nC 01/02/24")
    assert [(h.rev, h.date, h.description, h.raw) for h in history] == [
        ("A", "01/02/24", None, "A 01/02/24"), ("0", "01/02/2024", "As built", "0 01/02/2024 As  built"),
    ]
    comments = value(spark, X.extract_comments, "Comments\n1. Check\nResponse: Done\nand sent\n2) Update\n\n3. no")
    assert [(c.seq, c.client_comment, c.contractor_response) for c in comments] == [
        (1, "Check", "Done\nand sent"), (2, "Update", None),
    ]
    symbols = value(spark, X.extract_legend_symbols, "Legend\nMCB - Breaker\nM - no\nAB – dash\n")
    assert [(s.symbol, s.description) for s in symbols] == [("MCB", "Breaker"), ("AB", "dash")]
    wide = value(spark, X.extract_legend_symbols, "SYMBOL and its Description\nAB - x\n\nLegend\nCD - y")
    assert [(s.symbol, s.description) for s in wide] == [("AB", "x")]
    late = value(spark, X.extract_legend_symbols, "Description of a symbol\nLegend\nCD - y")
    assert [(s.symbol, s.description) for s in late] == [("CD", "y")]
    index = value(spark, X.extract_drawing_index, "Sheet Index\n1 - Cover\n2.1 – Plan")
    assert [(i.sheet_no, i.sheet_title) for i in index] == [("1", "Cover"), ("2.1", "Plan")]
    rating = value(spark, X.extract_equipment_ratings, "x EQP-001: 2 kW set, 230 V, 1-phase, 50 Hz, 2 kW\nABC-123: plain\n")
    assert [tuple(r) for r in rating] == [
        ("EQP-001", "2 kW set", "230 V", "1-phase", "50 Hz", "2 kW"), ("ABC-123", "plain", None, None, None, None),
    ]


def test_parse_counts_and_children(spark):
    # a comment without a response line takes the next one as its response
    text = "ARG-E-LO-00-009\nComments\n7. a\n9. b\n\nSignature\nChecked By: Q"
    parsed = parse_documents(spark.createDataFrame([(1, text), (2, "")], "document_id long, text string"))
    counts = {r.document_id: r.fields_extracted for r in parsed.collect()}
    assert counts == {1: 4, 2: 0}  # number, the line "Comments" as title, one comment, one name
    rows = explode_children(parsed)["comments_response"].orderBy("seq").collect()
    assert [(r.seq, r.client_comment, r.contractor_response) for r in rows] == [(1, "a", "9. b")]


def test_text_helpers(spark):
    assert value(spark, T.strip, "  a b\x1f\n") == "a b"
    assert value(spark, T.estimate_tokens, " ".join(["w"] * 10)) == 13
    assert value(spark, T.estimate_tokens, " \n ") == 0
    assert value(spark, lambda c: T.overlap_tail(c, 2), "a\nb  c") == "b c"
    assert value(spark, lambda c: T.overlap_tail(c, 3), "a\nb  c") == "a\nb  c"
    assert value(spark, T.split_sections, "a\n\n \n\n b \n\nc.d") == ["a", "b", "c.d"]
    assert [value(spark, T.extension, p) for p in ("a/b.PDF", "a.b/c", ".pdf", "x.", "x.tar.gz")] == [
        ".pdf", "", "", "", ".gz",
    ]
    assert value(spark, T.terms, "The Pumps, pump-2 und Öl") == ["pumps", "pump", "2", "und", "öl"]


@pytest.mark.parametrize("text", ["7" * 100_000, "Symbol " * 30_000, "Legend\n" + "A" * 100_000, "AB-" * 50_000, " " * 300_000])
def test_long_runs_stay_linear(spark, text):
    parsed = parse_documents(spark.createDataFrame([(1, text)], "document_id long, text string"))
    assert parsed.collect()[0].text_length == len(text)
