"""Maintained verdicts against a full judgement, and what a batch reads."""

from __future__ import annotations

from pathlib import Path

import pytest

from paperloom.operators.validation import rule_failure_report, validate_documents
from paperloom.streaming.ingest import maintained_validation
from paperloom.streaming.verdicts import VerdictTable

DOCUMENT = "id long, document_number string, title string, revision string, issue_status string, contract_number string, discipline string, page_count int"
RULE = "id int, name string, rule_type string, discipline string, def_type string, def_field string, def_pattern string, active boolean"
RULES = [
    (1, "title", "blocking", None, "required_field", "title", None, True),
    (2, "number", "blocking", "ELC", "pattern_match", "document_number", "E", True),
    (3, "revision", "warning", "07", "required_field", "revision", None, True),
]


def documents(spark, ids):
    rows = [
        (i, "E1" if i % 2 else "M1", None if i % 3 else "t", "A" if i % 5 else "", None, None, ["ELC", "07", None, "", "INS"][i % 5], i)
        for i in ids
    ]
    return spark.createDataFrame(rows, DOCUMENT)


def listed(df):
    return sorted(
        (
            r.document_id, r.document_number, r.passed, r.rules_evaluated, r.rules_failed,
            [(v.rule_name, v.message, v.details) for v in r.failed_rules], [(v.rule_name, v.message, v.details) for v in r.warnings],
        )
        for r in df.collect()
    )


def changed(**by_id):
    return [by_id.get(f"r{r[0]}", r) for r in RULES]


def test_same_as_full_judgement_after_each_batch(spark, tmp_path):
    table = VerdictTable(spark, str(tmp_path / "verdicts"))
    with pytest.raises(ValueError):
        table.validated()
    looser = (2, "number", "warning", "ELC", "pattern_match", "document_number", "E", True)
    general = (3, "revision", "warning", None, "required_field", "revision", None, True)
    steps = [
        (range(0, 20), RULES),
        (range(20, 30), RULES),  # arrivals only
        (range(0), changed(r2=looser)),  # a rule changes, nothing arrives
        (range(30, 35), changed(r2=looser, r3=general)),  # a rule of one discipline becomes general
        (range(35, 36), RULES[1:]),  # a rule is dropped, two become what they were
        (range(36, 50), RULES),  # and comes back
        (range(0), []),  # no rules at all
    ]
    seen = []
    for batch, (ids, rules) in enumerate(steps):
        seen += ids
        rules = spark.createDataFrame(rules, RULE)
        for _ in range(2):  # a batch that is run again changes nothing
            table.commit(batch, documents(spark, ids), rules)
        if not rules.isEmpty():
            assert listed(table.validated()) == listed(validate_documents(documents(spark, seen), rules)), batch
            report = rule_failure_report(documents(spark, seen), rules)
            assert sorted(map(tuple, table.rule_totals().collect())) == sorted(map(tuple, report.collect()))
    rows = table.validated().collect()
    assert {r.document_id for r in rows} == set(seen) and all(r.passed and r.rules_evaluated == 0 for r in rows)


def test_a_batch_that_stopped_half_way_goes_on_with_the_rules_it_had_read(spark, tmp_path):
    table = VerdictTable(spark, str(tmp_path / "verdicts"))
    rules = spark.createDataFrame(RULES, RULE)
    table.commit(0, documents(spark, range(10)), rules)
    table.commit(1, documents(spark, range(10, 20)), rules.where("id <> 1"))
    (tmp_path / "verdicts" / "verdicts" / "batch_id=1" / "_SUCCESS").unlink()
    assert listed(table.validated()) == listed(validate_documents(documents(spark, range(10)), rules))
    table.commit(1, documents(spark, range(10, 20)), rules)
    assert listed(table.validated()) == listed(validate_documents(documents(spark, range(20)), rules.where("id <> 1")))


def test_unaffected_disciplines_are_not_read(spark, tmp_path):
    table = VerdictTable(spark, str(tmp_path / "verdicts"))
    table.commit(0, documents(spark, range(20)), spark.createDataFrame(RULES, RULE))
    other = list(Path(tmp_path, "verdicts", "documents", "batch_id=0", "rules_of=07").glob("*.parquet"))
    assert other
    for name in other:
        name.write_bytes(b"not to be read")
        Path(name.parent, f".{name.name}.crc").unlink(missing_ok=True)
    rules = spark.createDataFrame(changed(r2=(2, "number", "warning", "ELC", "required_field", "title", None, True)), RULE)
    table.commit(1, documents(spark, range(20, 25)), rules)
    assert listed(table.validated()) == listed(validate_documents(documents(spark, range(25)), rules))
    # a rule of that discipline does read them
    rules = spark.createDataFrame(changed(r3=(3, "revision", "blocking", "07", "required_field", "revision", None, True)), RULE)
    with pytest.raises(Exception, match="(?i)parquet|magic|malformed|length"):
        table.commit(2, documents(spark, []), rules)


def test_stream_with_a_rule_change_between_micro_batches(spark, tmp_path):
    for part in range(3):
        documents(spark, range(part * 10, part * 10 + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = []
    stricter = changed(r1=(1, "title", "warning", None, "required_field", "title", None, True))

    def rules():
        read.append(1)
        return spark.createDataFrame(RULES if len(read) == 1 else stricter, RULE)

    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    maintained_validation(stream, rules, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    table = VerdictTable(spark, str(tmp_path / "out"))
    assert len(table.batches()) == 3
    want = validate_documents(documents(spark, range(30)), spark.createDataFrame(stricter, RULE))
    assert listed(table.validated()) == listed(want)
