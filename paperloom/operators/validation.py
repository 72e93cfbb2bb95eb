"""Validation of documents against rules held in a table, and rejection notes.

The active rules are packed into one array per discipline and joined to the documents by discipline, so each document
is judged within its own row: no product of rules and documents, and no grouping afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import APPROVED, BLOCKING, REJECTED
from paperloom.functions.scale import broadcast_if_small, computed_once
from paperloom.functions.text import let, strip

INPUT_COLUMNS = [
    "document_number", "title", "revision", "issue_status", "contract_number", "discipline", "page_count",
]
ALL_RULES, GENERAL_RULES = "*all", "*general"
# Verdict (passed, message, details) of a rule of type custom, from the fields of a document and the rule.
CustomRule = Callable[[Column, Column], Column]
_RULE_COLUMNS = ["id", "name", "rule_type", "def_type", "def_field", "def_pattern", "bad_pattern"]


def rules_from_definitions(rules: DataFrame) -> DataFrame:
    """Rules whose definition is a JSON string, with its parts as columns."""
    parts = F.from_json("definition", "type string, field string, pattern string")
    return rules.withColumn("d", parts).select(
        "id", "name", "rule_type", "discipline",
        F.col("d.type").alias("def_type"), F.col("d.field").alias("def_field"), F.col("d.pattern").alias("def_pattern"),
        "active",
    )


# What a rule's pattern is run inside of: from the start of the value.
_MATCH = r"(?dU)\A(?:", ")"


def _compile_error(spark, pattern: str) -> bool:
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(f"{_MATCH[0]}{pattern}{_MATCH[1]}")
        return False
    except Exception:
        return True


def checked_rules(rules: DataFrame) -> DataFrame:
    """Active rules with ``bad_pattern``. A pattern that does not compile would fail the whole job, not one rule."""
    active = rules.where(F.col("active"))
    patterns = active.where(F.col("def_pattern").isNotNull()).select("def_pattern").distinct()
    bad = [r[0] for r in patterns.toLocalIterator() if _compile_error(rules.sparkSession, r[0])]
    return active.withColumn("bad_pattern", F.coalesce(F.col("def_pattern").isin(bad), F.lit(False)))


def rule_sets(rules: DataFrame) -> DataFrame:
    """discipline_key, rules: per discipline its own and the general rules; all rules for documents without one."""
    checked = checked_rules(rules)
    packed = F.array_sort(F.collect_list(F.struct(*_RULE_COLUMNS)))
    general = checked.where(F.col("discipline").isNull()).agg(packed.alias("rules"))
    own = checked.where(F.col("discipline").isNotNull()).groupBy(F.col("discipline").alias("discipline_key")).agg(
        F.collect_list(F.struct(*_RULE_COLUMNS)).alias("own")
    )
    return (
        own.select("discipline_key", F.sort_array(F.concat("own", general.scalar())).alias("rules"))
        .unionByName(general.select(F.lit(GENERAL_RULES).alias("discipline_key"), "rules"))
        .unionByName(checked.agg(packed.alias("rules")).select(F.lit(ALL_RULES).alias("discipline_key"), "rules"))
    )


def with_rules(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents with the array of rules that apply to them."""
    sets = broadcast_if_small(rule_sets(rules))
    others = sets.where(F.col("discipline_key") == GENERAL_RULES).select("rules").scalar()
    key = F.coalesce(F.nullif(F.col("discipline"), F.lit("")), F.lit(ALL_RULES))
    joined = documents.withColumn("discipline_key", key).join(sets, "discipline_key", "left").drop("discipline_key")
    return joined.withColumn("rules", F.coalesce("rules", others))


def active_rules(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """The applicable pairs: document_id, rule_id, rule_name."""
    return with_rules(documents, rules).select(F.col("id").alias("document_id"), F.explode("rules").alias("r")).select(
        "document_id", F.col("r.id").alias("rule_id"), F.col("r.name").alias("rule_name")
    )


def validation_inputs() -> Column:
    """The checked columns of a document as a map from name to text."""
    return F.create_map(*[x for c in INPUT_COLUMNS for x in (F.lit(c), F.col(c).cast("string"))])


def _present(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def _verdict(passed: Column, message: Column, details: Column | None = None) -> Column:
    none = F.lit(None).cast("map<string,string>")
    return F.struct(
        passed.alias("passed"), message.alias("message"), (none if details is None else details).alias("details")
    )


def rule_required_field(fields: Column, rule: Column) -> Column:
    """Fails for a missing or blank value, and if the rule names no field."""
    field = rule["def_field"]
    found = F.coalesce(strip(F.try_element_at(fields, field)) != "", F.lit(False))
    return (
        F.when(~_present(field), _verdict(F.lit(False), F.lit("Rule missing 'field' definition")))
        .when(found, _verdict(F.lit(True), F.concat(F.lit("Required field '"), field, F.lit("' is present"))))
        .otherwise(
            _verdict(
                F.lit(False),
                F.concat(F.lit("Required field '"), field, F.lit("' is missing or empty")),
                F.create_map(F.lit("field"), field),
            )
        )
    )


def rule_pattern_match(fields: Column, rule: Column) -> Column:
    """The value must match from its start. A null value is matched as the text ``None``, an unknown field as ''."""
    field, pattern = rule["def_field"], rule["def_pattern"]
    value = F.try_element_at(fields, field)
    subject = F.when(F.map_contains_key(fields, field), F.coalesce(value, F.lit("None"))).otherwise(F.lit(""))
    matches = F.regexp_like(subject, F.concat(F.lit(_MATCH[0]), pattern, F.lit(_MATCH[1])))
    details = F.create_map(F.lit("field"), field, F.lit("pattern"), pattern, F.lit("value"), value)
    return (
        F.when(~_present(field) | ~_present(pattern), _verdict(F.lit(False), F.lit("Rule missing 'field' or 'pattern'")))
        .when(
            rule["bad_pattern"],
            _verdict(F.lit(False), F.concat(F.lit("Rule evaluation error: invalid pattern "), pattern)),
        )
        .when(matches, _verdict(F.lit(True), F.concat(F.lit("Field '"), field, F.lit("' matches pattern"))))
        .otherwise(
            _verdict(F.lit(False), F.concat(F.lit("Field '"), field, F.lit("' does not match required pattern")), details)
        )
    )


def rule_custom() -> Column:
    return _verdict(F.lit(True), F.lit("Custom validation passed"))


def rule_unknown_type(rule: Column) -> Column:
    return _verdict(F.lit(False), F.concat(F.lit("Unknown rule type: "), F.coalesce(rule["def_type"], F.lit("None"))))


def judge(fields: Column, rule: Column, custom: Column | None = None) -> Column:
    """The verdict of one rule. ``custom`` replaces the verdict of rules of type custom."""
    kind = rule["def_type"]
    return (
        F.when(kind == "required_field", rule_required_field(fields, rule))
        .when(kind == "pattern_match", rule_pattern_match(fields, rule))
        .when(kind == "custom", rule_custom() if custom is None else custom)
        .otherwise(rule_unknown_type(rule))
    )


def judged(documents: DataFrame, rules: DataFrame, custom: CustomRule | None = None) -> DataFrame:
    """Documents with ``verdicts``: one struct per applicable rule, in rule order. ``custom`` judges rules of type custom."""

    def entry(fields: Column, rule: Column) -> Column:
        return let(
            judge(fields, rule, None if custom is None else custom(fields, rule)),
            lambda v: F.struct(
                rule["id"].alias("rule_id"), rule["name"].alias("rule_name"), rule["rule_type"].alias("rule_type"),
                v["passed"].alias("passed"), v["message"].alias("message"), v["details"].alias("details"),
            ),
        )

    verdicts = let(validation_inputs(), lambda fields: F.transform("rules", lambda rule: entry(fields, rule)))
    return computed_once(with_rules(documents, rules), "verdicts", verdicts).drop("rules")


def validate_documents(documents: DataFrame, rules: DataFrame, custom: CustomRule | None = None) -> DataFrame:
    """document_id, document_number, passed, rules_evaluated, rules_failed, failed_rules, warnings.

    Only failures of blocking rules reject a document; all other failures are warnings.
    """
    failed = F.filter("verdicts", lambda v: ~v["passed"] & (v["rule_type"] == BLOCKING))
    warned = F.filter("verdicts", lambda v: ~v["passed"] & (v["rule_type"] != BLOCKING))
    return (
        judged(documents, rules, custom)
        .select(
            F.col("id").alias("document_id"), "document_number",
            F.size("verdicts").alias("rules_evaluated"), failed.alias("failed_rules"), warned.alias("warnings"),
        )
        .withColumn("rules_failed", F.size("failed_rules"))
        .withColumn("passed", F.col("rules_failed") == 0)
    )


def rejection_notes(validated: DataFrame, now: Column) -> DataFrame:
    """document_id, note, note_json for the rejected documents. Comments are numbered, failures before warnings."""

    def comment(prefix: str, offset: Column | int):
        def build(v: Column, i: Column) -> Column:
            return F.struct(
                (i + 1 + offset).alias("seq"),
                F.concat(F.lit(prefix), v["rule_name"], F.lit("] "), v["message"]).alias("client_comment"),
                F.lit(None).cast("string").alias("contractor_response"),
                v["rule_type"].alias("rule_type"),
                v["details"].alias("details"),
            )

        return build

    failures = F.transform("failed_rules", comment("[", 0))
    warnings = F.transform("warnings", comment("[WARNING - ", F.size("failed_rules")))
    note = F.struct(
        "document_number",
        now.alias("rejection_date"),
        F.lit("REJECTED").alias("status"),
        F.struct(
            F.size("failed_rules").alias("total_issues"),
            F.size("warnings").alias("total_warnings"),
            F.size("failed_rules").alias("blocking_failures"),
        ).alias("summary"),
        F.concat(failures, warnings).alias("comments_response"),
        F.lit("numbered_client_comment_contractor_response").alias("format"),
    )
    return (
        validated.where(~F.col("passed"))
        .select("document_id", note.alias("note"))
        .withColumn("note_json", F.to_json("note", {"ignoreNullFields": "false"}))
    )


def render_rejection(note: Column) -> Column:
    """Plain-text report of a note."""
    double, single = F.lit("=" * 80), F.lit("-" * 80)
    number = note["document_number"]
    head = F.array(double, F.lit("DOCUMENT VALIDATION REJECTION"), double, F.lit(""))
    named = F.when(_present(number), F.array(F.concat(F.lit("Document: "), number))).otherwise(
        F.array().cast("array<string>")
    )
    facts = F.array(
        F.concat(F.lit("Date: "), note["rejection_date"]),
        F.concat(F.lit("Status: "), note["status"]),
        F.lit(""),
        F.lit("SUMMARY:"),
        F.concat(F.lit("  - Blocking failures: "), note["summary"]["blocking_failures"].cast("string")),
        F.concat(F.lit("  - Warnings: "), note["summary"]["total_warnings"].cast("string")),
        F.lit(""),
        single,
        F.lit("CLIENT COMMENT / CONTRACTOR RESPONSE TABLE"),
        single,
        F.lit(""),
    )

    def lines(c: Column) -> Column:
        response = F.coalesce(F.nullif(c["contractor_response"], F.lit("")), F.lit("[Awaiting response]"))
        return F.array(
            F.concat(c["seq"].cast("string"), F.lit(". ["), F.upper(c["rule_type"]), F.lit("] "), c["client_comment"]),
            F.concat(F.lit("   Contractor Response: "), response),
            F.lit(""),
        )

    table = F.flatten(F.transform(note["comments_response"], lines))
    return F.array_join(F.concat(head, named, facts, table, F.array(double)), "\n")


def apply_decision(documents: DataFrame, validated: DataFrame) -> DataFrame:
    """Documents that were validated become Approved or Rejected; the others keep their status."""
    outcome = validated.select(F.col("document_id").alias("id"), "passed")
    decided = F.when(F.col("passed"), APPROVED).when(~F.col("passed"), REJECTED).otherwise(F.col("status"))
    return documents.join(outcome, "id", "left").withColumn("status", decided).drop("passed")


def rule_failure_report(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """Per rule: documents evaluated and failed. Grouped by rule with partial counts before the shuffle."""
    return (
        judged(documents, rules)
        .select(F.inline("verdicts"))
        .groupBy("rule_id", "rule_name", "rule_type")
        .agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(~F.col("passed")).alias("failed"))
    )
