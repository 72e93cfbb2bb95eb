"""Merging of recorded model responses into parsed documents. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import strip

RESULT_SCHEMA = (
    "general_notes array<string>, "
    "equipment_details array<struct<tag:string,description:string,rating:string,voltage:string,phase:string,"
    "frequency:string,power:string>>, "
    "legend_descriptions array<struct<symbol:string,description:string>>, "
    "complex_comments array<struct<comment:string,response:string>>, "
    "specifications array<string>"
)
RESULT_FIELDS = [
    "general_notes", "equipment_details", "legend_descriptions", "complex_comments", "specifications",
]
EXTRACTION_PROMPT = (
    "Read the engineering document below and answer with one JSON object and nothing else. "
    "Its keys are general_notes, equipment_details, legend_descriptions, complex_comments and specifications; "
    "each holds an array, empty if the document has nothing of the kind.\n\nDocument:\n",
    "\n\nJSON:",
)


def extraction_prompts(docs: DataFrame, max_chars: int = 8000) -> DataFrame:
    """id, part, prompt. A text longer than ``max_chars`` is asked about in as many prompts as it takes."""
    before, after = EXTRACTION_PROMPT
    last = F.greatest(F.ceil(F.length("text") / max_chars), F.lit(1)).cast("int") - 1
    parts = docs.select("id", "text", F.explode(F.sequence(F.lit(0), F.coalesce(last, F.lit(0)))).alias("part"))
    piece = F.substring(F.col("text"), F.col("part") * max_chars + 1, F.lit(max_chars))
    return parts.select("id", "part", F.concat(F.lit(before), piece, F.lit(after)).alias("prompt"))


def _unfenced(response: Column) -> Column:
    """Without the first and last line if the response is fenced as a code block."""
    text = strip(response)
    lines = F.split(text, "\n")
    inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(text.startswith("```"), inner).otherwise(text)


def parse_extraction_json(responses: DataFrame) -> DataFrame:
    """id, response -> id, result (null on error), error."""
    cleaned = responses.select("id", _unfenced(F.col("response")).alias("body"))
    valid = F.try_parse_json("body").isNotNull()
    is_object = F.ltrim("body").startswith("{")
    error = F.when(~valid | F.col("body").isNull(), "response is not valid JSON").when(
        ~is_object, "response is not a JSON object"
    )
    return cleaned.select("id", error.alias("error"), "body").select(
        "id", F.when(F.col("error").isNull(), F.from_json("body", RESULT_SCHEMA)).alias("result"), "error"
    )


def _new_items(found: Column, known: Column, key: str) -> Column:
    """Items of the model whose key the parser has not found; repeats within the model's list are all kept."""
    keys = F.transform(known, lambda k: k[key])
    return F.filter(
        F.coalesce(found, F.array()), lambda x: (x[key] != "") & ~F.coalesce(F.array_contains(keys, x[key]), F.lit(False))
    )


def _new_equipment() -> Column:
    return _new_items(F.col("result.equipment_details"), F.col("equipment_ratings"), "tag")


def _new_symbols() -> Column:
    return _new_items(F.col("result.legend_descriptions"), F.col("legend_symbols"), "symbol")


def _size(column: str | Column) -> Column:
    return F.coalesce(F.size(column), F.lit(0))


def merge_extractions(parsed: DataFrame, results: DataFrame) -> DataFrame:
    """Parsed documents with what the model adds. Scalars and everything the parser found stay as they are."""
    wanted = ["tag", "rating", "voltage", "phase", "frequency", "power"]
    equipment = F.transform(_new_equipment(), lambda x: F.struct(*[x[c].alias(c) for c in wanted]))
    comments = F.transform(
        "result.complex_comments",
        lambda c, i: F.struct(
            (i + 1).alias("seq"), c["comment"].alias("client_comment"), c["response"].alias("contractor_response")
        ),
    )
    has_result = F.col("result").isNotNull()
    joined = with_additions(parsed, results)
    return joined.withColumns(
        {
            "equipment_ratings": F.when(has_result, F.concat("equipment_ratings", equipment)).otherwise(
                F.col("equipment_ratings")
            ),
            "legend_symbols": F.when(has_result, F.concat("legend_symbols", _new_symbols())).otherwise(
                F.col("legend_symbols")
            ),
            "comments": F.when((F.size("comments") == 0) & (_size("result.complex_comments") > 0), comments).otherwise(
                F.col("comments")
            ),
            "general_notes": F.col("result.general_notes"),
            "specifications": F.col("result.specifications"),
            "parser": F.when(has_result, "deterministic+llm").otherwise("deterministic"),
        }
    ).drop("result", "error")


def with_additions(parsed: DataFrame, results: DataFrame) -> DataFrame:
    """Parsed documents with result, error and llm_fields_added, counted against the state before the merge."""
    joined = parsed.join(results.withColumnRenamed("id", "document_id"), "document_id", "left")
    added = (
        _size("result.general_notes")
        + _size(_new_equipment())
        + _size(_new_symbols())
        + F.when(F.size("comments") == 0, _size("result.complex_comments")).otherwise(0)
        + _size("result.specifications")
    )
    return joined.withColumn("llm_fields_added", F.when(F.col("result").isNotNull(), added).otherwise(0))


def count_llm_additions(parsed: DataFrame, results: DataFrame) -> DataFrame:
    return with_additions(parsed, results).select("document_id", "llm_fields_added")


def project_extractions(results: DataFrame, field: str) -> DataFrame:
    """id, pos, item for one field of the results; a missing field has no items."""
    return results.select("id", F.posexplode(F.coalesce(F.col(f"result.{field}"), F.array())).alias("pos", "item"))


def degrade_without_llm(parsed: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Parsed documents with the first usable result; llm_error says why there is none.

    ``primary`` and ``fallback`` come from ``parse_extraction_json``.
    """
    first = primary.select(F.col("id").alias("document_id"), F.col("result").alias("r1"), F.col("error").alias("e1"))
    second = fallback.select(F.col("id").alias("document_id"), F.col("result").alias("r2"), F.col("error").alias("e2"))
    joined = parsed.join(first, "document_id", "left").join(second, "document_id", "left")
    failed = F.col("r1").isNull() & F.col("r2").isNull()
    return (
        joined.withColumn("result", F.coalesce("r1", "r2"))
        .withColumn(
            "source", F.when(F.col("r1").isNotNull(), "primary").when(F.col("r2").isNotNull(), "fallback")
        )
        .withColumn("llm_error", F.when(failed, F.coalesce("e2", "e1", F.lit("no response"))))
        .drop("r1", "r2", "e1", "e2")
    )
