"""Data side of question answering: contexts, recorded answers, citations and the log. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.constants import CITATION_LIMIT, NO_CONTEXT_ANSWER
from paperloom.functions.fields import CITATION, all_groups, extract_page_numbers
from paperloom.functions.scale import broadcast_if_small
from paperloom.functions.text import let, strip

PROMPT = (
    "Answer the question from the context below and from nothing else. Cite each source as NUMBER · Sheet n or "
    "NUMBER · Page n. Reply in three lines that start with ANSWER:, CONFIDENCE: (High, Medium or Low) and CITATIONS:.\n\n"
    "Context:\n",
    "\n\nQuestion: ",
    "\n\nANSWER:",
)


def context_chunks(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their text and document, numbered in reading order: query_id, n, chunk_id, document_number, title, page, content.

    The page is that of the chunk table, if it has one (``chunk_corpus(pages=True)``), otherwise the first marker of the chunk.
    """
    marker = F.get(extract_page_numbers(F.col("content")), F.lit(0))
    page = (F.col("page") if "page" in chunks.columns else marker).alias("page")
    wanted = broadcast_if_small(hits.select("query_id", "chunk_id", "rank", "place"))
    fields = documents.select(F.col("id").alias("document_id"), "document_number", "title")
    found = chunks.select("chunk_id", "document_id", page, "content").join(wanted, "chunk_id").join(fields, "document_id")
    order = Window.partitionBy("query_id").orderBy("rank", "place")
    return found.select(
        "query_id",
        F.row_number().over(order).alias("n"),
        "chunk_id",
        "document_number",
        "title",
        "page",
        "content",
    )


def assemble_context(context: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, context, prompt, n_chunks. A query has a handful of chunks, so they meet in one row."""
    page = F.coalesce(F.col("page").cast("string"), F.lit("N/A"))
    part = F.concat(
        F.lit("["), F.col("n").cast("string"), F.lit("] Document: "), F.coalesce("document_number", F.lit("Unknown")),
        F.lit(" - "), F.coalesce("title", F.lit("Unknown")), F.lit(" (Page/Sheet: "), page, F.lit(")\n"), "content",
        F.lit("\n"),
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("part")))), lambda p: p["part"])
    joined = context.groupBy("query_id").agg(
        F.array_join(parts, "\n").alias("context"), F.count(F.lit(1)).cast("int").alias("n_chunks")
    )
    before, middle, after = PROMPT
    prompt = F.concat(F.lit(before), "context", F.lit(middle), "query", F.lit(after))
    return joined.join(queries.select("query_id", "query"), "query_id").select(
        "query_id", "context", prompt.alias("prompt"), "n_chunks"
    )


def parse_answers(responses: DataFrame) -> DataFrame:
    """query_id, answer, confidence, citations_text from answers in labelled lines; a later line overrules.

    Without a labelled answer the whole response is the answer; an unknown confidence counts as Medium.
    """

    def labelled(lines: Column, label: str) -> Column:
        return F.transform(
            F.filter(lines, lambda line: line.startswith(label)), lambda line: strip(F.replace(line, F.lit(label), F.lit("")))
        )

    def last(values: Column) -> Column:
        return F.try_element_at(values, F.lit(-1))

    def parts(lines: Column) -> Column:
        levels = F.filter(
            F.transform(labelled(lines, "CONFIDENCE:"), F.initcap), lambda c: c.isin("High", "Medium", "Low")
        )
        return F.struct(
            last(labelled(lines, "ANSWER:")).alias("answer"),
            F.coalesce(last(levels), F.lit("Medium")).alias("confidence"),
            last(labelled(lines, "CITATIONS:")).alias("citations_text"),
        )

    whole = strip(F.col("response"))
    lines = F.transform(F.split(whole, "\n"), strip)
    return responses.select("query_id", whole.alias("whole"), let(lines, parts).alias("p")).select(
        "query_id",
        F.coalesce(F.nullif("p.answer", F.lit("")), "whole").alias("answer"),
        "p.confidence",
        "p.citations_text",
    )


def parse_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """query_id, seq, document_number, title, page_or_sheet of the citations that name a document of the context."""
    text = F.col("citations_text")
    label = F.when(F.lower(text).contains("sheet"), "Sheet ").otherwise("Page ")
    pairs = F.arrays_zip(
        all_groups(text, CITATION, "dUi", 1).alias("number"), all_groups(text, CITATION, "dUi", 2).alias("page")
    )
    cited = answers.select("query_id", label.alias("label"), F.posexplode(pairs).alias("seq", "c")).select(
        "query_id", "seq", F.col("c.number").alias("document_number"), F.concat("label", "c.page").alias("page_or_sheet")
    )
    titles = context.groupBy("query_id", "document_number").agg(F.min_by("title", "n").alias("title"))
    return cited.join(titles, ["query_id", "document_number"]).select(
        "query_id", "seq", "document_number", F.coalesce("title", F.lit("Unknown")).alias("title"), "page_or_sheet"
    )


def context_citations(context: DataFrame, limit: int = CITATION_LIMIT) -> DataFrame:
    """The documents of the context in order of first appearance: same columns as ``parse_citations``."""
    numbered = context.where(F.col("document_number") != "")
    first = numbered.groupBy("query_id", "document_number").agg(
        F.min("n").alias("n"), F.min_by(F.struct("title", "page"), "n").alias("first")
    )
    order = Window.partitionBy("query_id").orderBy("n")
    page = F.col("first.page").cast("string")
    return (
        first.withColumn("seq", F.row_number().over(order) - 1)
        .where(F.col("seq") < limit)
        .select(
            "query_id",
            "seq",
            "document_number",
            F.coalesce("first.title", F.lit("Unknown")).alias("title"),
            F.coalesce(F.concat(F.lit("Sheet "), page), F.lit("N/A")).alias("page_or_sheet"),
        )
    )


def final_citations(explicit: DataFrame, from_context: DataFrame, answered: DataFrame) -> DataFrame:
    """The citations of an answer, or those of its context if it gives none."""
    without = answered.select("query_id").join(explicit.select("query_id").distinct(), "query_id", "left_anti")
    return explicit.unionByName(from_context.join(without, "query_id", "left_semi"))


def unanswerable_queries(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Fixed answers for the queries that have no context."""
    return queries.select("query_id").join(hits.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id",
        F.lit(NO_CONTEXT_ANSWER).alias("answer"),
        F.lit("Low").alias("confidence"),
        F.lit(0).alias("context_chunks_used"),
    )


def qa_log(
    queries: DataFrame, answers: DataFrame, citations: DataFrame, context: DataFrame, now: Column, model_version: str
) -> DataFrame:
    """One log row per answered query with the cited documents and retrieved chunks in order."""

    def listed(df: DataFrame, order: str, column: str, name: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct(order, column)))
        return df.groupBy("query_id").agg(F.transform(entries, lambda e: e[column]).alias(name))

    cited = listed(citations, "seq", "document_number", "cited_document_ids")
    retrieved = listed(context, "n", "chunk_id", "retrieved_chunk_ids")
    none = F.array().cast("array<string>")
    return (
        queries.select("query_id", F.col("query").alias("query_text"))
        .join(answers.select("query_id", "answer", F.col("confidence").alias("confidence_level")), "query_id")
        .join(cited, "query_id", "left")
        .join(retrieved, "query_id", "left")
        .withColumn("cited_document_ids", F.coalesce("cited_document_ids", none))
        .withColumns({"model_version": F.lit(model_version), "created_at": now})
    )
