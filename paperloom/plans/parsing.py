"""Queries on field extraction and on merging recorded model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import fields as X
from paperloom.functions.scale import spread
from paperloom.operators import enrichment as E
from paperloom.operators import parsing as P
from paperloom.plans.registry import query, shared_sql
from paperloom.session import new_folder, stored
from paperloom.sources import tables
from paperloom.sources.views import Source

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def drawings(src: Source):
    return spread(src.drawing_texts.select(F.col("id").alias("document_id"), "text"), "document_id")


shared_sql("texts_of_drawings", "SELECT id AS document_id, text FROM drawing_texts")

# One SQL expression per scalar field, on the column ``text``.
_NUMBER = r"[A-Z]{2,4}-[A-Z]-[A-Z]{2}-\d{2}-\d{3}"


def _title_sql(pattern: str) -> str:
    return (
        rf"nullif(regexp_replace(trim(regexp_extract(text, '(?i){pattern}', 1), {_BLANKS}), '\s+', ' ', 'g'), '')"
    )


def _status_sql() -> str:
    ticked = " ".join(
        rf"WHEN regexp_matches(upper(text), '(?:\[X\]|☑|✓|✔)\s*{label.upper()}') THEN '{code}'"
        for label, code in X.ISSUE_LABELS
    )
    named = " ".join(f"WHEN contains(upper(text), '{label.upper()}') THEN '{code}'" for label, code in X.ISSUE_LABELS)
    return f"CASE {ticked} {named} END"


SCALAR_SQL = {
    "document_number": f"nullif(regexp_extract(text, '{_NUMBER}'), '')",
    "title": "coalesce("
    + ", ".join(
        f"CASE WHEN length({_title_sql(p)}) > 5 THEN {_title_sql(p)} END"
        for p in (r"Title[:\s]+(.+)", r"Document Title[:\s]+(.+)", r"Drawing Title[:\s]+(.+)")
    )
    + rf", list_filter(list_transform(string_split(regexp_extract(text, '(?s){_NUMBER}(.*)', 1), chr(10)), "
    + rf"lambda l: trim(l, {_BLANKS})), lambda l: length(l) > 5 AND NOT regexp_full_match(l, '[A-Z0-9\-]+'))[1])",
    "revision": r"nullif(upper(regexp_extract(text, '(?i)Rev(?:ision)?\.?\s*([A-Z0-9]+)', 1)), '')",
    "issue_status": _status_sql(),
    "contract_number": r"nullif(regexp_extract(text, '(?i)(?:Contract|CTR|Agreement)[\s#:]+([A-Z0-9\-]+)', 1), '')",
    "page_count": r"coalesce(try_cast(nullif(regexp_extract(text, '(?i)(?:Page|Sheet)\s+(?:of|/)\s*(\d+)', 1), '') AS INT), "
    r"try_cast(nullif(regexp_extract(text, '(?i)(\d+)\s*(?:of|/)\s*(\d+)\s*(?:pages|sheets)', 2), '') AS INT))",
}

for _field, _expression in SCALAR_SQL.items():

    def _build(src: Source, field: str = _field):
        return src_texts(src).select("source", "document_id", getattr(X, f"extract_{field}")(F.col("text")).alias(field))

    query(
        f"extract_{_field}",
        f"SELECT source, document_id, {_expression} AS {_field} FROM field_texts",
    )(_build)

# Scalar fields are read from the drawing texts and from the corpus, where they occur by accident.
shared_sql(
    "field_texts",
    "SELECT 'drawing' AS source, id AS document_id, text FROM drawing_texts UNION ALL SELECT 'corpus', doc_id, text FROM documents",
)


def src_texts(src: Source):
    corpus = spread(src.documents.select(F.col("doc_id").alias("document_id"), "text"), "document_id")
    return drawings(src).select(F.lit("drawing").alias("source"), "document_id", "text").unionByName(
        corpus.select(F.lit("corpus").alias("source"), "document_id", "text")
    )


def _section(heading: str) -> str:
    return rf"regexp_extract(text, '(?si){heading}(.*?)(?:\n\n|\z)', 1)"


def _listed(expressions: str, inner: str, where: str = "true", order: str = "i") -> str:
    """Entries with their position among those that ``where`` keeps."""
    return f"""SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY {order}) - 1 AS INT) AS pos, {expressions}
FROM ({inner}) WHERE {where}"""


_HISTORY = _section(r"(?:Revision History|Rev(?:ision)? History|REVISION RECORD)")
shared_sql(
    "history_rows",
    _listed(
        rf"""regexp_extract(line, '^\s*([A-Z0-9]+)\s+\d{{2}}/\d{{2}}/\d{{2,4}}', 1) AS rev, w[2] AS date,
  CASE WHEN len(w) > 2 THEN array_to_string(list_slice(w, 3, len(w)), ' ') END AS description, trim(line, {_BLANKS}) AS raw""",
        rf"""SELECT document_id, line, i, string_split_regex(trim(line, {_BLANKS}), '\s+') AS w FROM (
  SELECT document_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT document_id, string_split({_HISTORY}, chr(10)) AS ls FROM texts_of_drawings))""",
        r"regexp_matches(line, '^\s*([A-Z0-9]+)\s+\d{2}/\d{2}/\d{2,4}')",
    ),
)
# RE2 has no look-ahead: the section is cut before every number that starts a line, then each piece is read alone.
_COMMENTS = _section("(?:Comments|COMMENTS|Comment/Response)")
_PIECE = r"(?s)^.*?(\d+)[\.\)]\s*(.*?)(?:\n|$)\s*(?:Response[:\s]+)?(.*)$"
shared_sql(
    "comment_rows",
    _listed(
        f"CAST(n AS INT) AS seq, c AS client_comment, r AS contractor_response",
        rf"""SELECT document_id, i, regexp_extract(p, '{_PIECE}', 1) AS n, trim(regexp_extract(p, '{_PIECE}', 2), {_BLANKS}) AS c,
  CASE WHEN regexp_extract(p, '{_PIECE}', 3) <> '' THEN trim(regexp_extract(p, '{_PIECE}', 3), {_BLANKS}) END AS r FROM (
  SELECT document_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
    SELECT document_id, string_split(regexp_replace({_COMMENTS}, '\n(\d+[\.\)])', chr(1) || '\1', 'g'), chr(1)) AS ps FROM texts_of_drawings)) WHERE regexp_matches(p, '{_PIECE}')""",
        "c <> ''",
    ),
)
_LEGEND = _section("(?:Legend|LEGEND|Symbol.*?Description)")
_LEGEND_LINE = r"(?m)^([A-Za-z0-9_\-]+)\s*[-–]\s*(.+)$"
shared_sql(
    "legend_rows",
    _listed(
        "symbol, description",
        rf"""SELECT document_id, unnest(a) AS symbol, trim(unnest(b), {_BLANKS}) AS description, generate_subscripts(a, 1) AS i FROM (
  SELECT document_id, regexp_extract_all({_LEGEND}, '{_LEGEND_LINE}', 1) AS a, regexp_extract_all({_LEGEND}, '{_LEGEND_LINE}', 2) AS b FROM texts_of_drawings)""",
        "length(symbol) > 1 AND description <> ''",
    ),
)
_EQUIPMENT = "(?i)" + X.EQUIPMENT.replace("'", "''")
shared_sql(
    "equipment_rows",
    _listed(
        "tag, rating, voltage, phase, frequency, power",
        "SELECT document_id, "
        + ", ".join(
            f"unnest({g}) AS {g}" if g == "tag" else f"nullif({'trim(' if g == 'rating' else ''}unnest({g}){')' if g == 'rating' else ''}, '') AS {g}"
            for g in ("tag", "rating", "voltage", "phase", "frequency", "power")
        )
        + ", generate_subscripts(tag, 1) AS i FROM (SELECT document_id, "
        + ", ".join(
            f"regexp_extract_all(text, '{_EQUIPMENT}', {n}) AS {g}"
            for n, g in enumerate(("tag", "rating", "voltage", "phase", "frequency", "power"), 1)
        )
        + " FROM texts_of_drawings)",
    ),
)
_INDEX = _section("(?:Drawing Index|DRAWING INDEX|Sheet Index|SHEET INDEX)")
_INDEX_LINE = r"(\d+(?:\.\d+)?)\s*[-–]\s*(.+?)(?:\n|$)"
shared_sql(
    "index_rows",
    _listed(
        "sheet_no, sheet_title",
        rf"""SELECT document_id, unnest(a) AS sheet_no, trim(unnest(b), {_BLANKS}) AS sheet_title, generate_subscripts(a, 1) AS i FROM (
  SELECT document_id, regexp_extract_all({_INDEX}, '{_INDEX_LINE}', 1) AS a, regexp_extract_all({_INDEX}, '{_INDEX_LINE}', 2) AS b FROM texts_of_drawings)""",
        "sheet_title <> ''",
    ),
)
_SIGNATURE = _section("(?:Signature|SIGNATURE|Approved by|PREPARED|CHECKED|APPROVED)")
shared_sql(
    "signature_rows",
    "SELECT document_id, "
    + ", ".join(
        rf"nullif(trim(regexp_extract({_SIGNATURE}, '(?i){label}[:\s]+(.+?)(?:\n|$)', 1), {_BLANKS}), '') AS {role}"
        for role, label in X.SIGNATURE_ROLES.items()
    )
    + " FROM texts_of_drawings",
)


def _entries(name: str, table: str, columns: str):
    extract = getattr(X, name)

    @query(name, f"SELECT document_id, pos, {columns} FROM {table}")
    def build(src: Source):
        rows = drawings(src).select("document_id", F.posexplode(extract(F.col("text"))).alias("pos", "e"))
        return rows.select("document_id", "pos", *[F.col(f"e.{c.strip()}") for c in columns.split(",")])

    return build


_entries("extract_revision_history", "history_rows", "rev, date, description, raw")
_entries("extract_comments", "comment_rows", "seq, client_comment, contractor_response")
_entries("extract_legend_symbols", "legend_rows", "symbol, description")
_entries("extract_equipment_ratings", "equipment_rows", "tag, rating, voltage, phase, frequency, power")
_entries("extract_drawing_index", "index_rows", "sheet_no, sheet_title")


@query("extract_signature_block", "SELECT * FROM signature_rows")
def extract_signature_block(src: Source):
    return drawings(src).select("document_id", X.extract_signature_block(F.col("text")).alias("s")).select(
        "document_id", "s.*"
    )


@query(
    "extract_page_numbers",
    r"""SELECT document_id, n FROM (SELECT document_id, CAST(unnest(regexp_extract_all(text, '(?i)\[Page\s+(\d+)\]', 1)) AS INT) AS n FROM (
  SELECT document_id, string_agg('[Page ' || page || '] ' || text, chr(10)) AS text FROM ocr_blocks GROUP BY document_id))""",
)
def extract_page_numbers(src: Source):
    # every block with the marker of its page in front
    marked = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("] "), "text")
    texts = src.ocr_blocks.groupBy("document_id").agg(F.array_join(F.collect_list(marked), "\n").alias("text"))
    return texts.select("document_id", F.explode(X.extract_page_numbers(F.col("text"))).alias("n"))


_COUNTS = """(SELECT count(*) FROM history_rows x WHERE x.document_id = s.document_id) AS n_revisions,
  (SELECT count(*) FROM comment_rows x WHERE x.document_id = s.document_id) AS n_comments,
  (SELECT count(*) FROM legend_rows x WHERE x.document_id = s.document_id) AS n_symbols,
  (SELECT count(*) FROM equipment_rows x WHERE x.document_id = s.document_id) AS n_equipment,
  (SELECT count(*) FROM index_rows x WHERE x.document_id = s.document_id) AS n_index"""
shared_sql(
    "parsed",
    "SELECT s.*, g.prepared_by, g.checked_by, g.approved_by, "
    + _COUNTS
    + " FROM (SELECT document_id, length(text) AS text_length, "
    + ", ".join(f"{sql} AS {name}" for name, sql in SCALAR_SQL.items())
    + " FROM texts_of_drawings) s JOIN signature_rows g ON g.document_id = s.document_id",
)
_FIELDS_SQL = (
    "CAST("
    + " + ".join(f"CAST(coalesce({c}, '') <> '' AS INT)" for c in X.SCALAR_FIELDS if c != "page_count")
    + " + CAST(coalesce(page_count, 0) <> 0 AS INT) + n_revisions + n_comments + n_symbols + n_equipment + n_index"
    + " + CAST(prepared_by IS NOT NULL AS INT) + CAST(checked_by IS NOT NULL AS INT) + CAST(approved_by IS NOT NULL AS INT) AS INT)"
)


@query("count_extracted_fields", f"SELECT document_id, CAST(text_length AS INT) AS text_length, {_FIELDS_SQL} AS fields_extracted FROM parsed")
def count_extracted_fields(src: Source):
    return P.parse_documents(drawings(src)).select("document_id", "text_length", "fields_extracted")


@query(
    "parse_documents",
    f"""SELECT document_id, document_number, title, revision, issue_status, contract_number, page_count, n_revisions, n_comments, n_symbols, n_equipment, n_index,
  prepared_by, checked_by, approved_by, {_FIELDS_SQL} AS fields_extracted FROM parsed""",
)
def parse_documents(src: Source):
    names = ["n_revisions", "n_comments", "n_symbols", "n_equipment", "n_index"]
    sizes = [F.size(c).cast("long").alias(n) for c, n in zip(X.LIST_FIELDS, names)]
    return P.parse_documents(drawings(src)).select(
        "document_id", *X.SCALAR_FIELDS, *sizes, "signature_block.*", "fields_extracted"
    )


@query(
    "explode_children",
    """SELECT 'revision_history' AS table_name, document_id, pos + 1 AS seq, rev AS key, description AS value FROM history_rows
UNION ALL SELECT 'comments_response', document_id, pos + 1, client_comment, contractor_response FROM comment_rows
UNION ALL SELECT 'legend_symbols', document_id, pos + 1, symbol, description FROM legend_rows
UNION ALL SELECT 'equipment_ratings', document_id, pos + 1, tag, rating FROM equipment_rows
UNION ALL SELECT 'drawing_index', document_id, pos + 1, sheet_no, sheet_title FROM index_rows""",
)
def explode_children(src: Source):
    # parsed once and kept: five tables are made of it
    children = P.explode_children(stored(P.parse_documents(drawings(src)), "parsed"))
    columns = {
        "revision_history": ("rev", "description"), "comments_response": ("client_comment", "contractor_response"),
        "legend_symbols": ("symbol", "description"), "equipment_ratings": ("tag", "rating"),
        "drawing_index": ("sheet_no", "sheet_title"),
    }
    parts = [
        children[t].select(F.lit(t).alias("table_name"), "document_id", "seq", F.col(k).alias("key"), F.col(v).alias("value"))
        for t, (k, v) in columns.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "write_child_tables",
    """SELECT 'revision_history' AS table_name, count(*) AS n FROM history_rows
UNION ALL SELECT 'comments_response', count(*) FROM comment_rows
UNION ALL SELECT 'legend_symbols', count(*) FROM legend_rows
UNION ALL SELECT 'equipment_ratings', count(*) FROM equipment_rows
UNION ALL SELECT 'drawing_index', count(*) FROM index_rows""",
)
def write_child_tables(src: Source):
    root = new_folder(src.spark, "tables")
    children = P.explode_children(stored(P.parse_documents(drawings(src)), "parsed"))
    tables.write_tables(children, root)
    return tables.table_counts({name: tables.read_table(src.spark, root, name) for name in children})


# Merging of model responses


def _json_sql(source: str) -> str:
    return f"""SELECT id, CASE WHEN NOT json_valid(body) THEN 'response is not valid JSON' WHEN body NOT LIKE '{{%' THEN 'response is not a JSON object' END AS error,
  CASE WHEN json_valid(body) AND body LIKE '{{%' THEN body END AS body FROM (
  SELECT id, CASE WHEN response LIKE '```%' THEN array_to_string(list_slice(string_split(response, chr(10)), 2, len(string_split(response, chr(10))) - 1), chr(10)) ELSE response END AS body FROM {source})"""


shared_sql("results", _json_sql("llm_responses"))
shared_sql("fallback_results", _json_sql("fallback_responses"))
shared_sql(
    "result_items",
    " UNION ALL ".join(
        f"SELECT id, '{f}' AS field, CAST(i - 1 AS INT) AS pos, item FROM (SELECT id, unnest(l) AS item, generate_subscripts(l, 1) AS i "
        f"FROM (SELECT id, CAST(json_extract(body, '$.{f}') AS JSON[]) AS l FROM results WHERE body IS NOT NULL))"
        for f in E.RESULT_FIELDS
    ),
)
shared_sql(
    "additions",
    """SELECT t.id AS document_id, count(*) FILTER (i.field = 'general_notes') AS notes,
  count(*) FILTER (i.field = 'equipment_details' AND NOT EXISTS (SELECT 1 FROM equipment_rows e WHERE e.document_id = t.id AND e.tag = i.item->>'$.tag')) AS equipment,
  count(*) FILTER (i.field = 'legend_descriptions' AND NOT EXISTS (SELECT 1 FROM legend_rows e WHERE e.document_id = t.id AND e.symbol = i.item->>'$.symbol')) AS symbols,
  count(*) FILTER (i.field = 'complex_comments' AND NOT EXISTS (SELECT 1 FROM comment_rows e WHERE e.document_id = t.id)) AS comments,
  count(*) FILTER (i.field = 'specifications') AS specifications
FROM drawing_texts t LEFT JOIN result_items i ON i.id = t.id GROUP BY t.id""",
)


def results(src: Source):
    return E.parse_extraction_json(src.llm_responses)


@query(
    "extraction_prompts",
    f"""SELECT id, CAST(part AS INT) AS part, '{E.EXTRACTION_PROMPT[0]}' || substr(text, part * 8000 + 1, 8000) || '{E.EXTRACTION_PROMPT[1]}' AS prompt
FROM (SELECT doc_id AS id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 8000) AS BIGINT), 1))) AS part FROM documents)""",
)
def extraction_prompts(src: Source):
    return E.extraction_prompts(src.documents.withColumnRenamed("doc_id", "id"))


@query(
    "parse_extraction_json",
    """SELECT r.id, r.error, (SELECT string_agg(i.item->>'$', ',' ORDER BY pos) FROM result_items i WHERE i.id = r.id AND field = 'general_notes') AS notes,
  (SELECT string_agg(i.item->>'$.tag', ',' ORDER BY pos) FROM result_items i WHERE i.id = r.id AND field = 'equipment_details') AS tags FROM results r""",
)
def parse_extraction_json(src: Source):
    return results(src).select(
        "id", "error", F.array_join("result.general_notes", ",").alias("notes"),
        F.array_join(F.transform("result.equipment_details", lambda e: e["tag"]), ",").alias("tags"),
    )


@query(
    "merge_extractions",
    """SELECT p.document_id, p.document_number, p.n_equipment + a.equipment AS n_equipment, p.n_symbols + a.symbols AS n_symbols, p.n_comments + a.comments AS n_comments,
  CASE WHEN r.body IS NULL THEN 'deterministic' ELSE 'deterministic+llm' END AS parser,
  (SELECT string_agg(i.item->>'$', ',' ORDER BY pos) FROM result_items i WHERE i.id = p.document_id AND field = 'general_notes') AS notes,
  (SELECT string_agg(i.item->>'$.tag', ',' ORDER BY pos) FROM result_items i WHERE i.id = p.document_id AND field = 'equipment_details' AND i.item->>'$.tag' LIKE 'TRF%') AS new_tags
FROM parsed p JOIN additions a ON a.document_id = p.document_id LEFT JOIN results r ON r.id = p.document_id""",
)
def merge_extractions(src: Source):
    merged = E.merge_extractions(P.parse_documents(drawings(src)), results(src))
    tags = F.transform("equipment_ratings", lambda e: e["tag"])
    new_tags = F.filter(tags, lambda t: t.startswith("TRF"))
    return merged.select(
        "document_id", "document_number",
        *[F.size(c).cast("long").alias(n) for c, n in
          (("equipment_ratings", "n_equipment"), ("legend_symbols", "n_symbols"), ("comments", "n_comments"))],
        "parser", F.array_join("general_notes", ",").alias("notes"),
        F.when(F.size(new_tags) > 0, F.array_join(new_tags, ",")).alias("new_tags"),
    )


@query(
    "count_llm_additions",
    "SELECT document_id, CAST(notes + equipment + symbols + comments + specifications AS INT) AS llm_fields_added FROM additions",
)
def count_llm_additions(src: Source):
    return E.count_llm_additions(P.parse_documents(drawings(src)), results(src))


@query("project_extractions", "SELECT id, field, pos, CASE WHEN field IN ('general_notes', 'specifications') THEN item->>'$' ELSE CAST(item AS VARCHAR) END AS item FROM result_items")
def project_extractions(src: Source):
    parts = []
    for field in E.RESULT_FIELDS:
        items = E.project_extractions(results(src), field)
        text = F.col("item") if field in ("general_notes", "specifications") else F.to_json("item")
        parts.append(items.select("id", F.lit(field).alias("field"), "pos", text.alias("item")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


@query(
    "degrade_without_llm",
    """SELECT p.document_id, p.document_number, CASE WHEN r.body IS NOT NULL THEN 'primary' WHEN f.body IS NOT NULL THEN 'fallback' END AS source,
  CASE WHEN r.body IS NULL AND f.body IS NULL THEN coalesce(f.error, r.error) END AS llm_error,
  CAST(coalesce(json_array_length(coalesce(r.body, f.body), '$.general_notes'), 0) AS INT) AS n_notes
FROM parsed p LEFT JOIN results r ON r.id = p.document_id LEFT JOIN fallback_results f ON f.id = p.document_id""",
)
def degrade_without_llm(src: Source):
    degraded = E.degrade_without_llm(
        P.parse_documents(drawings(src)), results(src), E.parse_extraction_json(src.fallback_responses)
    )
    return degraded.select(
        "document_id", "document_number", "source", "llm_error",
        F.coalesce(F.size("result.general_notes"), F.lit(0)).alias("n_notes"),
    )
