"""Registered queries of the training-data operators, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import (
    apportionment,
    chunk_recipes,
    conversation_repair,
    decontamination,
    divergence,
    license_scan,
    packing,
    quality_gam,
    simhash_bytes,
    suffix_dedup,
    token_rollup,
    url_rules,
    warc_revisits,
)
from paperloom.session import new_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKING_SQL: dict[str, str] = {}

Build = Callable[[SparkSession, str], DataFrame]


def register(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        QUERIES[name] = build
        if sql:
            CHECKING_SQL[name] = sql.strip()
        return build

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


# Verdict, host and path of the stated rules.
STATED_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@register("op1_url_rules")
def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The label of a page is that of the document with its number: block if it is bad or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), F.when(bad, url_rules.BLOCK).when(bad.isNotNull(), url_rules.ALLOW).alias("label")
    )
    return url_rules.judge_urls(table(spark, folder, "pages"), labels, STATED_RULES)


@register(
    "op2_decontaminate",
    f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS.format("text")} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
places AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)
),
found AS (SELECT r, i, n, item_id FROM places JOIN phrases USING (n, p)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""",
)
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op4_prefix_free_dedup")
def op4_prefix_free_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, folder, "documents"))


@register("op5_quality_gam")
def op5_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    return quality_gam.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op6_pack_mixture")
def op6_pack_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


@register(
    "op8_chunk_recipes",
    f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {LOWER.format("text")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r) = 1 AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
""",
)
def op8_chunk_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_recipes.exact_duplicates(table(spark, folder, "documents"))


@register("op10_simhash_bytes")
def op10_simhash_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_bytes.near_duplicates(table(spark, folder, "documents"))


def archive_records(pages: DataFrame) -> DataFrame:
    """A full response and a revisit for each page, with matching, weak, missing or other validators and some revisits too early."""
    kind = F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("long") % 5
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    at = F.col("page_id") * 60
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    full = F.array(
        pair("Content-Type", F.lit("text/html")), pair("Content-Length", F.length("html").cast("string")), pair("ETag", tag),
        pair("Last-Modified", date), pair("Cache-Control", F.lit("max-age=60")),
    )
    own = F.array(pair("Date", at.cast("string")), pair("Content-Length", F.lit("0")), pair("cache-control", F.lit("no-cache")))
    validators = (
        F.when(kind == 0, F.array(pair("etag", tag)))
        .when(kind == 1, F.array(pair("ETag", F.concat(F.lit("W/"), tag))))
        .when(kind == 2, F.array(pair("Last-Modified", date)))
        .when(kind == 3, F.array(pair("ETag", F.lit('"other"'))))
        .otherwise(F.array().cast(warc_revisits.HEADERS))
    )
    both = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.col("url").alias("url"), at.alias("ts"), F.lit("response").alias("type"), full.alias("headers")),
        F.struct(
            (F.col("page_id") * 2 + 1).alias("record_id"),
            F.concat("url", F.lit("#again")).alias("url"),
            F.when(kind == 4, at - 86_400).otherwise(at + 200_000).alias("ts"),
            F.lit("revisit").alias("type"),
            F.concat(own, validators).alias("headers"),
        ),
    )
    return pages.select(F.explode(both).alias("r")).select("r.*")


@register(
    "op3_warc_revisits",
    r"""
WITH p AS (
  SELECT page_id, url, length(html) AS size, '"' || left(md5(html), 16) || '"' AS tag, 'day ' || CAST(page_id % 365 AS VARCHAR) AS date,
    (CAST('0x' || left(md5(url), 4) AS INTEGER)) % 5 AS kind FROM pages
),
k AS (
  SELECT *, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest,
    translate(regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme FROM p
),
h AS (
  SELECT *, regexp_replace(translate(regexp_extract(rest, '^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(str_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query FROM k
),
c AS (
  SELECT *, regexp_replace(host, CASE WHEN scheme = 'https' THEN ':443$' ELSE ':80$' END, '') || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM h
),
revisit AS (SELECT page_id * 2 + 1 AS record_id, url_key, kind, tag, date, page_id * 60 AS spot, CASE WHEN kind = 4 THEN page_id * 60 - 86400 ELSE page_id * 60 + 200000 END AS ts FROM c),
response AS (SELECT page_id * 2 AS response_id, url_key, page_id * 60 AS ts, tag, date, size FROM c),
met AS (
  SELECT v.*, r.response_id, r.tag AS old_tag, r.date AS old_date, r.size,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.response_id DESC) AS n
  FROM revisit v LEFT JOIN response r ON v.url_key = r.url_key AND r.ts < v.ts
),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN kind IN (0, 1) THEN CASE WHEN tag = old_tag THEN 'resolved' ELSE 'mismatch' END
    WHEN kind = 2 THEN CASE WHEN date = old_date THEN 'resolved' ELSE 'mismatch' END WHEN kind = 3 THEN 'mismatch' ELSE 'unverified' END AS status
  FROM met WHERE n = 1
)
SELECT record_id, url_key, response_id, status, CASE WHEN status IN ('resolved', 'unverified') THEN
  'Content-Type: text/html' || chr(10) || 'Content-Length: ' || CAST(size AS VARCHAR)
  || CASE WHEN kind IN (0, 1) THEN '' ELSE chr(10) || 'ETag: ' || old_tag END
  || CASE WHEN kind = 2 THEN '' ELSE chr(10) || 'Last-Modified: ' || old_date END
  || chr(10) || 'Date: ' || CAST(spot AS VARCHAR) || chr(10) || 'cache-control: no-cache'
  || CASE kind WHEN 0 THEN chr(10) || 'etag: ' || tag WHEN 1 THEN chr(10) || 'ETag: W/' || tag WHEN 2 THEN chr(10) || 'Last-Modified: ' || date ELSE '' END END AS headers
FROM judged
""",
)
def op3_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = warc_revisits.resolve_revisits(archive_records(table(spark, folder, "pages")))
    return found.select(
        "record_id", "url_key", "response_id", "status",
        F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n").alias("headers"),
    )


TEMPLATES = ", ".join(f"({n}, '{label}', '{text}', {str(phrase).lower()}, {width})" for n, label, text, phrase, width in license_scan.templates())
GRAMS = f"""CASE width WHEN {license_scan.SHORT} THEN w[i] || ' ' || w[i + 1] ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END"""


@register(
    "op7_license_scan",
    f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents),
t AS (SELECT template, label, phrase, width, str_split(body, ' ') AS w FROM (VALUES {TEMPLATES}) AS v(template, label, body, phrase, width)),
known AS (SELECT template, label, phrase, len(w) - width + 1 AS pairs, i - 1 AS place, {GRAMS} AS pair FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM t)),
placed AS (
  SELECT r, i - 1 AS spot, {GRAMS} AS pair FROM (SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (VALUES ({license_scan.SHORT}), ({license_scan.LONG})) AS v(width))
),
votes AS (SELECT DISTINCT r, template, label, pairs, phrase, spot - place AS diagonal, place FROM placed JOIN known USING (pair)),
lines AS (SELECT DISTINCT r, template, phrase, diagonal FROM votes),
steps AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= CASE WHEN phrase THEN 0 ELSE {license_scan.NEIGHBOURS} END
    THEN 0 ELSE 1 END AS apart FROM lines
),
runs AS (SELECT r, template, diagonal, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM steps),
merged AS (
  SELECT r, template, label, phrase, pairs, run, count(DISTINCT place) AS seen, min(diagonal + place) AS first, max(diagonal + place) AS last
  FROM votes JOIN runs USING (r, template, diagonal) GROUP BY ALL
),
good AS (
  SELECT *, seen / pairs AS share FROM merged WHERE CASE WHEN phrase THEN seen = pairs
    ELSE seen / pairs >= {license_scan.COVERED} AND last - first + 1 <= {license_scan.STRETCH} * pairs END
),
found AS (
  SELECT r, count(*) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word, max(first) FILTER (phrase) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM good GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN found USING (r)
""",
)
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(table(spark, folder, "documents"))


@register("op9_token_rollup")
def op9_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents inserted, toxic ones deleted, those with repeated lines revised; the deletion is delivered twice."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    toxic = table(spark, folder, "labels").where("toxic = 1").select("doc_id").distinct()
    counters = {"word_bpe_49k": token_rollup.bpe_tokens(tokenizer_path()), "words_1": token_rollup.word_tokens}
    lines = F.split("text", "\n")
    repeated = F.coalesce(F.size(F.array_distinct(lines)) < F.size(lines), F.lit(False))
    first = stored(token_rollup.counted(docs.withColumn("repeated", repeated), counters), "token-ledger")
    gone = stored(first.join(toxic, "doc_id", "left_semi"), "deleted")
    left = docs.where(repeated).join(toxic, "doc_id", "left_anti")
    after = token_rollup.counted(left.withColumn("text", F.array_join(F.array_distinct(lines), "\n")), counters)
    rollup = token_rollup.TokenRollup(spark, new_folder(spark, "token-rollup"))
    rollup.commit(0, token_rollup.inserted(first))
    rollup.commit(1, token_rollup.deleted(gone))
    rollup.commit(2, token_rollup.revised(first.where("repeated").join(toxic, "doc_id", "left_anti"), after))
    rollup.commit(1, token_rollup.deleted(gone))
    return rollup.totals()


@register(
    "op11_mix_sources",
    rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || left(md5('{apportionment.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS draw FROM documents
),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source)),
weighed AS (SELECT *, number % 3 + 1 AS weight FROM named),
-- in order of size by weight, the first k targets are cut, for the least k that leaves the next one whole
tried AS (
  SELECT *, lead(size / weight, 1, 'infinity'::DOUBLE) OVER o AS next, sum(size) OVER () - 3 * sum(size) OVER o AS rest, sum(weight) OVER () - sum(weight) OVER o AS free
  FROM weighed WINDOW o AS (ORDER BY size / weight, number ROWS UNBOUNDED PRECEDING)
),
levels AS (
  SELECT CAST(rest AS BIGINT) AS rest, CAST(free AS BIGINT) AS free, next, 1 AS n FROM tried WHERE free > 0
  UNION ALL SELECT sum(size), sum(weight), min(size / weight), 0 FROM weighed
),
level AS (SELECT rest, free FROM levels WHERE CAST(rest AS DOUBLE) / free <= 3 * next OR rest = 0 ORDER BY free DESC LIMIT 1),
targets AS (
  SELECT number, source, size, CASE WHEN CAST(weight * rest AS DOUBLE) / free > 3 * size THEN CAST(3 * size AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / free END AS target
  FROM weighed, level
),
house AS (SELECT CAST((2 * sum(size) + {apportionment.BLOCK_WORDS}) // {2 * apportionment.BLOCK_WORDS} AS BIGINT) AS h, max(target) AS most FROM targets),
quotients AS (SELECT number, target / (2 * k + 1) AS quotient FROM (SELECT number, target, unnest(range(CAST(floor(target / {apportionment.BLOCK_WORDS}) AS BIGINT) + 3)) AS k FROM targets) WHERE target > 0),
ranked AS (SELECT number, row_number() OVER (ORDER BY quotient DESC, number) AS place FROM quotients),
seats AS (SELECT number, count(*) AS seats FROM ranked, house WHERE place <= h GROUP BY number),
budgets AS (SELECT t.*, least(coalesce(seats, 0) * {apportionment.BLOCK_WORDS}, 3 * size) AS budget FROM targets t LEFT JOIN seats USING (number)),
sources AS (
  SELECT number, source, size AS source_size, target, CASE WHEN size > 0 THEN budget // size ELSE 0 END AS repeats,
    least((size + {apportionment.BLOCK_WORDS - 1}) // {apportionment.BLOCK_WORDS}, CAST(floor(CASE WHEN size > 0 THEN budget % size ELSE 0 END / {float(apportionment.BLOCK_WORDS)} + 0.5) AS BIGINT)) AS blocks
  FROM budgets
),
placed AS (
  SELECT d.*, number, source_size, target, repeats, blocks, draw * {apportionment.SHARDS} // 4294967296 AS shard
  FROM d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
),
located AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY number ORDER BY shard, draw, CAST(doc_id AS VARCHAR), size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed
),
-- a block belongs to the shard of the document in which it starts
starts AS (
  SELECT number, shard, blocks, unnest(range(CAST((start + {apportionment.BLOCK_WORDS - 1}) // {apportionment.BLOCK_WORDS} AS BIGINT), CAST((start + size + {apportionment.BLOCK_WORDS - 1}) // {apportionment.BLOCK_WORDS} AS BIGINT))) AS block FROM located
),
cells AS (SELECT number, shard, any_value(blocks) AS blocks, count(*) AS n, min(block) AS first FROM starts GROUP BY number, shard),
votes AS (SELECT number, shard, row_number() OVER (PARTITION BY number ORDER BY n / CAST(2 * k + 1 AS DOUBLE) DESC, shard) <= blocks AS won FROM (SELECT *, unnest(range(n)) AS k FROM cells)),
quotas AS (SELECT number, shard, count(*) FILTER (won) AS quota FROM votes GROUP BY number, shard),
drawn AS (SELECT *, CAST('0x' || left(md5('{apportionment.SEED}:' || number || ':' || shard), 8) AS BIGINT) AS shift FROM cells JOIN quotas USING (number, shard)),
picked AS (
  SELECT number, block FROM starts JOIN drawn USING (number, shard)
  WHERE ((block - first) * CASE shift % 3 WHEN 0 THEN {apportionment.STEPS[0]} WHEN 1 THEN {apportionment.STEPS[1]} ELSE {apportionment.STEPS[2]} END + shift) % n < quota
),
spans AS (
  SELECT r, sum(least((block + 1) * {apportionment.BLOCK_WORDS}, start + size) - greatest(block * {apportionment.BLOCK_WORDS}, start)) AS words
  FROM (SELECT r, number, start, size, unnest(range(CAST(start // {apportionment.BLOCK_WORDS} AS BIGINT), CAST((start + size - 1) // {apportionment.BLOCK_WORDS} + 1 AS BIGINT))) AS block FROM located WHERE size > 0)
  JOIN picked USING (number, block) GROUP BY r
)
SELECT doc_id, size, source_size, target, CAST(repeats * size + coalesce(words, 0) AS BIGINT) AS taken FROM located LEFT JOIN spans USING (r)
""",
)
def op11_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mix = apportionment.mix_sources(table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", apportionment.taken_words(mix).alias("taken"))


@register(
    "op12_source_divergence",
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
g AS (
  SELECT lang, source, coalesce(totals.total, 0) AS total, coalesce(v.v, 0) AS v, coalesce(v.total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN totals USING (lang, source) LEFT JOIN v USING (lang)
),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (g.lang_total + 2 * g.v) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
)
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


def damaged_rows(conversations: DataFrame) -> DataFrame:
    """By a checksum of conversation and turn, rows are dropped, emptied, robbed of sentence ends, repeated or given to the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(blank("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


@register("op13_repair_conversations")
def op13_repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return conversation_repair.report_all(damaged_rows(conversations), conversations)
