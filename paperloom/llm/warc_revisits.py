"""Resolution of not-modified revisit records of a web archive.

A revisit says that a page had not changed and holds no content. It is joined as of its time to the latest earlier full
response with the same canonical URL. Its validators must agree with the response's: the entity tag by weak comparison, or,
if it names none, the date of last modification; a revisit without either is taken on trust. The headers of a revisit that
fits replace those of the response, save those that a not-modified answer may not change.

The join as of a time works within (URL, stretch of time) first and carries the last response of each stretch to later ones,
so a URL with a large part of all records is split by time, and only numbers and times take part; headers are fetched for
the pairs that result.

A null URL or time never matches. Of responses at the same time the one with the larger record_id wins. Header names
are compared without case, repeated headers are kept in order, and null headers are none. Repeated rows are resolved each. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import lower_ascii, numbered
from paperloom.session import stored

STRETCH_SECONDS = 86_400
# Headers that describe the stored content or the connection, which a 304 answer does not update.
NOT_UPDATED = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without closing slashes, sorted parameters without trackers; no fragment."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    scheme = lower_ascii(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(lower_ascii(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www\.", "")
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def header(headers: Column, name: str) -> Column:
    """First value of a header."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merge_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, with those the revisit may update replaced by its own."""
    permitted = F.filter(revisit, lambda h: ~F.lower(h["name"]).isin(NOT_UPDATED))
    names = F.transform(permitted, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(response, lambda h: ~F.array_contains(names, F.lower(h["name"]))), permitted)


def latest_earlier(records: DataFrame, stretch: int = STRETCH_SECONDS) -> DataFrame:
    """(_row, found) of revisits: number of the latest response with the same key and an earlier time, or null."""
    response = F.when(F.col("full"), F.struct("ts", "record_id", F.col("_row").alias("row")))
    events = records.where("key is not null and ts is not null").select("key", "ts", "record_id", "_row", "full", F.floor(F.col("ts") / stretch).alias("part"))
    last = events.where("full").groupBy("key", "part").agg(F.max(F.struct("ts", "record_id", F.col("_row").alias("row"))).alias("last"))
    parts = events.select("key", "part").distinct().join(last, ["key", "part"], "left")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(parts.select("key", "part", F.max("last").over(before).alias("carried")), "carried")
    within = Window.partitionBy("key", "part").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max(response).over(within)).where("not full")
    # the right side was written, so that both sides are dealt out and a large key can be split
    met = near.join(carried, ["key", "part"], "left")
    return met.select("_row", F.coalesce("near", "carried")["row"].alias("found"))


def resolve_revisits(records: DataFrame, stretch: int = STRETCH_SECONDS) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, ts in seconds, type, headers).

    Gives record_id, url_key, response_id, status (resolved, unverified, mismatch or no_response) and the merged headers, null
    unless the revisit is resolved or unverified.
    """
    headers = F.coalesce(F.col("headers"), F.array().cast(HEADERS))
    tag = lambda name: F.regexp_replace(header(headers, "etag"), "^W/", "").alias(name)
    rows = numbered(
        records.where(F.col("type").isin("response", "revisit")).select(
            "record_id", canonical_url(F.col("url")).alias("key"), "ts", (F.col("type") == "response").alias("full"), headers.alias("headers"),
            tag("tag"), header(headers, "last-modified").alias("modified"),
        ),
        "records",
    )
    found = stored(latest_earlier(rows, stretch), "as-of")
    revisits = rows.where("not full").join(found, "_row", "left")
    responses = rows.where("full").select(
        F.col("_row").alias("found"), F.col("record_id").alias("response_id"), F.col("headers").alias("old"), F.col("tag").alias("old_tag"),
        F.col("modified").alias("old_modified"),
    )
    agrees = F.when(F.col("tag").isNotNull(), F.coalesce(F.col("tag") == F.col("old_tag"), F.lit(False))).when(
        F.col("modified").isNotNull(), F.coalesce(F.col("modified") == F.col("old_modified"), F.lit(False))
    )
    status = (
        F.when(F.col("old").isNull(), "no_response").when(agrees, "resolved").when(agrees.isNull(), "unverified").otherwise("mismatch")
    )
    return (
        stored(revisits, "revisits")
        .join(responses, "found", "left")
        .select(
            "record_id",
            F.col("key").alias("url_key"),
            "response_id",
            status.alias("status"),
            F.when(status.isin("resolved", "unverified"), merge_headers(F.col("old"), F.col("headers"))).alias("headers"),
        )
    )
