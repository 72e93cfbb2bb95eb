"""URL filter by stated rules and by association rules mined from labelled pages, with DataFrame functions and Spark ML only.

A URL is a set of tokens: scheme, host, registered domain, words of the remaining host, shapes of the path's parts by
position, and names of query parameters. FP-growth finds token combinations with support; rules from them to a label are
kept if their confidence is high enough and exceeds, by ``MIN_GAIN``, that of every rule with one token less (and the share of
the label at large). Kept rules are indexed under their rarest token. URLs are reduced to the tokens that rules use, each
distinct combination of these is matched once through the index and checked for all tokens of a rule, and the rule of
highest confidence decides (then of higher support, then block before allow). URLs that no rule fits are allowed.

Tokens that stand in exactly the same labelled pages are one item, named by the least of them, when rules are mined: rules that
differ in such tokens only are one rule, which fits a URL that has any of them. Mining thus does not grow with the length of a URL,
whose own tokens are all one item; tokens without enough support are left out first.

Stated rules come first: one fits its host and all subdomains if the path starts with its path; the longest host and path
together wins, then the longer host.

The tokens of rules are bounded by the support: at most (tokens per URL) / ``MIN_SUPPORT`` of them are frequent. A null URL
or one without ``://`` has an empty host and path, fits no stated rule and has the tokens of an empty URL. Repeated rows are
judged alike. Several labels of one page count as block if one of them does; null labels are left out. Without labels there
are no mined rules. Columns other than id and URL are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scale import broadcast_if_small
from paperloom.llm.common import lower_ascii, numbered
from paperloom.session import stored

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.6
MIN_GAIN = 0.05
ALLOW, BLOCK = "allow", "block"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL."""
    url = F.coalesce(url, F.lit(""))
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    left = F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))
    named = lambda prefix, array: F.transform(array, lambda x: F.concat(F.lit(prefix), x))
    parts = F.transform(
        F.filter(F.split(path, "/"), lambda x: x != ""),
        lambda x, i: F.concat(F.lit("p"), (i + 1).cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "#")),
    )
    return F.array_distinct(
        F.concat(
            F.array(
                F.concat(F.lit("s:"), lower_ascii(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
                F.concat(F.lit("d:"), domain),
                F.concat(F.lit("f:"), host),
            ),
            named("h:", F.filter(F.flatten(F.transform(left, lambda x: F.split(x, "-"))), lambda x: x != "")),
            parts,
            named("q:", F.regexp_extract_all(url, F.lit("[?&]([^=&#]+)="), F.lit(1))),
        )
    )


def token_classes(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(token, name) of the tokens with support; those in the same rows of (_row, tokens) have one name."""
    rows = labelled.count()
    row = lambda seed: F.bit_xor(F.xxhash64("_row", F.lit(seed)))
    each = labelled.select("_row", F.explode("tokens").alias("token")).groupBy("token")
    # two hashes of the set of rows beside its size tell sets apart
    sets = stored(each.agg(F.count("*").alias("n"), row(1).alias("a"), row(2).alias("b")).where(F.col("n") >= min_support * rows), "token-sets")
    names = sets.groupBy("n", "a", "b").agg(F.min("token").alias("name"))
    return sets.join(names, ["n", "a", "b"]).select("token", "name")


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_gain: float = MIN_GAIN
) -> DataFrame:
    """Rules (tokens, label, confidence, support) from rows of (tokens, label)."""
    spark = labelled.sparkSession
    rows = stored(labelled.select("tokens", "label"), "labelled-urls")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "tokens array<string>, label string, confidence double, support double")
    baskets = rows.select(F.concat("tokens", F.array(F.concat(F.lit("y:"), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    mined = stored(
        model.associationRules.where(F.col("consequent")[0].startswith("y:")).select(
            F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 3, 9).alias("label"), "confidence", "support"
        ),
        "mined-rules",
    )
    base = rows.groupBy("label").agg((F.count(F.lit(1)) / total).alias("known")).select(F.array().cast("array<string>").alias("shorter"), "label", "known")
    known = mined.select(F.col("tokens").alias("shorter"), "label", F.col("confidence").alias("known")).union(base)
    shorter = mined.select("tokens", "label", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("shorter"))
    best = shorter.join(known, ["shorter", "label"]).groupBy("tokens", "label").agg(F.max("known").alias("known"))
    return (
        mined.join(best, ["tokens", "label"], "left")
        .where(F.col("known").isNull() | (F.col("confidence") >= F.col("known") + min_gain))
        .select("tokens", "label", "confidence", "support")
    )


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(signature, label) of the best rule for each distinct signature that one fits, through the inverted index."""
    frequency = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    numbered = rules.withColumn("rule", F.xxhash64("tokens", "label"))
    rarest = (
        numbered.select("rule", F.explode("tokens").alias("token")).join(frequency, "token").groupBy("rule").agg(F.min(F.struct("n", "token")).alias("t"))
    )
    index = stored(numbered.join(rarest, "rule").select(F.col("t.token").alias("token"), "tokens", "label", "confidence", "support"), "rule-index")
    candidates = sets.select("signature", F.explode("signature").alias("token")).join(broadcast_if_small(index), "token")
    fits = candidates.where(F.size(F.array_except("tokens", "signature")) == 0)
    best = F.max(F.struct("confidence", "support", "label")).alias("best")
    return fits.groupBy("signature").agg(best).select("signature", F.col("best.label").alias("label"))


def stated_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule string and verdict of the stated rule (verdict, host, path) that wins, or nulls. The list is written out in the plan."""
    name = verdict = F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """One row per page: page_id, host, path, rule and verdict. ``labels`` has (page_id, label), allow or block."""
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tokens = parts.select("page_id", "host", "path", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    known = labels.where("page_id is not null and label is not null").groupBy("page_id").agg(F.max("label").alias("label"))
    labelled = numbered(tokens.join(known, "page_id").select("tokens", "label"), "labelled-pages")
    classes = stored(token_classes(labelled), "token-classes")
    items = labelled.select("_row", "label", F.explode_outer("tokens").alias("token")).join(broadcast_if_small(classes), "token", "left")
    items = items.groupBy("_row", "label").agg(F.collect_set("name").alias("tokens"))
    mined = stored(mine_rules(items), "rules")
    # bounded by the support
    used = classes.join(mined.select(F.explode("tokens").alias("name")).distinct(), "name").select("token", "name").collect()
    vocabulary = F.array(*[F.lit(r.token) for r in used]) if used else F.array().cast("array<string>")
    other = [F.lit(x) for r in used if r.token != r.name for x in (r.token, r.name)]
    named = F.array_intersect("tokens", vocabulary)
    if other:
        renamed = F.create_map(*other)
        named = F.array_distinct(F.transform(named, lambda x: F.coalesce(F.try_element_at(renamed, x), x)))
    name, verdict = stated_rule(rules, F.col("host"), F.col("path"))
    signed = tokens.select(
        "page_id", "host", "path", name.alias("rule"), verdict.alias("stated"), F.array_sort(named).alias("signature")
    )
    verdicts = stored(match_rules(signed.select("signature").distinct(), mined), "verdicts")
    return signed.join(broadcast_if_small(verdicts), "signature", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("stated", "label", F.lit(ALLOW)).alias("verdict")
    )
