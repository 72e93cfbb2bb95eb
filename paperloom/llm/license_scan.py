"""License scans by diagonal voting, with DataFrame functions only.

The hash of every two consecutive words of a text is joined to those of phrases and notices, that of every four to those of
longer passages of license texts (grams). A match votes for the diagonal (place in the text less place in the template) it
lies on. A short phrase is present where all its grams vote for one diagonal. For longer templates neighbouring diagonals are
merged, so that words put in or left out do not break a match, and a span is verified when enough of the template's grams are
in it and it is not much longer than the template. Grams are compared as words after the hashes have met, so hash collisions
have no votes.

Texts are read once: words are hashed within the row, and only places whose gram hash some template has leave it. The table of
templates is fixed and small; it is broadcast. Matches carry a digest of their text instead of an id, so
repeated rows and ids need no care, and copies of a text share one result. Null and empty texts have no words, no labels,
null first and last words and score 0. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.scale import computed_once
from paperloom.llm.common import WORD, words
from paperloom.llm.license_texts import PASSAGES
from paperloom.session import stored

# Phrases that count as they stand.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Opening words of public license texts and notices.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
NEIGHBOURS = 2
COVERED = 0.8
STRETCH = 1.25
# Words of a gram: of phrases and notices, and of passages.
SHORT, LONG = 2, 4


def templates() -> list[tuple[int, str, str, bool, int]]:
    """Number, label, words joined by spaces, whether it is a phrase, and the words of a gram, of every template."""
    passages = [(label, " ".join(re.findall(WORD, text.lower()))) for label, text in PASSAGES]
    n, m = len(PHRASES), len(PHRASES) + len(NOTICES)
    rows = enumerate([*PHRASES, *NOTICES, *passages])
    return [(i, label, text, i < n, SHORT if i < m else LONG) for i, (label, text) in rows]


def template_table(spark: SparkSession) -> DataFrame:
    """One row per gram of a template: its words, its place, the template, its label, grams, whether it is a phrase, its width."""
    rows = []
    for number, label, text, phrase, width in templates():
        parts = text.split()
        n = len(parts) - width + 1
        rows += [(" ".join(parts[i : i + width]), i, number, label, n, phrase, width) for i in range(n)]
    known = "known string, place long, template int, label string, pairs long, phrase boolean, width int"
    hashes = F.transform(F.split("known", " "), lambda x: F.xxhash64(x))
    long = F.when(F.col("width") == LONG, _gram_hash(F.col("hw"), F.lit(0), LONG))
    return spark.createDataFrame(rows, known).withColumn("hw", hashes).withColumn("h", F.coalesce(long, _gram_hash(F.col("hw"), F.lit(0), SHORT))).drop("hw")


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _gram_hash(hashes: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(hashes, at + i) for i in range(width)))


def _hits(known: list[int], width: int) -> Column:
    """array<struct<at, h, gram>>: the places of a text whose gram of ``width`` words has a known hash."""
    places = F.when(F.size("w") >= width, F.sequence(F.lit(0), F.size("w") - width)).otherwise(F.array().cast("array<int>"))
    found = F.filter(places, lambda i: _gram_hash(F.col("hw"), i, width).isin(known))
    return F.transform(
        found,
        lambda i: F.struct(
            i.cast("long").alias("at"),
            _gram_hash(F.col("hw"), i, width).alias("h"),
            F.array_join(F.slice("w", i + 1, width), " ").alias("gram"),
        ),
    )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_words, hits: one row per document, from one pass over the texts.

    The hashes of the templates, whose number is fixed, are a set within the expression.
    """
    rows = template_table(docs.sparkSession).select("width", "h").distinct().collect()
    known = {k: [r["h"] for r in rows if r["width"] == k] for k in (SHORT, LONG)}
    cut = computed_once(docs.select("doc_id", "text"), "w", words(F.col("text")))
    hashed = computed_once(cut, "hw", F.transform("w", lambda x: F.xxhash64(x)))
    hits = F.concat(*(_hits(known[k], k) for k in (SHORT, LONG)))
    return hashed.select("doc_id", _key(F.col("text")).alias("key"), F.size("w").cast("long").alias("n_words"), hits.alias("hits"))


def diagonals(scan: DataFrame) -> DataFrame:
    """Votes per text, template and diagonal: the places in the template that have a gram there."""
    placed = scan.select("key", F.inline("hits"))
    votes = placed.join(F.broadcast(template_table(scan.sparkSession)), "h").where("gram = known")
    return votes.groupBy("key", "template", "label", "pairs", "phrase", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places")
    )


def spans(votes: DataFrame) -> DataFrame:
    """Verified spans: key, template, label, phrase, first word, share of the template's grams."""
    in_order = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > F.when(F.col("phrase"), 0).otherwise(NEIGHBOURS), F.lit(True))
    runs = votes.withColumn("run", F.sum(apart.cast("int")).over(in_order))
    merged = runs.groupBy("key", "template", "label", "pairs", "phrase", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("seen"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("places")).alias("last"),
    )
    share = F.col("seen") / F.col("pairs")
    good = F.when(F.col("phrase"), F.col("seen") == F.col("pairs")).otherwise(
        (share >= COVERED) & (F.col("last") - F.col("first") + 1 <= STRETCH * F.col("pairs"))
    )
    return merged.where(good).select("key", "template", "label", "phrase", "first", share.alias("share"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of the phrases, their labels, all labels, and the best share of a template."""
    phrase = F.col("phrase")
    scan = stored(scanned(docs), "scan")
    found = spans(stored(diagonals(scan), "diagonals")).groupBy("key").agg(
        F.count(F.when(phrase, 1)).alias("n_base"),
        F.min(F.when(phrase, F.col("first"))).alias("first_word"),
        F.max(F.when(phrase, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    return scan.drop("hits").join(stored(found, "licenses"), "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
