"""License scan: an exact set-similarity join of text blocks with license templates.

A block is any stretch of as many words as a template has different ones; it meets the
template if it contains at least ``CONTAINMENT`` of them. The join finds all such blocks without comparing
every block: the template's tokens are put in order of their frequency in the
whole corpus, and a block that meets the template must hold one of the rarest few (the
prefix), whose number follows from the threshold. Only words that equal a prefix token
are joined with the templates. Of the words around such a hit the places of the template's tokens are noted, and only stretches
that hold as many places as the threshold needs are cut out and counted (positional filter); too short ones
at the end of a text are left out (length filter).

Base places, where a template's words stand consecutively, are among the blocks found.
All templates together are a fixed table of a few rows, the only thing broadcast.

Defined cases: null and empty texts have no words; repeated rows each get the same row; rows
without an id are scanned like others; a text with ties among templates gets all labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CONTAINMENT = 0.8
# Phrases that decide alone (base), and wordings that name the same licenses.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
WORDINGS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def needed(size: int, least: float = CONTAINMENT) -> int:
    return math.ceil(least * size - 1e-9)


def templates(spark: SparkSession, frequency: DataFrame, least: float = CONTAINMENT) -> DataFrame:
    """One row for each prefix token of each template."""
    rows = []
    for k, (label, phrase, base) in enumerate([(*x, True) for x in BASE] + [(*x, False) for x in WORDINGS]):
        said = phrase.split(" ")
        size = len(set(said))
        rows.append((k, label, base, said, sorted(set(said)), size, needed(size, least)))
    table = spark.createDataFrame(rows, "template int, label string, base boolean, said array<string>, tokens array<string>, size int, needed int")
    ranked = table.withColumn("token", F.explode("tokens")).join(frequency, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = F.array_sort(F.collect_list(F.struct("n", "token")))
    prefixes = ranked.groupBy("template").agg(order.alias("ordered")).join(table, "template")
    kept = F.slice("ordered", F.lit(1), F.col("size") - F.col("needed") + 1)
    return prefixes.select("template", "label", "base", "said", "tokens", "size", "needed", F.explode(kept).alias("prefix")).withColumn("token", F.col("prefix.token")).drop("prefix")


def blocks(keyed: DataFrame, least: float = CONTAINMENT) -> DataFrame:
    """Blocks that meet a template: doc_id, _text, template, label, start, is_base, share."""
    vocabulary = sorted({w for _, phrase in (*BASE, *WORDINGS) for w in phrase.split(" ")})
    said = keyed.select(F.explode("_words").alias("token")).filter(F.col("token").isin(vocabulary))
    frequency = said.groupBy("token").agg(F.count("*").alias("n"))
    known = templates(keyed.sparkSession, frequency, least)
    at = keyed.select("doc_id", "_text", "_words", F.posexplode("_words").alias("at", "token"))
    hits = at.join(F.broadcast(known), "token")  # a fixed table: a few rows for each template
    length = F.greatest("size", F.size("said"))
    # From here on a hit carries the words around it, not those of its text.
    low = F.greatest(F.lit(0), F.col("at") - length + 1)
    around = hits.withColumn("low", low).withColumn("_around", F.slice("_words", F.col("low") + 1, F.col("at") - F.col("low") + length)).drop("_words")
    marked = F.filter(F.transform("_around", lambda w, i: F.when(F.array_contains("tokens", w), i)), lambda i: i.isNotNull())

    def viable(places: Column) -> Column:
        """Starts of stretches with enough places; no block holds more of the tokens than it has of these."""

        def enough(start: Column) -> Column:
            return F.size(F.filter(places, lambda p: (p >= start) & (p < start + F.col("size")))) >= F.col("needed")

        first = F.sequence(F.lit(0), F.col("at") - F.col("low"))
        return F.when(F.size(places) >= F.col("needed"), F.filter(first, enough)).otherwise(F.array().cast("array<int>"))

    # The places are found once for each hit, not for each start.
    starts = around.withColumn("_at", F.explode(F.element_at(F.transform(F.array(marked), viable), 1))).withColumn("start", F.col("low") + F.col("_at"))
    block = F.slice("_around", F.col("_at") + 1, F.col("size"))
    cut = starts.select("doc_id", "_text", "template", "label", "start", "needed", "size", "tokens", block.alias("block"),
                        (F.col("base") & (F.slice("_around", F.col("_at") + 1, F.size("said")) == F.col("said"))).alias("is_base"))
    shared = cut.filter(F.size("block") >= F.col("needed")).withColumn("shared", F.size(F.array_intersect("tokens", "block")))
    return shared.filter(F.col("is_base") | (F.col("shared") >= F.col("needed"))).select(
        "doc_id", "_text", "template", "label", "start", "is_base", (F.col("shared") / F.col("size")).alias("share")
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """Per document its number of words, base places and labels, all labels, and the best containment."""
    keyed = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_text"), words(text).alias("_words"))
    base = F.when(F.col("is_base"), F.col("start"))
    places = F.count_distinct(F.when(F.col("is_base"), F.struct("template", "start")))
    found = blocks(keyed, least).groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_t")).agg(
        places.alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    counted = keyed.select("doc_id", "_text", F.size("_words").cast("long").alias("n_words"))
    return counted.join(found, counted["doc_id"].eqNullSafe(found["_id"]) & (counted["_text"] == found["_t"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle_sql(least: float = CONTAINMENT) -> str:
    """The same by trying every template at every word."""
    rows = []
    for k, (label, phrase, base) in enumerate([(*x, True) for x in BASE] + [(*x, False) for x in WORDINGS]):
        said = phrase.split(" ")
        size = len(set(said))
        rows.append(f"({k}, '{label}', {str(base).lower()}, {said}, {sorted(set(said))}, {size}, {needed(size, least)})")
    return rf"""
    WITH templates(template, label, base, said, tokens, size, needed) AS (VALUES {", ".join(rows)}),
    texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(len(w))) AS start FROM texts),
    tried AS (
      SELECT doc_id, template, label, start, needed, size, base AND w[start + 1 : start + len(said)] = said AS is_base,
             len(list_intersect(tokens, w[start + 1 : start + size])) AS shared
      FROM starts, templates WHERE list_has_any(tokens, w[start + 1 : start + 4])
    ),
    found AS (
      SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(shared / size) AS score
      FROM tried WHERE is_base OR shared >= needed GROUP BY doc_id
    )
    SELECT t.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM texts t LEFT JOIN found USING (doc_id)
    """
