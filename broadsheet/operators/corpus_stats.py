"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from broadsheet.session import cut_lineage


def total_articles(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("total_articles"))


def by_language(articles: DataFrame) -> DataFrame:
    counts = articles.groupBy("detected_language").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("detected_language"))


def top_sources(articles: DataFrame, k: int = 10) -> DataFrame:
    counts = articles.groupBy("source").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("source")).limit(k)


def top_entities(entities: DataFrame, k: int = 10) -> DataFrame:
    counts = entities.groupBy("canonical_name", "entity_type").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("canonical_name"), F.asc("entity_type")).limit(k)


def marketing_count(articles: DataFrame) -> DataFrame:
    return articles.filter("subscription_marketing").agg(F.count("*").alias("marketing_count"))


def languages(articles: DataFrame) -> DataFrame:
    present = articles.filter("detected_language is not null and detected_language != ''")
    return present.select("detected_language").distinct().orderBy("detected_language")


def entity_directory(entities: DataFrame) -> DataFrame:
    """Canonical entities with their distinct spellings and number of mentions.

    Mentions collapse to one row per spelling first, so the list step never
    sees more than the distinct spellings of an entity.
    """
    spellings = entities.groupBy("canonical_name", "entity_type", "raw_name").agg(F.count("*").alias("n"))
    directory = spellings.groupBy("canonical_name", "entity_type").agg(
        F.array_sort(F.collect_list("raw_name")).alias("aliases"),
        F.sum("n").alias("occurrence_count"),
    )
    return directory.orderBy(F.desc("occurrence_count"), F.asc("canonical_name"), F.asc("entity_type"))


#: Most entities a cloud shows; their keys are broadcast.
CLOUD_LIMIT = 10_000


def entity_cloud(entities: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` most mentioned entities in the form of the directory; only their spellings are gathered."""
    if not 0 <= k <= CLOUD_LIMIT:
        raise ValueError(f"a cloud shows at most {CLOUD_LIMIT} entities")
    order = [F.desc("occurrence_count"), F.asc("canonical_name"), F.asc("entity_type")]
    counted = entities.groupBy("canonical_name", "entity_type").agg(F.count("*").alias("occurrence_count"))
    top = cut_lineage(counted.orderBy(*order).limit(k))
    same = lambda left, right: F.col(f"{left}.canonical_name").eqNullSafe(F.col(f"{right}.canonical_name")) & F.col(
        f"{left}.entity_type").eqNullSafe(F.col(f"{right}.entity_type"))
    mine = entities.alias("e").join(F.broadcast(top).alias("t"), same("e", "t"), "left_semi")
    spelled = mine.groupBy("canonical_name", "entity_type").agg(F.array_sort(F.collect_set("raw_name")).alias("aliases"))
    return top.alias("t").join(F.broadcast(spelled).alias("s"), same("t", "s")).select(
        "t.canonical_name", "t.entity_type", "s.aliases", "t.occurrence_count"
    ).orderBy(*order)


def translation_pairs(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """Translated articles to judge; ``limit`` is the sample size a report asks for."""
    pairs = articles.filter(
        (F.col("detected_language") != "en")
        & F.col("summary").isNotNull()
        & F.col("original_language_summary").isNotNull()
    ).select("uid", "title", "detected_language", "original_language_summary", "summary")
    return pairs if limit is None else pairs.orderBy("uid").limit(limit)
