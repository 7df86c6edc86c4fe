"""The ingestion job: raw items of all adapters through the models into the store, one repeatable batch at a time."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.operators import enrich, ingest, translation
from broadsheet.operators.store import Store
from broadsheet.schemas import ARTICLES, align_schema
from broadsheet.session import cut_lineage

#: Of the rows of one uid the earliest by these counts; names are resolved in this order.
ORDER = ["datetime", "url", "title"]


@dataclass(frozen=True)
class Models:
    analyst: enrich.Infer
    embedder: enrich.Embed
    translators: translation.Translators | None = None
    #: Folder of the cached translations.
    translations: str | None = None


def english(rows: DataFrame, models: Models) -> DataFrame:
    """Summaries of other languages translated by the tier of their language; texts without a translator keep the analyst's."""
    if models.translators is None:
        return rows
    if models.translations is None:
        raise ValueError("translators need a folder for the translations they keep")
    spark = rows.sparkSession
    done, fresh = translation.routed(rows, translation.cached(spark, models.translations), models.translators, "summary_orig", to="_english")
    done = cut_lineage(done)  # read before the cache grows
    translation.remember(spark, fresh, models.translations)
    translated = F.when(F.col("route") != translation.NONE, F.col("_english")).otherwise(F.col("summary_en"))
    return done.withColumn("summary_en", translated).drop("_english", "route")


def prompt_of(title: Column, sender: Column, body: Column) -> Column:
    blank = F.lit("")
    return F.concat(
        F.lit("Title: "), F.coalesce(title, blank), F.lit("\nSender: "), F.coalesce(sender, blank), F.lit("\n\n"), F.coalesce(body, blank)
    )


def analysed(raw: DataFrame, models: Models, at: datetime.datetime | Column) -> tuple[DataFrame, DataFrame]:
    """(articles with ``entities_json``, dead letters) of raw items that are not stored yet.

    Items without a readable date get ``at``. An item whose analysis fails or that lacks a vector is left out,
    and so comes up again in the next batch.
    """
    now = F.lit(at).cast("timestamp_ntz")
    dated = raw.withColumn("datetime", F.coalesce("datetime", now))
    capped = ingest.with_word_cap(dated)
    prompted = capped.withColumn("prompt", prompt_of(F.col("title"), F.col("sender"), F.col("model_text")))
    inferred = enrich.infer(prompted, "prompt", models.analyst)
    valid = enrich.normalised(enrich.parsed(enrich.answered(inferred)).filter("is_valid"))
    described = enrich.publisher_columns(enrich.with_image_note(english(valid, models)))
    both = enrich.embedded(described, models.embedder)
    articles = both.withColumns({
        "summary": F.col("summary_en"), "original_language_summary": F.col("summary_orig"), "detected_language": F.col("language"),
        "raw_email": F.col("raw_source"), "flag_status": F.lit(None).cast("string"), "ingested_at": now,
    })
    return articles.select(*(F.col(f.name).cast(f.dataType) for f in ARTICLES.fields), "entities_json"), enrich.dead_letters(inferred)


def run_batch(store: Store, batch: str, adapters: Sequence[DataFrame], models: Models, at: datetime.datetime | Column, mail: bool = False) -> DataFrame | None:
    """Takes one batch of raw items from the adapters to the store; returns its dead letters, None if it is committed already.

    Models see each unknown item once: copies inside the batch and stored items go before them.
    """
    if store.is_committed(batch):
        return None
    raw = ingest.combined(adapters).filter("uid IS NOT NULL")
    once = ingest.top_per_group(raw, ["uid"], [F.asc_nulls_last(c) for c in ORDER])
    articles, failed = analysed(align_schema(store.unseen(once, mail), raw.schema), models, at)
    store.commit(batch, articles, ORDER, at, mail)
    return failed
