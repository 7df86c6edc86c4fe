"""The translation route: each row goes to the model of its language's tier, and on to the next one when that fails.

English is not translated. Low-resource languages have a model of their own with a persistent cache; other languages, and
what that model leaves unanswered, go to the primary model, then to the secondary one, and at last keep their text
under a warning. Models see each distinct text of a language once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from broadsheet.functions import textclean
from broadsheet.operators import enrich
from broadsheet.operators.ranking import top_per_group
from broadsheet.session import cut_lineage

CACHE = "cache_key string, translation string"
#: Where a translation came from.
NONE, CACHED, OWN, PRIMARY, SECONDARY, FAILED = "none", "cache", "low_resource", "primary", "secondary", "failed"


@dataclass(frozen=True)
class Translators:
    """Models get prompts that name the language; ``name`` is that of ``low_resource`` in the cache."""

    low_resource: enrich.Infer
    primary: enrich.Infer
    secondary: enrich.Infer
    name: str


def prompt_of(text: Column, language: Column) -> Column:
    return F.concat(F.lit("Translate from "), language, F.lit(" into English. Answer with the translation alone.\n\n"), text)


def _asked(rows: DataFrame, model: enrich.Infer) -> DataFrame:
    """Rows with ``response``, NULL where the model has no usable one."""
    asked = enrich.infer(rows, "prompt", model, json_mode=False).drop("attempts", "rejects")
    failed = enrich.needs_second_try(F.col("text"), F.col("response"))
    return asked.withColumn("response", F.when(~failed, F.col("response")))


def routed(rows: DataFrame, cache: DataFrame, models: Translators, text: str = "text", language: str = "language",
           to: str = "translation") -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``to`` and ``route``, rows the cache gains).

    A NULL language counts as English. A NULL or blank text stays as it is. The cache gains one row for each key.
    """
    if {to, "route", "_key"} & set(rows.columns):
        raise ValueError(f"the rows have one of the columns {to}, route and _key already")
    spoken = F.coalesce(F.col(language), F.lit("en"))
    tier = enrich.translation_tier(spoken)
    wanted = (tier != "none") & (F.trim(F.col(text)) != "")
    key = textclean.translation_key(F.col(text), spoken, F.lit(models.name))
    keyed = rows.withColumn("_key", F.when(wanted, key))
    distinct = keyed.filter("_key IS NOT NULL").select(
        F.col("_key").alias("cache_key"), F.col(text).alias("text"), spoken.alias("language"), tier.alias("tier")
    ).dropDuplicates(["cache_key"]).withColumn("prompt", prompt_of(F.col("text"), F.col("language")))

    known = cache.groupBy("cache_key").agg(F.min("translation").alias("cached"))
    low = cut_lineage(distinct.filter("tier = 'low_resource'").join(known, "cache_key", "left"))
    own = _asked(low.filter("cached IS NULL").drop("cached"), models.low_resource)
    fresh = own.filter("response IS NOT NULL").select("cache_key", F.col("response").alias("translation"))

    left = distinct.filter("tier = 'other'").unionByName(own.filter("response IS NULL").drop("response"))
    first = _asked(left, models.primary)
    second = _asked(first.filter("response IS NULL").drop("response"), models.secondary)
    warning = enrich.translated(F.col("text"), F.col("language"), F.lit(None).cast("string"), F.lit(None).cast("string"))

    def answers(found: DataFrame, value: str, route: str) -> DataFrame:
        return found.filter(F.col(value).isNotNull()).select(F.col("cache_key").alias("_key"), F.col(value).alias(to), F.lit(route).alias("route"))

    every = answers(low, "cached", CACHED).unionByName(answers(own, "response", OWN)).unionByName(answers(first, "response", PRIMARY))
    every = every.unionByName(answers(second, "response", SECONDARY))
    every = every.unionByName(answers(second.filter("response IS NULL").withColumn("warned", warning), "warned", FAILED))
    joined = keyed.join(every, "_key", "left").drop("_key")
    kept = F.coalesce(F.col("route"), F.lit(NONE))
    return joined.withColumns({to: F.coalesce(F.col(to), F.col(text)), "route": kept}), fresh


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache stored at ``path``, empty before its first row."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CACHE)


def remember(spark: SparkSession, fresh: DataFrame, path: str) -> None:
    """Adds the rows whose keys the cache lacks, each key once; has one writer at a time."""
    once = top_per_group(fresh, ["cache_key"], [F.asc("translation")])
    once.join(cached(spark, path).select("cache_key"), "cache_key", "left_anti").write.mode("append").parquet(path)
