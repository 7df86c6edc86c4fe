"""From raw articles of all adapters to the rows that are new."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.functions import textclean
from broadsheet.operators import search
from broadsheet.operators.ranking import top_per_group
from broadsheet.schemas import RAW_ARTICLE, align_schema

# Fixed value: prefix that older mail ids carry in the store.
OLD_MAIL_PREFIX = "body"


def combined(batches: Sequence[DataFrame]) -> DataFrame:
    """All adapters' rows in the common raw-article form."""
    return functools.reduce(DataFrame.unionByName, [align_schema(b, RAW_ARTICLE) for b in batches])


def unseen(raw: DataFrame, stored: DataFrame, mail: bool = False) -> DataFrame:
    """Raw rows whose uid is not stored.

    For mail the stored id may carry a prefix. Rewriting the stored ids gives
    one equality join, where an OR of two would compare all pairs.
    """
    known = stored.select("uid")
    if mail:
        prefixed = known.filter(F.col("uid").startswith(OLD_MAIL_PREFIX))
        known = known.union(prefixed.select(F.substring("uid", len(OLD_MAIL_PREFIX) + 1, 1 << 30).alias("uid")))
    return raw.join(known, "uid", "left_anti")


def first_per_uid(raw: DataFrame, arrival: str = "arrival") -> DataFrame:
    return top_per_group(raw, ["uid"], [F.asc(arrival)])


def new_items(raw: DataFrame, stored: DataFrame, arrival: str = "arrival", mail: bool = False) -> DataFrame:
    """First row per unseen uid.

    Copies go first: they collapse before the one shuffle by uid, which the
    join then reuses, so a uid with very many copies never gathers in a task.
    """
    return unseen(first_per_uid(raw, arrival), stored, mail)


def with_word_cap(raw: DataFrame, cap: int = textclean.WORD_CAP) -> DataFrame:
    """Adds model_text, the first ``cap`` words that a model gets to see, and truncated; the body stays whole."""
    capped = raw.withColumn("_capped", textclean.capped_words(F.col("body"), cap))
    return capped.withColumns({"model_text": F.col("_capped.text"), "truncated": F.col("_capped.truncated")}).drop("_capped")


def append_articles(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Adds rows not stored yet, with vector norms, partitioned by publication day.

    Of rows with one uid the earliest is stored; rows without a uid can't be recognised again and are left out.
    (``store.Store`` commits articles with their entities, and looks up ids without reading all of them.)
    """
    once = top_per_group(rows.filter("uid IS NOT NULL"), ["uid"], [F.asc("datetime"), F.asc("ingested_at"), F.asc("url")])
    dated = search.with_norms(once).withColumn("day", F.to_date("datetime"))
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # first write: nothing is there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        dated = dated.join(stored.select("uid"), "uid", "left_anti")
    # Rebalancing gives each day few files and splits a day that holds most of the rows.
    dated.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def highest_mail_uid(raw: DataFrame) -> DataFrame:
    """Cursor of a mailbox: the largest numeric uid."""
    return raw.agg(F.max(F.col("uid").try_cast("bigint")).alias("last_uid"))


def all_mail_ids(yearly: Sequence[DataFrame]) -> DataFrame:
    """Distinct mail ids of several yearly listings, ascending."""
    return functools.reduce(DataFrame.unionByName, yearly).distinct().orderBy("mail_id")
