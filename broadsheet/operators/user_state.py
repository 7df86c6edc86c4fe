"""Histories, flags, saved searches and notifications as append logs with current views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from broadsheet.operators.ranking import top_per_group

# Fixed value: entries of a search history that are shown.
HISTORY_SHOWN = 10


def recent_history(history: DataFrame, k: int = HISTORY_SHOWN) -> DataFrame:
    return top_per_group(history, ["username"], [F.desc("searched_at"), F.desc("id")], k)


def append_history(history: DataFrame, entries: DataFrame) -> DataFrame:
    return history.unionByName(entries)


def apply_flags(articles: DataFrame, flag_log: DataFrame) -> DataFrame:
    """Articles with the latest flag of the log (uid, flag_status, ts, seq)."""
    latest = flag_log.groupBy("uid").agg(
        F.max_by(F.struct(F.col("flag_status").alias("value")), F.struct("ts", "seq")).alias("flag")
    )
    joined = articles.join(latest, "uid", "left")
    value = F.when(F.col("flag").isNotNull(), F.col("flag.value")).otherwise(F.col("flag_status"))
    return joined.withColumn("flag_status", value).drop("flag")


def unknown_flags(articles: DataFrame, flag_log: DataFrame) -> DataFrame:
    """Log rows whose article does not exist."""
    return flag_log.join(articles.select("uid"), "uid", "left_anti")


def delete_searches(saved: DataFrame, deletions: DataFrame) -> DataFrame:
    """Drops (id, username) pairs; a request of somebody else changes nothing."""
    return saved.join(deletions.select("id", "username"), ["id", "username"], "left_anti")


def rejected_deletions(saved: DataFrame, deletions: DataFrame) -> DataFrame:
    """Requests for a missing search ('not found') or another user's ('not owner')."""
    owners = saved.select("id", F.col("username").alias("owner"))
    joined = deletions.join(owners, "id", "left")
    reason = F.when(F.col("owner").isNull(), "not found").when(F.col("owner") != F.col("username"), "not owner")
    return joined.withColumn("reason", reason).filter("reason is not null").drop("owner")


def mark_read(notifications: DataFrame, username: str) -> DataFrame:
    read = F.col("is_read") | F.coalesce(F.col("username") == username, F.lit(False))
    return notifications.withColumn("is_read", read)


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("username").agg(F.count_if(~F.col("is_read")).alias("unread"))


def newest_first(rows: DataFrame, username: str) -> DataFrame:
    return rows.filter(F.col("username") == username).orderBy(F.desc("created_at"), F.desc("id"))
