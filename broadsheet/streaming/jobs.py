"""Streaming counterparts of ingestion, alerts and the timeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from broadsheet.functions import dates
from broadsheet.operators import alerts, ingest
from broadsheet.operators.ranking import top_per_group
from broadsheet.schemas import ARTICLES, SAVED_SEARCHES, align_schema
from broadsheet.session import cut_lineage

# Fixed value: how far back a sync looks for mail.
LOOKBACK = "7 days"

#: A saved search with the time of its newest known article and the number of the change that saved it.
STATE = T.StructType([*SAVED_SEARCHES.fields, T.StructField("since", T.TimestampNTZType()), T.StructField("seq", T.LongType())])
#: Change log of saved searches: the last change of an id counts, a tombstone if ``deleted``.
CHANGES = T.StructType([*STATE.fields, T.StructField("deleted", T.BooleanType())])


def article_stream(spark: SparkSession, path: str, files_per_trigger: int = 50) -> DataFrame:
    """Landed articles, at most ``files_per_trigger`` files per micro-batch."""
    return spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _arrival() -> Column:
    """When a row came in, as an instant; rows that don't say count as coming in now."""
    return F.coalesce(dates.utc_instant(F.col("ingested_at")), F.current_timestamp())


def in_lookback(lookback: str = LOOKBACK) -> Column:
    """Whether a row was published within the lookback before it came in; undated rows were."""
    published = dates.utc_instant(F.col("datetime"))
    return F.coalesce(published >= _arrival() - F.expr(f"INTERVAL {lookback}"), F.lit(True))


def ingest_stream(stream: DataFrame, store: str, checkpoint: str, available_now: bool = True,
                  lookback: str | None = LOOKBACK, left_out: str | None = None) -> StreamingQuery:
    """Appends unseen articles to the store; ``lookback=None`` is the historical backfill.

    What was published before the lookback is not picked up; it is measured
    from each row's own arrival, so one wrong date cannot hold back others. ``left_out`` names a
    folder for those rows. The checkpoint replaces a cursor file: a batch counts as done only after
    its write. A batch repeated after a failure finds its own rows stored.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if lookback is None else batch.filter(in_lookback(lookback))
        once = top_per_group(rows, ["uid"], [F.asc("datetime"), F.asc("ingested_at"), F.asc("url")])
        ingest.append_articles(batch.sparkSession, once, store)
        if lookback is not None and left_out is not None:
            batch.filter(~in_lookback(lookback)).write.mode("overwrite").parquet(f"{left_out}/batch={batch_id}")

    return _started(stream, write, checkpoint, available_now)


def save_initial_searches(searches: DataFrame, articles: DataFrame, state: str, by: str = "datetime") -> None:
    """First snapshot: the searches with the time of their newest known article."""
    dated = alerts.with_watermark(searches, articles, by).withColumn("seq", F.lit(None).cast("long"))
    dated.select(STATE.names).write.mode("overwrite").parquet(f"{state}/searches/0")


def log_changes(changes: DataFrame, path: str) -> None:
    """Appends saved and deleted searches to the change log. ``changes`` has ``id`` and ``seq`` at least; what it lacks is null."""
    align_schema(changes, CHANGES).select(CHANGES.names).write.mode("append").parquet(path)


def with_changes(held: DataFrame, log: DataFrame) -> DataFrame:
    """Searches (``STATE``) after the changes that were logged since.

    A search that is saved anew starts from its own ``since`` (1970 if it has none), one that hasn't changed keeps its watermark.
    """
    last = log.groupBy("id").agg(F.max_by(F.struct(*CHANGES.names), "seq").alias("c")).select("id", "c")
    both = held.select("id", F.struct(*STATE.names).alias("h")).join(last, "id", "full")
    is_new = F.col("c").isNotNull() & (F.col("c.seq") > F.coalesce("h.seq", F.lit(-1)))
    saved = F.struct(*(
        F.coalesce("c.since", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias(n) if n == "since" else F.col(f"c.{n}").alias(n)
        for n in STATE.names
    ))
    kept = both.filter(~is_new | ~F.coalesce("c.deleted", F.lit(False))).select(F.when(is_new, saved).otherwise(F.col("h")).alias("s"))
    return kept.filter("s IS NOT NULL").select("s.*")


def alert_stream(stream: DataFrame, state: str, checkpoint: str, now: Callable[[], object],
                 available_now: bool = True, by: str = "datetime", changes: str | None = None) -> StreamingQuery:
    """Checks every saved search on each micro-batch.

    ``state`` holds one snapshot of the saved searches per batch and the
    notifications by batch. A repeated batch starts from the snapshot before
    it and overwrites its own output, so it neither alerts twice nor skips.
    ``changes`` names a log (``log_changes``) of searches that are saved and deleted
    meanwhile; a batch sees those logged before it began.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        searches = batch.sparkSession.read.schema(STATE).parquet(f"{state}/searches/{batch_id}")
        if changes is not None:
            # Materialised, as the log may grow while the batch runs.
            searches = cut_lineage(with_changes(searches, batch.sparkSession.read.schema(CHANGES).parquet(changes)))
        found = cut_lineage(alerts.matches(searches, batch, by))
        joined = searches.join(found, "id", "left")
        joined.filter("new_results_count is not null").select(
            F.col("id").alias("search_id"), "username", "search_text", "new_results_count", "newest_title",
            F.lit(now()).cast("timestamp_ntz").alias("created_at"), F.lit(False).alias("is_read"),
        ).write.mode("overwrite").parquet(f"{state}/notifications/batch={batch_id}")
        joined.withColumns({
            "latest_id": F.coalesce("newest_uid", "latest_id"), "since": F.coalesce("newest_at", "since"),
        }).select(STATE.names).write.mode("overwrite").parquet(f"{state}/searches/{batch_id + 1}")

    return _started(stream, check, checkpoint, available_now)


def daily_counts(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Articles per day, final once the watermark has passed the day.

    An article dated after its arrival counts on the day it arrived, so a wrong
    date closes no day that is still open.
    """
    timed = stream.withColumn("event_time", F.least(dates.utc_instant(F.col("datetime")), _arrival()))
    counts = timed.withWatermark("event_time", lateness).groupBy(F.window("event_time", "1 day")).count()
    return counts.select(F.to_date(dates.utc_wall(F.col("window.start"))).alias("dt"), F.col("count").alias("cnt"))


def _started(stream: DataFrame, each, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
