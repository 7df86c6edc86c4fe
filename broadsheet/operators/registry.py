"""Source registry: validation, ids, duplicates, lists, statistics and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions import textclean
from broadsheet.operators.ranking import number_within

# Fixed values of the registry.
PLATFORMS = ("telegram", "rss", "newsletter", "fediverse")
PLATFORM_CODES = {"telegram": "TEL", "rss": "RSS", "newsletter": "NEW", "fediverse": "FED"}
OTHER_PLATFORM_CODE, DEFAULT_TOPIC = "SRC", "GEN"
PUBLISHER_TYPES = (
    "state_media", "independent_journalist", "civil_society", "anonymous_influencer",
    "consumer_news", "cultural_music_art", "gossip_celebrity", "newsfluencer",
    "mainstream_publication", "sport", "technology_science", "pr_news_agency", "other",
)
LENGTHS = {
    "source_name": (2, 150), "ingest_url": (5, None), "primary_language": (2, 10),
    "input_by": (2, 100), "country_iso": (2, 5), "topic_code": (2, 10),
}
OPTIONAL_LENGTHS = {"languages_spoken": 200, "geographic_focus": 200}
REQUIRED_FLAGS = ("gating_passed", "activity_passed", "telegram_passed")



def _auditor(df: DataFrame, input_by: str | None, normalise: bool) -> DataFrame:
    if not input_by:
        return df
    stored = F.lower(F.trim(F.col("input_by"))) if normalise else F.col("input_by")
    return df.filter(stored == input_by.strip().lower())


def listed(sources: DataFrame, include_deleted: bool = False, input_by: str | None = None,
           normalise: bool = False) -> DataFrame:
    """Registry rows, newest first. ``normalise`` also folds the stored auditor name."""
    rows = sources if include_deleted else sources.filter(~F.col("is_deleted"))
    return _auditor(rows, input_by, normalise).orderBy(F.desc("date_added"), F.desc("source_id"))


def text_filtered(sources: DataFrame, text: str = "", platform: str = "all") -> DataFrame:
    rows = sources if platform == "all" else sources.filter(F.col("platform") == platform)
    wanted = text.strip().lower()
    if not wanted:
        return rows
    found = F.lit(False)
    for column in ("source_id", "source_name", "ingest_url", "primary_language", "publisher_type", "input_by"):
        found = found | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(wanted))
    return rows.filter(found)


def ingest_targets(sources: DataFrame) -> DataFrame:
    """Active rows with what their adapter fetches; newsletters have no target."""
    active = sources.filter(~F.col("is_deleted")).select("platform", "source_name", "ingest_url")
    return active.withColumn("target", textclean.ingest_target(F.col("platform"), F.col("ingest_url")))


def violations() -> Column:
    """Names of the rules a submission breaks, in rule order."""
    rules: list[tuple[str, Column]] = []
    for column, (least, most) in LENGTHS.items():
        size = F.char_length(column)
        bad = F.col(column).isNull() | (size < least)
        rules.append((f"{column}_length", bad if most is None else bad | (size > most)))
    for column, most in OPTIONAL_LENGTHS.items():
        rules.append((f"{column}_length", F.coalesce(F.char_length(column) > most, F.lit(False))))
    rules.append(("platform_unknown", ~F.coalesce(F.col("platform").isin(*PLATFORMS), F.lit(False))))
    rules.append(("publisher_type_unknown", ~F.coalesce(F.col("publisher_type").isin(*PUBLISHER_TYPES), F.lit(False))))
    for column in REQUIRED_FLAGS:
        rules.append((f"{column}_missing", F.col(column).isNull()))
    url = F.trim("ingest_url")
    telegram = F.coalesce(F.col("platform") == "telegram", F.lit(False))
    public = F.contains(url, F.lit("t.me/")) | F.contains(url, F.lit("telegram.me/"))
    private = F.contains(url, F.lit("+")) | F.contains(url, F.lit("#")) | F.contains(url, F.lit("joinchat"))
    rules.append(("telegram_url", telegram & ~public))
    rules.append(("telegram_private", telegram & private))
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]))


def validated(submissions: DataFrame) -> DataFrame:
    return submissions.withColumn("violations", violations())


def duplicate_check(submissions: DataFrame, sources: DataFrame) -> DataFrame:
    """Active registry rows with the same URL or the same name, if any."""
    active = sources.filter(~F.col("is_deleted"))
    by_url = active.groupBy(F.col("ingest_url").alias("url_key")).agg(F.min("source_id").alias("url_match"))
    by_name = active.groupBy(F.col("source_name").alias("name_key")).agg(F.min("source_id").alias("name_match"))
    checked = (
        submissions.withColumns({"url_key": F.trim("ingest_url"), "name_key": F.trim("source_name")})
        .join(by_url, "url_key", "left")
        .join(by_name, "name_key", "left")
        .drop("url_key", "name_key")
    )
    return checked.withColumn("is_duplicate", F.col("url_match").isNotNull() | F.col("name_match").isNotNull())


def id_prefix(country: Column, platform: Column, topic: Column) -> Column:
    code = F.lit(OTHER_PLATFORM_CODE)
    for name, short in PLATFORM_CODES.items():
        code = F.when(F.lower(platform) == name, F.lit(short)).otherwise(code)
    kept = F.substring(F.regexp_replace(F.upper(F.trim(topic)), "[^A-Z0-9]", ""), 1, 4)
    kept = F.coalesce(F.nullif(kept, F.lit("")), F.lit(DEFAULT_TOPIC))
    return F.concat_ws("_", F.upper(F.trim(country)), code, kept)


def stored_prefix(source_id: Column) -> Column:
    return F.regexp_replace(source_id, r"_[^_]*$", "")


def last_numbers(sources: DataFrame) -> DataFrame:
    """Highest numeric suffix per id prefix, deleted rows included."""
    number = F.element_at(F.split("source_id", "_"), -1).try_cast("int")
    return sources.groupBy(stored_prefix(F.col("source_id")).alias("prefix")).agg(
        F.coalesce(F.max(number), F.lit(0)).alias("last_number")
    )


def with_new_ids(submissions: DataFrame, sources: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Adds ``source_id``: consecutive numbers per prefix after the stored ones."""
    prefixed = submissions.withColumn(
        "prefix", id_prefix(F.col("country_iso"), F.col("platform"), F.col("topic_code"))
    )
    numbered = number_within(prefixed, ["prefix"], [arrival], "n").join(last_numbers(sources), "prefix", "left")
    number = (F.col("n") + F.coalesce("last_number", F.lit(0))).cast("string")
    padded = F.when(F.char_length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return numbered.withColumn("source_id", F.concat_ws("_", "prefix", padded)).drop("prefix", "n", "last_number")


def judged(submissions: DataFrame, sources: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Submissions with ``reason``: NULL if acceptable, else why not.

    Within one batch the first acceptable row of a URL wins, as it would when
    the rows came one after another.
    """
    rows = validated(submissions).withColumn("url", F.trim("ingest_url"))
    stored = sources.groupBy(F.col("ingest_url").alias("url")).agg(F.bool_or(~F.col("is_deleted")).alias("active"))
    valid = rows.filter(F.size("violations") == 0)
    winners = valid.groupBy("url").agg(F.min(arrival).alias("first_arrival"))
    looked_up = rows.join(stored.join(winners, "url", "full"), "url", "left")
    reason = (
        F.when(F.size("violations") > 0, F.concat(F.lit("invalid: "), F.array_join("violations", ",")))
        .when(F.col("active"), F.lit("duplicate active url"))
        .when(~F.col("active"), F.lit("url held by a deleted source"))
        .when(F.col(arrival) > F.col("first_arrival"), F.lit("duplicate active url"))
    )
    return looked_up.withColumn("reason", reason).drop("url", "active", "first_arrival", "violations")


def insert_batch(submissions: DataFrame, sources: DataFrame, today: Column, arrival: str = "arrival"):
    """(accepted registry rows, rejected submissions with their reason)."""
    rows = judged(submissions, sources, arrival)
    accepted = with_new_ids(rows.filter("reason is null"), sources, arrival)
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    accepted = accepted.select(
        "source_id", F.trim("source_name").alias("source_name"), "platform",
        F.trim("ingest_url").alias("ingest_url"), F.lower(F.trim("primary_language")).alias("primary_language"),
        text("languages_spoken").alias("languages_spoken"), text("geographic_focus").alias("geographic_focus"),
        "publisher_type", F.trim("input_by").alias("input_by"), today.cast("date").alias("date_added"),
        *REQUIRED_FLAGS, F.lit(False).alias("is_verified"), F.lit(False).alias("is_deleted"),
    )
    return accepted, rows.filter("reason is not null")


def totals(sources: DataFrame, input_by: str | None = None, normalise: bool = False) -> DataFrame:
    rows = _auditor(sources, input_by, normalise)
    return rows.agg(
        F.count_if(~F.col("is_deleted")).alias("total_active"),
        F.count_if(~F.col("is_deleted") & F.col("is_verified")).alias("total_verified"),
        F.count_if(F.col("is_deleted")).alias("total_deleted"),
    )


def by_platform(sources: DataFrame) -> DataFrame:
    """Active rows per platform; a platform without rows shows 0."""
    active = sources.filter(~F.col("is_deleted"))
    one_row = active.agg(*[F.count_if(F.col("platform") == p).alias(p) for p in PLATFORMS])
    return one_row.unpivot([], list(PLATFORMS), "platform", "count")


def by_column(sources: DataFrame, column: str) -> DataFrame:
    return sources.filter(~F.col("is_deleted")).groupBy(column).agg(F.count("*").alias("count"))


def by_country(sources: DataFrame) -> DataFrame:
    country = F.split_part(F.col("source_id"), F.lit("_"), F.lit(1))
    return by_column(sources.withColumn("country", country), "country")


def apply_changes(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Registry after a log of (source_id, ts, seq, action).

    Actions: delete, restore, verify, unverify. Deletion and verification are
    separate properties, each set by its latest action; nothing is removed.
    """
    when = F.struct("ts", "seq")
    deleting = F.when(F.col("action").isin("delete", "restore"), when)
    verifying = F.when(F.col("action").isin("verify", "unverify"), when)
    latest = changes.groupBy("source_id").agg(
        F.max_by(F.col("action") == "delete", deleting).alias("now_deleted"),
        F.max_by(F.col("action") == "verify", verifying).alias("now_verified"),
    )
    return sources.join(latest, "source_id", "left").withColumns({
        "is_deleted": F.coalesce("now_deleted", "is_deleted"),
        "is_verified": F.coalesce("now_verified", "is_verified"),
    }).drop("now_deleted", "now_verified")
