"""Registered statistics, alert and user-state queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.operators import alerts, corpus_stats, user_state
from broadsheet.plans import bindings as b
from broadsheet.plans.bindings import with_views
from broadsheet.plans.search_queries import _cos


def _plain(spark, sf):
    return b.articles(spark, sf, vectors=False, labels=False)


def _stat(function, view=_plain):
    return lambda spark, sf: function(view(spark, sf))


def entity_directory(spark, sf):
    rows = corpus_stats.entity_directory(b.entities(spark, sf))
    return rows.withColumn("aliases", F.array_join("aliases", "|"))


def entity_cloud(spark, sf):
    rows = corpus_stats.entity_cloud(b.entities(spark, sf))
    return rows.withColumn("aliases", F.array_join("aliases", "|"))


def translation_pairs(spark, sf):
    return corpus_stats.translation_pairs(_plain(spark, sf))


def watermark_lookup(spark, sf):
    rows = alerts.with_watermark(b.saved_searches(spark, sf), _plain(spark, sf))
    return rows.select("id", "since")


def _alerts(by):
    def run(spark, sf):
        articles = b.articles(spark, sf, labels=False)
        searches = alerts.with_watermark(b.saved_searches(spark, sf), _plain(spark, sf), by)
        found = alerts.matches(searches, articles, by)
        return found.select("id", "new_results_count", "newest_uid", "newest_title")

    return run


def alerts_advance(spark, sf):
    articles = b.articles(spark, sf, labels=False)
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    _, advanced = alerts.check_alerts(b.saved_searches(spark, sf), articles, now)
    return advanced.select("id", "username", "search_text", "latest_id")


def alerts_notifications(spark, sf):
    articles = b.articles(spark, sf, labels=False)
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    sent, _ = alerts.check_alerts(b.saved_searches(spark, sf), articles, now)
    return sent


def saved_search_seed(spark, sf):
    articles = b.articles(spark, sf, labels=False)
    return alerts.seed_searches(b.saved_searches(spark, sf), articles).select("id", "username", "latest_id")


def topk_per_query(spark, sf):
    rows = alerts.nearest_articles(b.saved_searches(spark, sf), b.articles(spark, sf, labels=False), 5)
    return rows.select("id", "rank", "uid", F.round("similarity", 6).alias("similarity"))


def history_last10(spark, sf):
    return user_state.recent_history(b.history(spark, sf))


def history_append(spark, sf):
    entries = b.saved_searches(spark, sf).select(
        (F.col("id") + 10_000_000).alias("id"), "username", "search_text", "space", F.col("created_at").alias("searched_at")
    )
    return user_state.append_history(b.history(spark, sf), entries)


def flag_compaction(spark, sf):
    return user_state.apply_flags(_plain(spark, sf), b.flag_log(spark, sf)).select("uid", "flag_status")


def unknown_flags(spark, sf):
    return user_state.unknown_flags(_plain(spark, sf).filter("content_type != 'rss'"), b.flag_log(spark, sf))


def _deletions(spark, sf):
    """Requests derived from events: a user asks for the search numbered like the event's hour."""
    return b.table(spark, sf, "events").filter("event_type = 'error'").select(
        F.hour("ts").cast("long").alias("id"), F.concat(F.lit("user"), (F.col("user_id") % 2).cast("string")).alias("username")
    ).distinct()


_DELETIONS = """, deletions AS (SELECT DISTINCT CAST(hour(ts) AS BIGINT) AS id, 'user' || (user_id % 2) AS username
 FROM events WHERE event_type = 'error')"""


def saved_search_delete(spark, sf):
    rows = user_state.delete_searches(b.saved_searches(spark, sf), _deletions(spark, sf))
    return rows.select("id", "username", "search_text")


def saved_search_rejected(spark, sf):
    return user_state.rejected_deletions(b.saved_searches(spark, sf), _deletions(spark, sf))


def notifications_read(spark, sf):
    return user_state.mark_read(b.notifications(spark, sf), "8")


def notifications_unread(spark, sf):
    return user_state.unread_counts(b.notifications(spark, sf))


def notifications_newest(spark, sf):
    return user_state.newest_first(b.notifications(spark, sf), "8").select("id", "search_text", "created_at", "is_read")


def saved_searches_newest(spark, sf):
    return user_state.newest_first(b.saved_searches(spark, sf), "user1").select("id", "search_text", "threshold", "created_at")


_SIM = f"CASE WHEN s.space = 'english' THEN {_cos('a.english_embedding', 's.query_vector')} ELSE {_cos('a.multilingual_embedding', 's.query_vector')} END"
_VEC = "CASE WHEN s.space = 'english' THEN a.english_embedding ELSE a.multilingual_embedding END"


def _match_sql(by: str, newer: bool = True) -> str:
    since = f""", wm AS (SELECT s.*, coalesce(a.{by}, TIMESTAMP '1970-01-01') AS since
 FROM saved s LEFT JOIN articles a ON a.uid = s.latest_id)"""
    return since + f""", found AS (
 SELECT s.id, a.uid, a.title, a.{by} AS seen, round({_SIM}, 6) AS sim FROM wm s JOIN articles a
 ON {f'a.{by} > s.since' if newer else 'TRUE'} WHERE {_VEC} IS NOT NULL AND {_SIM} >= s.threshold),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen DESC, sim DESC, uid) AS rn,
  count(*) OVER (PARTITION BY id) AS n FROM found)"""


def _alerts_sql(by: str) -> str:
    return with_views("articles saved", _match_sql(by) + """
SELECT id, n AS new_results_count, uid AS newest_uid, title AS newest_title FROM ranked WHERE rn = 1""")


QUERIES = {
    "corpus_total": (_stat(corpus_stats.total_articles), "SELECT count(*) AS total_articles FROM documents"),
    "stats_languages": (_stat(corpus_stats.by_language),
        "SELECT lang AS detected_language, count(*) AS count FROM documents GROUP BY lang"),
    "stats_top_sources": (_stat(corpus_stats.top_sources),
        "SELECT source, count(*) AS count FROM documents GROUP BY source ORDER BY count DESC, source LIMIT 10"),
    "stats_top_entities": (_stat(corpus_stats.top_entities, b.entities), with_views("entities", """
SELECT canonical_name, entity_type, count(*) AS count FROM entities GROUP BY ALL
ORDER BY count DESC, canonical_name, entity_type LIMIT 10""")),
    "marketing_count": (
        _stat(corpus_stats.marketing_count, lambda spark, sf: b.articles(spark, sf, vectors=False)),
        with_views("articles", "SELECT count(*) AS marketing_count FROM articles WHERE subscription_marketing")),
    "distinct_languages": (_stat(corpus_stats.languages),
        "SELECT DISTINCT lang AS detected_language FROM documents WHERE lang IS NOT NULL AND lang <> ''"),
    "entity_directory": (entity_directory, with_views("entities", """
SELECT canonical_name, entity_type, string_agg(DISTINCT raw_name, '|' ORDER BY raw_name) AS aliases,
 count(*) AS occurrence_count FROM entities GROUP BY canonical_name, entity_type""")),
    "entity_cloud": (entity_cloud, with_views("entities", """
SELECT canonical_name, entity_type, string_agg(DISTINCT raw_name, '|' ORDER BY raw_name) AS aliases,
 count(*) AS occurrence_count FROM entities GROUP BY canonical_name, entity_type
ORDER BY occurrence_count DESC, canonical_name, entity_type LIMIT 25""")),
    "translation_pairs": (translation_pairs, with_views("articles", """
SELECT uid, title, detected_language, original_language_summary, summary FROM articles
WHERE detected_language <> 'en' AND summary IS NOT NULL AND original_language_summary IS NOT NULL""")),
    "watermark_lookup": (watermark_lookup, with_views("articles saved", """
SELECT s.id, coalesce(a.datetime, TIMESTAMP '1970-01-01') AS since FROM saved s LEFT JOIN articles a ON a.uid = s.latest_id""")),
    "alerts_batch": (_alerts("datetime"), _alerts_sql("datetime")),
    "alerts_by_arrival": (_alerts("ingested_at"), _alerts_sql("ingested_at")),
    "alerts_advance": (alerts_advance, with_views("articles saved", _match_sql("datetime") + """
SELECT s.id, s.username, s.search_text, coalesce(r.uid, s.latest_id) AS latest_id
FROM saved s LEFT JOIN ranked r ON r.id = s.id AND r.rn = 1""")),
    "alerts_notifications": (alerts_notifications, with_views("articles saved", _match_sql("datetime") + """
SELECT s.id AS search_id, s.username, s.search_text, r.n AS new_results_count, r.title AS newest_title,
 TIMESTAMP '2024-03-01 00:00:00' AS created_at, FALSE AS is_read FROM saved s JOIN ranked r ON r.id = s.id AND r.rn = 1""")),
    "saved_search_seed": (saved_search_seed, with_views("articles saved", _match_sql("datetime", newer=False) + """
SELECT s.id, s.username, coalesce(r.uid, '') AS latest_id FROM saved s LEFT JOIN ranked r ON r.id = s.id AND r.rn = 1""")),
    "topk_per_query": (topk_per_query, with_views("articles saved", f"""
, scored AS (SELECT s.id, a.uid, round({_SIM}, 6) AS similarity FROM saved s CROSS JOIN articles a WHERE {_VEC} IS NOT NULL)
SELECT id, CAST(rn AS INTEGER) AS rank, uid, similarity FROM
 (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, uid) AS rn FROM scored) WHERE rn <= 5""")),
    "history_last10": (history_last10, with_views("history", """
SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY username ORDER BY searched_at DESC, id DESC) <= 10""")),
    "history_append": (history_append, with_views("history saved", """
SELECT * FROM history UNION ALL SELECT id + 10000000, username, search_text, space, created_at FROM saved""")),
    "flag_compaction": (flag_compaction, with_views("articles flag_log", """
, latest AS (SELECT uid, flag_status FROM flag_log QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ts DESC, seq DESC) = 1)
SELECT a.uid, CASE WHEN l.uid IS NOT NULL THEN l.flag_status ELSE a.flag_status END AS flag_status
FROM articles a LEFT JOIN latest l ON l.uid = a.uid""")),
    "unknown_flags": (unknown_flags, with_views("articles flag_log", """
SELECT * FROM flag_log WHERE uid NOT IN (SELECT uid FROM articles WHERE content_type <> 'rss')""")),
    "saved_search_delete": (saved_search_delete, with_views("saved", _DELETIONS + """
SELECT id, username, search_text FROM saved s
WHERE NOT EXISTS (SELECT 1 FROM deletions d WHERE d.id = s.id AND d.username = s.username)""")),
    "saved_search_rejected": (saved_search_rejected, with_views("saved", _DELETIONS + """
SELECT d.id, d.username, CASE WHEN s.id IS NULL THEN 'not found' ELSE 'not owner' END AS reason
FROM deletions d LEFT JOIN saved s ON s.id = d.id WHERE s.id IS NULL OR s.username <> d.username""")),
    "notifications_read": (notifications_read, with_views("notifications", """
SELECT id, username, search_text, new_results_count, newest_title, created_at, is_read OR username = '8' AS is_read
FROM notifications""")),
    "notifications_unread": (notifications_unread, with_views("notifications", """
SELECT username, count(*) FILTER (WHERE NOT is_read) AS unread FROM notifications GROUP BY username""")),
    "saved_searches_newest": (saved_searches_newest, with_views("saved", """
SELECT id, search_text, threshold, created_at FROM saved WHERE username = 'user1'""")),
    "notifications_newest": (notifications_newest, with_views("notifications", """
SELECT id, search_text, created_at, is_read FROM notifications WHERE username = '8'""")),
}
