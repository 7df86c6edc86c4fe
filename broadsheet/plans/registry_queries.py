"""Registered source-registry and ingestion queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.operators import exports, ingest, ingest_job, known_ids, registry
from broadsheet.operators.store import Store
from broadsheet.plans import bindings as b
from broadsheet.plans import stand_ins
from broadsheet.plans.bindings import with_views
from broadsheet.schemas import ARTICLES, align_schema
from broadsheet.session import shared_folder, widen


def _registry(function, *args, **options):
    return lambda spark, sf: function(b.sources(spark, sf), *args, **options)


def sources_scan(spark, sf):
    return registry.ingest_targets(b.sources(spark, sf))


def registry_validate(spark, sf):
    rows = registry.validated(b.submissions(spark, sf))
    return rows.select("arrival", F.array_join("violations", ",").alias("violations"))


def registry_duplicates(spark, sf):
    rows = registry.duplicate_check(b.submissions(spark, sf), b.sources(spark, sf))
    return rows.select("arrival", "url_match", "name_match", "is_duplicate")


def registry_last_numbers(spark, sf):
    return registry.last_numbers(b.sources(spark, sf))


def registry_ids(spark, sf):
    rows = registry.with_new_ids(b.submissions(spark, sf), b.sources(spark, sf))
    return rows.select("arrival", "source_id")


def _inserted(spark, sf):
    return registry.insert_batch(b.submissions(spark, sf), b.sources(spark, sf), F.lit("2024-06-01"))


def registry_insert_accepted(spark, sf):
    return _inserted(spark, sf)[0]


def registry_insert_rejected(spark, sf):
    return _inserted(spark, sf)[1].select("arrival", "source_name", "ingest_url", "reason")


def soft_delete_compaction(spark, sf):
    rows = registry.apply_changes(b.sources(spark, sf), b.registry_changes(spark, sf))
    return rows.select("source_id", "is_deleted", "is_verified")


def registry_activity(spark, sf):
    return exports.registry_activity(b.registry_changes(spark, sf))


def registry_export(spark, sf):
    return exports.registry_export(b.sources(spark, sf), "ra_bob")


# --- ingestion ---------------------------------------------------------------------------


def _raw(spark, sf):
    """Documents and conversations as raw items of two adapters; some uids occur twice."""
    documents = b.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("uid"), "source", F.col("text").alias("body"), F.lit("rss").alias("platform"),
    )
    talks = b.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("uid"), F.col("role").alias("source"), F.col("text").alias("body"),
        F.lit("email").alias("platform"), (F.col("conv_id") * 1000 + F.col("turn")).alias("arrival"),
    )
    first = documents.withColumn("arrival", F.lit(1_000_000_000) + F.col("uid").cast("long"))
    return ingest.combined([first, talks])


def _stored(spark, sf):
    """Already stored ids: every user of the event log, every third one in the old spelling."""
    users = b.table(spark, sf, "events").select("user_id").distinct()
    user = F.col("user_id").cast("string")
    return users.select(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("body"), user)).otherwise(user).alias("uid"))


def union_adapters(spark, sf):
    return _raw(spark, sf).select("uid", "source", "body", "platform", "arrival")


def new_items(spark, sf):
    return ingest.unseen(_raw(spark, sf), _stored(spark, sf)).select("uid", "platform", "arrival")


def mail_new_items(spark, sf):
    return ingest.unseen(_raw(spark, sf), _stored(spark, sf), mail=True).select("uid", "platform", "arrival")


def first_per_uid(spark, sf):
    return ingest.first_per_uid(_raw(spark, sf)).select("uid", "platform", "arrival", "body")


def dedup_new_items(spark, sf):
    return ingest.new_items(_raw(spark, sf), _stored(spark, sf), mail=True).select("uid", "platform", "arrival")


def _fresh_folder(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def append_sink(spark, sf):
    """Store after two overlapping appends."""
    rows = b.articles(spark, sf, vectors=False, labels=False)
    folder = _fresh_folder(spark, "articles")
    ingest.append_articles(spark, rows.filter("content_type in ('rss', 'email')"), folder)
    ingest.append_articles(spark, rows, folder)
    return spark.read.parquet(folder).select("uid", "datetime", "title", "summary", "content_type")


def known_id_lookup(spark, sf):
    """New mail by the filters of two batches of stored ids, and the ids of the buckets these name."""
    layout = known_ids.Layout(buckets=256, bits=1 << 14)
    stored = _stored(spark, sf)
    halves = [stored.filter(F.length("uid") % 2 == k) for k in (0, 1)]
    filters = known_ids.merged([known_ids.filters(h, layout) for h in halves])
    raw = _raw(spark, sf).select("uid", "platform", "arrival")
    spellings = raw.select(F.explode(F.array("uid", F.concat(F.lit(ingest.OLD_MAIL_PREFIX), "uid"))).alias("uid"))
    buckets = known_ids.buckets_to_read(spellings, filters, layout)
    known = known_ids.known(stored, layout).filter(F.col("bucket").isin(buckets))
    return ingest.unseen(raw, known, mail=True)


def ingest_pipeline(spark, sf):
    """Articles, entities and lexicon after two batches that overlap, the second one run twice, and a run that stopped half-way."""
    store = Store(spark, _fresh_folder(spark, "ingested"))
    models = ingest_job.Models(stand_ins.reporter, stand_ins.hashing_embedder)
    at = F.lit("2024-06-01 00:00:00")
    doc = F.col("doc_id")
    items = widen(b.table(spark, sf, "documents")).select(
        doc.cast("string").alias("uid"), (F.expr(b.START) + b._minutes(doc * 37 % 43200)).alias("datetime"), "source",
        F.lit("desk").alias("sender"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat(F.lit("https://a.example/"), doc.cast("string")).alias("url"), F.col("text").alias("body"), F.lit("rss").alias("platform"),
    )
    copies = items.withColumns({"datetime": F.col("datetime") + b._minutes(F.lit(5)), "body": F.lit("a later copy")})
    ingest_job.run_batch(store, "first", [items.filter("cast(uid as long) % 3 <> 0")], models, at)
    for _ in range(2):
        ingest_job.run_batch(store, "second", [items, copies], models, at)
    articles, _ = ingest_job.analysed(copies.withColumns({"uid": F.concat(F.lit("x"), "uid"), "raw_source": F.lit(""), "image_url": F.lit("")}), models, at)
    store.stage("third", articles, ingest_job.ORDER, at)  # never published
    store.compact("folded")
    return (
        store.read("articles").select(F.lit("article").alias("kind"), "uid", F.col("summary").alias("name"), F.col("source").alias("other"))
        .unionByName(store.read("entities").select(F.lit("entity").alias("kind"), "uid", F.col("raw_name").alias("name"), F.col("canonical_name").alias("other")))
        .unionByName(store.read("lexicon").select(F.lit("lexicon").alias("kind"), F.lit("").alias("uid"), F.col("raw_name").alias("name"), F.col("canonical_name").alias("other")))
    )


def word_cap(spark, sf):
    rows = widen(b.table(spark, sf, "documents"))
    rows = rows.select(F.col("doc_id").cast("string").alias("uid"), F.col("text").alias("body"))
    return ingest.with_word_cap(rows, 400)  # lower than the default, which the test texts never reach


def mail_cursor(spark, sf):
    return ingest.highest_mail_uid(_raw(spark, sf))


def mail_ids_union(spark, sf):
    """One listing for each year the orders have; a customer may be in several."""
    rows = b.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("mail_id"))
    years = [r["year"] for r in rows.select("year").distinct().sort("year").collect()]
    return ingest.all_mail_ids([rows.filter(F.col("year") == y).select("mail_id") for y in years])


def align_columns(spark, sf):
    """An older article table without flags, raw payload and vectors, brought to the current columns."""
    old = b.articles(spark, sf, vectors=False, labels=False).drop("flag_status", "raw_email", "english_embedding", "url")
    rows = align_schema(old, ARTICLES)
    return rows.select("uid", "datetime", "url", "raw_email", "flag_status", F.size("english_embedding").alias("dimension"))


_RAW = """raw AS (
 SELECT CAST(doc_id AS VARCHAR) AS uid, source, text AS body, 'rss' AS platform, 1000000000 + doc_id AS arrival FROM documents
 UNION ALL SELECT CAST(conv_id AS VARCHAR), role, text, 'email', conv_id * 1000 + turn FROM conversations),
stored AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'body' || user_id ELSE CAST(user_id AS VARCHAR) END AS uid FROM events)
"""

_PREFIX = """upper(trim(country_iso)) || '_' || CASE lower(platform) WHEN 'telegram' THEN 'TEL' WHEN 'rss' THEN 'RSS'
 WHEN 'newsletter' THEN 'NEW' WHEN 'fediverse' THEN 'FED' ELSE 'SRC' END || '_' ||
 coalesce(nullif(left(regexp_replace(upper(trim(topic_code)), '[^A-Z0-9]', '', 'g'), 4), ''), 'GEN')"""

_LAST = """last_numbers AS (SELECT regexp_replace(source_id, '_[^_]*$', '') AS prefix,
 coalesce(max(TRY_CAST(regexp_extract(source_id, '[^_]*$') AS INTEGER)), 0) AS last_number FROM sources GROUP BY 1)"""


def _ids_sql(of: str) -> str:
    return f"""numbered AS (SELECT s.*, {_PREFIX} AS prefix, row_number() OVER (PARTITION BY {_PREFIX} ORDER BY arrival) AS n FROM {of} s),
 named AS (SELECT s.*, prefix || '_' || printf('%03d', n + coalesce(last_number, 0)) AS source_id
  FROM numbered s LEFT JOIN last_numbers USING (prefix))"""


_VIOLATIONS = """concat_ws(',',
 CASE WHEN length(source_name) NOT BETWEEN 2 AND 150 THEN 'source_name_length' END,
 CASE WHEN length(ingest_url) < 5 THEN 'ingest_url_length' END,
 CASE WHEN length(primary_language) NOT BETWEEN 2 AND 10 THEN 'primary_language_length' END,
 CASE WHEN length(input_by) NOT BETWEEN 2 AND 100 THEN 'input_by_length' END,
 CASE WHEN length(country_iso) NOT BETWEEN 2 AND 5 THEN 'country_iso_length' END,
 CASE WHEN length(topic_code) NOT BETWEEN 2 AND 10 THEN 'topic_code_length' END,
 CASE WHEN length(languages_spoken) > 200 THEN 'languages_spoken_length' END,
 CASE WHEN length(geographic_focus) > 200 THEN 'geographic_focus_length' END,
 CASE WHEN platform NOT IN ('telegram', 'rss', 'newsletter', 'fediverse') THEN 'platform_unknown' END,
 CASE WHEN publisher_type NOT IN ('state_media', 'independent_journalist', 'civil_society', 'anonymous_influencer',
  'consumer_news', 'cultural_music_art', 'gossip_celebrity', 'newsfluencer', 'mainstream_publication', 'sport',
  'technology_science', 'pr_news_agency', 'other') THEN 'publisher_type_unknown' END,
 CASE WHEN platform = 'telegram' AND ingest_url NOT LIKE '%t.me/%' AND ingest_url NOT LIKE '%telegram.me/%' THEN 'telegram_url' END,
 CASE WHEN platform = 'telegram' AND (ingest_url LIKE '%+%' OR ingest_url LIKE '%#%' OR ingest_url LIKE '%joinchat%') THEN 'telegram_private' END)"""

_JUDGED = f"""checked AS (SELECT *, {_VIOLATIONS} AS violations, trim(ingest_url) AS url FROM submissions),
 firsts AS (SELECT url, min(arrival) AS first_arrival FROM checked WHERE violations = '' GROUP BY url),
 held AS (SELECT ingest_url AS url, bool_or(NOT is_deleted) AS active FROM sources GROUP BY ingest_url),
 judged AS (SELECT c.*, CASE WHEN violations <> '' THEN 'invalid: ' || violations WHEN active THEN 'duplicate active url'
  WHEN NOT active THEN 'url held by a deleted source' WHEN arrival > first_arrival THEN 'duplicate active url' END AS reason
  FROM checked c LEFT JOIN firsts USING (url) LEFT JOIN held USING (url)),
 accepted AS (SELECT * FROM judged WHERE reason IS NULL)"""


def _grouped(column: str) -> str:
    return with_views("sources", f"SELECT {column}, count(*) AS count FROM sources WHERE NOT is_deleted GROUP BY 1")


QUERIES = {
    "sources_scan": (sources_scan, with_views("sources", r"""
SELECT platform, source_name, ingest_url, CASE platform WHEN 'rss' THEN ingest_url
 WHEN 'telegram' THEN regexp_replace(ingest_url, '^.*/([^/]+)$', '\1')
 WHEN 'fediverse' THEN regexp_extract(ingest_url, '.*/(@.*)$', 1) || '@' || regexp_extract(ingest_url, 'https?://([^/]+)/.*', 1)
 END AS target FROM sources WHERE NOT is_deleted""")),
    "registry_list": (_registry(registry.listed, input_by=" RA_BOB "),
        with_views("sources", "SELECT * FROM sources WHERE NOT is_deleted AND input_by = 'ra_bob'")),
    "registry_list_normalised": (_registry(registry.listed, include_deleted=True, input_by="ra_carol", normalise=True),
        with_views("sources", "SELECT * FROM sources WHERE lower(input_by) = 'ra_carol'")),
    "registry_text_filter": (_registry(registry.text_filtered, " Chan1", "telegram"), with_views("sources", """
SELECT * FROM sources WHERE platform = 'telegram' AND (contains(lower(source_id), 'chan1') OR contains(lower(source_name), 'chan1')
 OR contains(lower(ingest_url), 'chan1') OR contains(lower(primary_language), 'chan1')
 OR contains(lower(publisher_type), 'chan1') OR contains(lower(input_by), 'chan1'))""")),
    "registry_validate": (registry_validate,
        with_views("submissions", f"SELECT arrival, {_VIOLATIONS} AS violations FROM submissions")),
    "registry_duplicates": (registry_duplicates, with_views("sources", """
, active AS (SELECT * FROM sources WHERE NOT is_deleted)
SELECT arrival, url_match, name_match, url_match IS NOT NULL OR name_match IS NOT NULL AS is_duplicate FROM
 (SELECT arrival, (SELECT min(source_id) FROM active a WHERE a.ingest_url = trim(s.ingest_url)) AS url_match,
  (SELECT min(source_id) FROM active a WHERE a.source_name = trim(s.source_name)) AS name_match FROM submissions s)""")),
    "registry_last_numbers": (registry_last_numbers, with_views("sources", f", {_LAST} SELECT * FROM last_numbers")),
    "registry_ids": (registry_ids, with_views("sources",
        f", {_LAST}, {_ids_sql('submissions')} SELECT arrival, source_id FROM named")),
    "registry_insert_accepted": (registry_insert_accepted, with_views("sources", f""", {_LAST}, {_JUDGED}, {_ids_sql('accepted')}
SELECT source_id, trim(source_name) AS source_name, platform, url AS ingest_url, lower(trim(primary_language)) AS primary_language,
 coalesce(trim(languages_spoken), '') AS languages_spoken, coalesce(trim(geographic_focus), '') AS geographic_focus,
 publisher_type, trim(input_by) AS input_by, DATE '2024-06-01' AS date_added, gating_passed, activity_passed, telegram_passed,
 FALSE AS is_verified, FALSE AS is_deleted FROM named""")),
    "registry_insert_rejected": (registry_insert_rejected, with_views("sources", f""", {_JUDGED}
SELECT arrival, source_name, ingest_url, reason FROM judged WHERE reason IS NOT NULL""")),
    "soft_delete_compaction": (soft_delete_compaction, with_views("sources registry_changes", """
, d AS (SELECT source_id, action FROM registry_changes WHERE action IN ('delete', 'restore')
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, seq DESC) = 1),
v AS (SELECT source_id, action FROM registry_changes WHERE action IN ('verify', 'unverify')
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, seq DESC) = 1)
SELECT s.source_id, coalesce(d.action = 'delete', s.is_deleted) AS is_deleted, coalesce(v.action = 'verify', s.is_verified) AS is_verified
FROM sources s LEFT JOIN d USING (source_id) LEFT JOIN v USING (source_id)""")),
    "registry_activity": (registry_activity, with_views("registry_changes", """
SELECT ts, CAST(ts AS DATE) AS day, actor, action, source_id FROM registry_changes""")),
    "registry_export": (registry_export, with_views("sources", "SELECT * FROM sources WHERE input_by = 'ra_bob'")),
    "registry_stats": (_registry(registry.totals), with_views("sources", """
SELECT count(*) FILTER (WHERE NOT is_deleted) AS total_active, count(*) FILTER (WHERE NOT is_deleted AND is_verified) AS total_verified,
 count(*) FILTER (WHERE is_deleted) AS total_deleted FROM sources""")),
    "registry_stats_auditor": (_registry(registry.totals, "ra_amina"), with_views("sources", """
SELECT count(*) FILTER (WHERE NOT is_deleted) AS total_active, count(*) FILTER (WHERE NOT is_deleted AND is_verified) AS total_verified,
 count(*) FILTER (WHERE is_deleted) AS total_deleted FROM sources WHERE input_by = 'ra_amina'""")),
    "registry_by_platform": (_registry(registry.by_platform), with_views("sources", """
SELECT p.platform, count(s.source_id) AS count FROM (VALUES ('telegram'), ('rss'), ('newsletter'), ('fediverse')) p(platform)
LEFT JOIN sources s ON s.platform = p.platform AND NOT s.is_deleted GROUP BY 1""")),
    "registry_by_type": (_registry(registry.by_column, "publisher_type"), _grouped("publisher_type")),
    "registry_by_language": (_registry(registry.by_column, "primary_language"), _grouped("primary_language")),
    "registry_by_country": (_registry(registry.by_country), _grouped("split_part(source_id, '_', 1) AS country")),
    "union_adapters": (union_adapters, f"WITH {_RAW} SELECT * FROM raw"),
    "new_items": (new_items, f"""WITH {_RAW} SELECT uid, platform, arrival FROM raw WHERE uid NOT IN (SELECT uid FROM stored)"""),
    "mail_new_items": (mail_new_items, f"""WITH {_RAW} SELECT uid, platform, arrival FROM raw
WHERE uid NOT IN (SELECT uid FROM stored) AND 'body' || uid NOT IN (SELECT uid FROM stored)"""),
    "first_per_uid": (first_per_uid, f"""WITH {_RAW} SELECT uid, platform, arrival, body FROM raw
QUALIFY row_number() OVER (PARTITION BY uid ORDER BY arrival) = 1"""),
    "dedup_new_items": (dedup_new_items, f"""WITH {_RAW} SELECT uid, platform, arrival FROM raw
WHERE uid NOT IN (SELECT uid FROM stored) AND 'body' || uid NOT IN (SELECT uid FROM stored)
QUALIFY row_number() OVER (PARTITION BY uid ORDER BY arrival) = 1"""),
    "append_sink": (append_sink, with_views("articles", "SELECT uid, datetime, title, summary, content_type FROM articles")),
    "word_cap": (word_cap, r"""
WITH w AS (SELECT doc_id, text, string_split(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), ' ') AS words FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS uid, text AS body,
 CASE WHEN len(words) > 400 THEN array_to_string(words[1:400], ' ') ELSE text END AS model_text,
 len(words) > 400 AS truncated FROM w"""),
    "mail_cursor": (mail_cursor, f"WITH {_RAW} SELECT max(TRY_CAST(uid AS BIGINT)) AS last_uid FROM raw"),
    "mail_ids_union": (mail_ids_union,
        "SELECT mail_id FROM (SELECT DISTINCT year(o_orderdate) AS y, o_custkey AS mail_id FROM orders) GROUP BY mail_id"),
    "known_id_lookup": (known_id_lookup, f"""WITH {_RAW} SELECT uid, platform, arrival FROM raw
WHERE uid NOT IN (SELECT uid FROM stored) AND 'body' || uid NOT IN (SELECT uid FROM stored)"""),
    "ingest_pipeline": (ingest_pipeline, with_views("articles", r"""
, capped AS (SELECT doc_id, source, text, string_split(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), ' ') AS words FROM documents),
 prompts AS (SELECT doc_id, source, 'Title: ' || split_part(text, chr(10), 1) || chr(10) || 'Sender: desk' || chr(10) || chr(10) ||
  CASE WHEN len(words) > 12000 THEN array_to_string(words[1:12000], ' ') ELSE text END AS prompt FROM capped),
 made AS (SELECT CAST(doc_id AS VARCHAR) AS uid, source, prompt, md5('organisation ' || (length(prompt) % 40)) AS org, length(prompt) % 2 AS odd,
  doc_id % 3 = 0 AS later, TIMESTAMP '2024-01-01' + INTERVAL (doc_id * 37 % 43200) MINUTE AS dated FROM prompts WHERE length(prompt) % 11 <> 0),
 spelled AS (SELECT *, CASE WHEN odd = 1 THEN upper(org) ELSE org END AS name FROM made),
 firsts AS (SELECT org, arg_min(name, row(later, dated, uid)) AS canonical FROM spelled GROUP BY org)
SELECT 'article' AS kind, uid, md5(prompt) AS name, source AS other FROM spelled
UNION ALL SELECT 'entity', uid, name, canonical FROM spelled JOIN firsts USING (org)
UNION ALL SELECT 'lexicon', '', canonical, canonical FROM firsts""")),
    "align_schema": (align_columns, with_views("articles", """
SELECT uid, datetime, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS raw_email, CAST(NULL AS VARCHAR) AS flag_status,
 CAST(NULL AS INTEGER) AS dimension FROM articles""")),
}
