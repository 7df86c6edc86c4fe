"""Registered search queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from broadsheet.functions import keyword, vectors
from broadsheet.operators import exports, search
from broadsheet.operators.search import SearchRequest
from broadsheet.plans import bindings as b
from broadsheet.plans.bindings import with_views
from broadsheet.session import cut_lineage, shared_folder


def _request(spark, sf, **options) -> SearchRequest:
    return SearchRequest(query_vector=b.query_vector(spark, sf), **options)


def _cos(column: str, query: str = "(SELECT embedding FROM embeddings WHERE vec_id = 0)") -> str:
    a, q = f"{column}::DOUBLE[]", f"{query}::DOUBLE[]"
    return (
        f"(list_dot_product({a}, {q}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({q}, {q}))))"
    )


COS_EN, COS_ML = _cos("english_embedding"), _cos("multilingual_embedding")


def semantic_topk(spark, sf):
    request = _request(spark, sf, threshold=0.1, language="en", limit=20)
    rows = search.top_similar(b.articles(spark, sf, labels=False), request)
    return rows.withColumn("similarity", F.round("similarity", 6))


def semantic_multilingual(spark, sf):
    request = _request(spark, sf, space="multilingual", limit=50)
    rows = search.top_similar(b.articles(spark, sf, labels=False), request)
    return rows.select("uid", F.round("similarity", 6).alias("similarity"))


def semantic_by_date(spark, sf):
    request = _request(spark, sf, threshold=0.05, sort_by="date", limit=30)
    return search.page(search.hits(b.articles(spark, sf, labels=False), request), request).select("uid", "datetime")


def semantic_threshold_count(spark, sf):
    request = _request(spark, sf, threshold=0.15)
    return search.total(search.hits(b.articles(spark, sf, labels=False), request))


def search_filters(spark, sf):
    request = _request(
        spark, sf, content_type="Email, rss", start_date="2024-01-03", end_date="2024-01-25", language="EN", threshold=0.01,
    )
    rows = search.hits(b.articles(spark, sf, labels=False), request)
    return rows.select("uid", "datetime", "content_type", F.round("similarity", 6).alias("similarity"))


def search_filters_whole_day(spark, sf):
    request = _request(spark, sf, end_date="2024-01-09", end_inclusive_day=True, content_type="all,rss")
    return search.hits(b.articles(spark, sf, labels=False), request).select("uid", "datetime")


def search_timeline(spark, sf):
    request = _request(spark, sf, threshold=0.1)
    return search.timeline(search.hits(b.articles(spark, sf, labels=False), request))


def timeline_gapfill(spark, sf):
    request = _request(spark, sf, threshold=0.25)
    return search.gap_filled(search.timeline(search.hits(b.articles(spark, sf, labels=False), request)))


def search_page_offset(spark, sf):
    request = _request(spark, sf, offset=40, limit=20)
    rows = search.page(search.hits(b.articles(spark, sf, labels=False), request), request)
    return rows.select("uid", F.round("similarity", 6).alias("similarity"))


def search_page_seek(spark, sf):
    """The third page, reached from cursor to cursor."""
    request = _request(spark, sf, limit=20)
    found = search.hits(b.articles(spark, sf, labels=False), request)
    # Scored once, and without the texts: a page that is written takes with it whatever columns its rows have.
    found = cut_lineage(found.select("uid", "datetime", "similarity"))
    cursor = None
    for _ in range(3):
        rows = cut_lineage(search.page_after(found, request, cursor))
        cursor = search.cursor_after(rows, request)
    return rows.select("uid", F.round("similarity", 6).alias("similarity"))


def page_numbers(spark, sf):
    request = _request(spark, sf, threshold=0.05)
    totals = search.total(search.hits(b.articles(spark, sf, labels=False), request))
    return search.page_numbers(totals, offset=40)


def vector_norms(spark, sf):
    rows = b.table(spark, sf, "embeddings")
    return rows.select(
        "vec_id",
        F.round(vectors.norm(F.col("embedding")), 6).alias("norm"),
        vectors.has_dimension(F.col("embedding"), 64).alias("usable"),
    )


def _keyword(text: str, space: str = "english", compat: bool = False):
    def run(spark, sf):
        rows = b.articles(spark, sf, vectors=False, labels=False)
        return rows.filter(keyword.matches(text, space, compat)).select("uid")

    return run


def _ilike(pattern: str, column: str = "summary") -> str:
    quoted = pattern.replace("'", "''")
    return f"(title ILIKE '{quoted}' OR {column} ILIKE '{quoted}')"


def _keyword_sql(where: str) -> str:
    return with_views("articles", f"SELECT uid FROM articles WHERE {where}")


def _near(a: str, c: str, n: int) -> str:
    return f"regexp_matches(summary, '{keyword.near_pattern(a, c, n)}', 'i')"


def keyword_page(spark, sf):
    request = SearchRequest(text="there* NOT blethe", content_type="rss,email", sort_by="similarity", limit=25, offset=5)
    rows = search.page(search.hits(b.articles(spark, sf, labels=False), request), request)
    return rows.select("uid", "datetime", "similarity")


def highlight_terms(spark, sf):
    rows = b.articles(spark, sf, vectors=False, labels=False).filter(keyword.matches("Thet OR étion"))
    return search.highlighted(rows, "Thet OR étion").select("uid", "title", "summary")


def entities_per_article(spark, sf):
    return search.entity_counts(b.entities(spark, sf))


def search_results(spark, sf):
    request = _request(spark, sf, limit=100)
    rows = search.results(b.articles(spark, sf, labels=False), b.entities(spark, sf), request)
    return rows.select(
        "uid", "title", "summary", "source", "detected_language", "content_type", "has_raw_email",
        F.round("similarity", 6).alias("similarity"), search.entity_text(F.col("entities")).alias("entity_list"),
        F.array_join("topics", "|").alias("topics"),
    )


def csv_projection(spark, sf):
    request = _request(spark, sf, threshold=0.05, language="fr", content_type="email,rss,telegram")
    return exports.result_export(b.articles(spark, sf, labels=False), b.entities(spark, sf), request)


def csv_export(spark, sf):
    """All results written in parts and read back."""
    request = _request(spark, sf, threshold=0.05, language="fr", content_type="email,rss,telegram")
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    exports.write_ordered_csv(b.articles(spark, sf, labels=False), b.entities(spark, sf), request, folder)
    return exports.read_csv(spark, folder)


def raw_exports(spark, sf):
    return exports.raw_exports(b.articles(spark, sf, vectors=False, labels=False))


_PAGE_SQL = "ORDER BY {cos} DESC, uid LIMIT {n} OFFSET {o}"
_ENTITY_LIST = (
    "lists AS (SELECT uid, string_agg(canonical_name || ':' || entity_type, ';' "
    "ORDER BY canonical_name || ':' || entity_type) AS entity_list FROM entities GROUP BY uid)"
)

QUERIES = {
    "semantic_topk": (semantic_topk, with_views("articles", f"""
SELECT uid, title, round({COS_EN}, 6) AS similarity, CAST(floor({COS_EN} * 100 + 0.5) AS INTEGER) AS percent FROM articles
WHERE english_embedding IS NOT NULL AND detected_language = 'en' AND {COS_EN} >= 0.1
{_PAGE_SQL.format(cos=COS_EN, n=20, o=0)}""")),
    "semantic_multilingual": (semantic_multilingual, with_views("articles", f"""
SELECT uid, round({COS_ML}, 6) AS similarity FROM articles WHERE multilingual_embedding IS NOT NULL
{_PAGE_SQL.format(cos=COS_ML, n=50, o=0)}""")),
    "semantic_by_date": (semantic_by_date, with_views("articles", f"""
SELECT uid, datetime FROM articles WHERE english_embedding IS NOT NULL AND {COS_EN} >= 0.05
ORDER BY datetime DESC, uid LIMIT 30""")),
    "semantic_threshold_count": (semantic_threshold_count, with_views("articles", f"""
SELECT count(*) AS total_count FROM articles WHERE english_embedding IS NOT NULL AND {COS_EN} >= 0.15""")),
    "search_filters": (search_filters, with_views("articles", f"""
SELECT uid, datetime, content_type, round({COS_EN}, 6) AS similarity FROM articles
WHERE english_embedding IS NOT NULL AND content_type IN ('email', 'rss') AND datetime >= TIMESTAMP '2024-01-03'
 AND datetime <= TIMESTAMP '2024-01-25' AND detected_language = 'en' AND {COS_EN} >= 0.01""")),
    "search_filters_whole_day": (search_filters_whole_day, with_views("articles", """
SELECT uid, datetime FROM articles WHERE english_embedding IS NOT NULL AND datetime < TIMESTAMP '2024-01-10'""")),
    "search_timeline": (search_timeline, with_views("articles", f"""
SELECT CAST(datetime AS DATE) AS dt, count(*) AS cnt FROM articles
WHERE english_embedding IS NOT NULL AND {COS_EN} >= 0.1 GROUP BY 1""")),
    "timeline_gapfill": (timeline_gapfill, with_views("articles", f"""
, days AS (SELECT CAST(datetime AS DATE) AS dt, count(*) AS cnt FROM articles
  WHERE english_embedding IS NOT NULL AND {COS_EN} >= 0.25 GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS dt
  FROM (SELECT min(dt) AS lo, max(dt) AS hi FROM days))
SELECT spine.dt, coalesce(cnt, 0) AS cnt FROM spine LEFT JOIN days ON spine.dt = days.dt""")),
    "search_page_offset": (search_page_offset, with_views("articles", f"""
SELECT uid, round({COS_EN}, 6) AS similarity FROM articles WHERE english_embedding IS NOT NULL
{_PAGE_SQL.format(cos=COS_EN, n=20, o=40)}""")),
    "search_page_seek": (search_page_seek, with_views("articles", f"""
SELECT uid, round({COS_EN}, 6) AS similarity FROM articles WHERE english_embedding IS NOT NULL
{_PAGE_SQL.format(cos=COS_EN, n=20, o=40)}""")),
    "page_numbers": (page_numbers, with_views("articles", f"""
SELECT n AS total_count, CAST(ceil(n / 20) AS BIGINT) AS total_pages, CAST(3 AS BIGINT) AS current_page,
 CAST(20 AS BIGINT) AS previous_offset, CAST(CASE WHEN n > 60 THEN 60 END AS BIGINT) AS next_offset,
 CAST((greatest(ceil(n / 20), 1) - 1) * 20 AS BIGINT) AS last_offset
FROM (SELECT count(*) AS n FROM articles WHERE english_embedding IS NOT NULL AND {COS_EN} >= 0.05)""")),
    "vector_norms": (vector_norms, """
SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
 len(embedding) = 64 AS usable FROM embeddings"""),
    "keyword_term": (_keyword("hinhea*"), _keyword_sql(_ilike("%hinhea%"))),
    "keyword_wildcards": (_keyword("t?er*ing"), _keyword_sql(_ilike("%t_er%ing%"))),
    "keyword_phrase": (_keyword('"of the"'), _keyword_sql(_ilike("%of the%"))),
    "keyword_near": (_keyword("there NEAR/3 with"), _keyword_sql(_near("there", "with", 3))),
    "keyword_near_phrase": (_keyword('ÉTION near/2 "le la"'), _keyword_sql(_near("ÉTION", "le la", 2))),
    "keyword_boolean": (
        _keyword('(thering OR "en la") AND NOT (wher* under) blea'),
        _keyword_sql(
            f"({_ilike('%thering%')} OR {_ilike('%en la%')}) AND NOT ({_ilike('%wher%')} AND {_ilike('%under%')})"
            f" AND {_ilike('%blea%')}"
        ),
    ),
    "keyword_precedence": (
        _keyword("ieren or thand not tion and les"),
        _keyword_sql(f"{_ilike('%ieren%')} OR ({_ilike('%thand%')} AND NOT {_ilike('%tion%')} AND {_ilike('%les%')})"),
    ),
    "keyword_null_summary": (
        _keyword("NOT there", "multilingual"),
        _keyword_sql(f"NOT {_ilike('%there%', 'original_language_summary')}"),
    ),
    "keyword_malformed": (_keyword('of the AND'), _keyword_sql(_ilike("%of the AND%"))),
    "keyword_word_operators": (_keyword("thand ored"), _keyword_sql(f"{_ilike('%thand%')} AND {_ilike('%ored%')}")),
    "keyword_compat_operators": (
        _keyword("thand ored", compat=True), _keyword_sql(f"{_ilike('%thand%')} OR {_ilike('%ed%')}")
    ),
    "keyword_page": (keyword_page, with_views("articles", f"""
SELECT uid, datetime, CAST(1.0 AS DOUBLE) AS similarity FROM articles
WHERE english_embedding IS NOT NULL AND {_ilike('%there%')} AND NOT {_ilike('%blethe%')} AND content_type IN ('rss', 'email')
ORDER BY datetime DESC, uid LIMIT 25 OFFSET 5""")),
    "highlight_terms": (highlight_terms, with_views("articles", f"""
SELECT uid, regexp_replace(title, '(Thet|tion)', '<em>\\1</em>', 'gi') AS title,
 regexp_replace(summary, '(Thet|tion)', '<em>\\1</em>', 'gi') AS summary
FROM articles WHERE {_ilike('%Thet%')} OR {_ilike('%étion%')}""")),
    "entities_per_article": (entities_per_article, with_views("entities", """
SELECT uid, canonical_name, entity_type, count(*) AS mentions FROM entities GROUP BY ALL""")),
    "search_results": (search_results, with_views("articles entities", f"""
, page AS (SELECT *, {COS_EN} AS similarity FROM articles WHERE english_embedding IS NOT NULL
 {_PAGE_SQL.format(cos=COS_EN, n=100, o=0)}), {_ENTITY_LIST}
SELECT page.uid, title, summary, source, detected_language, content_type,
 raw_email IS NOT NULL AND raw_email <> '' AS has_raw_email, round(similarity, 6) AS similarity,
 coalesce(entity_list, '') AS entity_list, array_to_string(topics, '|') AS topics
FROM page LEFT JOIN lists ON lists.uid = page.uid""")),
    "csv_projection": (csv_projection, with_views("articles entities", f"""
, page AS (SELECT *, {COS_EN} AS similarity FROM articles
 WHERE english_embedding IS NOT NULL AND content_type IN ('email', 'rss', 'telegram') AND {COS_EN} >= 0.05
 {_PAGE_SQL.format(cos=COS_EN, n=10000, o=0)}), {_ENTITY_LIST}
SELECT page.uid AS "UID", strftime(datetime, '%Y-%m-%d %H:%M:%S') AS "Date", source AS "Source", sender AS "Sender",
 title AS "Title", url AS "URL", summary AS "English Summary", coalesce(original_language_summary, '') AS "Original Summary",
 detected_language AS "Detected Language", content_type AS "Content Type", array_to_string(topics, ';') AS "Topics",
 array_to_string(themes, ';') AS "Themes", array_to_string(keywords, ';') AS "Keywords",
 printf('%.4f', similarity) AS "Cosine Similarity Score", coalesce(entity_list, '') AS "Resolved Entities"
FROM page LEFT JOIN lists ON lists.uid = page.uid""")),
    "csv_export": (csv_export, with_views("articles entities", f"""
, page AS (SELECT *, {COS_EN} AS similarity FROM articles
 WHERE english_embedding IS NOT NULL AND content_type IN ('email', 'rss', 'telegram') AND {COS_EN} >= 0.05
), {_ENTITY_LIST}
SELECT page.uid AS "UID", strftime(datetime, '%Y-%m-%d %H:%M:%S') AS "Date", source AS "Source", sender AS "Sender",
 title AS "Title", url AS "URL", summary AS "English Summary", coalesce(original_language_summary, '') AS "Original Summary",
 detected_language AS "Detected Language", content_type AS "Content Type", array_to_string(topics, ';') AS "Topics",
 array_to_string(themes, ';') AS "Themes", array_to_string(keywords, ';') AS "Keywords",
 printf('%.4f', similarity) AS "Cosine Similarity Score", coalesce(entity_list, '') AS "Resolved Entities"
FROM page LEFT JOIN lists ON lists.uid = page.uid""")),
    "raw_exports": (raw_exports, with_views("articles", r"""
SELECT uid, coalesce(nullif(substr(trim(regexp_replace(coalesce(nullif(title, ''), 'content'), '[^\p{L}\p{N} _-]', '', 'g')), 1, 50), ''), 'download')
  || CASE WHEN content_type IN ('email', 'gmail', 'imap') THEN '.eml' ELSE '.txt' END AS filename,
 CASE WHEN content_type IN ('email', 'gmail', 'imap') THEN 'message/rfc822' ELSE 'text/plain' END AS mime_type,
 raw_email AS content
FROM articles WHERE raw_email IS NOT NULL AND raw_email <> ''""")),
}
