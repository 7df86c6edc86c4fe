"""The given tables seen as articles, entities, user state and registry.

Every view exists twice: as a DataFrame and, in ``VIEWS``, as the SQL the
registered queries are checked against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(number: Column, *values: str) -> Column:
    """Value at position ``number`` modulo the number of values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _minutes(count: Column) -> Column:
    return F.make_dt_interval(mins=count.cast("int"))


START = "timestamp_ntz'2024-01-01 00:00:00'"
TYPES = ("email", "rss", "telegram", "subscription", "fediverse")


def articles(spark: SparkSession, sf: str, vectors: bool = True, labels: bool = True) -> DataFrame:
    """Documents as articles; ``vectors``/``labels`` off spares the joins a query has no use for."""
    rows = table(spark, sf, "documents")
    if vectors:
        found = table(spark, sf, "embeddings").select("vec_id", "embedding")
        english = found.withColumnsRenamed({"vec_id": "doc_id", "embedding": "english_embedding"})
        # The multilingual vector is the neighbour's: ids 0 and 1, 2 and 3, ... swap.
        other = found.select(
            F.col("vec_id").bitwiseXOR(F.lit(1).cast("long")).alias("doc_id"),
            F.col("embedding").alias("multilingual_embedding"),
        )
        rows = rows.join(english, "doc_id", "left").join(other, "doc_id", "left")
    else:
        rows = rows.withColumns({
            "english_embedding": F.lit(None).cast("array<float>"),
            "multilingual_embedding": F.lit(None).cast("array<float>"),
        })
    if labels:
        rows = rows.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(None).cast("int"))
    doc, text, lang = F.col("doc_id"), F.col("text"), F.col("lang")
    published = F.expr(START) + _minutes(doc * 37 % 43200)
    return rows.select(
        doc.cast("string").alias("uid"),
        published.alias("datetime"),
        F.col("source"),
        F.concat(F.lit("desk@"), "source", F.lit(".example")).alias("sender"),
        F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example/a/"), doc.cast("string")).alias("url"),
        text.alias("summary"),
        F.when((lang != "en") | (doc % 3 != 0), text).alias("original_language_summary"),
        lang.alias("detected_language"),
        F.lit(False).alias("truncated"),
        _pick(doc, *TYPES).alias("content_type"),
        F.array(F.concat(F.lit("topic "), lang), F.col("source")).alias("topics"),
        F.array(F.concat(F.lit("theme "), _pick(doc, *TYPES))).alias("themes"),
        F.split(F.lower(F.split_part(text, F.lit("\n"), F.lit(1))), " ").alias("keywords"),
        (F.coalesce("quality", F.lit(1)) == 0).alias("subscription_marketing"),
        "english_embedding",
        "multilingual_embedding",
        F.when(doc % 4 == 1, "").when(doc % 4 != 0, text).alias("raw_email"),
        F.lit(None).cast("string").alias("flag_status"),
        (published + _minutes(doc % 90)).alias("ingested_at"),
    )


def entities(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("uid"), F.col("p_type").alias("entity_type"),
        F.col("p_name").alias("raw_name"), F.col("p_brand").alias("canonical_name"),
    )


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    """One stored vector as the query of a search (a single row)."""
    row = table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


def history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("username"),
        F.col("event_type").alias("search_text"), F.lit("english").alias("space"), F.col("ts").alias("searched_at"),
    )


def saved_searches(spark: SparkSession, sf: str) -> DataFrame:
    """One saved search per label; its query is the label's vector with the lowest id."""
    first = table(spark, sf, "embeddings").groupBy("label").agg(
        F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("embedding")
    )
    label = F.col("label")
    return first.select(
        label.cast("long").alias("id"),
        F.concat(F.lit("user"), (label % 3).cast("string")).alias("username"),
        F.concat(F.lit("label "), label.cast("string")).alias("search_text"),
        F.when(label % 2 == 0, "english").otherwise("multilingual").alias("space"),
        (F.lit(0.05) + label.cast("double") / 100).alias("threshold"),
        F.when(label % 3 == 0, "").otherwise(F.col("vec_id").cast("string")).alias("latest_id"),
        (F.expr(START) + _minutes(label)).alias("created_at"),
        F.col("embedding").cast("array<double>").alias("query_vector"),
    )


def notifications(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("username"),
        F.col("event_type").alias("search_text"), F.floor("value").cast("long").alias("new_results_count"),
        F.col("props").alias("newest_title"), F.col("ts").alias("created_at"),
        (F.col("event_type") == "view").alias("is_read"),
    )


def flag_log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").filter(kind.isin("click", "view", "error")).select(
        F.col("user_id").cast("string").alias("uid"),
        F.when(kind == "click", "Flagged").when(kind == "view", "Cleared").alias("flag_status"),
        "ts", F.col("event_id").alias("seq"),
    )


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as submitted sources, with duplicates, private links and broken values among them."""
    rows = table(spark, sf, "supplier").join(
        table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey"
    )
    key = F.col("s_suppkey")
    # Every tenth source repeats the address of the one four ids before it (same platform).
    site = F.when(key % 10 == 7, key - 4).otherwise(key).cast("string")
    platform = _pick(key, "telegram", "rss", "newsletter", "fediverse")
    url = (
        F.when((key % 4 == 0) & (key % 3 == 0), F.concat(F.lit("https://t.me/+joinchat/x"), site))
        .when(key % 4 == 0, F.concat(F.lit(" https://t.me/s/chan"), site))
        .when(key % 4 == 3, F.concat(F.lit("https://social"), site, F.lit(".example/@desk"), site))
        .otherwise(F.concat(F.lit("https://site"), site, F.lit(".example/feed")))
    )
    return rows.select(
        key.alias("arrival"),
        F.when(key % 13 == 5, "X").otherwise(F.col("s_name")).alias("source_name"),
        platform.alias("platform"),
        url.alias("ingest_url"),
        _pick(F.floor(key / 5), "en", "FR", "de").alias("primary_language"),
        F.when(key % 2 == 0, "en, fr").alias("languages_spoken"),
        F.col("n_name").alias("geographic_focus"),
        _pick(key, "sport", "other", "civil_society", "state_media", "blog").alias("publisher_type"),
        _pick(F.floor(key / 7), "ra_amina", "ra_bob", "Ra_Carol").alias("input_by"),
        F.lit(True).alias("gating_passed"),
        (key % 2 == 0).alias("activity_passed"),
        F.lit(True).alias("telegram_passed"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("country_iso"),
        _pick(key, "POL", "eco-nomy", "tec", "##").alias("topic_code"),
    )


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """The stored registry: every third supplier, some of them soft-deleted."""
    rows = submissions(spark, sf).filter(F.col("arrival") % 3 == 1)
    key = F.col("arrival")
    code = _pick(key, "TEL", "RSS", "NEW", "FED")
    return rows.select(
        F.concat_ws("_", "country_iso", code, _pick(key, "POL", "ECON", "TEC", "GEN"),
                    F.when(key < 1000, F.lpad(key.cast("string"), 3, "0")).otherwise(key.cast("string"))).alias("source_id"),
        "source_name", "platform", F.trim("ingest_url").alias("ingest_url"),
        F.lower("primary_language").alias("primary_language"),
        F.coalesce("languages_spoken", F.lit("")).alias("languages_spoken"),
        "geographic_focus", "publisher_type", "input_by",
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 200).cast("int")).alias("date_added"),
        "gating_passed", "activity_passed", "telegram_passed",
        (key % 2 == 0).alias("is_verified"), (key % 7 == 0).alias("is_deleted"),
    )


def registry_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as administrative actions on the source of the same supplier number."""
    rows = sources(spark, sf).select("source_id", F.split_part("source_id", F.lit("_"), F.lit(4)).cast("long").alias("supplier"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.join(rows, orders.o_custkey == rows.supplier).select(
        "source_id", F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
        _pick(F.col("o_orderkey"), "delete", "verify", "restore", "unverify").alias("action"),
        F.lit("admin").alias("actor"),
    )


# Typed by hand on both sides: a name pattern that both regex dialects read alike.
NAME = "[A-Z][a-z]+"


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Capitalised words of all documents as entity mentions in reading order."""
    words = F.regexp_extract_all("text", F.lit(NAME), F.lit(0))
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.posexplode(words).alias("pos", "raw_name"))
    kind = F.when(F.col("lang") == "en", "PERSON").when(F.col("lang") == "fr", "ORG").when(F.col("lang") == "de", "GPE")
    return rows.select(
        F.col("doc_id").cast("string").alias("uid"), F.struct("doc_id", "pos").alias("seq"), "raw_name",
        kind.otherwise("LOC").alias("entity_type"),
    )


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Capitalised words of the conversations as an existing lexicon."""
    words = F.regexp_extract_all("text", F.lit(NAME), F.lit(0))
    rows = table(spark, sf, "conversations").select("conv_id", "role", F.explode(words).alias("raw_name"))
    first = rows.groupBy("raw_name").agg(F.min("conv_id").alias("conv_id"), F.min("role").alias("role"))
    return first.select(
        "raw_name", F.upper("raw_name").alias("canonical_name"),
        F.when(F.col("role") == "assistant", "PERSON").otherwise("ORG").alias("entity_type"),
        (F.expr(START) + _minutes(F.col("conv_id"))).alias("created_at"),
    )


def escaped(text: Column) -> Column:
    """Text as XML or HTML character data."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def date_text(number: Column, at: Column) -> Column:
    """A time in one of the spellings that feeds and mails use."""
    spelled = lambda f: F.date_format(at, f)
    return (
        F.when(number % 6 == 0, F.concat(spelled("E, d MMM yyyy HH:mm:ss"), F.lit(" +0200")))
        .when(number % 6 == 1, F.concat(spelled("E, dd MMM yyyy HH:mm:ss"), F.lit(" -0530 (XYZ)")))
        .when(number % 6 == 2, F.concat(spelled("d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(number % 6 == 3, spelled("yyyy-MM-dd HH:mm:ss"))
        .when(number % 6 == 4, F.concat(spelled("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .otherwise(F.lit("next Tuesday"))
    )


# --- the same views as SQL ---------------------------------------------------------------

_SQL_DATE_TEXT = """CASE {n} % 6
  WHEN 0 THEN strftime({at}, '%a, %-d %b %Y %H:%M:%S') || ' +0200'
  WHEN 1 THEN strftime({at}, '%a, %d %b %Y %H:%M:%S') || ' -0530 (XYZ)'
  WHEN 2 THEN strftime({at}, '%-d %b %Y %H:%M:%S') || ' +0000'
  WHEN 3 THEN strftime({at}, '%Y-%m-%d %H:%M:%S')
  WHEN 4 THEN strftime({at}, '%Y-%m-%dT%H:%M:%S') || 'Z'
  ELSE 'next Tuesday' END"""


def sql_date_text(number: str, at: str) -> str:
    return _SQL_DATE_TEXT.format(n=number, at=at)


VIEWS = {
    "articles": """
 SELECT CAST(d.doc_id AS VARCHAR) AS uid, d.doc_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id * 37 % 43200 AS BIGINT)) AS datetime,
  d.source, 'desk@' || d.source || '.example' AS sender, split_part(d.text, chr(10), 1) AS title,
  'https://' || d.source || '.example/a/' || d.doc_id AS url, d.text AS summary,
  CASE WHEN d.lang <> 'en' OR d.doc_id % 3 <> 0 THEN d.text END AS original_language_summary,
  d.lang AS detected_language, FALSE AS truncated,
  ['email','rss','telegram','subscription','fediverse'][1 + d.doc_id % 5] AS content_type,
  ['topic ' || d.lang, d.source] AS topics,
  ['theme ' || ['email','rss','telegram','subscription','fediverse'][1 + d.doc_id % 5]] AS themes,
  string_split(lower(split_part(d.text, chr(10), 1)), ' ') AS keywords,
  coalesce(l.quality, 1) = 0 AS subscription_marketing,
  e.embedding AS english_embedding, m.embedding AS multilingual_embedding,
  CASE d.doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE d.text END AS raw_email,
  CAST(NULL AS VARCHAR) AS flag_status,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id * 37 % 43200 + d.doc_id % 90 AS BIGINT)) AS ingested_at
 FROM documents d
 LEFT JOIN embeddings e ON e.vec_id = d.doc_id
 LEFT JOIN embeddings m ON xor(m.vec_id, 1) = d.doc_id
 LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "entities": """
 SELECT CAST(l_orderkey AS VARCHAR) AS uid, p_type AS entity_type, p_name AS raw_name, p_brand AS canonical_name
 FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "history": """
 SELECT event_id AS id, CAST(user_id AS VARCHAR) AS username, event_type AS search_text,
  'english' AS space, ts AS searched_at FROM events""",
    "saved": """
 SELECT CAST(label AS BIGINT) AS id, 'user' || (label % 3) AS username, 'label ' || label AS search_text,
  CASE WHEN label % 2 = 0 THEN 'english' ELSE 'multilingual' END AS space,
  0.05::DOUBLE + label::DOUBLE / 100 AS threshold,
  CASE WHEN label % 3 = 0 THEN '' ELSE CAST(min(vec_id) AS VARCHAR) END AS latest_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(label AS BIGINT)) AS created_at,
  arg_min(embedding, vec_id) AS query_vector
 FROM embeddings GROUP BY label""",
    "notifications": """
 SELECT event_id AS id, CAST(user_id AS VARCHAR) AS username, event_type AS search_text,
  CAST(floor(value) AS BIGINT) AS new_results_count, props AS newest_title, ts AS created_at,
  event_type = 'view' AS is_read FROM events""",
    "flag_log": """
 SELECT CAST(user_id AS VARCHAR) AS uid,
  CASE event_type WHEN 'click' THEN 'Flagged' WHEN 'view' THEN 'Cleared' END AS flag_status, ts, event_id AS seq
 FROM events WHERE event_type IN ('click', 'view', 'error')""",
    "submissions": """
 SELECT s_suppkey AS arrival, CASE WHEN s_suppkey % 13 = 5 THEN 'X' ELSE s_name END AS source_name,
  ['telegram','rss','newsletter','fediverse'][1 + s_suppkey % 4] AS platform,
  CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 3 = 0 THEN 'https://t.me/+joinchat/x' || site
   WHEN s_suppkey % 4 = 0 THEN ' https://t.me/s/chan' || site
   WHEN s_suppkey % 4 = 3 THEN 'https://social' || site || '.example/@desk' || site
   ELSE 'https://site' || site || '.example/feed' END AS ingest_url,
  ['en','FR','de'][1 + (s_suppkey // 5) % 3] AS primary_language,
  CASE WHEN s_suppkey % 2 = 0 THEN 'en, fr' END AS languages_spoken, n_name AS geographic_focus,
  ['sport','other','civil_society','state_media','blog'][1 + s_suppkey % 5] AS publisher_type,
  ['ra_amina','ra_bob','Ra_Carol'][1 + (s_suppkey // 7) % 3] AS input_by,
  TRUE AS gating_passed, s_suppkey % 2 = 0 AS activity_passed, TRUE AS telegram_passed,
  'N' || s_nationkey AS country_iso, ['POL','eco-nomy','tec','##'][1 + s_suppkey % 4] AS topic_code
 FROM (SELECT *, CAST(CASE WHEN s_suppkey % 10 = 7 THEN s_suppkey - 4 ELSE s_suppkey END AS VARCHAR) AS site
       FROM supplier) JOIN nation ON n_nationkey = s_nationkey""",
    "sources": """
 SELECT country_iso || '_' || ['TEL','RSS','NEW','FED'][1 + arrival % 4] || '_' ||
   ['POL','ECON','TEC','GEN'][1 + arrival % 4] || '_' ||
   (CASE WHEN arrival < 1000 THEN lpad(CAST(arrival AS VARCHAR), 3, '0') ELSE CAST(arrival AS VARCHAR) END) AS source_id,
  source_name, platform, trim(ingest_url) AS ingest_url, lower(primary_language) AS primary_language,
  coalesce(languages_spoken, '') AS languages_spoken, geographic_focus, publisher_type, input_by,
  DATE '2024-01-01' + CAST(arrival % 200 AS INTEGER) AS date_added, gating_passed, activity_passed, telegram_passed,
  arrival % 2 = 0 AS is_verified, arrival % 7 = 0 AS is_deleted
 FROM submissions WHERE arrival % 3 = 1""",
    "registry_changes": """
 SELECT source_id, o_orderdate AS ts, o_orderkey AS seq,
  ['delete','verify','restore','unverify'][1 + o_orderkey % 4] AS action, 'admin' AS actor
 FROM orders JOIN sources ON o_custkey = CAST(split_part(source_id, '_', 4) AS BIGINT)""",
    "mentions": f"""
 SELECT CAST(doc_id AS VARCHAR) AS uid, doc_id, pos, raw_name,
  CASE lang WHEN 'en' THEN 'PERSON' WHEN 'fr' THEN 'ORG' WHEN 'de' THEN 'GPE' ELSE 'LOC' END AS entity_type
 FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{NAME}')) AS raw_name,
        unnest(range(len(regexp_extract_all(text, '{NAME}')))) AS pos FROM documents)""",
    "lexicon": f"""
 SELECT raw_name, upper(raw_name) AS canonical_name,
  CASE WHEN min(role) = 'assistant' THEN 'PERSON' ELSE 'ORG' END AS entity_type,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(min(conv_id)) AS created_at
 FROM (SELECT conv_id, role, unnest(regexp_extract_all(text, '{NAME}')) AS raw_name FROM conversations)
 GROUP BY raw_name""",
}
_NEEDS = {"sources": ["submissions"], "registry_changes": ["submissions", "sources"]}


def with_views(names: str, query: str) -> str:
    """``query`` with the named views (and the ones they need) defined in front."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [v for v in [*_NEEDS.get(name, []), name] if v not in wanted]
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in wanted) + "\n" + query
