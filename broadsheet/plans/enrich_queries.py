"""Registered enrichment, entity-resolution and streaming queries and their SQL."""

from __future__ import annotations

import datetime
import math
import uuid

from pyspark.sql import functions as F

from broadsheet.functions import similarity, textclean
from broadsheet.operators import enrich, entities, translation
from broadsheet.plans import bindings as b
from broadsheet.plans import stand_ins
from broadsheet.plans.bindings import with_views
from broadsheet.plans.corpus_queries import _match_sql
from broadsheet.schemas import ARTICLES
from broadsheet.session import cut_lineage, shared_folder, widen
from broadsheet.streaming import jobs


def _documents(spark, sf):
    return widen(b.table(spark, sf, "documents"))


def _fresh_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _language():
    """Two African codes among the documents' own languages, and some missing."""
    doc = F.col("doc_id")
    return F.when(doc % 9 == 4, "zu").when(doc % 9 == 5, "wo").when(doc % 9 != 6, F.col("lang"))


def _responses(spark, sf):
    """Model answers built from the documents: valid, fenced, cut off, text-less and other shapes."""
    doc, text = F.col("doc_id"), F.col("text")
    objects = F.array(
        F.struct(F.col("source").alias("raw_name"), F.lit("ORG").alias("entity_type")),
        F.struct(F.lit("").alias("raw_name"), F.lit("GPE").alias("entity_type")),
    )
    common = [
        _language().alias("detected_language"), text.alias("summary_en"),
        F.when(doc % 4 != 0, F.concat(F.lit("orig "), text)).alias("summary_orig"),
        F.struct(F.when(doc % 2 == 0, F.col("source")).alias("publisher"), F.lit("Web").alias("platform")).alias("publisher_metadata"),
        F.array(F.lit("topic"), F.col("lang")).alias("topics"), F.array(F.lit("theme")).alias("themes"),
        (doc % 6 == 0).alias("subscription_marketing"), F.when(doc % 8 == 4, doc % 16 == 4).alias("contains_text"),
    ]
    shape = doc % 3
    table = F.struct(F.array("source").alias("name"), F.array("lang").alias("type"))
    json_text = (
        F.when(shape == 0, F.to_json(F.struct(*common, objects.alias("entities"))))
        .when(shape == 1, F.to_json(F.struct(*common, F.array("source", "lang").alias("entities"))))
        .otherwise(F.to_json(F.struct(*common, table.alias("entities"))))
    )
    response = (
        F.when(doc % 10 == 1, F.concat(F.lit("```json\n"), json_text, F.lit("\n```")))
        .when(doc % 10 == 2, F.substring(json_text, 1, 40))
        .otherwise(json_text)
    )
    return _documents(spark, sf).select(
        "doc_id", "source", F.when(doc % 5 != 0, "rss").alias("platform"),
        F.when(doc % 7 == 0, "https://img.example/x.jpg").alias("image_url"), response.alias("response"),
    )


def _analysed(spark, sf):
    return enrich.normalised(enrich.parsed(_responses(spark, sf)).filter("is_valid"))


def analysis_parse(spark, sf):
    rows = enrich.parsed(_responses(spark, sf))
    return rows.select(
        "doc_id", "is_valid", F.col("analysis.summary_en").alias("summary_en"),
        F.array_join("analysis.topics", ",").alias("topics"), F.col("analysis.publisher_metadata.publisher").alias("publisher"),
    )


def analysis_normalise(spark, sf):
    rows = enrich.with_image_note(_analysed(spark, sf))
    return rows.select("doc_id", "language", "summary_en", "summary_orig", "subscription_marketing")


def analysis_entities(spark, sf):
    rows = _analysed(spark, sf).withColumn("uid", F.col("doc_id").cast("string"))
    found = entities.mentions(rows, F.col("entities_json"), F.col("doc_id"))
    return found.select("uid", F.col("seq.pos").alias("pos"), "raw_name", "entity_type")


def translation_routing(spark, sf):
    rows = _documents(spark, sf).withColumn("language", F.coalesce(_language(), F.lit("en")))
    return rows.select("doc_id", "language", enrich.translation_tier(F.col("language")).alias("tier"))


def translation_fallback(spark, sf):
    rows = _documents(spark, sf).select("doc_id", "text", F.col("lang").alias("language"))
    return enrich.translate(rows, stand_ins.first_translator, stand_ins.second_translator)


def _spoken():
    """Every fourth document counts as written in a low-resource language."""
    return F.when(F.col("doc_id") % 4 == 0, "zu").otherwise(F.col("lang")).alias("language")


def _translators():
    return translation.Translators(stand_ins.low_resource_translator, stand_ins.primary_translator, stand_ins.second_translator, "model-b")


def translation_router(spark, sf):
    rows = _documents(spark, sf).select("doc_id", "text", _spoken(), "source")
    known = rows.filter("language = 'zu' AND source IN ('src0', 'src2', 'src4', 'src6', 'src8')")
    key = textclean.translation_key(F.col("text"), F.col("language"), F.lit("model-b"))
    cache = known.select(key.alias("cache_key"), F.concat(F.lit("cached "), "text").alias("translation"))
    done, _ = translation.routed(rows, cache, _translators())
    return done.select("doc_id", "language", "route", "translation")


def translation_cache(spark, sf):
    """Routes and cache after the documents went through twice: each key is stored once, and the second time comes from the cache."""
    rows = _documents(spark, sf).select("doc_id", "text", _spoken())
    folder = _fresh_folder(spark, "translations")
    for _ in range(2):
        done, fresh = translation.routed(rows, translation.cached(spark, folder), _translators())
        done = cut_lineage(done)
        translation.remember(spark, fresh, folder)
    routes = done.groupBy("route").agg(F.count("*").alias("n"))
    stored = translation.cached(spark, folder).agg(F.lit("stored").alias("route"), F.count("*").alias("n"))
    return routes.unionByName(stored)


def publisher_fallback(spark, sf):
    rows = enrich.publisher_columns(enrich.parsed(_responses(spark, sf)).filter("is_valid"))
    return rows.select("doc_id", "author", "source", "content_type")


def _requests(spark, sf):
    return _documents(spark, sf).select("doc_id", "text", F.col("lang").alias("language"))


def _cache(spark, sf):
    """Earlier translations: documents of every second source."""
    known = _documents(spark, sf).filter("source in ('src0', 'src2', 'src4', 'src6', 'src8')")
    key = textclean.translation_key(F.col("text"), F.col("lang"), F.lit("model-a"))
    return known.select(key.alias("cache_key"), F.concat(F.lit("cached "), "text").alias("translation")).distinct()


def cache_hit_miss(spark, sf):
    return enrich.with_cache(_requests(spark, sf), _cache(spark, sf), "model-a").select("doc_id", "is_hit")


def cached_translation(spark, sf):
    filled, _ = enrich.cached_translations(
        _requests(spark, sf), _cache(spark, sf), "model-a", stand_ins.second_translator
    )
    return filled.select("doc_id", "is_hit", "translation")


def cached_translation_new(spark, sf):
    """The rows that the cache gains."""
    return enrich.cached_translations(_requests(spark, sf), _cache(spark, sf), "model-a", stand_ins.second_translator)[1]


def infer_stage(spark, sf):
    rows = _documents(spark, sf).select("doc_id", F.col("text").alias("prompt"))
    done = enrich.infer(rows, "prompt", stand_ins.HesitantAnalyst())
    return done.select("doc_id", "attempts", F.col("response").isNotNull().alias("accepted"),
                       F.array_join(F.col("rejects.reason"), "|").alias("reasons"))


def audit_log(spark, sf):
    rows = _documents(spark, sf).select(F.col("text").alias("prompt"))
    done = enrich.infer(rows, "prompt", stand_ins.HesitantAnalyst())
    calls = enrich.audit_rows(done, "stand-in", "analyst", "prompt", F.lit("2024-02-01 00:00:00"))
    return calls.groupBy("day", "provider", "model", "rejected_reason").agg(F.count("*").alias("calls"))


def embed_stage(spark, sf):
    rows = b.articles(spark, sf, vectors=False, labels=False).select(
        "uid", F.col("summary").alias("summary_en"), F.col("original_language_summary").alias("summary_orig"), "topics", "themes"
    )
    done = enrich.embedded(rows, stand_ins.digest_embedder)
    return done.select("uid", _listed("english_embedding").alias("en"), _listed("multilingual_embedding").alias("ml"))


def _listed(vector):
    return F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), ",")


def reembed(spark, sf):
    done = enrich.reembedded(b.articles(spark, sf, labels=False), stand_ins.digest_embedder)
    first = [F.round(F.get(v, F.lit(0)).cast("double"), 5).alias(f"first_{n}") for v, n in (("english_embedding", "en"), ("multilingual_embedding", "ml"))]
    return done.select("uid", F.size("english_embedding").alias("en"), F.size("multilingual_embedding").alias("ml"), *first)


def judge_stage(spark, sf):
    pairs = b.articles(spark, sf, vectors=False, labels=False)
    from broadsheet.operators.corpus_stats import translation_pairs

    scores = enrich.judged(translation_pairs(pairs), stand_ins.judge)
    return enrich.judge_report(scores, ["lang"])


def judge_report(spark, sf):
    """Scores from the line items, one judged pair per line; missing where the line number is 7."""
    lines = b.table(spark, sf, "lineitem")
    score = lambda c: F.when(F.col("l_linenumber") != 7, c.cast("int"))
    scores = lines.select(
        F.col("l_returnflag").alias("lang"),
        score(1 + F.col("l_partkey") % 5).alias("semantic_accuracy"), score(1 + F.col("l_suppkey") % 5).alias("tone_alignment"),
        score(1 + F.col("l_orderkey") % 5).alias("nuance_retention"), score(1 + F.col("l_linenumber") % 5).alias("idiomatic_mapping"),
    )
    return enrich.judge_report(scores, ["lang"])


def model_times(spark, sf):
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("provider"), F.concat(F.lit("model-"), (F.col("l_suppkey") % 3).cast("string")).alias("model"),
        F.concat(F.lit("stage-"), (F.col("l_linenumber") % 3).cast("string")).alias("stage"), F.col("l_quantity").alias("seconds"),
    )
    return enrich.stage_times(lines).withColumn("mean_seconds", F.round("mean_seconds", 6))


def compare_models(spark, sf):
    texts = b.table(spark, sf, "benchmark").select("item_id", "text")
    models = {"first": stand_ins.first_translator, "second": stand_ins.second_translator}
    return enrich.compare_models(texts, "text", models).select("item_id", "model", "response")


def lexicon_exact(spark, sf):
    names = b.mentions(spark, sf).select("raw_name").distinct()
    rows = entities.exact_lookup(names, b.lexicon(spark, sf))
    return rows.select("raw_name", "canonical_name")


def lexicon_fuzzy(spark, sf):
    names = b.mentions(spark, sf).select(F.col("entity_type").alias("type"), entities.name_key(F.col("raw_name")).alias("word"))
    found = entities.fuzzy_lookup(names, b.lexicon(spark, sf))
    return found.select("type", "word", "canonical_name", F.round("similarity", 6).alias("similarity"))


def name_similarity(spark, sf):
    """Scores of part names against the names of the parts of the same brand and type that share a size."""
    parts = b.table(spark, sf, "part")
    left = parts.select("p_brand", "p_type", "p_size", F.col("p_name").alias("a")).distinct()
    right = left.withColumnRenamed("a", "b")
    pairs = left.join(right, ["p_brand", "p_type", "p_size"]).select("a", "b").distinct()
    return pairs.withColumn("similarity", F.round(similarity.jaro_winkler(F.col("a"), F.col("b")), 6))


def entity_resolution(spark, sf):
    resolved, _ = entities.resolve(b.mentions(spark, sf), b.lexicon(spark, sf))
    return resolved.groupBy("entity_type", "raw_name", "canonical_name").agg(F.count("*").alias("mentions"))


def lexicon_insert(spark, sf):
    """Names of the documents added where the lexicon lacks them; the first spelling row wins."""
    names = b.mentions(spark, sf).groupBy("raw_name").agg(F.min("entity_type").alias("entity_type"))
    additions = names.withColumn("canonical_name", F.col("raw_name"))
    now = F.lit("2024-02-02 00:00:00")
    return entities.add_to_lexicon(b.lexicon(spark, sf), additions, now)


# --- streams over landed articles --------------------------------------------------------


#: Rows of a landed file: a task writes one, however many there are.
_LANDED_ROWS = 10_000


def _landed(spark, sf, vectors: bool):
    """The articles written as the files a stream picks up, four at least, each of a stretch of time; and how many these are."""
    folder = _fresh_folder(spark, "landing")
    rows = b.articles(spark, sf, vectors=vectors, labels=False)
    count = max(4, math.ceil(rows.count() / _LANDED_ROWS))
    rows.select(ARTICLES.names).repartitionByRange(count, "datetime", "uid").write.parquet(folder)
    return folder, count


def stream_ingest(spark, sf):
    """Two runs over the same landing folder; the second finds nothing new."""
    (landing, count), store = _landed(spark, sf, False), _fresh_folder(spark, "store")
    checkpoint = _fresh_folder(spark, "progress")
    for _ in range(2):
        stream = jobs.article_stream(spark, landing, files_per_trigger=math.ceil(count / 2))
        jobs.ingest_stream(stream, store, checkpoint).awaitTermination()
    return spark.read.parquet(store).select("uid", "datetime", "summary")


def stream_backfill(spark, sf):
    (landing, count), store = _landed(spark, sf, False), _fresh_folder(spark, "store")
    stream = jobs.article_stream(spark, landing, files_per_trigger=math.ceil(count / 4))
    jobs.ingest_stream(stream, store, _fresh_folder(spark, "progress"), lookback=None).awaitTermination()
    return spark.read.parquet(store).select("uid", "datetime", "summary")


def _alerts_in_batches(spark, sf, initial, between=None):
    """Notifications of four micro-batches that arrive in order of time, summed per search; ``between`` changes searches half-way."""
    landing, state, progress = (_fresh_folder(spark, n) for n in ("landing", "alerts", "progress"))
    changes = _fresh_folder(spark, "changes")
    jobs.save_initial_searches(initial, b.articles(spark, sf, vectors=False, labels=False), state)
    rows = b.articles(spark, sf, vectors=True, labels=False).select(ARTICLES.names)
    start, week = datetime.datetime(2024, 1, 1), datetime.timedelta(minutes=10_800)  # a quarter of the days the articles span
    jobs.log_changes(spark.createDataFrame([], jobs.CHANGES), changes)
    for part in range(4):
        if part == 2 and between is not None:
            between(changes)
        rows.filter(F.col("datetime").between(start + part * week, start + (part + 1) * week - datetime.timedelta(minutes=1))).write.mode("append").parquet(landing)
        stream = jobs.article_stream(spark, landing, files_per_trigger=1_000)
        jobs.alert_stream(stream, state, progress, lambda: datetime.datetime(2024, 3, 1), changes=changes).awaitTermination()
    sent = spark.read.parquet(f"{state}/notifications")
    return sent.groupBy("search_id").agg(F.sum("new_results_count").alias("new_results_count"))


def stream_alerts(spark, sf):
    return _alerts_in_batches(spark, sf, b.saved_searches(spark, sf))


def stream_alerts_changing(spark, sf):
    """Half-way every fifth search is saved, every seventh deleted, and every eleventh deleted and saved again."""
    saved = b.saved_searches(spark, sf)

    def between(changes):
        new = saved.filter("id % 5 = 0").select("*", F.lit(1).cast("long").alias("seq"))
        gone = saved.filter("id % 7 = 3").select("id", F.lit(2).cast("long").alias("seq"), F.lit(True).alias("deleted"))
        both = saved.filter("id % 11 = 1").select("id", F.lit(3).cast("long").alias("seq"), F.lit(True).alias("deleted"))
        again = saved.filter("id % 11 = 1").select("*", F.lit(4).cast("long").alias("seq"))
        for rows in (new, gone, both, again):
            jobs.log_changes(rows, changes)

    return _alerts_in_batches(spark, sf, saved.filter("id % 5 <> 0"), between)


def stream_timeline(spark, sf):
    (landing, count), counts = _landed(spark, sf, False), _fresh_folder(spark, "timeline")
    # In one batch, as files come in no order of time and a later batch would find its days closed.
    stream = jobs.daily_counts(jobs.article_stream(spark, landing, files_per_trigger=count))
    (
        stream.writeStream.outputMode("append").format("parquet").option("path", counts)
        .option("checkpointLocation", _fresh_folder(spark, "progress")).trigger(availableNow=True).start()
    ).awaitTermination()
    return spark.read.schema("dt date, cnt long").parquet(counts)


_LANG = "CASE WHEN doc_id % 9 = 4 THEN 'zu' WHEN doc_id % 9 = 5 THEN 'wo' WHEN doc_id % 9 <> 6 THEN lang END"
_NO_TEXT = "(doc_id % 8 = 4 AND doc_id % 16 <> 4)"
_ANALYSED = f"""WITH a AS (SELECT *, {_LANG} AS given, {_NO_TEXT} AS no_text FROM documents WHERE doc_id % 10 <> 2),
 n AS (SELECT *, CASE WHEN no_text THEN 'en' ELSE coalesce(given, 'en') END AS language,
  CASE WHEN no_text THEN '{enrich.NO_TEXT}' ELSE text END AS en FROM a),
 o AS (SELECT *, CASE WHEN language = 'en' THEN en WHEN doc_id % 4 <> 0 THEN 'orig ' || text ELSE text END AS orig FROM n)"""
_NOTE = "'" + enrich.IMAGE_NOTE.replace("\n", "' || chr(10) || '") + "'"
_DONE_TEXTS = "doc_id % 7 = 0 AND NOT no_text"

_KINDS = f"""SELECT doc_id, CASE WHEN length(text) % 11 = 0 THEN '{enrich.EMPTY}' WHEN length(text) % 7 = 0 THEN '{enrich.BAD_JSON}'
 WHEN length(text) % 5 = 0 THEN '{enrich.REPEATS}' END AS kind, length(text) % 3 = 0 AS hesitated FROM documents"""


def _bytes_sql(code: str) -> str:
    return "[" + ", ".join(f"CAST('0x' || substr({code}, {1 + 2 * i}, 2) AS INTEGER)" for i in range(8)) + "]"


_EMBEDDED = f"""texts AS (SELECT *, chr(10) || 'Topics: ' || array_to_string(topics, ', ') || chr(10) || 'Themes: ' || array_to_string(themes, ', ') AS tail,
  CASE WHEN trim(coalesce(original_language_summary, '')) = '' THEN summary ELSE original_language_summary END AS original FROM articles),
 coded AS (SELECT *, length(summary || tail) % 13 <> 0 AND length(original || tail) % 13 <> 0 AS made,
  {_bytes_sql("md5(summary || tail)")} AS new_en, {_bytes_sql("md5(original || tail)")} AS new_ml FROM texts)"""
_SCORES = ", ".join(
    f"round(avg(1 + CAST('0x' || substr(code, {1 + 2 * i}, 2) AS INTEGER) % 5), 2) AS avg_{score}"
    for i, score in enumerate(enrich.SCORES)
)

_SEPARATOR = "chr(1)"
_KEY = f"sha256(text || {_SEPARATOR} || lang || {_SEPARATOR} || 'model-a')"
_HIT = f"""(SELECT {_KEY} FROM documents WHERE source IN ('src0', 'src2', 'src4', 'src6', 'src8'))"""

_PROMPTS = """SELECT *, language = 'zu' AS low, language = 'zu' AND text IN (SELECT text FROM documents WHERE doc_id % 4 = 0
  AND source IN ('src0', 'src2', 'src4', 'src6', 'src8')) AS hit,
 'Translate from ' || language || ' into English. Answer with the translation alone.' || chr(10) || chr(10) || text AS prompt
 FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'zu' ELSE lang END AS language FROM documents)"""

QUERIES = {
    "analysis_parse": (analysis_parse, """
SELECT doc_id, doc_id % 10 <> 2 AS is_valid, CASE WHEN doc_id % 10 <> 2 THEN text END AS summary_en,
 CASE WHEN doc_id % 10 <> 2 THEN 'topic,' || lang END AS topics,
 CASE WHEN doc_id % 10 <> 2 AND doc_id % 2 = 0 THEN source END AS publisher FROM documents"""),
    "analysis_normalise": (analysis_normalise, _ANALYSED + f"""
SELECT doc_id, language, CASE WHEN {_DONE_TEXTS} THEN en || {_NOTE} ELSE en END AS summary_en,
 CASE WHEN {_DONE_TEXTS} THEN orig || {_NOTE} ELSE orig END AS summary_orig, doc_id % 6 = 0 AS subscription_marketing FROM o"""),
    "analysis_entities": (analysis_entities, f"""
SELECT CAST(doc_id AS VARCHAR) AS uid, CAST(pos AS INTEGER) AS pos, raw_name, entity_type FROM (
 SELECT doc_id, 0 AS pos, source AS raw_name, CASE doc_id % 3 WHEN 0 THEN 'ORG' WHEN 1 THEN 'Unknown' ELSE lang END AS entity_type
 FROM documents WHERE doc_id % 10 <> 2 AND NOT {_NO_TEXT}
 UNION ALL SELECT doc_id, 1, lang, 'Unknown' FROM documents WHERE doc_id % 3 = 1 AND doc_id % 10 <> 2 AND NOT {_NO_TEXT})"""),
    "translation_routing": (translation_routing, f"""
SELECT doc_id, language, CASE WHEN language IN ('xh', 'zu', 'tn', 'rw', 'st', 'ss', 'wo') THEN 'low_resource'
 WHEN language <> 'en' THEN 'other' ELSE 'none' END AS tier FROM (SELECT doc_id, coalesce({_LANG}, 'en') AS language FROM documents)"""),
    "translation_fallback": (translation_fallback, """
SELECT doc_id, text, lang AS language, CASE WHEN length(text) % 2 = 0 THEN 'T:' || md5(text) WHEN length(text) % 3 <> 0 THEN 'R:' || md5(text)
 ELSE '[Translation Failed - Original Language: ' || lang || ']' || chr(10) || chr(10) || text END AS translation FROM documents"""),
    "translation_router": (translation_router, f"""
WITH p AS ({_PROMPTS}) SELECT doc_id, language, CASE WHEN language = 'en' OR trim(text) = '' THEN 'none' WHEN hit THEN 'cache' WHEN low AND length(prompt) % 5 <> 0 THEN 'low_resource'
  WHEN length(prompt) % 2 = 0 THEN 'primary' WHEN length(prompt) % 3 <> 0 THEN 'secondary' ELSE 'failed' END AS route,
 CASE WHEN language = 'en' OR trim(text) = '' THEN text WHEN hit THEN 'cached ' || text WHEN low AND length(prompt) % 5 <> 0 THEN 'L:' || md5(prompt)
  WHEN length(prompt) % 2 = 0 THEN 'T:' || md5(prompt) WHEN length(prompt) % 3 <> 0 THEN 'R:' || md5(prompt)
  ELSE '[Translation Failed - Original Language: ' || language || ']' || chr(10) || chr(10) || text END AS translation FROM p"""),
    "translation_cache": (translation_cache, f"""
WITH p AS ({_PROMPTS}), r AS (SELECT text, CASE WHEN language = 'en' OR trim(text) = '' THEN 'none' WHEN low AND length(prompt) % 5 <> 0 THEN 'cache'
  WHEN length(prompt) % 2 = 0 THEN 'primary' WHEN length(prompt) % 3 <> 0 THEN 'secondary' ELSE 'failed' END AS route FROM p)
SELECT route, count(*) AS n FROM r GROUP BY route UNION ALL SELECT 'stored', count(DISTINCT text) FROM r WHERE route = 'cache'"""),
    "publisher_fallback": (publisher_fallback, """
SELECT doc_id, 'Unknown' AS author, source, CASE WHEN doc_id % 5 <> 0 THEN 'rss' ELSE 'Web' END AS content_type
FROM documents WHERE doc_id % 10 <> 2"""),
    "cache_hit_miss": (cache_hit_miss, f"SELECT doc_id, {_KEY} IN {_HIT} AS is_hit FROM documents"),
    "cached_translation": (cached_translation, f"""
SELECT doc_id, hit AS is_hit, CASE WHEN hit THEN 'cached ' || text WHEN length(text) % 3 <> 0 THEN 'R:' || md5(text) END AS translation
FROM (SELECT *, {_KEY} IN {_HIT} AS hit FROM documents)"""),
    "infer_stage": (infer_stage, f"""
SELECT doc_id, CASE WHEN kind IS NOT NULL THEN 3 WHEN hesitated THEN 2 ELSE 1 END AS attempts, kind IS NULL AS accepted,
 CASE WHEN kind IS NULL THEN CASE WHEN hesitated THEN '{enrich.EMPTY}' ELSE '' END ELSE kind || '|' || kind || '|' || kind END AS reasons FROM ({_KINDS})"""),
    "audit_log": (audit_log, f"""
SELECT DATE '2024-02-01' AS day, 'stand-in' AS provider, 'analyst' AS model, kind AS rejected_reason, CAST(sum(n) AS BIGINT) AS calls
FROM (SELECT kind, CASE WHEN kind IS NULL THEN 1 ELSE 3 END AS n FROM ({_KINDS})
 UNION ALL SELECT '{enrich.EMPTY}', 1 FROM ({_KINDS}) WHERE kind IS NULL AND hesitated) GROUP BY kind"""),
    "cached_translation_new": (cached_translation_new, f"""
SELECT DISTINCT {_KEY} AS cache_key, 'R:' || md5(text) AS translation FROM documents
WHERE {_KEY} NOT IN {_HIT} AND length(text) % 3 <> 0"""),
    "embed_stage": (embed_stage, with_views("articles", f""", {_EMBEDDED}
SELECT uid, array_to_string(new_en, ',') AS en, array_to_string(new_ml, ',') AS ml FROM coded WHERE made""")),
    "reembed": (reembed, with_views("articles", f""", {_EMBEDDED}
SELECT uid, CASE WHEN made THEN 8 ELSE len(english_embedding) END AS en, CASE WHEN made THEN 8 ELSE len(multilingual_embedding) END AS ml,
 round(CASE WHEN made THEN CAST(new_en[1] AS DOUBLE) ELSE CAST(english_embedding[1] AS DOUBLE) END, 5) AS first_en,
 round(CASE WHEN made THEN CAST(new_ml[1] AS DOUBLE) ELSE CAST(multilingual_embedding[1] AS DOUBLE) END, 5) AS first_ml FROM coded""")),
    "judge_stage": (judge_stage, with_views("articles", f"""
, p AS (SELECT detected_language AS lang, md5('TEXT A (Original Language):' || chr(10) || original_language_summary || chr(10) || chr(10)
  || 'TEXT B (English Translation):' || chr(10) || summary) AS code FROM articles
  WHERE detected_language <> 'en' AND original_language_summary <> '' AND summary <> '')
SELECT lang, count(*) AS n, {_SCORES} FROM p GROUP BY lang""")),
    "judge_report": (judge_report, """
SELECT l_returnflag AS lang, count(*) AS n, round(avg(CASE WHEN l_linenumber <> 7 THEN 1 + l_partkey % 5 END), 2) AS avg_semantic_accuracy,
 round(avg(CASE WHEN l_linenumber <> 7 THEN 1 + l_suppkey % 5 END), 2) AS avg_tone_alignment,
 round(avg(CASE WHEN l_linenumber <> 7 THEN 1 + l_orderkey % 5 END), 2) AS avg_nuance_retention,
 round(avg(CASE WHEN l_linenumber <> 7 THEN 1 + l_linenumber % 5 END), 2) AS avg_idiomatic_mapping FROM lineitem GROUP BY 1"""),
    "model_times": (model_times, """
WITH t AS (SELECT l_returnflag AS provider, 'model-' || (l_suppkey % 3) AS model, 'stage-' || (l_linenumber % 3) AS stage,
 avg(l_quantity) AS mean_seconds FROM lineitem GROUP BY ALL)
SELECT provider, model, stage, round(mean_seconds, 6) AS mean_seconds FROM t
UNION ALL SELECT provider, model, 'total', round(sum(mean_seconds), 6) FROM t GROUP BY provider, model"""),
    "compare_models": (compare_models, """
SELECT item_id, 'first' AS model, CASE WHEN length(text) % 2 = 0 THEN 'T:' || md5(text) ELSE text END AS response FROM benchmark
UNION ALL SELECT item_id, 'second', CASE WHEN length(text) % 3 <> 0 THEN 'R:' || md5(text) END FROM benchmark"""),
    "lexicon_exact": (lexicon_exact, with_views("mentions lexicon", """
, known AS (SELECT lower(raw_name) AS key, canonical_name FROM lexicon
 QUALIFY row_number() OVER (PARTITION BY lower(raw_name) ORDER BY created_at, raw_name) = 1)
SELECT n.raw_name, k.canonical_name FROM (SELECT DISTINCT raw_name FROM mentions) n LEFT JOIN known k ON k.key = lower(n.raw_name)""")),
    "lexicon_fuzzy": (lexicon_fuzzy, None),
    "name_similarity": (name_similarity, None),
    "entity_resolution": (entity_resolution, None),
    "lexicon_insert": (lexicon_insert, with_views("mentions lexicon", """
SELECT * FROM lexicon UNION ALL
SELECT raw_name, raw_name, min(entity_type), TIMESTAMP '2024-02-02 00:00:00' FROM mentions
WHERE raw_name NOT IN (SELECT raw_name FROM lexicon) GROUP BY raw_name""")),
    "stream_ingest": (stream_ingest, with_views("articles", "SELECT uid, datetime, summary FROM articles")),
    "stream_backfill": (stream_backfill, with_views("articles", "SELECT uid, datetime, summary FROM articles")),
    "stream_alerts": (stream_alerts, with_views("articles saved", _match_sql("datetime") + """
SELECT id AS search_id, n AS new_results_count FROM ranked WHERE rn = 1""")),
    "stream_alerts_changing": (stream_alerts_changing, with_views("articles saved", _match_sql("datetime", newer=False) + """
, counted AS (SELECT f.id, w.since, f.seen, f.seen >= TIMESTAMP '2024-01-16' AS late, f.id % 5 = 0 AS added,
  f.id % 7 = 3 AS deleted, f.id % 11 = 1 AS again FROM found f JOIN wm w ON w.id = f.id)
SELECT id AS search_id, count(*) AS new_results_count FROM counted
WHERE CASE WHEN late THEN again OR (NOT deleted AND (added OR seen > since)) ELSE NOT added AND seen > since END GROUP BY id""")),
    "stream_timeline": (stream_timeline, with_views("articles", """
SELECT CAST(datetime AS DATE) AS dt, count(*) AS cnt FROM articles
WHERE CAST(datetime AS DATE) + INTERVAL 1 DAY <= (SELECT max(datetime) FROM articles) - INTERVAL 1 DAY GROUP BY 1""")),
}
