import datetime

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import enrich, exports, ingest, ranking, registry, user_state
from broadsheet.plans import stand_ins
from broadsheet.schemas import ARTICLES, SOURCES, align_schema
from broadsheet.streaming import jobs

SUBMISSION = (
    "arrival long, source_name string, platform string, ingest_url string, primary_language string, languages_spoken string, "
    "geographic_focus string, publisher_type string, input_by string, gating_passed boolean, activity_passed boolean, "
    "telegram_passed boolean, country_iso string, topic_code string"
)


def _submission(n, name, platform, url, country, topic, by="ra_amina", kind="consumer_news"):
    return (n, name, platform, url, "EN", None, None, kind, by, True, True, True, country, topic)


def _insert(spark, rows, sources=None):
    stored = sources if sources is not None else spark.createDataFrame([], SOURCES)
    return registry.insert_batch(spark.createDataFrame(rows, SUBMISSION), stored, F.lit("2026-05-21"))


def test_submission_cases(spark):
    accepted, rejected = _insert(spark, [
        _submission(1, "Premium Times Nigeria", "telegram", " https://t.me/s/premiumtimes ", "ng", "pol"),
        _submission(2, "Premium Times again", "telegram", "https://t.me/s/premiumtimes", "NG", "POL"),
        _submission(3, "Private", "telegram", "https://t.me/+joinchat/abcde123", "NG", "POL"),
        _submission(4, "Mastodon News Room", "fediverse", "@index@news.example", "US", "GEN"),
        _submission(5, "TechCrunch Science Africa", "newsletter", "https://t.example/feed", "KE", "tech-nol", kind="technology_science"),
        _submission(6, "Second", "telegram", "https://t.me/s/second", "NG", "POL"),
        _submission(7, "X", "rss", "http", "KENYA1", "##", kind="blog"),
    ])
    got = {r.arrival_name: r.source_id for r in accepted.select(F.col("source_name").alias("arrival_name"), "source_id").collect()}
    assert got == {
        "Premium Times Nigeria": "NG_TEL_POL_001", "Mastodon News Room": "US_FED_GEN_001",
        "TechCrunch Science Africa": "KE_NEW_TECH_001", "Second": "NG_TEL_POL_002",
    }
    reasons = {r.arrival: r.reason for r in rejected.collect()}
    assert reasons[2] == "duplicate active url" and reasons[3] == "invalid: telegram_private"
    assert reasons[7] == "invalid: source_name_length,ingest_url_length,country_iso_length,publisher_type_unknown"
    assert accepted.columns == SOURCES.names


def test_deleted_address_and_numbers_after_stored_ones(spark):
    first, _ = _insert(spark, [_submission(1, "Aa", "rss", "https://a.example", "NG", "POL")])
    stored = first.withColumns({"source_id": F.lit("NG_RSS_POL_1041"), "is_deleted": F.lit(True)})
    accepted, rejected = _insert(spark, [
        _submission(1, "Bb", "rss", "https://a.example", "NG", "POL"), _submission(2, "Cc", "rss", "https://c.example", "NG", "POL"),
    ], stored)
    assert [r.source_id for r in accepted.collect()] == ["NG_RSS_POL_1042"]
    assert [r.reason for r in rejected.collect()] == ["url held by a deleted source"]


def test_soft_delete_restore_and_verify(spark):
    stored, _ = _insert(spark, [_submission(1, "Aa", "rss", "https://a.example", "NG", "POL")])
    stored = stored.cache()
    log = lambda *actions: spark.createDataFrame(
        [("NG_RSS_POL_001", datetime.datetime(2026, 1, 1), i, a) for i, a in enumerate(actions)],
        "source_id string, ts timestamp_ntz, seq long, action string",
    )
    count = lambda *actions: tuple(registry.totals(registry.apply_changes(stored, log(*actions))).first())
    assert count("delete") == (0, 0, 1)
    assert count("verify", "delete", "restore") == (1, 1, 0)
    assert registry.listed(stored, input_by=" RA_AMINA ").count() == 1 and registry.listed(stored, input_by="ra_bob").count() == 0
    zero = {r["platform"]: r["count"] for r in registry.by_platform(stored).collect()}
    assert zero == {"telegram": 0, "rss": 1, "newsletter": 0, "fediverse": 0}


def test_numbering_spreads_a_hot_group(spark):
    frame = spark.range(20_000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), "id")
    numbered = ranking.number_within(frame.repartition(7), ["k"], ["id"], "n").cache()
    checks = numbered.groupBy("k").agg(F.count("*").alias("c"), F.max("n").alias("top"), F.countDistinct("n").alias("d")).collect()
    assert all(r.c == r.top == r.d for r in checks)
    assert numbered.join(numbered.selectExpr("k", "id as id2", "n + 1 as n"), ["k", "n"]).filter("id < id2").count() == 0


def test_top_per_group_cuts_before_the_shuffle(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = ranking.top_per_group(frame, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_history_flags_and_notifications(spark):
    start = datetime.datetime(2026, 1, 1)
    history = spark.createDataFrame(
        [(i, "a" if i % 4 else "b", start + datetime.timedelta(minutes=i)) for i in range(50)], "id long, username string, searched_at timestamp_ntz")
    recent = user_state.recent_history(history).collect()
    assert sorted(r.id for r in recent if r.username == "b") == list(range(12, 49, 4)) and len(recent) == 20
    articles = spark.createDataFrame([("1", "Flagged"), ("2", None), ("3", "Flagged")], "uid string, flag_status string")
    log = spark.createDataFrame([("1", None, start, 2), ("1", "Flagged", start, 1), ("2", "Cleared", start, 1), ("9", "Flagged", start, 1)],
                                "uid string, flag_status string, ts timestamp_ntz, seq long")
    assert dict(user_state.apply_flags(articles, log).select("uid", "flag_status").collect()) == {"1": None, "2": "Cleared", "3": "Flagged"}
    assert [r.uid for r in user_state.unknown_flags(articles, log).collect()] == ["9"]
    notes = spark.createDataFrame([("a", False), ("a", True), ("b", False)], "username string, is_read boolean")
    assert dict(user_state.unread_counts(user_state.mark_read(notes, "a")).collect()) == {"a": 0, "b": 1}


def test_ingest_keeps_first_and_drops_known(spark):
    raw = spark.createDataFrame([("1", 2, "late"), ("1", 1, "early"), ("2", 3, "x"), ("3", 4, "y")], "uid string, arrival long, body string")
    stored = spark.createDataFrame([("2",), ("body3",)], "uid string")
    assert {r.uid: r.body for r in ingest.new_items(raw, stored, mail=True).collect()} == {"1": "early"}
    assert {r.uid for r in ingest.new_items(raw, stored).collect()} == {"1", "3"}
    assert ingest.highest_mail_uid(raw.select("uid").union(stored)).first()[0] == 3


def _dated(spark, rows):
    return align_schema(spark.createDataFrame(rows, "uid string, datetime timestamp_ntz"), ARTICLES).select(ARTICLES.names)


def test_stream_ingest_is_idempotent_and_outlives_a_wrong_date(spark, tmp_path):
    landing, store, progress, late = (str(tmp_path / n) for n in ("landing", "store", "progress", "late"))
    day = lambda d: datetime.datetime(2026, 1, d)

    def land(*rows):
        _dated(spark, rows).withColumn("ingested_at", F.lit(day(22))).coalesce(1).write.mode("append").parquet(landing)
        stream = jobs.article_stream(spark, landing)
        jobs.ingest_stream(stream, store, progress, left_out=late).awaitTermination()
        return sorted(r.uid for r in spark.read.parquet(store).collect())

    assert land(("a", day(20)), ("a", day(20)), ("undated", None)) == ["a", "undated"]
    assert land(("future", datetime.datetime(2031, 1, 1))) == ["a", "future", "undated"]
    assert land(("b", day(19)), ("a", day(20)), ("old", day(1))) == ["a", "b", "future", "undated"]
    assert land(("c", day(21))) == ["a", "b", "c", "future", "undated"]
    assert [r.uid for r in spark.read.parquet(late).collect()] == ["old"]


def test_a_bad_prompt_fails_alone(spark):
    def picky(prompts):
        if "bad" in prompts:
            raise RuntimeError("refused")
        return ["{}" for _ in prompts][: 1 if len(prompts) > 3 else None]

    frame = spark.createDataFrame([(p,) for p in ("a", "b", "bad", "c", "d", "e")], "prompt string").coalesce(1)
    rows = {r.prompt: r for r in enrich.infer(frame, "prompt", picky).collect()}
    assert [p for p, r in rows.items() if r.response is None] == ["bad"] and len(rows) == 6
    vectors = enrich.embed(frame, ["prompt"], ["v"], lambda texts: [[1.0] for t in texts if t != "bad" or 1 / 0]).collect()
    assert sorted(r.prompt for r in vectors if r.v is None) == ["bad"]


def test_inference_retries_and_keeps_failures(spark):
    def flaky(prompts):
        # Valid only when asked alone, which happens once the others are accepted.
        return ["{}" if p == "good" or len(prompts) == 1 else "not json" for p in prompts]

    frame = spark.createDataFrame([("good",), ("late",)], "prompt string").coalesce(1)
    rows = {r.prompt: r for r in enrich.infer(frame, "prompt", flaky).collect()}
    assert (rows["good"].attempts, rows["late"].attempts, rows["late"].response) == (1, 2, "{}")
    assert [x.reason for x in rows["late"].rejects] == [enrich.BAD_JSON]

    def broken(prompts):
        raise RuntimeError("down")

    dead = enrich.dead_letters(enrich.infer(frame, "prompt", broken)).collect()
    assert len(dead) == 2 and all(len(r.rejects) == 3 and "down" in r.rejects[0].reason for r in dead)


def test_reembedding_keeps_old_vectors_on_failure(spark):
    frame = _dated(spark, [("1", None), ("2", None)]).withColumns({
        "summary": F.when(F.col("uid") == "1", "text"), "english_embedding": F.array(F.lit(9.0).cast("float")),
        "multilingual_embedding": F.array(F.lit(8.0).cast("float")),
    })
    rows = {r.uid: r for r in enrich.reembedded(frame, stand_ins.hashing_embedder).collect()}
    assert len(rows["1"].english_embedding) == 64
    assert (rows["2"].english_embedding, rows["2"].multilingual_embedding) == ([9.0], [8.0])


@pytest.mark.parametrize("first, second, expected", [
    ("hi", None, "hi"), ("text", "two", "two"), (" ", "two", "two"), (None, " ", None), (None, "text", "text"),
])
def test_translation_fallback(spark, first, second, expected):
    frame = spark.createDataFrame([("text", "zu", first, second)], "t string, l string, a string, b string")
    got = frame.select(enrich.translated(F.col("t"), F.col("l"), F.col("a"), F.col("b"))).first()[0]
    assert got == (expected or "[Translation Failed - Original Language: zu]\n\ntext")


def test_cache_computes_each_distinct_miss_once(spark):
    requests = spark.createDataFrame([("a", "zu")] * 50 + [("b", "zu")], "text string, language string")
    filled, fresh = enrich.cached_translations(
        requests, spark.createDataFrame([], "cache_key string, translation string"), "m", lambda ts: [t * 2 for t in ts])
    assert fresh.count() == 2 and {(r.text, r.translation) for r in filled.collect()} == {("a", "aa"), ("b", "bb")}
    again, none = enrich.cached_translations(requests, fresh, "m", lambda ts: [None for _ in ts])
    assert none.count() == 0 and again.filter("is_hit").count() == 51


def test_publisher_may_be_a_list(spark):
    answers = [
        '{"publisher_metadata": {"publisher": ["A", "B"], "author": null, "platform": "Ghost"}}',
        '{"publisher_metadata": {"publisher": "C", "author": ["x", "y"]}}', "{}",
    ]
    frame = spark.createDataFrame([(i, a, "feed", None) for i, a in enumerate(answers)],
                                  "i int, response string, source string, platform string")
    rows = enrich.publisher_columns(enrich.parsed(frame)).orderBy("i").collect()
    assert [(r.author, r.source, r.content_type) for r in rows] == [
        ("Unknown", "A, B", "Ghost"), ("x, y", "C", "feed"), ("Unknown", "feed", "feed")]


def test_logs_append_by_day(spark, tmp_path):
    path = str(tmp_path / "log")
    frame = spark.createDataFrame([("q", "{}")], "prompt string, note string")
    done = enrich.infer(frame, "prompt", lambda ps: ["{}" for _ in ps])
    for day in ("2026-01-01", "2026-01-02"):
        exports.append_log(enrich.audit_rows(done, "p", "m", "prompt", F.lit(f"{day} 10:00:00")), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 2 and rows.filter("day = '2026-01-02'").first().rejected_reason is None


def test_landed_files_are_bounded_and_the_timeline_stays_whole(spark, sf, monkeypatch):
    from broadsheet.plans import enrich_queries

    whole = sorted(map(tuple, enrich_queries.stream_timeline(spark, sf).collect()))
    rows = spark.read.parquet(f"{sf}/documents.parquet").count()
    monkeypatch.setattr(enrich_queries, "_LANDED_ROWS", max(1, rows // 10))
    folder, count = enrich_queries._landed(spark, sf, False)
    files = spark.read.parquet(folder).groupBy(F.input_file_name().alias("file")).count().collect()
    assert count >= 10 and sum(f["count"] for f in files) == rows and max(f["count"] for f in files) <= rows / 4
    assert sorted(map(tuple, enrich_queries.stream_timeline(spark, sf).collect())) == whole
