import datetime
import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import alerts
from broadsheet.schemas import ARTICLES, SAVED_SEARCHES, align_schema
from broadsheet.streaming import jobs

START = datetime.datetime(2026, 5, 20, 10)

def _now():
    return F.lit("2026-06-01 00:00:00").cast("timestamp_ntz")


def _articles(spark, rows):
    frame = spark.createDataFrame(
        rows, "uid string, datetime timestamp_ntz, title string, english_embedding array<float>, "
        "multilingual_embedding array<float>, ingested_at timestamp_ntz",
    )
    return align_schema(frame, ARTICLES).select(ARTICLES.names)


def _searches(spark, rows):
    return spark.createDataFrame(rows, SAVED_SEARCHES)


def _same(uid, at, title):
    vector = [0.5] * 384
    return (uid, at, title, vector, vector, at)


FIRST = _same("uid-1", START, "Initial Energy Policies")
SECOND = _same("uid-2", START + datetime.timedelta(hours=26), "New Energy security Breakthrough")
SEARCH = (1, "testuser", "energy security", "english", 0.40, "", START, [0.5] * 384)


def test_saved_search_then_alert_flow(spark):
    before = _articles(spark, [FIRST])
    seeded = alerts.seed_searches(_searches(spark, [SEARCH]), before)
    assert seeded.first()["latest_id"] == "uid-1"
    quiet, same = alerts.check_alerts(seeded, before, _now())
    assert quiet.count() == 0 and same.first()["latest_id"] == "uid-1"
    sent, advanced = alerts.check_alerts(seeded, _articles(spark, [FIRST, SECOND]), _now())
    (row,) = sent.collect()
    assert (row.username, row.new_results_count, row.newest_title, row.is_read) == (
        "testuser", 1, "New Energy security Breakthrough", False)
    assert advanced.first()["latest_id"] == "uid-2"
    again, _ = alerts.check_alerts(advanced, _articles(spark, [FIRST, SECOND]), _now())
    assert again.count() == 0


def _cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    size = (sum(x * x for x in a) ** 0.5) * ((sum(x * x for x in b) ** 0.5) or 1.0)
    return dot / size if size else 0.0


def _random_case(seed, articles=150, searches=40, width=6):
    rng = random.Random(seed)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(width)]
    rows = []
    for i in range(articles):
        at = START + datetime.timedelta(hours=rng.randint(0, 40))
        rows.append((f"u{i}", at, f"t{i}", vector() if i % 9 else None, vector() if i % 8 else None, at + datetime.timedelta(hours=1)))
    saved = [
        (i, f"user{i % 4}", f"s{i}", "english" if i % 3 else "multilingual", rng.choice([0.0, 0.3123, 0.7123]),
         rng.choice(["", "gone", f"u{i}"]), START, vector())
        for i in range(searches)
    ]
    return rows, saved


def _expected(rows, saved):
    times = {r[0]: r[1] for r in rows}
    found = {}
    for s in saved:
        since = times.get(s[5], datetime.datetime(1970, 1, 1))
        hits = []
        for uid, at, title, en, ml, _ in rows:
            vector = en if s[3] == "english" else ml
            if vector is not None and at > since and round(_cosine(vector, s[7]), 9) >= s[4]:
                hits.append((at, round(_cosine(vector, s[7]), 6), uid, title))
        if hits:
            newest = sorted(hits, key=lambda h: (-h[0].timestamp(), -h[1], h[2]))[0]
            found[s[0]] = (len(hits), newest[2], newest[3])
    return found


@pytest.mark.parametrize("max_bytes", [alerts.MAX_BROADCAST_BYTES, 6 * 8 * 5])
def test_matches_equal_all_pairs_also_in_small_blocks(spark, max_bytes):
    rows, saved = _random_case(1)
    articles = _articles(spark, rows).repartition(5)
    searches = alerts.with_watermark(_searches(spark, saved), articles)
    got = {
        r.id: (r.new_results_count, r.newest_uid, r.newest_title)
        for r in alerts.matches(searches, articles, max_bytes=max_bytes).collect()
    }
    assert got == _expected(rows, saved)


@pytest.mark.parametrize("max_bytes", [alerts.MAX_BROADCAST_BYTES, 6 * 8 * 5])
def test_nearest_articles_equal_all_pairs(spark, max_bytes):
    rows, saved = _random_case(2)
    got = {}
    found = alerts.nearest_articles(_searches(spark, saved), _articles(spark, rows).repartition(5), 4, max_bytes)
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.uid)
    for s in saved:
        scored = [
            (-round(_cosine(v, s[7]), 6), r[0]) for r in rows for v in [r[3] if s[3] == "english" else r[4]] if v is not None
        ]
        assert got[s[0]] == [uid for _, uid in sorted(scored)[:4]]


def test_other_dimension_is_an_error(spark):
    articles = _articles(spark, [("a", START, "t", [1.0, 2.0], None, START)])
    searches = _searches(spark, [SEARCH[:7] + ([1.0, 2.0, 3.0],)]).withColumn("since", F.lit("1970-01-01").cast("timestamp_ntz"))
    with pytest.raises(Exception, match="vector length"):
        alerts.matches(searches, articles).collect()


def test_no_searches_gives_no_rows(spark):
    empty = _searches(spark, []).withColumn("since", F.lit("1970-01-01").cast("timestamp_ntz"))
    assert alerts.matches(empty, _articles(spark, [FIRST])).count() == 0


def test_stream_alerts_equal_batch(spark, tmp_path):
    rows, saved = _random_case(3)
    rows.sort(key=lambda r: r[1])
    landing, state = str(tmp_path / "landing"), str(tmp_path / "state")
    # Batches in order of time; rows of one time stay together, as equal times never alert twice.
    cuts = [0, 50, 100, len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        while 0 < a < len(rows) and rows[a][1] == rows[a - 1][1]:
            a += 1
        while b < len(rows) and rows[b][1] == rows[b - 1][1]:
            b += 1
        _articles(spark, rows[a:b]).coalesce(1).write.mode("append").parquet(landing)
    saved = [s[:5] + ("",) + s[6:] for s in saved]
    searches = _searches(spark, saved)
    jobs.save_initial_searches(searches, _articles(spark, rows).limit(0), state)
    jobs.alert_stream(
        jobs.article_stream(spark, landing, 1), state, str(tmp_path / "progress"), lambda: datetime.datetime(2026, 6, 1)
    ).awaitTermination()
    sent = spark.read.parquet(f"{state}/notifications")
    assert sent.select("batch").distinct().count() == 3
    got = {r.search_id: r.n for r in sent.groupBy("search_id").agg(F.sum("new_results_count").alias("n")).collect()}
    assert got == {k: v[0] for k, v in _expected(rows, saved).items()}
    last = {r.id: r.latest_id for r in spark.read.parquet(f"{state}/searches/3").collect()}
    assert {k: v[1] for k, v in _expected(rows, saved).items()} == {k: v for k, v in last.items() if v}


def test_changes_of_saved_searches_merge_into_the_state(spark, tmp_path):
    log, old = str(tmp_path / "log"), datetime.datetime(1970, 1, 1)
    held = spark.createDataFrame([(i, "u", f"s{i}", "english", 0.1, "x", START, [1.0], START, None) for i in range(5)], jobs.STATE)
    jobs.log_changes(spark.createDataFrame([(1, 1, True), (2, 2, True)], "id long, seq long, deleted boolean"), log)
    new = spark.createDataFrame([(2, 3, "anew"), (9, 4, "new"), (8, 5, "short-lived")], "id long, seq long, search_text string")
    jobs.log_changes(new, log)
    jobs.log_changes(spark.createDataFrame([(8, 6, True), (77, 7, True)], "id long, seq long, deleted boolean"), log)
    read = lambda: spark.read.schema(jobs.CHANGES).parquet(log)
    state = jobs.with_changes(held, read())
    rows = {r.id: (r.search_text, r.since, r.seq) for r in state.collect()}
    assert rows == {0: ("s0", START, None), 3: ("s3", START, None), 4: ("s4", START, None), 2: ("anew", old, 3), 9: ("new", old, 4)}
    # What has been applied isn't applied again, so a watermark that moved on stays.
    moved = state.withColumn("since", F.lit(START).cast("timestamp_ntz"))
    assert {r.since for r in jobs.with_changes(moved, read()).collect()} == {START}
    assert state.columns == jobs.STATE.names and jobs.with_changes(held, read().limit(0)).count() == 5
