import datetime
import random

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from broadsheet.functions import keyword, vectors
from broadsheet.operators import exports, ingest, search
from broadsheet.operators.search import SearchRequest
from broadsheet.plans import bindings
from broadsheet.schemas import ARTICLES, align_schema

ROWS = [
    ("1", "Initial Energy Policies", "grid reform in Abuja with solar power", None),
    ("2", "New Energy security Breakthrough", None, "ÉTÉ chaud à Dakar"),
    ("3", "Oracle of android", "100% of a_b \\back and été sale", "x"),
    ("4", None, "Nothing here but investment news", "investors meet"),
    ("5", "it's \"quoted\"", "power is solar", "y"),
]
MALFORMED = [
    "a AND", "OR a", "((energy)", "NOT NOT energy", '"', "()", "energy)", "x NEAR/2", '"a b" NEAR/2 c',
    "power NEAR/1 solar NEAR/1 grid", "NEAR/3", "energy AND OR power", "not", "( or )",
]


def _frame(spark):
    return spark.createDataFrame(ROWS, "uid string, title string, summary string, original_language_summary string")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t (uid VARCHAR, title VARCHAR, summary VARCHAR, original_language_summary VARCHAR)")
    connection.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", ROWS)
    return connection


def _like(pattern):
    quoted = pattern.replace("'", "''")
    return f"(title ILIKE '{quoted}' OR SUMMARY_COLUMN ILIKE '{quoted}')"


def _close(a, b, n):
    return f"regexp_matches(SUMMARY_COLUMN, '{keyword.near_pattern(a, b, n)}', 'i')"


CASES = [
    ("energy", _like("%energy%")), ("invest*", _like("%invest%")), ("*invest", _like("%invest%")), ("inv?st", _like("%inv_st%")),
    ("100%", _like("%100%")), ("a_b", _like("%a_b%")), ("\\back", _like("%\\back%")), ("it's", _like("%it's%")),
    ('"solar power"', _like("%solar power%")), ("power near/1 solar", _close("power", "solar", 1)),
    ('power NEAR/0 "is solar"', _close("power", "is solar", 0)), ("sol* NEAR/0 power", _close("sol", "power", 0)),
    ("été", _like("%été%")), ("ÉTÉ", _like("%ÉTÉ%")), ("", "TRUE"), ("  ", "TRUE"),
    ("energy security", f"{_like('%energy%')} AND {_like('%security%')}"),
    ("energy or power not news and solar", f"{_like('%energy%')} OR ({_like('%power%')} AND NOT {_like('%news%')} AND {_like('%solar%')})"),
    ("not (power or news)", f"NOT ({_like('%power%')} OR {_like('%news%')})"),
    *[(q, _like(f"%{q}%")) for q in MALFORMED],
]


def _agree(spark, duck, cases):
    frame = _frame(spark).cache()
    spaces = ("english", "multilingual")
    flags = [
        F.coalesce(keyword.matches(q, s), F.lit(False)).alias(f"c{i}_{s}") for i, (q, _) in enumerate(cases) for s in spaces
    ]
    rows = frame.select("uid", *flags).collect()
    for i, (query, where) in enumerate(cases):
        for space in spaces:
            got = sorted(r.uid for r in rows if r[f"c{i}_{space}"])
            sql = where.replace("SUMMARY_COLUMN", keyword.SUMMARY_OF_SPACE[space])
            assert got == sorted(u for (u,) in duck.execute(f"SELECT uid FROM t WHERE {sql}").fetchall()), query


def test_keyword_queries_agree_with_sql(spark, duck):
    _agree(spark, duck, CASES)


def _random_tree(rng, depth):
    """(query text, SQL) of the same random condition."""
    if depth == 0 or rng.random() < 0.2:
        word = rng.choice(["energy", "power", "solar", "news", "é*", "in abuja", "NEAR"])
        if word == "NEAR":
            n = rng.randint(0, 3)
            return f"power NEAR/{n} solar", _close("power", "solar", n)
        text = f'"{word}"' if " " in word else word
        return text, _like("%" + word.replace("*", "") + "%")
    kind = rng.choice(["AND", "and", "", "OR", "NOT"])
    left, left_sql = _random_tree(rng, depth - 1)
    if kind == "NOT":
        return f"NOT ({left})", f"NOT ({left_sql})"
    right, right_sql = _random_tree(rng, depth - 1)
    return f"({left}) {kind} ({right})", f"({left_sql}) {kind.upper() or 'AND'} ({right_sql})"


def test_random_conditions_agree_with_sql(spark, duck):
    rng = random.Random(5)
    _agree(spark, duck, [_random_tree(rng, rng.randint(1, 3)) for _ in range(80)])


def test_word_bounded_operators(spark):
    frame = _frame(spark)
    assert [r.uid for r in frame.filter(keyword.matches("oracle android")).collect()] == ["3"]
    assert sorted(r.uid for r in frame.filter(keyword.matches("grid oracle", compat=True)).collect()) == ["1", "3"]
    assert frame.filter(keyword.matches("grid oracle")).count() == 0


def test_columns_combine_without_the_search_box(spark):
    where = (keyword.term("energy") | keyword.near("power", "solar", 3)) & ~keyword.phrase("security")
    assert sorted(r.uid for r in _frame(spark).filter(where).collect()) == ["1", "5"]


def test_highlight(spark):
    assert keyword.highlight_words('(power NEAR/3 solar) OR "in abuja" not of') == ["power", "solar", "abuja"]
    row = _frame(spark).filter("uid = 5").select(keyword.highlight(F.col("summary"), "POWER")).first()
    assert row[0] == "<em>power</em> is solar"


def _articles(spark, count=30):
    start = datetime.datetime(2024, 1, 1, 10)
    rows = [
        (str(i), start + datetime.timedelta(days=i // 3), f"title {i}", [float(i % 5), 1.0, 0.5] if i % 7 else None)
        for i in range(count)
    ]
    frame = spark.createDataFrame(rows, "uid string, datetime timestamp_ntz, title string, english_embedding array<float>")
    return align_schema(frame, ARTICLES)


def test_pages_concatenate_to_the_full_order(spark):
    articles = _articles(spark)
    whole = SearchRequest(query_vector=[1.0, 0.0, 0.0], limit=100)
    full = [r.uid for r in search.page(search.hits(articles, whole), whole).collect()]
    pages = []
    for offset in range(0, 40, 7):
        request = SearchRequest(query_vector=[1.0, 0.0, 0.0], limit=7, offset=offset)
        pages += [r.uid for r in search.page(search.hits(articles, request), request).collect()]
    assert pages == full and len(full) == len(set(full)) == 25


def test_total_is_sum_of_timeline_and_gaps_are_filled(spark):
    request = SearchRequest(query_vector=[1.0, 0.0, 0.0], threshold=0.9)
    response = search.search(_articles(spark), spark.createDataFrame([], "uid string, canonical_name string, entity_type string"), request)
    days = response["timeline"].collect()
    assert response["total"].first()[0] == sum(r.cnt for r in days) == response["results"].count()
    filled = search.gap_filled(response["timeline"]).orderBy("dt").collect()
    assert (filled[-1].dt - filled[0].dt).days + 1 == len(filled) > len(days)


def test_bare_end_date_excludes_the_rest_of_the_day(spark):
    articles = _articles(spark)
    at = lambda **o: search.hits(articles, SearchRequest(text="", end_date="2024-01-02", **o)).count()
    assert (at(), at(end_inclusive_day=True)) == (2, 5)


def test_zero_and_missing_vectors_score_zero(spark):
    frame = spark.createDataFrame([("a", [0.0, 0.0]), ("b", None), ("c", [3.0, 4.0])], "uid string, v array<float>")
    got = dict(frame.select("uid", vectors.cosine_to(F.col("v"), [3.0, 4.0])).collect())
    assert got == {"a": 0.0, "b": 0.0, "c": 1.0}
    assert frame.select(vectors.cosine_to(F.col("v"), [0.0, 0.0]).alias("s")).agg(F.max("s")).first()[0] == 0.0


def test_other_dimension_is_an_error(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>")
    with pytest.raises(PySparkException):
        frame.select(vectors.cosine_to(F.col("v"), [1.0, 2.0])).collect()


def test_stored_norms_give_the_same_similarity(spark, sf):
    query = bindings.query_vector(spark, sf)
    table = bindings.table(spark, sf, "embeddings").withColumn("n", vectors.norm(F.col("embedding")))
    plain, stored = vectors.cosine_to(F.col("embedding"), query), vectors.cosine_to(F.col("embedding"), query, F.col("n"))
    assert table.filter(F.abs(plain - stored) > 1e-12).count() == 0


def test_batch_cosine_equals_the_expression(spark, sf):
    query = bindings.query_vector(spark, sf)
    table = bindings.table(spark, sf, "embeddings").withColumn("n", vectors.norm(F.col("embedding")))
    vector = F.col("embedding")
    scored = table.select(vectors.cosine_to(vector, query).alias("a"), vectors.batch_cosine_to(vector, query).alias("b"),
                          vectors.batch_cosine_to(vector, query, F.col("n")).alias("c"))
    assert scored.filter("abs(a - b) > 1e-12 or abs(a - c) > 1e-12").count() == 0
    few = spark.createDataFrame([("a", [0.0, 0.0]), ("b", None), ("c", [3.0, 4.0]), ("d", [1.0, None])], "uid string, v array<float>")
    got = dict(few.select("uid", vectors.batch_cosine_to(F.col("v"), [3.0, 4.0])).collect())
    assert got == {"a": 0.0, "b": 0.0, "c": 1.0, "d": 0.0}
    with pytest.raises(PySparkException):
        few.select(vectors.batch_cosine_to(F.col("v"), [1.0, 2.0, 3.0])).collect()


def test_a_search_scores_each_article_once(spark, sf):
    request = SearchRequest(query_vector=bindings.query_vector(spark, sf), threshold=0.1)
    found = search.page(search.hits(bindings.articles(spark, sf, labels=False), request), request)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "articles")
    _articles(spark).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    request = SearchRequest(query_vector=[1.0, 0.0, 0.0], start_date="2024-01-03", language="en", content_type="rss")
    found = search.timeline(search.hits(spark.read.parquet(path), request))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "GreaterThanOrEqual(datetime" in scan and "EqualTo(detected_language,en)" in scan
    assert "raw_email" not in scan and "summary" not in scan


def test_store_prunes_days_and_reuses_norms(spark, tmp_path):
    path = str(tmp_path / "store")
    ingest.append_articles(spark, _articles(spark), path)
    stored = spark.read.parquet(path)
    request = SearchRequest(query_vector=[1.0, 0.0, 0.0], start_date="2024-01-03", end_date="2024-01-06", threshold=0.5)
    found = search.hits(stored, request)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "english_norm" in plan
    same = search.hits(_articles(spark), request)
    pick = lambda df: sorted((r.uid, round(r.similarity, 9)) for r in df.collect())
    assert pick(found) == pick(same) != []


def test_request_validation():
    for bad in ({"limit": 0}, {"limit": 10_001}, {"offset": -1}, {"threshold": 1.5}, {"space": "x"}, {"sort_by": "x"}):
        with pytest.raises(ValueError):
            SearchRequest(text="a", **bad)
    with pytest.raises(ValueError):
        SearchRequest()


def test_single_file_csv_has_mark_and_quotes(spark, tmp_path):
    frame = spark.createDataFrame([("a", 'say "hi"'), ("b", None)], "UID string, Title string")
    exports.write_single_csv(frame.orderBy("UID"), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text(encoding="utf-8") == chr(0xFEFF) + 'UID,Title\n"a","say ""hi"""\n"b",""\n'




def test_seek_pages_are_written_without_texts(spark, sf, monkeypatch):
    from broadsheet.plans import search_queries

    written, real = [], search_queries.cut_lineage
    monkeypatch.setattr(search_queries, "cut_lineage", lambda rows: written.append(set(rows.columns)) or real(rows))
    assert search_queries.search_page_seek(spark, sf).count() == search_queries.search_page_offset(spark, sf).count()
    assert written and all(c <= {"uid", "datetime", "similarity"} for c in written)
