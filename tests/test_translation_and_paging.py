import csv
import datetime
import io

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import corpus_stats, exports, search, translation
from broadsheet.operators.search import SearchRequest

REQUESTS = [(1, "abc", "zu"), (2, "abc", "zu"), (3, "defg", "zu"), (4, "hi", "fr"), (5, "hij", "fr"), (6, "k", "en"), (7, "l", None), (8, None, "zu"), (9, " ", "fr"), (10, "mno", "xh")]


def _models():
    """Inner functions, so that they travel to the tasks by value."""

    def body(prompt):
        return prompt.split("\n\n", 1)[1]

    def own(prompts):
        if any("defg" in p for p in prompts):
            raise ValueError("out of memory")
        return ["own " + body(p) for p in prompts]

    def primary(prompts):
        assert not any("from en " in p or p.endswith("\n\n") for p in prompts)
        return [None if len(body(p)) == 3 else body(p) if len(body(p)) == 2 else "first " + body(p) for p in prompts]

    def secondary(prompts):
        return [None if body(p) == "hi" else "second " + body(p) for p in prompts]

    return translation.Translators(own, primary, secondary, "m")


def test_each_text_takes_the_route_of_its_language(spark, tmp_path):
    rows = spark.createDataFrame(REQUESTS, "id long, text string, language string").repartition(3)
    models = _models()
    folder = str(tmp_path / "cache")
    done, fresh = translation.routed(rows, translation.cached(spark, folder), models)
    got = {r.id: (r.route, r.translation) for r in done.collect()}
    warning = "[Translation Failed - Original Language: fr]\n\nhi"
    assert got == {1: ("low_resource", "own abc"), 2: ("low_resource", "own abc"), 3: ("primary", "first defg"), 4: ("failed", warning), 5: ("secondary", "second hij"),
                   6: ("none", "k"), 7: ("none", "l"), 8: ("none", None), 9: ("none", " "), 10: ("low_resource", "own mno")}
    assert sorted(r.translation for r in fresh.collect()) == ["own abc", "own mno"]
    for _ in range(2):
        translation.remember(spark, fresh, folder)
    assert translation.cached(spark, folder).count() == 2
    again, none = translation.routed(rows, translation.cached(spark, folder), models)
    assert none.count() == 0 and {r.id for r in again.filter("route = 'cache'").collect()} == {1, 2, 10}
    assert translation.routed(rows.limit(0), translation.cached(spark, folder), models)[0].count() == 0
    with pytest.raises(ValueError):
        translation.routed(rows, translation.cached(spark, folder), models, to="text")


def _articles(spark, n=57):
    day = datetime.datetime(2024, 1, 1)
    rows = [(f"u{k * 37 % n:03}", day + datetime.timedelta(hours=k % 9) if k % 8 else None, k % 5 / 4) for k in range(n)]
    return spark.createDataFrame(rows, "uid string, datetime timestamp_ntz, similarity double").repartition(4)


@pytest.mark.parametrize("sort_by", ["date", "similarity"])
def test_pages_by_cursor_are_those_by_offset(spark, sort_by):
    found = _articles(spark)
    cursor, seen = None, []
    for k in range(7):
        request = SearchRequest(query_vector=[1.0], sort_by=sort_by, limit=10, offset=10 * k)
        by_cursor = search.page_after(found, request, cursor)
        assert [r.uid for r in by_cursor.collect()] == [r.uid for r in search.page(found, request).collect()]
        seen += [r.uid for r in by_cursor.collect()]
        cursor = search.cursor_after(by_cursor, request) or cursor
    assert len(seen) == len(set(seen)) == 57 and search.cursor_after(found.limit(0), request) is None


def test_the_cloud_is_the_top_of_the_directory(spark):
    rows = [(k % 7, "ORG" if k % 2 else None, f"s{k % 11}") for k in range(200)] + [(None, "ORG", "x")] * 30
    entities = spark.createDataFrame([(None if a is None else f"n{a}", b, c) for a, b, c in rows], "canonical_name string, entity_type string, raw_name string")
    for k in (0, 5, 100):
        wanted = corpus_stats.entity_directory(entities).select("canonical_name", "entity_type", "aliases", "occurrence_count").limit(k)
        assert corpus_stats.entity_cloud(entities, k).collect() == wanted.collect()
    with pytest.raises(ValueError):
        corpus_stats.entity_cloud(entities, 10**6)


def test_parts_of_an_ordered_export_are_one_file(spark, sf, tmp_path):
    from broadsheet.plans import bindings as b

    request = SearchRequest(query_vector=b.query_vector(spark, sf), threshold=0.0)
    articles = b.articles(spark, sf, labels=False).withColumn("title", F.concat("title", F.lit(' "q", \n end ')))
    folder = tmp_path / "export"
    exports.write_ordered_csv(articles, b.entities(spark, sf), request, str(folder))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*")))
    head, *rows = csv.reader(io.StringIO(text.removeprefix(exports.BOM), newline=""))
    assert tuple(head) == exports.RESULT_TITLES and len(rows) > 100
    scores = [float(r[13]) for r in rows]
    assert scores == sorted(scores, reverse=True)
    read = exports.read_csv(spark, str(folder)).collect()
    assert sorted(map(tuple, read)) == sorted(map(tuple, rows))
