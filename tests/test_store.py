"""The store's commits, its index of known ids, and the ingestion job on top of them."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import files, ingest_job, known_ids
from broadsheet.operators.store import Store
from broadsheet.schemas import ARTICLES, RAW_ARTICLE

AT = datetime.datetime(2026, 5, 20)
ORDER = ["datetime", "uid"]


def _articles(spark, rows):
    """(uid, minute, entities) as analysed articles."""
    base = datetime.datetime(2026, 5, 18, 10)
    made = [(u, base + datetime.timedelta(minutes=m), f"summary {u}", json.dumps(e)) for u, m, e in rows]
    frame = spark.createDataFrame(made, "uid string, datetime timestamp_ntz, summary string, entities_json string")
    lacking = [f for f in ARTICLES.fields if f.name not in frame.columns]
    return frame.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in lacking))


def _org(*names):
    return [{"raw_name": n, "entity_type": "ORG"} for n in names]


def _state(store):
    return {t: sorted(map(tuple, store.read(t).collect()), key=str) for t in ("articles", "entities", "lexicon")}


THREE = [("article_1", 0, _org("TotalEnergies", "Eni", "Patrick Pouyanné")), ("article_2", 30, _org("Banque mondiale", "CEDEAO", "cedeao")),
         ("article_3", 45, _org("GAUFF Engineering", "Total Energies", "eni"))]


def test_three_articles_are_committed_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("articles").count() == 0 and store.batches() == []
    assert store.commit("one", _articles(spark, THREE), ORDER, AT)
    before = _state(store)
    assert [len(before[t]) for t in ("articles", "entities", "lexicon")] == [3, 9, 7]
    assert ("article_3", "ORG", "eni", "Eni") in before["entities"] and ("article_3", "ORG", "Total Energies", "TotalEnergies") in before["entities"]
    assert not store.commit("one", _articles(spark, [("other", 0, [])]), ORDER, AT)
    assert store.commit("two", _articles(spark, THREE), ORDER, AT)  # another batch of the same articles
    assert _state(store) == before and store.batches() == ["one", "two"]


def test_a_run_that_stops_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.commit("one", _articles(spark, THREE[:1]), ORDER, AT)
    before = _state(store)
    write = Store._write

    def stopped(self, table, batch, rows):
        if table == "lexicon":
            raise RuntimeError("lost")
        write(self, table, batch, rows)

    monkeypatch.setattr(Store, "_write", stopped)
    with pytest.raises(RuntimeError):
        store.commit("two", _articles(spark, THREE), ORDER, AT)
    assert _state(store) == before and store.batches() == ["one"]
    monkeypatch.undo()
    assert store.commit("two", _articles(spark, THREE), ORDER, AT)
    assert [len(rows) for rows in _state(store).values()] == [3, 9, 7]


def test_copies_within_a_batch_and_rows_without_uid(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [("a", 9, _org("Late")), ("a", 1, _org("Early")), (None, 0, _org("Nobody")), ("b", 2, []), ("b", 2, [])]
    store.commit("one", _articles(spark, rows), ORDER, AT)
    state = _state(store)
    assert sorted(r[0] for r in state["articles"]) == ["a", "b"] and [r[2] for r in state["entities"]] == ["Early"]


def test_compaction_keeps_every_row_and_later_batches_go_on(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for k, row in enumerate(THREE):
        store.commit(f"b{k}", _articles(spark, [row]), ORDER, AT)
    before = _state(store)
    assert store.compact("folded") and _state(store) == before and store.batches() == ["folded"]
    assert not store.compact("folded")
    assert store.commit("next", _articles(spark, [*THREE, ("new", 99, _org("ENI"))]), ORDER, AT)
    state = _state(store)
    assert len(state["articles"]) == 4 and ("new", "ORG", "ENI", "Eni") in state["entities"] and len(state["lexicon"]) == 7


def test_published_files_appear_once(spark, tmp_path):
    path = str(tmp_path / "c" / "x")
    assert files.names(spark, str(tmp_path / "c")) == []
    assert files.publish(spark, path, "é") and not files.publish(spark, path, "other")
    assert files.read(spark, path) == "é" and files.names(spark, str(tmp_path / "c")) == ["x"]
    store = Store(spark, str(tmp_path / "s"), known_ids.Layout(buckets=8))
    assert Store(spark, store.root, known_ids.Layout(buckets=9)).layout.buckets == 8
    with pytest.raises(ValueError):
        store.commit("a/b", _articles(spark, []), ORDER, AT)


def test_filters_miss_no_known_id_and_few_others(spark):
    layout = known_ids.Layout(buckets=16, bits=1 << 12, hashes=5)
    draw = random.Random(2)
    ids = [f"id{draw.randrange(10**9)}" for _ in range(4_000)]
    frame = lambda some: spark.createDataFrame([(i,) for i in some], "uid string")
    filters = known_ids.merged([known_ids.filters(frame(ids[:2_000]), layout), known_ids.filters(frame(ids[1_500:3_000]), layout)])
    found = {r.uid for r in known_ids.maybe_known(frame(ids), filters, layout).collect()}
    assert set(ids[:3_000]) <= found and len(found) < 3_000 + 100
    assert known_ids.buckets_to_read(frame([]), filters, layout) == []


def test_a_lookup_reads_only_buckets_that_may_hold_its_ids(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), known_ids.Layout(buckets=32, bits=1 << 12))
    store.commit("one", _articles(spark, [(f"u{k}", k, []) for k in range(300)]), ORDER, AT)
    asked = spark.createDataFrame([("u7",), ("new1",), ("bodyx",), ("u8",)], "uid string")
    assert sorted(r.uid for r in store.unseen(asked).collect()) == ["bodyx", "new1"]
    buckets = known_ids.buckets_to_read(asked, store.read("filters"), store.layout)
    assert 2 <= len(buckets) <= 3
    read = store.known_in(buckets)
    assert len({f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()}) == 32  # before the filter on partitions
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString() or "bucket#" in read._jdf.queryExecution().toString()
    only_new = spark.createDataFrame([(f"fresh{k}",) for k in range(5)], "uid string")
    assert "known" not in store.unseen(only_new)._jdf.queryExecution().toString()


def test_mail_ids_in_the_older_spelling_are_known(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit("one", _articles(spark, [("body17", 0, []), ("18", 0, [])]), ORDER, AT)
    asked = spark.createDataFrame([("17",), ("18",), ("19",)], "uid string")
    assert [r.uid for r in store.unseen(asked, mail=True).collect()] == ["19"]
    assert sorted(r.uid for r in store.unseen(asked).collect()) == ["17", "19"]


def test_job_from_adapters_to_store(spark, tmp_path):
    def report(prompts):  # within the test, so that it travels to the tasks by value
        done = {"detected_language": "pt", "entities": [{"raw_name": "Eni", "entity_type": "ORG"}], "topics": ["t"], "themes": []}
        return [None if "broken" in p else json.dumps(done | {"summary_en": p[:12]}) for p in prompts]

    def vectors(texts):
        return [[float(len(t)), 1.0] for t in texts]

    store, models = Store(spark, str(tmp_path / "s")), ingest_job.Models(report, vectors)
    row = lambda uid, title, day: (uid, day, "src", "desk", title, f"u/{uid}", "text", "rss", "raw", None)
    day = datetime.datetime(2026, 5, 1)
    feed = spark.createDataFrame([row("1", "one", day), row("2", "broken", day), row("1", "one again", day + datetime.timedelta(1))], RAW_ARTICLE)
    mail = spark.createDataFrame([row("3", "undated", None), row(None, "nobody", day)], RAW_ARTICLE)
    failed = ingest_job.run_batch(store, "b1", [feed, mail], models, AT)
    assert [r.uid for r in failed.collect()] == ["2"]
    rows = {r.uid: r for r in store.read("articles").collect()}
    assert set(rows) == {"1", "3"} and rows["1"].summary == "Title: one\nS" and rows["3"].datetime == datetime.datetime(2026, 5, 20)
    assert rows["1"].english_embedding == [len("Title: one\nS\nTopics: t\nThemes: "), 1.0] and rows["1"].detected_language == "pt"
    assert ingest_job.run_batch(store, "b1", [feed], models, AT) is None
    again = ingest_job.run_batch(store, "b2", [feed, mail], models, AT)
    assert [r.uid for r in again.collect()] == ["2"] and store.read("articles").count() == 2 and store.read("lexicon").count() == 1


def test_a_batch_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    rows = _articles(spark, [(f"u{k}", k, _org(f"name {k % 3}")) for k in range(40)])

    def answered(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    store = Store(spark, str(tmp_path / "store"))
    store.commit("one", rows.mapInPandas(answered, rows.schema), ORDER, AT)
    assert seen.value == 40 and store.read("articles").count() == 40
