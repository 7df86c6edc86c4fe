import datetime
import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from broadsheet.functions import similarity
from broadsheet.operators import entities
from broadsheet.schemas import ENTITY_LEXICON
from tests import brute

WORDS = st.text(alphabet="abcdeér ", min_size=0, max_size=40)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_similarity_equals_plain_version(a, b):
    assert similarity.jaro_winkler_pairs([a], [b])[0] == brute.jaro_winkler(a, b)


@settings(max_examples=300, deadline=None)
@given(WORDS, st.data())
def test_keys_lose_no_pair(a, data):
    letters = list(a)
    for _ in range(data.draw(st.integers(0, 6))):
        at = data.draw(st.integers(0, len(letters)))
        if data.draw(st.booleans()):
            letters.insert(at, data.draw(st.sampled_from("abcdeér")))
        elif at < len(letters):
            letters.pop(at)
    b = "".join(letters)
    if brute.jaro_winkler(a, b) >= 0.88:
        of_a, of_b = similarity.join_keys(a, 0.88), similarity.join_keys(b, 0.88)
        assert set(of_a["longer"]) & set(of_b["shorter"]) or set(of_a["shorter"]) & set(of_b["longer"])


def _names(seed, count, letters="abcd"):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(count // 3)]
    names = []
    for _ in range(count):
        name = list(rng.choice(stems))
        for _ in range(rng.randint(0, 2)):
            name.insert(rng.randint(0, len(name)), rng.choice(letters))
        text = "".join(name)
        names.append(rng.choice([text, text.upper(), f" {text} ", text.title()]))
    return names


def test_similar_pairs_equal_all_pairs(spark):
    words = sorted({n.strip().lower() for n in _names(3, 240, "abcdefg")})
    kinds = {w: "PERSON" if i % 3 else "ORG" for i, w in enumerate(words)}
    frame = spark.createDataFrame([(kinds[w], w) for w in words], "type string, word string")
    got = {(r.left_word, r.right_word): r.similarity for r in entities.similar_pairs(frame, frame).collect()}
    want = {
        (a, b): brute.jaro_winkler(a, b)
        for a in words for b in words
        if kinds[a] == kinds[b] and brute.jaro_winkler(a, b) >= 0.88
    }
    assert got == want


def _mentions(spark, rows):
    numbered = [(i, *r) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(numbered, "n long, uid string, raw_name string, entity_type string")
    return frame.select("uid", F.struct("n").alias("seq"), "raw_name", "entity_type")


def _lexicon(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    timed = [(r, c, k, start + datetime.timedelta(minutes=i)) for i, (r, c, k) in enumerate(rows)]
    return spark.createDataFrame(timed, ENTITY_LEXICON)


def _same_as_sequential(spark, mentions, lexicon):
    got, added = entities.resolve(_mentions(spark, mentions), _lexicon(spark, lexicon))
    want, want_added = brute.resolve(mentions, lexicon)
    assert Counter(tuple(r) for r in got.select("uid", "entity_type", "raw_name", "canonical_name").collect()) == Counter(want)
    assert Counter(tuple(r) for r in added.select("raw_name", "canonical_name", "entity_type").collect()) == Counter(want_added)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolution_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    mentions = [(f"a{i // 4}", name, rng.choice(["PERSON", "ORG"])) for i, name in enumerate(_names(seed, 150))]
    known = [n.strip() for n in _names(seed + 50, 12)]
    lexicon = [(n, n.title(), rng.choice(["PERSON", "ORG"])) for n in dict.fromkeys(known)]
    _same_as_sequential(spark, mentions, lexicon)


def test_resolution_in_lots_equals_one_by_one(spark, monkeypatch):
    """Names are decided lot by lot, and the first lots spare later ones most of their pairs."""
    monkeypatch.setattr(entities, "_FIRST_LOT", 15)
    met, pairs = [], entities.similar_pairs

    def counted(left, right, least):
        found = pairs(left, right, least)
        met.append(found.count())
        return found

    monkeypatch.setattr(entities, "similar_pairs", counted)
    rng = random.Random(8)
    mentions = [(f"a{i // 4}", name, rng.choice(["PERSON", "ORG"])) for i, name in enumerate(_names(8, 150, "ab"))]
    lexicon = [(n, n.title(), rng.choice(["PERSON", "ORG"])) for n in dict.fromkeys(n.strip() for n in _names(58, 12, "ab"))]
    _same_as_sequential(spark, mentions, lexicon)
    words = {n.strip().lower(): k for _, n, k in reversed(mentions)}
    every = sum(words[a] == words[b] and brute.jaro_winkler(a, b) >= 0.88 for a in words for b in words)
    assert sum(met) < every, (sum(met), every)


def test_best_of_the_lexicon_equals_all_pairs(spark):
    """Equal, close and less close names, and a type that the lexicon lacks."""
    names = sorted({n.strip().lower() for n in _names(6, 120, "abcdefg")})
    known = sorted({n.strip().lower() for n in _names(6, 60, "abcdefg")})
    frame = spark.createDataFrame([(t, w) for w in names for t in ("ORG", "LOC")], "type string, word string")
    got = {r.word: (r.type, r.canonical_name, r.similarity) for r in entities.fuzzy_lookup(frame, _lexicon(spark, [(n, n.upper(), "ORG") for n in known])).collect()}
    want = {}
    for a in names:
        best = min((-brute.jaro_winkler(a, b), b.upper()) for b in known)
        if -best[0] >= 0.88:
            want[a] = ("ORG", best[1], -best[0])
    assert got == want and {s == 1 for _, _, s in want.values()} == {True, False}


def test_resolution_cases(spark):
    lexicon = [("Eskom Holdings", "Eskom", "ORG"), ("La CEDEAO", "ECOWAS", "ORG"), ("Sénégal", "Senegal", "LOC")]
    mentions = [
        ("u1", "eskom holdings", "PERSON"),  # exact hit under another type
        ("u1", " Eskomm ", "ORG"),           # similar, kept untrimmed in the entities
        ("u2", "Eskomm", "LOC"),             # known by then, whatever the type
        ("u2", "", "ORG"), ("u2", "  ", "ORG"), ("u2", "Nobody", ""),
        ("u3", "Nairobi County", "GPE"), ("u3", "Nairobi Countys", "GPE"), ("u4", "Nairobi Countyss", "GPE"),
    ]
    _same_as_sequential(spark, mentions, lexicon)


def test_hot_name_resolves(spark):
    mentions = [("u", "Busy Name", "ORG")] * 3000 + [("v", "Busy Names", "ORG"), ("w", "Other", "ORG")]
    _same_as_sequential(spark, mentions, [])


def test_entity_shapes(spark):
    shapes = [
        '[{"raw_name":"A","entity_type":"ORG"},{"name":"B","type":"GPE"},{"raw_name":"C"}]',
        '["Plain", "Second"]', '{"raw_name":["X","Y"],"entity_type":["ORG","LOC"]}',
        '{"name":["P"],"type":["PERSON"]}', "[]", None,
    ]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, j string")
    rows = frame.select("i", entities.entity_array(F.col("j")).alias("e")).orderBy("i").collect()
    got = [None if r.e is None else [(x.raw_name, x.entity_type) for x in r.e] for r in rows]
    assert got == [
        [("A", "ORG"), ("B", "GPE")], [("Plain", "Unknown"), ("Second", "Unknown")],
        [("X", "ORG"), ("Y", "LOC")], [("P", "PERSON")], [], None,
    ]


def test_lexicon_first_writer_wins(spark):
    lexicon = _lexicon(spark, [("A", "Old", "ORG")])
    more = spark.createDataFrame(
        [("A", "New", "ORG"), ("a", "Lower", "ORG"), ("B", "B1", "GPE")], "raw_name string, canonical_name string, entity_type string"
    )
    rows = entities.add_to_lexicon(lexicon, more, F.lit("2024-02-01")).collect()
    assert {(r.raw_name, r.canonical_name) for r in rows} == {("A", "Old"), ("a", "Lower"), ("B", "B1")}
