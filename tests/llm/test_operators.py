"""Operators against brute force, exact round trips and held-out labels, on small inputs with every odd case."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from broadsheet.llm import arrow_text, bpe, discriminant, languages, leaks, licenses, main_text, near_copies, quality_rules, suffixes, toxicity
from broadsheet.llm.queries import fold, table, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, doc string, bucket string, label string"


def _docs(spark, rows):
    """Documents with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, "x", "y", "z") for i, t, lang, src in rows], DOCS)


def _words(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghijklmnoprstu") for _ in range(draw.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(_words(60_000, 7))
    plain = " ".join(_words(300, 1))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, plain, "en", "a"), (4, plain, "en", "a"), (3, plain, "en", "a"),
            (None, plain, "de", "b"), (5, long, "en", "a"), (6, "é", "fr", "a"), (7, "\n \t", "fr", "a"), (3, "other text", "en", "b")]
    return _docs(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, [])


# --- shared helpers


def test_words_and_hashes_agree_with_a_plain_reading():
    texts = ["The cat, the CAT; naïve", "", "x", "  ", "a1b2 ééé"]
    encoded = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])])
    data = np.frombuffer(b"".join(encoded), np.uint8)
    rows, starts, ends, rolling = arrow_text.words_of(offsets, data)
    lowered = b"".join(encoded).decode().lower().encode()
    got = [(r, lowered[s:e].decode()) for r, s, e in zip(rows, starts, ends, strict=True)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())]
    hashes = rolling.of(starts, ends)
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == len({w for _, w in got})


# --- 1 near copies


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], max(row[k], row[k - 1], last + (x == y))
    return row[-1]


def _linked(texts, least=0.8):
    """All pairs whose longest common run of words, gaps allowed, is at least that share of the longer text."""
    said = {i: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t or "")) for i, t in texts.items()}
    bags = {i: Counter(w) for i, w in said.items()}
    out = set()
    for i in said:
        for j in said:
            longer = max(len(said[i]), len(said[j]))
            if i < j and min(len(said[i]), len(said[j])) >= least * longer > 0 and sum((bags[i] & bags[j]).values()) >= least * longer:
                if _lcs(said[i], said[j]) >= least * longer:
                    out.add((i, j))
    return out


def test_near_copies_match_brute_force(spark):
    texts, draw = {}, random.Random(3)
    for g in range(12):
        base = _words(120, 100 + g)
        for k in range(4):
            said = list(base)
            for _ in range(k):
                said[draw.randrange(len(said))] = f"edit{draw.randrange(10**6)}"
            texts[10 * g + k] = " ".join(said)
    for k in range(20):
        texts[500 + k] = " ".join(_words(80, 900 + k))
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in sorted(_linked(texts)):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in near_copies.classes(_docs(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()}
    assert got == {i: find(i) for i in texts}


def test_near_copies_with_much_common_boilerplate_are_found(spark):
    """Families that share two thirds of their text with all others meet foreign heads in most of their buckets."""
    shared, texts = _words(200, 40), {}
    for g in range(60):
        own = _words(100, 4_000 + g)
        edited = [w if k % 7 != 3 else f"edit{g}x{k}" for k, w in enumerate(own)]
        texts[2 * g], texts[2 * g + 1] = " ".join(shared + own), " ".join(shared + edited)
    got = {r.doc_id: r.class_id for r in near_copies.classes(_docs(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()}
    assert got == {i: i - i % 2 for i in texts}


def _one_bucket(spark, texts):
    """Texts that all share their key, as members and documents of ``near_copies.linked``; and their nodes."""
    docs = _docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).selectExpr("doc_id AS doc", "text", "md5(text) AS digest")
    members = docs.selectExpr("xxhash64(digest) AS node", "array(7L) AS keys", "100L AS size", "digest", "doc AS first")
    return members, docs, {r["first"]: r["node"] for r in members.collect()}


def test_no_link_inside_a_bucket_is_lost(spark):
    # Each text is similar to the next only: whichever is the head, most links are between a text that it has and one that it hasn't.
    words = [f"w{k}" for k in range(400)]
    members, docs, nodes = _one_bucket(spark, [" ".join(words[15 * k : 15 * k + 100]) for k in range(12)])
    roots = {r["node"]: r["root"] for r in near_copies.linked(members, docs).collect()}
    assert len({roots[n] for n in nodes.values()}) == 1


def test_members_that_meet_in_blocks_are_compared_like_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "_BLOCK", 3)
    rng = random.Random(11)
    passage, texts = [f"common{k}" for k in range(40)], []
    for family in range(8):
        own = [f"f{family}x{k}" for k in range(60)]
        texts += [" ".join(passage + [w if rng.random() > 0.06 else f"n{rng.random()}" for w in own]) for _ in range(family + 1)]
    members, docs, nodes = _one_bucket(spark, texts)
    code: dict = {}
    said = [np.array([code.setdefault(w, len(code)) for w in t.split()], np.uint32) for t in texts]
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if near_copies.similarity(said[i], said[j])]
    classes = list(range(len(texts)))
    for i, j in similar:
        classes = [classes[j] if c == classes[i] else c for c in classes]
    texts_of = docs.selectExpr("xxhash64(digest) AS node", "text")
    roots = near_copies._settled(members.selectExpr("1L AS bucket", "node"), None, near_copies._sequences(texts_of), near_copies.SIMILARITY)
    got = {r["node"]: r["root"] for r in roots.collect()}
    of = [got.get(nodes[i], nodes[i]) for i in range(len(texts))]
    assert all((of[i] == of[j]) == (classes[i] == classes[j]) for i in range(len(texts)) for j in range(i))


def test_settling_a_bucket_hands_on_fewer_rows_than_it_has_pairs(spark, monkeypatch):
    """Forty near copies of one text and forty texts of the same words in any order share a bucket: no step writes their pairs."""
    rng, made = random.Random(12), []
    base, words = [f"b{k}" for k in range(60)], [f"w{k}" for k in range(60)]
    texts = [" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(40)]
    texts += [" ".join(rng.sample(words, len(words))) for _ in range(40)]
    members, docs, nodes = _one_bucket(spark, texts)
    plain = near_copies.cut_lineage

    def counted(rows):
        made.append(plain(rows))
        return made[-1]

    sequences = near_copies._sequences(docs.selectExpr("xxhash64(digest) AS node", "text"))
    # All share two buckets; the pairs meet in the first of them only.
    placed = members.selectExpr("explode(array(1L, 2L)) AS bucket", "node")
    monkeypatch.setattr(near_copies, "cut_lineage", counted)
    monkeypatch.setattr(near_copies, "_BLOCK", 16)
    roots = {r["node"]: r["root"] for r in near_copies._settled(placed, None, sequences, near_copies.SIMILARITY).collect()}
    monkeypatch.setattr(near_copies, "cut_lineage", plain)
    copies = {nodes[k] for k in range(40)}
    assert {roots[n] for n in copies} == {min(copies)} and all(roots.get(nodes[k], nodes[k]) == nodes[k] for k in range(40, 80))
    assert max(rows.count() for rows in made) <= 2 * 80 * 6
    deals = near_copies._blocks(placed.selectExpr("bucket", "node", "node AS root", "240L AS bytes"))
    links = near_copies._links(placed.selectExpr("bucket", "node", "node AS root"), sequences, near_copies.SIMILARITY)
    assert 39 <= links.count() < deals.count() and links.count() < 40 * 12


def test_buckets_with_the_same_members_are_settled_once(spark):
    members, docs, nodes = _one_bucket(spark, [f"{k} " + " ".join(_words(30, k)) for k in range(6)])
    placed = members.selectExpr("explode(array(1L, 2L, 3L)) AS bucket", "node").union(members.filter("first < 3").selectExpr("4L", "node"))
    got = near_copies._apart(placed, None, None).collect()
    assert {(r["bucket"], r["node"]) for r in got} == {(1, n) for n in nodes.values()} | {(4, nodes[k]) for k in range(3)} and len(got) == 9


def test_rows_that_a_crowded_bucket_deals_grow_with_its_members(spark, monkeypatch):
    """Ever more texts share a passage and differ otherwise; each has one copy with every eighth word changed."""
    monkeypatch.setattr(near_copies, "_BLOCK", 4)
    dealt, plain = [], near_copies._blocks

    def counted(rest):
        dealt.append(plain(rest).count())
        return plain(rest)

    monkeypatch.setattr(near_copies, "_blocks", counted)
    for many in (100, 400):
        texts, passage = [], [f"common{k}" for k in range(12)]
        for family in range(many):
            own = [f"f{family}x{k}" for k in range(20)]
            texts += [" ".join([*passage, *own]), " ".join([*passage, *(f"n{w}" if k % 8 == 3 else w for k, w in enumerate(own))])]
        members, docs, nodes = _one_bucket(spark, texts)
        sequences = near_copies._sequences(docs.selectExpr("xxhash64(digest) AS node", "text"))
        roots = {r["node"]: r["root"] for r in near_copies._settled(members.selectExpr("1L AS bucket", "node"), None, sequences, near_copies.SIMILARITY).collect()}
        assert all(roots[nodes[k]] == roots[nodes[k + 1]] == min(nodes[k], nodes[k + 1]) for k in range(0, 2 * many, 2))
    assert dealt[1] <= 5 * dealt[0] and dealt[1] <= 800 * 8, dealt


def test_components_take_few_jobs(spark, monkeypatch):
    """A path in any order, a large star and two triangles: merged in one task, and by several tasks with joins after them."""
    rng = random.Random(4)
    names = rng.sample(range(-(10**12), 10**12), 400)
    edges = [*zip(names[:200], names[1:200]), *((names[200], n) for n in names[201:394]), *(t for k in (394, 397) for t in ((names[k], names[k + 1]), (names[k + 1], names[k + 2]), (names[k + 2], names[k])))]
    rng.shuffle(edges)
    want = {n: min(part) for part in (names[:200], names[200:394], names[394:397], names[397:]) for n in part}
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "few")
    got = near_copies.components(frame).collect()
    jobs = len(tracker.getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("many", "many")
    monkeypatch.setattr(near_copies, "_FOREST", 60)
    more = near_copies.components(frame).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got)) == sorted(map(tuple, more)) == sorted(want.items()) and jobs <= 8, jobs


def test_near_copies_of_the_given_documents_are_found(spark):
    """At least nine of ten pairs of different texts that are similar word by word are in one class, and no other pairs link classes."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    linked = _linked({i: t for i, t in texts.items() if len(t) < 20_000})
    got = {r.doc_id: r.class_id for r in near_copies.classes(docs).collect()}
    different = [(i, j) for i, j in linked if texts[i] != texts[j]]
    together = sum(got[i] == got[j] for i, j in different)
    assert len(different) > 50 and together >= 0.9 * len(different), (together, len(different))
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    assert all(find(i) == find(got[i]) for i in texts if len(texts[i]) < 20_000)


def test_alignment_in_the_band_is_the_longest_common_subsequence():
    draw = random.Random(5)
    for _ in range(50):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        assert near_copies.matched(a, b, 40) == table[-1][-1]


def test_near_copies_of_odd_rows(odd, empty):
    rows = near_copies.classes(odd).collect()
    classes = sorted((r.doc_id or 0, r.class_id or 0, r.is_kept) for r in rows)
    # 3 holds two texts, which are two documents; 1, 2 and 7 hold no word, 7 another text.
    assert classes == [(0, 0, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 3, False), (5, 5, True), (6, 6, True), (7, 7, True)]
    kept = near_copies.one_of_each(odd)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 3, 5, 6, 7] and kept.columns == odd.columns
    assert near_copies.classes(empty).count() == 0


# --- 2 and 3: SQL on the test tables is compared by tests/test_registered_queries.py


def test_license_scan_of_odd_rows(spark, odd, empty):
    rows = _docs(spark, [(1, "x Under the MIT-license, under the mit license", "en", "a"), (None, "cc by nc", None, None),
                         (2, "licensed under gnu general public license version 3 today", "en", "a")])
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(rows).collect()}
    assert got == {1: (9, 2, 1, 5, "mit", "mit"), None: (3, 1, 0, 0, "cc-by-nc", "cc-by-nc"), 2: (9, 0, None, None, "", "gpl-3")}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0


def test_quality_counts_match_a_plain_reading(spark, odd, empty):
    texts = {1: "a b c a b c x\nline\nline\n\n#x", 2: None, 3: "a a a a", 4: "x\x0by  z", 5: "p q"}
    rows = {r.doc_id: r for r in quality_rules.judged(_docs(spark, [(i, t, None, "s") for i, t in texts.items()])).collect()}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        spoken = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(words), len(covered), len(spoken) - len(set(spoken)))
        assert r.word_chars == sum(map(len, words)) and r.n_symbols == sum(c in "#*$%&|<>" for c in text or "") and r.base_failed and not r.kept
    assert quality_rules.judged(odd).count() == odd.count() and quality_rules.judged(empty).count() == 0


def test_sketch_bins_keep_a_sixteenth(spark):
    values = spark.range(0, 5000).withColumn("bin", quality_rules.bin_of(F.col("id"))).withColumn("low", quality_rules.value_of(F.col("bin")))
    assert all(r.low <= r.id <= r.low * 17 / 16 for r in values.collect())


# --- 4 and 6 and 10: held-out labels


def test_quality_scores_hold_on_other_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = discriminant.scored(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"), fold(5) != 0)
    found = rows.join(table(spark, sf, "labels"), "doc_id").filter(fold(5) == 0).collect()
    assert sum((r.score >= discriminant.THRESHOLD) == (r.quality == 1) for r in found) >= 0.9 * len(found) > 0


def test_languages_hold_on_other_documents(spark, sf):
    rows = languages.predicted(table(spark, sf, "documents").select("doc_id", "text", "lang"), fold(4) != 2).filter(fold(4) == 2).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 0


@pytest.mark.parametrize("count", [2, 4, 5, 9])
def test_codewords_differ(count):
    code = languages.codewords(count)
    assert min((code[i] != code[j]).sum() for i in range(count) for j in range(i)) >= (2 if count > 2 else 1)


def test_toxicity_holds_on_other_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = toxicity.scored(spark, docs, labels, fold(3) != 1).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.score >= toxicity.THRESHOLD for r in clean) <= 0.02 * len(clean)
    assert sum(r.score >= toxicity.THRESHOLD for r in rows if r.toxic == 1) >= 0.7 * sum(r.toxic == 1 for r in rows)


def test_disguises_are_undone():
    counts = np.zeros((toxicity.CLASSES,) * 3, np.int64)
    for word in ("trash", "idiot", "stupid", "moron", "pathetic", "loser", "hello", "the") * 50:
        c = np.concatenate([[0, 0], toxicity._classes_of(word), [0]])
        np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    undo = toxicity.Restorer(toxicity.log_model(counts))
    assert undo("tr4sh 1d1ot s t u p i d! m0r0n p@thetic looooser") == "trash idiot stupid! moron pathetic loser"
    assert undo("hello 2024, the 3.5!!! $$$") == "hello 2024, the 3.5!!! $$$"


def test_disguises_of_every_shape_are_undone():
    counts = np.zeros((toxicity.CLASSES,) * 3, np.int64)
    for word in ("idiot", "stupid", "ass", "asshole", "shit", "yourself", "hello", "the") * 50:
        c = np.concatenate([[0, 0], toxicity._classes_of(word), [0]])
        np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    undo = toxicity.Restorer(toxicity.log_model(counts))
    assert undo("1d10t @$$hole y0ur53lf a$$ 5h1+ the") == "idiot asshole yourself ass shit the"
    assert undo("$ h i t") == "shit" and undo("hello, a s s!") == "hello, ass!" and undo("€l") != "€l"
    assert len(undo("s***t")) == 5 and undo("s***t").isalpha() and undo("st***d") == "stupid"
    assert undo("stu" + 70 * "u" + "pid") == undo("stu" + 300 * "u" + "pid") == "stupid"
    assert undo("hello 1 2 3 the 4.5.6") == "hello 1 2 3 the 4.5.6"


@pytest.mark.parametrize("apply", [
    lambda s, d, l: discriminant.scored(d.select("doc_id", "text"), l), lambda s, d, l: languages.predicted(d.select("doc_id", "text", "lang")),
    lambda s, d, l: toxicity.scored(s, d, l),
])
def test_scores_of_odd_rows(spark, odd, empty, apply):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    rows = apply(spark, odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
    assert apply(spark, empty, labels.limit(0)).count() == 0


# --- 5 main text


def test_main_text_keeps_the_article():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=1>Home</a></li></ul></nav>
    <div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p>One  <b>two</b><br>three<p>Four.</p><div class="comments"><p>I agree</p></div></article>
    <aside>More</aside><footer>&copy; x</footer></body>"""
    assert main_text.main_text(page) == "Head & line\n\nOne two three\n\nFour."
    bare = "<ul class=menu><li><a href=/a>A</a></ul><div>" + "<p>Long sentence of the story itself.</p>" * 3 + "</div><div id='footer'>f</div>"
    assert main_text.main_text(bare) == "\n\n".join(["Long sentence of the story itself."] * 3)
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<p></p><!-- <p>x") == ""
    assert main_text.main_text("<article>a <") == "a <"


def test_main_text_goes_on_behind_what_interrupts_it():
    first, second = ([f"{x} sentence {k} of the story itself." for k in range(n)] for x, n in (("First", 5), ("Second", 3)))
    said = lambda lines: "".join(f"<p>{x}</p>" for x in lines)
    aside = "<aside><h3>Related</h3><ul>" + "<li><a href=/r>Another story</a></li>" * 5 + "</ul></aside>"
    around = "<ul class=menu><li>A<li>B<li>C</ul><div>{}</div><ul><li><a href=/>x</a><li><a href=/>y</a><li><a href=/>z</a></ul><div><p>Some words below.</p></div>"
    assert main_text.main_text(around.format(said(first) + aside + said(second))) == "\n\n".join(first + second)
    parts = f"<div>{said(first)}</div>{aside}<div>{said(second)}</div>"
    assert main_text.main_text(around.format(parts + said(["End."]))).startswith("\n\n".join(first))
    linked = "<p><a href=/s>A source named in a paragraph of links</a></p>"
    got = main_text.main_text(around.format(said(first) + linked + said(second)))
    assert got == "\n\n".join([*first, "A source named in a paragraph of links", *second])


_STORY = [f"Paragraph {k} of the story, with enough words in it to count." for k in range(6)]
_SAID = "".join(f"<p>{x}</p>" for x in _STORY)


@pytest.mark.parametrize("around", [
    '<div class="container no-sidebar">{}</div>', '<div class="layout with-sidebar">{}</div>', '<div class="page has-header">{}</div>',
    '<div class="content side-by-side">{}</div>', '<div id="alert-systems-essay">{}</div>', '<div class="search-results">{}</div>',
    '<form id="page">{}</form>', '<form><article>{}</article></form>', '<div class="sidebar">{}</div>', '<div class="sidebar">' * 3000 + "{}",
    "<div>{}</div><article><h2>Teaser</h2><p>Short.</p></article>", "<article><h2>Teaser</h2><p>Short.</p></article><div>{}</div>",
    '<div class="page-header"><p>Our town</p></div>{}<div class="comments">' + "<p>I agree with all of that, and more.</p>" * 40 + "</div>",
    '<article>{}<form><label>Mail</label><input></form></article><div class="ad-slot">Buy</div>',
])
def test_main_text_lets_the_lines_decide(around):
    page = "<body><nav><a href=/>Home</a></nav>" + around.format(_SAID) + "<footer>(c) x</footer></body>"
    assert main_text.main_text(page).split("\n\n") == _STORY


def test_main_text_keeps_lists_of_references():
    links = "".join(f"<li><a href=/{k}>Reference number {k}</a></li>" for k in range(4))
    listed = [f"Reference number {k}" for k in range(4)]
    page = f"<ul><li><a href=/>Home</a></ul><div>{_SAID}<h2>References</h2><ol>{links}</ol></div>"
    assert main_text.main_text(page).split("\n\n") == [*_STORY, "References", *listed]
    assert main_text.main_text(f"<article>{_SAID}<ul>{links}</ul></article>").split("\n\n") == [*_STORY, *listed]
    assert main_text.main_text(f"<div><ul>{links}</ul>{_SAID}</div>").split("\n\n") == _STORY


def test_main_text_of_the_given_pages_whatever_marks_the_article(spark):
    from html import unescape

    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "html")
    for change in (lambda h: h, lambda h: re.sub("(</?)article", r"\1div", h), lambda h: re.sub("</?article>", "", h)):
        rows = [(r["page_id"], r["html"]) for r in pages.collect()]
        changed = spark.createDataFrame([(i, change(h)) for i, h in rows], "page_id long, html string")
        got = {r["page_id"]: r["text"] for r in main_text.extracted(changed).collect()}
        for i, html in rows:
            inner = html[html.index("<article>") + 9 : html.index("</article>")]
            blocks = (" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1|h2|h3|ul|li|div|blockquote)>", inner))
            assert got[i] == "\n\n".join(x for x in blocks if x)


def test_main_text_of_odd_tables(spark):
    long = "<p>" + "word " * 400_000 + "</p>"
    rows = [(1, None, "a"), (2, "", "b"), (3, _SAID, "c"), (3, _SAID, "c"), (None, "<p>x", None), (4, long, "d"), (5, "<nav>a</nav>", "e"), (6, "<" * 1000, "f")]
    pages = spark.createDataFrame(rows, "page_id long, html string, weights string")
    got = sorted(((r["page_id"] or 0, r["weights"], r["text"]) for r in main_text.extracted(pages).collect()), key=str)
    assert [(i, len(t)) for i, _, t in got] == [(0, 1), (1, 0), (2, 0), (3, len("\n\n".join(_STORY))), (3, len("\n\n".join(_STORY))), (4, 1_999_999), (5, 0), (6, 1000)]
    assert main_text.extracted(pages.limit(0)).collect() == []
    with pytest.raises(ValueError, match="name another"):
        main_text.extracted(pages, to="Weights")


# --- 7 leaks


def test_leaks_find_verbatim_and_edited_copies(spark, odd, empty):
    item = _words(40, 11)
    edited = [w if k % 6 else "changed" for k, w in enumerate(item)]
    rest = _words(100, 12)
    docs = _docs(spark, [(1, " ".join(rest[:50] + item + rest[50:]), "en", "a"), (2, " ".join(rest[:20] + edited), "en", "a"),
                         (3, " ".join(rest), "en", "a"), (4, None, "en", "a"), (1, " ".join(item).upper(), "en", "a")])
    items = spark.createDataFrame([(7, " ".join(item), 0), (8, "two words", 0), (9, None, 0), (None, "x y z", 0)], "item_id long, text string, doc_id long")
    found = sorted((r.doc_id, r.item_id, round(r.score, 2), r.first_word, r.last_word) for r in leaks.leaks(docs, items).collect())
    assert [x[:2] for x in found] == [(1, "7"), (1, "7"), (2, "7")] and (1, "7", 1.0, 50, 89) in found and found[2][2] > leaks.THRESHOLD
    assert sorted(r.doc_id for r in leaks.clean(docs, items).collect()) == [3, 4]
    assert leaks.clean(odd, items).columns == odd.columns and leaks.clean(odd, items).count() == odd.count()
    assert leaks.leaks(empty, items).count() == 0 and leaks.leaks(odd, items.limit(0)).count() == 0


def test_leaks_of_items_that_share_a_phrase_go_by_their_rare_words():
    phrase = [f"p{k}" for k in range(8)]
    texts = [" ".join(phrase + [f"w{i}x{k}" for k in range(12)]) for i in range(300)]
    table = leaks.Items(texts)
    table.keep_rarest({int(w): 99 for w in table.words[:8].view(np.int64)}, leaks.THRESHOLD)
    assert all(np.diff(table.rare_bounds) == 20 - 9 + 1) and not set(table.rare.tolist()) & set(table.words[:8].tolist())
    said = [" ".join([f"z{k}" for k in range(50)] + phrase), texts[17] + " and more", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(said)], names=["text"])
    ((count, rows, words),) = leaks._word_blocks(batch)
    row, _, item, _ = leaks._hits(rows, words, table)
    kept = table.possible(rows, words, row, item)
    assert len(row) > 3600 and set(zip(row[kept].tolist(), item[kept].tolist())) == {(1, 17)}
    assert [[h["item"] for h in x] for x in leaks._found(rows, words, count, table, leaks.THRESHOLD)] == [[], [17], []]


def test_leaks_find_edited_copies_that_many_documents_hold(spark):
    item = _words(40, 11)
    edited = " ".join(w if k % 4 != 3 else "changed" for k, w in enumerate(item))
    docs = _docs(spark, [(k, f"{' '.join(_words(30, 700 + k))} {edited}", "en", "a") for k in range(12)] + [(50, " ".join(_words(90, 60)), "en", "a")])
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in leaks.leaks(docs, items).collect()) == list(range(12))


# --- 8 byte pairs


def test_encoding_is_the_tokenizer_librarys(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    extra = ["Hello <|endoftext|>world", "ΑΣ İstanbul c'est 's'street aaaaaaa ll'll 12345 日本語 😀 é ﬁ ½ ² a\x1cb c\x85d", "!!!???..."]
    rows = odd.unionByName(_docs(spark, [(100 + k, t, "en", "a") for k, t in enumerate(extra)]))
    encoded = bpe.decode(bpe.encode(rows, tokenizer_path()), tokenizer_path()).collect()
    for r in encoded:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    sha = lambda said: hashlib.sha256(said.encode()).hexdigest()
    digests = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(rows, tokenizer_path()).collect())
    wanted = [(r.doc_id or 0, library.encode(r.text or "", add_special_tokens=False).ids) for r in encoded]
    assert digests == sorted((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for i, ids in wanted)
    assert bpe.digests(empty, tokenizer_path()).count() == 0


# --- 9 suffixes


@pytest.mark.parametrize("length, gram", [(100, 28), (16, 8)])
def test_removal_matches_a_dictionary_of_all_strings(spark, length, gram):
    draw = random.Random(9)
    shared = " ".join(_words(60, 21))
    texts = {}
    for k in range(60):
        said = " ".join(_words(30, 300 + k))
        if k % 3 == 0:
            said += shared[draw.randrange(50) : 50 + draw.randrange(300)] + "é" * (k % 2 * 150) + said[:120]
        texts[k] = said * (2 if k % 10 == 5 else 1)
    texts[60], texts[61], texts[62] = "ab" * 400, "", texts[3]
    rows = suffixes.removed(_docs(spark, [(i, t, "en", "a") for i, t in texts.items()]).repartition(4), length=length, gram=gram).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}
    assert got == suffixes.brute({i: t.encode() for i, t in texts.items()}, length)


def test_the_cover_has_a_shift_for_every_two_positions():
    for r in range(suffixes.PERIOD):
        for s in range(suffixes.PERIOD):
            k = suffixes.shifts()[r, s]
            assert {(r + k) % suffixes.PERIOD, (s + k) % suffixes.PERIOD} <= set(suffixes.COVER)


def test_removal_from_odd_rows(odd, empty):
    rows = suffixes.removed(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id == 4:
            assert (r.n_removed, r.n_spans) == (r.n_bytes, 1)
        else:
            assert r.n_removed == 0 and bytes(r.kept).decode() == (r.text or "")
    assert suffixes.deduplicated(odd).columns == odd.columns and suffixes.deduplicated(empty).count() == 0


def test_removal_from_documents_with_columns_named_like_those_of_spans(spark):
    said = " ".join(_words(60, 33))
    rows = [(k, said + str(k), k, k, "h", "b") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place long, more int, hash string, bytes string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.removed(docs).collect()}
    assert got == suffixes.brute({r[0]: r[1].encode() for r in rows})


# --- pipeline


def test_removal_takes_one_python_worker_for_each_task(spark):
    phrase = " ".join(_words(40, 3))
    texts = [(1, phrase + " é", "en", "a"), (2, "é" + phrase + "é", "en", "a"), (3, phrase, "en", "a"), (4, "", "en", "a"), (5, None, "en", "a"), (None, phrase, "en", "a")]
    cut = suffixes.deduplicated(_docs(spark, texts))
    # Rows with an id and those without, each in tasks of their own.
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    assert {r.doc_id: r.text for r in cut.collect()} == {1: phrase + " é", 2: "éé", 3: "", 4: "", 5: None, None: phrase}


def test_a_worker_gives_back_what_its_allocators_hold():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    arrow_text.let_go()
    before = resident()
    kept, made = [], [np.ones(1 << 13) for _ in range(4_000)]  # too small to be mapped on their own
    kept.append(np.ones(1 << 13))  # and the last one stays, so that the heap can't shrink
    del made
    arrow_text.let_go()
    assert resident() - before < 100 << 20


def test_pipeline_keeps_clean_documents(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf)
    docs = table(spark, sf, "documents").count()
    assert 0.5 * docs < rows.count() <= docs and {"doc_id", "n_tokens", "token_ids"} <= set(rows.columns)


def test_every_operator_is_registered():
    names = contract.queries()
    assert {re.match(r"op(\d+)_", n).group(1) for n in names if n.startswith("op")} == {str(k) for k in range(1, 11)} and "pipeline" in names


def test_a_worker_keeps_the_tables_of_one_operator():
    model = toxicity.log_model(np.ones((64, 64, 64)))
    first = toxicity._restorer(model)
    assert toxicity._restorer(model) is first
    encoder = bpe._encoder(type("Shared", (), {"value": bpe.Vocabulary(tokenizer_path())}))
    assert list(arrow_text._held.values()) == [encoder]
    arrow_text.let_go()
    assert not arrow_text._held
