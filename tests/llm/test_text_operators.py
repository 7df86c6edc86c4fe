"""SentencePiece coding, fill-in-middle and spelling variants against the library, plain readings and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from broadsheet.llm import fill_middle, pieces, suffixes, toxicity, variants
from broadsheet.llm.queries import PIECES, table, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, draws string, word string, n string, signature string"


def _docs(spark, rows):
    """Documents with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "u", "v", "w") for i, t in rows], DOCS)


def _junk(alphabet, count, longest, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randrange(longest))) for _ in range(count)]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(_junk("abcdeghilnorstuz", 40_000, 12, 7))
    rows = [(1, None), (2, ""), (3, "Colour and color,  colour\n"), (3, "Colour and color,  colour\n"), (None, "\t naïve ▁ text \u0000 漢字"),
            (4, long), (5, "   "), (6, "a <P> b <M> c"), (7, "other text under one id"), (7, "text under one id, other")]
    return _docs(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, [])


# --- 11 sentence pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))


@pytest.fixture(scope="module")
def coder():
    with open(tokenizer_path(PIECES), "rb") as file:
        return pieces.Backtracker(pieces.Pieces(file.read()))


def test_backtracking_gives_the_ids_and_texts_of_the_library(coder, library):
    texts = [*_junk("aabbe  \n\t▁é😀ｑthing<s>01́漢字\u0000", 800, 60, 1), *_junk("ab", 100, 200, 2), *_junk("the ", 200, 80, 3)]
    for n in range(70):
        texts += [" " * n, " " * n + "hello", "x" + " " * n + "zq" + " " * (n % 37), "=" * n, "-" * n + "x"]
    texts += ["ab" * 20_000, "".join(random.Random(4).choice("abcdeghi") for _ in range(30_000))]
    assert [coder.encode(t) for t in texts] == library.encode(texts)
    assert [coder.decode(coder.encode(t)) for t in texts] == [library.decode(i) for i in library.encode(texts)]


def test_any_ids_decode_like_the_library(coder, library):
    draw = random.Random(5)
    for _ in range(4_000):
        ids = [draw.choice([draw.randrange(3, 259), draw.randrange(32_000), draw.randrange(3), 28_705]) for _ in range(draw.randrange(8))]
        assert coder.decode(ids) == library.decode(ids)
    with pytest.raises(ValueError):
        coder.decode([32_000])


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_encoding_is_the_plain_order_of_merges(coder, text):
    plain = coder.merged("▁" + text.replace(" ", "▁")) if text else []
    assert [i for i in coder.encode(text) if i not in coder._p.bytes_of] == [coder._p.ids[p] for p in plain if p in coder._p.ids]


def test_encode_and_decode_columns(spark, odd, empty, library):
    path = tokenizer_path(PIECES)
    coded = pieces.decode(pieces.encode(odd, path), path)
    assert coded.columns == [*odd.columns, "piece_ids", "decoded"]
    for row in coded.collect():
        assert row.piece_ids == library.encode(row.text or "")
        assert row.decoded == library.decode(row.piece_ids)
    assert pieces.encode(empty, path).count() == 0 and pieces.digests(empty, path).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(odd, path, to="Draws")


def test_piece_digests_of_whole_documents(spark, sf, library):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = pieces.digests(table(spark, sf, "documents"), tokenizer_path(PIECES)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# --- 12 fill in the middle


def _plain_fim(doc, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_piece_tables_match_plain_strings(spark, odd):
    texts = [(i, t) for i, t in enumerate(_junk("ab \n\té漢<PSM>\x0b ", 400, 40, 9))]
    rows = [*texts, *((r.doc_id, r.text) for r in odd.collect())]
    got = fill_middle.digests(_docs(spark, rows)).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((d, n, f, p, m, digest(o), digest(t or "")) for d, t in rows for n, f, p, m, o in [_plain_fim(d, t)]), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_transformed_texts_come_back(odd, empty):
    there = fill_middle.transformed(odd)
    back = fill_middle.originals(there)
    assert back.columns == [*odd.columns, "fim_text", "fim_form", "restored"]
    for row in back.collect():
        assert row.restored == (row.text or "") and row.fim_text == _plain_fim(row.doc_id, row.text)[-1]
    assert fill_middle.originals(fill_middle.transformed(empty)).count() == 0


@given(st.text("ab<PSM> ", max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm"]))
def test_cuts_split_and_arrangements_permute(text, a, b, form):
    data = text.encode()
    one, two = sorted((min(a, len(data)), min(b, len(data))))
    cut = fill_middle.PieceTable.whole(data).cut(one, two)
    assert len(cut.pieces) == 3 and cut.joined() == data and cut.cut(one, one, two).joined() == data
    output = cut.arranged(form).joined()
    assert len(output) == len(data) + 9 and cut.arranged(form).digest() == hashlib.sha256(output).hexdigest()
    if not any(m in text for m in ("<P>", "<S>", "<M>")):
        assert fill_middle.restored(output, form).joined() == data


def test_a_text_of_another_form_is_an_error():
    with pytest.raises(ValueError):
        fill_middle.restored(b"<P>a<S>b", "psm")
    with pytest.raises(ValueError):
        fill_middle.restored(b"a<P>", "spm")


# --- 13 spelling variants


def test_variants_match_brute_force(spark, odd):
    draw, texts = random.Random(11), []
    bases = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(4, 9))) for _ in range(60)]
    for doc in range(300):
        words = []
        for _ in range(40):
            word = draw.choice(bases[: draw.choice([5, 20, 60])])
            if draw.random() < 0.4:
                at, letter = draw.randrange(len(word)), draw.choice("abé")
                word = draw.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word.upper()])
            words.append(word)
        texts.append((doc, draw.choice([" ", ", ", "7"]).join(words)))
    texts += [(doc, " ".join(["misspelling"] * 3 + ["Äpfel", "äpfel", "÷×abcÀ"])) for doc in range(500)]
    for k, n in enumerate((4, 9, 20, 50, 120)):  # a chain of forms
        texts.append((1_000 + k, " ".join(["zuverlässigkeiten"[: 10 + k]] * n)))
    rows = [*texts, *((r.doc_id, r.text) for r in odd.collect())]
    got = variants.variants(_docs(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = variants.brute(rows)
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert any(w[2] not in (w[0], w[1]) for w in want)  # some root is more than one step away


@given(st.text("abcé", min_size=1, max_size=9), st.integers(0, 8), st.sampled_from("abcé"), st.sampled_from(["replace", "insert", "delete"]))
@settings(max_examples=300, deadline=None)
def test_near_words_share_a_signature(word, at, letter, edit):
    at = min(at, len(word) - 1)
    other = {"replace": word[:at] + letter + word[at + 1 :], "insert": word[:at] + letter + word[at:], "delete": word[:at] + word[at + 1 :]}[edit]
    if word == other or not other:
        return
    at, signature, side = variants.keys([word, other])
    of = [{(s, d) for r, s, d in zip(at.tolist(), signature.tolist(), side.tolist(), strict=True) if r == k} for k in (0, 1)]
    if len(word) == len(other):
        assert any(d == 0 and (s, 0) in of[1] for s, d in of[0])
    else:
        short, long = of if len(word) < len(other) else of[::-1]
        assert any(d == 1 and (s, 2) in long for s, d in short)


def test_no_words_at_all(spark, empty):
    assert variants.variants(empty).count() == 0
    assert variants.variants(_docs(spark, [(1, None), (2, "one two"), (3, "")])).count() == 0


# --- 10 toxicity: the lattice


def _all_paths(word, model):
    """The best score and all readings that reach it, by going through every path of the lattice."""
    runs = [(m.group(0)[0], len(m.group(0))) for m in re.finditer(r"\*|(.)\1*", re.sub(r"[ .\-_]", "", word.lower()), re.S)]
    paths = [("", 0.0)]
    for sign, length in runs:
        if sign.isalpha():
            options = [(sign, toxicity._COST_SINGLED * (length > 1)), *([(sign * 2, toxicity._COST_DOUBLED)] if length > 1 else [])]
        else:
            options = [(c, toxicity._COST_SIGN) for c in toxicity.STANDS_FOR[sign]]
            if sign != "*":
                options += [(c * 2, toxicity._COST_SIGN + toxicity._COST_DOUBLED) for c in toxicity.STANDS_FOR[sign] if length > 1]
                options.append(("", toxicity._COST_KEPT * length))
        paths = [(said + piece, cost + extra) for said, cost in paths for piece, extra in options]

    def score(said, cost):
        codes = [0, 0, *toxicity._classes_of(said), 0]
        return sum(float(model[tuple(codes[k : k + 3])]) for k in range(len(codes) - 2)) - cost

    scored = [(score(*p), p[0]) for p in paths]
    top = max(scored)[0]
    return {said for value, said in scored if value > top - 1e-6}


def test_restored_words_are_the_best_of_all_paths():
    draw = random.Random(8)
    model = np.log(np.random.default_rng(8).dirichlet(np.full(toxicity.CLASSES, 0.3), (toxicity.CLASSES, toxicity.CLASSES)) + 1e-9).astype(np.float32)
    for _ in range(300):
        word = "".join(draw.choice("abé1$0*") * draw.choice([1, 1, 1, 2]) for _ in range(draw.randint(1, 4)))
        if word.count("*") <= 3:
            assert toxicity.restore(word, model) in _all_paths(word, model), word


# --- 9 suffixes: a phrase in a third of all rows


def test_a_phrase_that_many_texts_embed_is_split_exactly(spark, monkeypatch):
    draw, phrase = random.Random(13), "the same sixty bytes stand in very many rows of this corpus!"
    shared = "".join(draw.choice("abcdefgh ") for _ in range(150))
    texts = {}
    for doc in range(900):
        before, after = ("".join(draw.choice("abcdefghijklmnop ") for _ in range(90)) for _ in range(2))
        texts[doc] = before + (phrase if doc % 3 == 0 else "") + after + (shared if doc % 50 == 7 else "") + (phrase + shared[:60] if doc % 9 == 0 else "")
    monkeypatch.setattr(suffixes, "HOT", 40)
    got = suffixes.digests(_docs(spark, list(texts.items())))
    assert "min(struct(doc" in got._jdf.queryExecution().toString()  # the hot bucket went the other way
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()}
    assert rows == suffixes.brute({i: t.encode() for i, t in texts.items()})
    assert sum(r[1] for r in rows.values()) > 2_000
