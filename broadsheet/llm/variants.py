"""Spelling variants: words that one inserted, deleted or replaced letter tells apart, found by PartEnum signatures.

1.  *Words.* Runs of letters of whole texts, A-Z in lower case, are counted: by document, by task, then over all.
2.  *Vectors.* The letters of a word are a multiset, seen as a binary vector with one dimension for each letter and
    occurrence number. One edit changes two dimensions at most: words of equal length that are near have Hamming
    distance two, a word and one that has a letter more have distance one.
3.  *PartEnum.* The dimensions are dealt to parts by a hash. Vectors at distance k agree on all parts but k, so each word has a
    signature for every set of parts that leaves out k of them: 2 of ``REPLACED`` parts among words of one length,
    1 of ``INSERTED`` parts between words of neighbouring lengths. No pair is missed.
4.  As the edit also leaves one half of the word alone, each signature is taken once with the shorter length's half of
    letters at the front and once with those at the back. That keeps signatures rare, however large the vocabulary is.
5.  Words that share a signature are joined on it, and verified by their edit distance in the join.

Each word's *form* is its near word that occurs most often (of equals the smallest in code-point order), if that occurs at
least ``TIMES`` as often; forms are followed to the last one, the *root*, by doubling the steps: an occurrence at
least doubles with each step, so few rounds do.

Defined cases: null and empty texts have no words; a null id counts as the empty text where the draw of misspellings is
made; repeated rows count each for itself; texts of any length are read whole; other columns, whatever their names, play no part;
an empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.arrow_text import scramble
from broadsheet.session import cut_lineage

LEAST_LETTERS, LEAST_SEEN = 5, 3
TIMES = 2
MISSPELT = 97
REPLACED, INSERTED = 4, 3  # parts
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_HELD = 100_000


def misspelt(run: str, prefix: int, one_in: int = MISSPELT) -> str:
    """A lower-cased run, without one letter where the checksum that goes on from ``prefix`` says so."""
    drawn = zlib.crc32(run.encode(), prefix)
    if drawn % one_in:
        return run
    at = drawn % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, seen: int = LEAST_SEEN) -> DataFrame:
    """word and n: runs of ``docs`` after the draw of misspellings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            ids = batch.column("doc").to_pylist()
            for doc, said in zip(ids, batch.column("text").cast(pa.large_binary()), strict=True):
                lowered = (said.as_py() or b"").translate(_LOWER).decode()
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(_RUN.findall(lowered)).items():
                    if len(word) >= least:
                        word = misspelt(word, prefix)
                        if len(word) >= least:
                            held[word] += n
                if len(held) >= _HELD:
                    yield rows()
        yield rows()

    chosen = docs.select(docs[key].cast("string").alias("doc"), docs[text].cast("string").alias("text"))
    parts = chosen.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= seen)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, the row of each, and the boundaries of the rows."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    return points, np.repeat(np.arange(len(words)), sizes), np.concatenate([[0], np.cumsum(sizes)])


def part_sums(points: np.ndarray, rows: np.ndarray, count: int, parts: int) -> np.ndarray:
    """Of each row's binary vector a hash for each part of the dimensions (letter, occurrence number)."""
    order = np.lexsort((points, rows))
    p, r = points[order], rows[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (r[1:] != r[:-1])]) if len(p) else np.zeros(0, bool)
    occurrence = np.arange(len(p)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(p) else p.astype(np.int64)
    with np.errstate(over="ignore"):
        dimension = scramble(p * np.uint64(0x1_0000_0001) + occurrence.astype(np.uint64) + np.uint64(parts))
        sums = np.zeros((count, parts), np.uint64)
        np.add.at(sums, (r, (dimension % np.uint64(parts)).astype(np.int64)), scramble(dimension))
    return sums


def signatures(sums: np.ndarray, left_out: int) -> np.ndarray:
    """PartEnum: of each row a number for every set of parts that leaves out ``left_out`` of them."""
    parts = sums.shape[1]
    with np.errstate(over="ignore"):
        out = []
        for k, gone in enumerate(combinations(range(parts), left_out)):
            made = np.full(len(sums), k + 1 + 64 * parts, np.uint64)
            for part in set(range(parts)) - set(gone):
                made = scramble(made * np.uint64(31) + sums[:, part])
            out.append(made)
    return np.stack(out, 1)


def _halves(points: np.ndarray, bounds: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and of the last ``half`` letters of each row."""
    front, back = (np.zeros(len(half), np.uint64) for _ in range(2))
    with np.errstate(over="ignore"):
        for k in range(int(half.max(initial=0))):
            there = half > k
            front[there] = scramble(front[there] * np.uint64(31) + points[bounds[:-1][there] + k])
            back[there] = scramble(back[there] * np.uint64(31) + points[bounds[1:][there] - half[there] + k])
    return front, back + np.uint64(1)


# Sides of a signature: among equal lengths, the shorter word, the longer word.
_EQUAL, _SHORT, _LONG = 0, 1, 2


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, signature and side for all signatures of the words."""
    points, rows, bounds = _letters(words)
    sizes = np.diff(bounds)
    replaced = signatures(part_sums(points, rows, len(words), REPLACED), 2)
    inserted = signatures(part_sums(points, rows, len(words), INSERTED), 1)
    found = []
    for side, drawn, longer in ((_EQUAL, replaced, sizes), (_SHORT, inserted, sizes + 1), (_LONG, inserted, sizes)):
        for end in _halves(points, bounds, np.maximum(longer - (side != _EQUAL), 0) // 2):
            with np.errstate(over="ignore"):
                found.append((side, scramble(drawn ^ scramble(end * np.uint64(64) + longer.astype(np.uint64))[:, None])))
    at = np.concatenate([np.repeat(np.arange(len(words)), made.shape[1]) for _, made in found])
    sides = np.concatenate([np.full(made.size, side, np.int32) for side, made in found])
    return at, np.concatenate([made.ravel() for _, made in found]).view(np.int64), sides


def near(words: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of words that one edit tells apart, each once. ``words``: word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, signature, side = keys(batch.column("word").to_pylist())
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(signature), pa.array(side), *taken.columns], names=["signature", "side", "word", "n"])

    drawn = words.select("word", "n").mapInArrow(run, "signature long, side int, word string, n long")
    left = drawn.select("signature", F.col("side").alias("side_a"), F.col("word").alias("a"), F.col("n").alias("n_a")).filter(f"side_a <> {_LONG}")
    right = drawn.select("signature", F.col("side").alias("side_b"), F.col("word").alias("b"), F.col("n").alias("n_b")).filter(f"side_b <> {_SHORT}")
    # Hot signatures are split by adaptive execution, which a sort-merge join allows.
    met = left.join(right.hint("merge"), "signature").filter(
        f"(side_a = {_EQUAL} AND side_b = {_EQUAL} AND a < b) OR (side_a = {_SHORT} AND side_b = {_LONG})"
    )
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b").distinct()


def rooted(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form. ``forms``: word, form."""
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut_lineage(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if joined.filter("moved").isEmpty():
            return joined.select("word", "root")
        steps = joined.select("word", "root")


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of counted words."""
    words = cut_lineage(words.select("word", "n"))
    pairs = cut_lineage(near(words))
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    with_best = words.join(best, "word", "left")
    strong = -F.col("best.less") >= times * F.col("n")
    formed = cut_lineage(with_best.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
    ))
    roots = rooted(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of ``docs`` with their near words, forms and roots."""
    return grouped(counted(docs, key, text))


def brute(texts: list[tuple[int | None, str | None]]) -> set[tuple]:
    """The same by comparing all pairs, for tests."""
    total: Counter[str] = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}

    def one_edit(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    nearby = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, some in nearby.items():
        best = min(some, key=lambda x: (-words[x], x)) if some else None
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(nearby[w]), words[form[w]] if form[w] is not None else None))
    return out
