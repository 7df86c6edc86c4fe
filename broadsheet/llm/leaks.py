"""Documents that hold benchmark items: word n-grams as seeds, Smith-Waterman on words.

Three-word runs of an item are its seeds. An alignment that reaches the threshold matches at least ``THRESHOLD`` of the item's words, so
it matches one of the ``1 - THRESHOLD`` of them that are rarest in the whole corpus, and one more: a seed counts only in
texts that hold one of these rare words too. A phrase that many texts and items share thus leads to items whose other words are there, and
no copy is lost by it. Wherever a seed counts the item is aligned
locally with the words around, and the score, as a share
of the score of a verbatim copy, tells copies (also edited ones: a fifth
of the words changed leaves about two thirds) from chance. Places with too few of the item's words
for the threshold, in whatever order, are left out before; no alignment there could reach it.

Test items go to the tasks in blocks of at most ``BLOCK_BYTES`` of text, two passes each (to count words, to search), so nothing that
grows with the corpus is broadcast and documents are never shuffled; a task sends on one count for each word of the block.

Defined cases: items of fewer than ``SEED`` words, or null, match nothing; equal items match each; null and
empty texts hold none; repeated rows are searched each on its own; all columns of ``docs`` stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.arrow_text import columns, let_go, per_row, row_blocks, scramble, words_of

SEED = 3
BLOCK_BYTES = 8 << 20
_TEXT_BYTES = 1 << 18  # of documents that are read at a time
MATCH, MISMATCH, GAP = 3, -2, -2
THRESHOLD = 0.45


def runs(rows: np.ndarray, words: np.ndarray, size: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of ``size`` words inside a row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    made = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            made = made * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        made = scramble(made)
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return at, made[at]


class Items:
    """A block of test items: words, and seeds with the places they come from."""

    def __init__(self, texts: list[str]):
        encoded = [(t or "").encode("utf-8", "replace") for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
        rows, starts, ends, rolling = words_of(offsets, np.frombuffer(b"".join(encoded), np.uint8))
        self.words, self.bounds = rolling.of(starts, ends), per_row(rows, len(texts))
        at, seeds = runs(rows, self.words)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item = seeds[order], rows[at[order]]
        self.place = at[order] - self.bounds[self.item]

        self.rare, self.rare_bounds = self.words, self.bounds

    def keep_rarest(self, held: dict[int, int], least: float) -> None:
        """Notes the words of each item of which an alignment must match one; ``held`` says how often a word stands in the corpus, if it does."""
        found = np.array([held.get(x, 0) for x in self.words.view(np.int64).tolist()], np.int64)
        sizes = np.diff(self.bounds)
        of = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((self.words, found, of))
        rank = np.arange(len(order)) - self.bounds[of]
        kept = rank <= sizes[of] - np.ceil(least * sizes[of] - 1e-9)
        self.rare, self.rare_bounds = self.words[order[kept]], per_row(of[kept], len(sizes))

    def possible(self, rows: np.ndarray, words: np.ndarray, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which hits (row, item) are in rows that hold a rare word of the item."""
        if not len(row):
            return np.zeros(0, bool)
        pairs, each = np.unique(row * (len(self.bounds) - 1) + item, return_inverse=True)
        of_row, of_item = np.divmod(pairs, len(self.bounds) - 1)
        counts = self.rare_bounds[of_item + 1] - self.rare_bounds[of_item]
        starts = np.cumsum(counts) - counts
        at = np.repeat(self.rare_bounds[of_item] - starts, counts) + np.arange(counts.sum())
        with np.errstate(over="ignore"):
            there = np.unique(scramble(words ^ scramble(rows.astype(np.uint64))))
            asked = scramble(self.rare[at] ^ scramble(np.repeat(of_row, counts).astype(np.uint64)))
        seen = there[np.minimum(np.searchsorted(there, asked), len(there) - 1)] == asked
        return np.logical_or.reduceat(seen, starts)[each]


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score as a share of a verbatim copy's, first and last word in ``text``."""
    n = len(text)
    steps = np.arange(n + 1)
    above, origin = np.zeros(n + 1), steps.copy()
    best = (0.0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(text == word, MATCH, MISMATCH)
        score, source = np.zeros(n + 1), steps.copy()
        score[1:] = np.maximum(diagonal, 0)
        source[1:] = np.where(diagonal > 0, origin[:-1], steps[1:])
        down = above + GAP
        better = down > score
        score, source = np.where(better, down, score), np.where(better, origin, source)
        # Gaps in the item: the best score so far to the left, less the way from it.
        lifted = score - GAP * steps
        reach = np.maximum.accumulate(lifted)
        leader = np.maximum.accumulate(np.where(lifted == reach, steps, 0))
        along = reach + GAP * steps
        above, origin = np.maximum(along, 0), np.where(along > 0, source[leader], steps)
        top = int(above.argmax())
        if above[top] > best[0]:
            best = (float(above[top]), int(origin[top]), top - 1)
    return best[0] / (MATCH * max(len(item), 1)), best[1], best[2]


def _shared(item: np.ndarray, text: np.ndarray) -> int:
    """How many words of ``item`` are anywhere in ``text``: no alignment matches more."""
    if len(item) * len(text) > 1 << 16:
        return int(np.isin(item, text).sum())
    return int((item[:, None] == text).any(1).sum())


def _hits(rows: np.ndarray, words: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Row, word, item and place in the item of every seed found."""
    at, seeds = runs(rows, words)
    if not len(items.seeds) or not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    low = np.searchsorted(items.seeds, seeds)
    found = items.seeds[np.minimum(low, len(items.seeds) - 1)] == seeds
    at, low, high = at[found], low[found], np.searchsorted(items.seeds, seeds[found], "right")
    counts = high - low
    each = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(at, counts)
    return rows[at], at, items.item[each], items.place[each]


def _found(rows: np.ndarray, words: np.ndarray, count: int, items: Items, least: float) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(count)]
    row, at, item, place = _hits(rows, words, items)
    kept = items.possible(rows, words, row, item)
    row, at, item, place = (x[kept] for x in (row, at, item, place))
    bounds = per_row(rows, count)
    order = np.lexsort((at, item, row))
    row, at, item, place = (x[order] for x in (row, at, item, place))
    size = items.bounds[item + 1] - items.bounds[item]
    slack = size // 4 + 2
    begin = np.maximum(at - place - slack, bounds[row])
    end = np.minimum(at - place + size + slack, bounds[row + 1])
    k = 0
    while k < len(row):
        low, high, r, i = begin[k], end[k], row[k], item[k]
        k += 1
        while k < len(row) and row[k] == r and item[k] == i and begin[k] <= high:
            low, high = min(low, begin[k]), max(high, end[k])
            k += 1
        mine = items.words[items.bounds[i] : items.bounds[i + 1]]
        if _shared(mine, words[low:high]) < least * len(mine) - 1e-9:
            continue
        share, first, last = align(mine, words[low:high])
        if share >= least:
            base = int(low - bounds[r])
            hit = {"item": int(i), "score": share, "first_word": base + first, "last_word": base + last}
            if out[r] and out[r][-1]["item"] == hit["item"]:  # the best place of each item
                if out[r][-1]["score"] < share:
                    out[r][-1] = hit
            else:
                out[r].append(hit)
    return out


def _word_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    offsets, data = columns(batch, "text")
    for first, last in row_blocks(offsets, _TEXT_BYTES):
        rows, starts, ends, rolling = words_of(offsets[first : last + 1], data)
        yield last - first, rows, rolling.of(starts, ends)


def _held(texts: DataFrame, shared) -> dict[int, int]:
    """How often each word of a block of items stands in ``texts`` (column text), of those that do: no more than the block has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known = np.unique(shared.value[0].words)
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, words in _word_blocks(batch):
                if len(known) and len(words):
                    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    counts += np.bincount(at[known[at] == words], minlength=len(known))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(counts[some])], names=["word", "n"])

    found = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True))


def _searcher(shared, least: float):
    @F.pandas_udf("array<struct<item_id: string, score: double, first_word: long, last_word: long>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        let_go()
        table, names = shared.value
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(batch.tolist(), pa.string())], names=["text"])
            made: list = []
            for count, of, words in _word_blocks(rows):
                for hits in _found(of, words, count, table, least):
                    made.append([{"item_id": names[h["item"]], "score": h["score"], "first_word": h["first_word"], "last_word": h["last_word"]} for h in hits])
            yield pd.Series(made, dtype=object)

    return search


def with_leaks(docs: DataFrame, items: DataFrame, to: str = "leaks", item_key: str = "item_id", item_text: str = "text",
               text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """``docs`` with the items each text holds: array of item_id (as text), score, first_word, last_word."""
    said = items.filter(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("string").alias("name"), F.col(item_text).alias("said"))
    size = said.agg(F.sum(F.octet_length("said"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    spark, out, parts = docs.sparkSession, docs, []
    for block in range(blocks):
        own = said.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).orderBy("name", "said").collect()  # about BLOCK_BYTES
        table = Items([r["said"] for r in own])
        names = [r["name"] for r in own]
        every = spark.sparkContext.broadcast((table, names))
        table.keep_rarest(_held(docs.select(F.col(text).cast("string").alias("text")), every), least)
        every.unpersist()
        shared = spark.sparkContext.broadcast((table, names))
        parts.append(_searcher(shared, least)(F.col(text).cast("string")))
    return out.withColumn(to, F.concat(*parts))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row for each document and item it holds."""
    rows = with_leaks(docs.select(key, options.get("text", "text")), items, "_leaks", **options)
    return rows.select(F.col(key).alias("doc_id"), F.inline("_leaks"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a test item."""
    return with_leaks(docs, items, "_leaks", **options).filter(F.size("_leaks") == 0).drop("_leaks")
