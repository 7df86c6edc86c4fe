"""Quality by regularised quadratic discriminant analysis.

Statistics of the whole text (shares of kinds of characters, word and line lengths, how
much repeats), made roughly normal by logarithms and arcsines, are modelled for each class
as one normal distribution. Class covariances are shrunk towards the pooled one and that towards
its diagonal, and their Cholesky factors are computed once and sent to the tasks; the score is the
logistic function of the difference of the log-densities (half Mahalanobis distance and determinant) plus the prior's.

Means and covariances come from sums over all labelled rows, added up in the tasks: what
reaches the driver is one number for each cell of a matrix of ``len(STATISTICS)`` squared.

Defined cases: null text is the empty text, which has statistics and a score; repeated rows are
scored each on its own; without labels of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.arrow_text import Rolling, columns, per_row, row_blocks, words_of
from broadsheet.session import cut_lineage

THRESHOLD = 0.3
TOWARDS_POOLED, TOWARDS_DIAGONAL = 0.1, 0.1
STATISTICS = (
    "words", "word_size", "word_spread", "upper", "digits", "signs", "stops", "bangs", "bars", "blanks",
    "different_words", "same_as_before", "different_lines", "line_size", "entropy", "wide",
)


def _share(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


_KINDS = {
    "upper": (lambda b: (b >= 0x41) & (b <= 0x5A)), "digits": (lambda b: (b >= 0x30) & (b <= 0x39)),
    "signs": (lambda b: np.isin(b, np.frombuffer(b"#*$%&<>@~^_=+\\/{}[]", np.uint8))),
    "stops": (lambda b: np.isin(b, np.frombuffer(b".,;:?", np.uint8))), "bangs": (lambda b: b == 0x21), "bars": (lambda b: b == 0x7C),
    "blanks": (lambda b: np.isin(b, np.frombuffer(b" \t\n\r", np.uint8))), "wide": (lambda b: b >= 0x80),
}


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One line of ``STATISTICS`` for each row of a block."""
    base, n = int(offsets[0]), len(offsets) - 1
    part, cuts = data[base : int(offsets[-1])], offsets - base
    size = np.maximum(np.diff(cuts), 1)
    out = dict.fromkeys(STATISTICS)
    for name, kind in _KINDS.items():
        sums = _share(kind(part))
        out[name] = np.arcsin(np.sqrt(np.clip((sums[cuts[1:]] - sums[cuts[:-1]]) / size, 0, 1)))
    rows, starts, ends, rolling = words_of(offsets, data)
    hashes, bounds = rolling.of(starts, ends), per_row(rows, n)
    words = np.diff(bounds)
    some = np.maximum(words, 1)
    long = (ends - starts).astype(float)
    mean = np.bincount(rows, long, n) / some
    out["words"], out["word_size"] = np.log1p(words), np.log1p(mean)
    out["word_spread"] = np.log1p(np.sqrt(np.maximum(np.bincount(rows, long**2, n) / some - mean**2, 0)))
    order = np.lexsort((hashes, rows))
    new = np.concatenate([[True], (rows[order][1:] != rows[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])])[: len(rows)]
    kinds = np.bincount(rows[order], new, n)
    out["different_words"] = np.log1p(kinds) - np.log1p(words)
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])])[: len(rows)]
    out["same_as_before"] = np.arcsin(np.sqrt(np.bincount(rows, same, n) / some))
    # Lines: between line feeds and ends of rows.
    feeds = np.flatnonzero(part == 0x0A)
    edges = np.unique(np.concatenate([cuts[:-1], feeds + 1]))
    edges = edges[edges < len(part)]
    stops = np.minimum(np.concatenate([edges[1:], [len(part)]]), cuts[np.searchsorted(cuts, edges, "right")] if len(edges) else edges)[: len(edges)]
    line_rows = np.searchsorted(cuts, edges, "right") - 1
    stops = stops - ((part[stops - 1] == 0x0A) if len(edges) else 0)
    full = stops > edges
    edges, stops, line_rows = edges[full], stops[full], line_rows[full]
    lines = np.bincount(line_rows, minlength=n)
    said = Rolling(part).of(edges, stops)
    pairs = np.unique(np.stack([line_rows.astype(np.uint64), said], 1), axis=0)[:, 0].astype(np.int64) if len(said) else np.zeros(0, np.int64)
    out["different_lines"] = np.log1p(np.bincount(pairs, minlength=n)) - np.log1p(lines)
    out["line_size"] = np.log1p(size / np.maximum(lines, 1))
    owner = np.repeat(np.arange(n), np.diff(cuts))
    table = np.bincount(owner * 64 + (part & 63), minlength=n * 64).reshape(n, 64) / size[:, None]
    out["entropy"] = -(table * np.log(np.maximum(table, 1e-12))).sum(1)
    return np.stack([out[name] for name in STATISTICS], 1)


def described(docs: DataFrame, text: str = "text", to: str = "stats") -> DataFrame:
    """The columns of ``docs`` but the text, and its statistics."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = columns(batch, "_text")
            made = [statistics(offsets[a : b + 1], data) for a, b in row_blocks(offsets)]
            values = np.concatenate(made) if made else np.zeros((0, len(STATISTICS)))
            lists = pa.ListArray.from_arrays(np.arange(0, values.size + 1, len(STATISTICS), dtype=np.int32), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), lists], names=[*rest, to])

    chosen = docs.select(*rest, F.col(text).cast("string").alias("_text"))
    return chosen.mapInArrow(run, ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in rest) + f", `{to}` array<double>")


class Discriminant:
    """Two normal distributions with cached triangular factors."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        d = len(STATISTICS)
        self.ready = all(sums.get(c, (0,))[0] > 1 for c in (0, 1))
        if not self.ready:
            return
        total = sum(sums[c][0] for c in (0, 1))
        means = {c: sums[c][1] / sums[c][0] for c in (0, 1)}
        own = {c: sums[c][2] / sums[c][0] - np.outer(means[c], means[c]) for c in (0, 1)}
        pooled = sum(sums[c][0] * own[c] for c in (0, 1)) / total
        pooled = (1 - TOWARDS_DIAGONAL) * pooled + TOWARDS_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        self.parts = []
        for c in (0, 1):
            factor = np.linalg.cholesky((1 - TOWARDS_POOLED) * own[c] + TOWARDS_POOLED * pooled)
            constant = np.log(sums[c][0] / total) - np.log(np.diag(factor)).sum()
            self.parts.append((means[c], np.linalg.inv(factor), constant))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5)
        densities = [constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, constant in self.parts]
        return 1 / (1 + np.exp(np.clip(densities[0] - densities[1], -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id") -> Discriminant:
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    rows = stats.join(known, F.col(key) == F.col("_key")).select("label", "stats")
    d = len(STATISTICS)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), float).reshape(-1, d)
            marks = np.array(batch.column("label").to_pylist(), int)
            for c in (0, 1):
                own = x[marks == c]
                cells[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        label, cell = np.divmod(np.arange(cells.size), cells.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(cells.ravel())], names=["label", "cell", "value"])

    cells = np.zeros((2, 1 + d + d * d))
    for row in rows.mapInArrow(summed, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect():
        cells[row["label"], row["cell"]] = row["value"]
    return Discriminant({c: (cells[c, 0], cells[c, 1 : 1 + d], cells[c, 1 + d :].reshape(d, d)) for c in (0, 1)})


def scored(docs: DataFrame, labels: DataFrame, learn_from=None, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with ``score``: how likely label 1 is."""
    stats = cut_lineage(described(docs, text))
    model = fit(stats, labels if learn_from is None else labels.filter(learn_from))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in stats.columns if c != "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(shared.value.score(x))], names=[*rest, "score"])

    return stats.mapInArrow(run, ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in rest) + ", score double")
