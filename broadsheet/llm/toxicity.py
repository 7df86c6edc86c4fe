"""Toxicity of texts read through a noisy channel.

Disguised words (digits and signs for letters, letters spaced out or repeated,
masked letters) become small character lattices. The best path under a
character trigram model, whose counts are gathered from every whole text,
replaces the disguise, and the restored text is scored: words and word beginnings
with learned log-odds give evidence, and a logistic regression turns what a
text holds of it into a probability.

The trigram table has ``CLASSES`` ** 3 cells whatever the corpus holds. Labels are learned
from at most ``SAMPLE`` rows of each class, those whose hashed ids are smallest;
everything else covers all rows.

Defined cases: null and empty texts get the score of a text without evidence;
repeated rows are scored each on its own; labels that are null or without a
document teach nothing; without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.llm.arrow_text import Rolling, columns, held, per_row, row_blocks, words_of

SAMPLE = 8_000
THRESHOLD = 0.7
_ACCENTED = "ßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
CLASSES = 64
_OTHER = CLASSES - 1
_BEGINNINGS = (4, 5, 6)
_LEAST_SEEN = 5
_LEAST_ODDS = 2.0

# What a sign may stand for; costs are negative log-probabilities of the channel.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "*": "abcdefghijklmnopqrstuvwxyz",
}
_COST_SIGN, _COST_KEPT, _COST_DOUBLED, _COST_SINGLED = 1.0, 8.0, 1.5, 0.5

_LETTER = r"[^\W\d_]"
_SIGN = r"[0-9@$!|+€*]"
_ANY = rf"(?:{_LETTER}|{_SIGN})"
_DISGUISED = re.compile(
    # letters and signs spaced out by one sign each
    rf"(?<![\w@$!|+€]){_ANY}([ .\-_]){_ANY}(?:\1{_ANY})+(?![\w@$|+€])"
    # words that mix letters with signs
    rf"|(?<![\w@$!|+€])(?:{_SIGN}+{_LETTER}|{_LETTER}+(?:{_SIGN}+{_LETTER}|[0-9@$+]|\*\*)){_ANY}*"
    # a letter three times
    rf"|(?<!\w){_LETTER}*?({_LETTER})\2\2{_LETTER}*(?!\w)"
)
#: Signs behind a word that belong to the sentence.
_BEHIND = re.compile(r"(?:[!|€]|(?<!\*)\*(?!\*))+\Z")
_LONGEST = 60


def _classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _CLASS_OF[np.minimum(codes, len(_CLASS_OF) - 1)]


def _class_table() -> np.ndarray:
    table = np.zeros(0x3000, np.int64)
    letters = np.array([chr(c).isalpha() for c in range(0x3000)])
    table[letters] = _OTHER
    table[-1] = 0
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz" + _ACCENTED, 1):
        table[ord(c)] = k
        if len(c.upper()) == 1:
            table[ord(c.upper())] = k
    return table


_CLASS_OF = _class_table()


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each three classes of characters follow each other in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for value in batch.column("text"):
                said = value.as_py()
                if said:
                    c = np.concatenate([[0, 0], _classes_of(said), [0]])
                    code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
                    np.add.at(total, code, 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "cell long, n long")
    table = np.zeros(CLASSES**3, np.int64)
    for row in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most CLASSES ** 3 rows
        table[row["cell"]] = row["n"]
    return table.reshape(CLASSES, CLASSES, CLASSES)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of the third class after the first two, smoothed by shorter contexts."""
    single = counts.sum((0, 1)) + 0.5
    single = single / single.sum()
    pairs = counts.sum(0) + 20 * single
    pairs = pairs / pairs.sum(1, keepdims=True)
    triples = counts + 10 * pairs
    return np.log(triples / triples.sum(2, keepdims=True)).astype(np.float32)


_class_of: dict[str, int] = {}


def _class(c: str) -> int:
    known = _class_of.get(c)
    if known is None:
        known = int(_CLASS_OF[min(ord(c), len(_CLASS_OF) - 1)])
        if len(_class_of) < 10_000:
            _class_of[c] = known
    return known


def restore(word: str, model: np.ndarray, flat: list[float] | None = None) -> str:
    """The likeliest letters behind a disguised word: Viterbi over its lattice. ``flat``: the model's cells as a list."""
    if flat is None:
        flat = model.ravel().tolist()
    letters = re.sub(r"[ .\-_]", "", word.lower())
    # A masked letter is one each; all else may be repeated.
    runs = [(m.group(0)[0], len(m.group(0))) for m in re.finditer(r"(.)\1*", letters, re.S)]
    paths: dict = {(0, 0): (0.0, None)}  # score, and the pieces chosen as a linked list
    for at, (sign, length) in enumerate(runs):
        if sign == "*":
            masked = _Masked(paths, model, length)
            if at == len(runs) - 1:
                return masked.best(model)
            paths = masked.paths()
            continue
        options: list[tuple[str, float]] = []
        if sign.isalpha():
            options = [(sign, _COST_SINGLED * (length > 1)), (sign * 2, _COST_DOUBLED)] if length > 1 else [(sign, 0.0)]
        else:
            for letter in STANDS_FOR.get(sign, ""):
                options.append((letter, _COST_SIGN))
                if length > 1:
                    options.append((letter * 2, _COST_SIGN + _COST_DOUBLED))
            if sign != "*":
                options.append(("", _COST_KEPT * length))
        best: dict = {}
        coded = [(piece, cost, [_class(c) for c in piece]) for piece, cost in options]
        for (p, q), (score, said) in paths.items():
            for piece, cost, classes in coded:
                a, b, total = p, q, score - cost
                for k in classes:
                    total += flat[(a * CLASSES + b) * CLASSES + k]
                    a, b = b, k
                held = best.get((a, b))
                if held is None or total > held[0]:
                    best[a, b] = (total, (said, piece))
        paths = best or paths
    ends = [(score + flat[(a * CLASSES + b) * CLASSES], said) for (a, b), (score, said) in paths.items()]
    top = max(score for score, _ in ends)
    return max(_joined(said) for score, said in ends if score == top)


class _Masked:
    """The best paths through a run of masked letters, as tables over the last two classes."""

    def __init__(self, paths: dict, model: np.ndarray, count: int):
        self._letters = STANDS_FOR["*"]
        known = np.arange(1, len(self._letters) + 1)
        places: dict[int, list] = {}
        for (a, b), (score, said) in paths.items():
            places.setdefault(b, []).append((a, score, said))
        self.firsts = np.array(sorted(places))
        # One row for each path, those to one class side by side, of equals the smallest first class first.
        some = [x for b in self.firsts.tolist() for x in sorted(places[b], key=lambda x: x[0])]
        self._said = [said for _, _, said in some]
        sizes = [len(places[b]) for b in self.firsts.tolist()]
        total = model[[a for a, _, _ in some], np.repeat(self.firsts, sizes)][:, known] + np.array([score for _, score, _ in some])[:, None]
        starts = np.cumsum([0, *sizes[:-1]])
        top = np.maximum.reduceat(total, starts, 0)
        rows = np.where(total == np.repeat(top, sizes, 0), np.arange(len(some))[:, None], len(some))
        self._before = [np.minimum.reduceat(rows, starts, 0)]
        self.scores = top - _COST_SIGN
        for _ in range(count - 1):
            total = self.scores[:, :, None] + model[np.ix_(self.firsts, known, known)]
            self._before.append(total.argmax(0))
            self.scores = total.max(0) - _COST_SIGN
            self.firsts = known

    def said(self, j: int, k: int) -> tuple:
        """The pieces of the best path to a cell."""
        piece = ""
        for before in self._before[:0:-1]:
            piece = self._letters[k] + piece
            j, k = int(before[j, k]), j
        return self._said[self._before[0][j, k]], self._letters[k] + piece

    def paths(self) -> dict:
        firsts = self.firsts.tolist()
        return {(b, k + 1): (score, self.said(j, k)) for j, (b, row) in enumerate(zip(firsts, self.scores.tolist(), strict=True)) for k, score in enumerate(row)}

    def best(self, model: np.ndarray) -> str:
        """The best path that ends here."""
        total = self.scores + model[self.firsts, 1 : len(self._letters) + 1, 0]
        return max(_joined(self.said(int(j), int(k))) for j, k in np.argwhere(total == total.max()))


def _joined(said: tuple | None) -> str:
    pieces = []
    while said is not None:
        said, piece = said
        pieces.append(piece)
    return "".join(reversed(pieces))


def _mask(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


_IS_LETTER = _mask("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_IS_LETTER[0x80:] = True
_IS_SIGN, _IS_TAIL, _IS_GAP, _IS_BLANK = _mask("0123456789@$!|+*"), _mask("0123456789$@+"), _mask(" .-_"), _mask(" \t\n\r\f\v")
_AHEAD = 8


def suspects(data: np.ndarray) -> np.ndarray:
    """Positions at or next to which a disguise may stand: a cheap test that misses none
    of what ``_DISGUISED`` finds among ASCII signs and letters of one or two bytes."""
    n = len(data)
    d = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(_AHEAD, np.uint8)])
    letter, sign = _IS_LETTER[d], _IS_SIGN[d]
    low = np.where(_IS_LETTER[d] & (d < 0x60), d | 32, d)

    def at(a: np.ndarray, k: int) -> np.ndarray:
        return a[3 + k : 3 + k + n]

    found = at(sign, 0) & at(letter, 1)
    found |= at(letter, -1) & (at(_IS_TAIL[d], 0) | ((at(d, 0) == ord("*")) & (at(d, 1) == ord("*"))))
    found |= (at(d, 0) == 0xE2) & (at(d, 1) == 0x82) & (at(d, 2) == 0xAC)  # the euro sign
    found |= at(letter, 0) & (at(low, 0) == at(low, 1)) & (at(low, 1) == at(low, 2))
    found |= (at(d, 0) >= 0xC3) & (at(d, 0) == at(d, 2)) & (at(d, 2) == at(d, 4)) & (at(d, 1) == at(d, 3)) & (at(d, 3) == at(d, 5))
    either = letter | sign
    gap = at(_IS_GAP[d], 1) & at(either, 0) & at(either, 2)
    found |= gap & (at(d, 1) == at(d, 3)) & at(either, 4)
    found |= gap & (at(d, 1) == at(d, 4)) & (at(d, 2) >= 0xC3)  # a letter of two bytes
    return np.flatnonzero(found)


class Restorer:
    """Texts with their disguised words restored; answers are kept for words met again."""

    def __init__(self, model: np.ndarray):
        self._model, self._known, self._flat = model, {}, model.ravel().tolist()

    def _one(self, match: re.Match) -> str:
        word = match.group(0)
        behind = _BEHIND.search(word)
        if behind:
            return self._undone(word[: behind.start()]) + behind.group(0)
        return self._undone(word)

    def _undone(self, word: str) -> str:
        if not any(c.isalpha() for c in word):
            return word
        if len(word) > 2 * _LONGEST:  # not kept
            return restore(word, self._model, self._flat)
        said = self._known.get(word)
        if said is None:
            if len(self._known) > 100_000:
                self._known.clear()
            said = self._known[word] = restore(word, self._model, self._flat)
        return said

    def __call__(self, text: str) -> str:
        return self.rows(np.array([0, len(text.encode())]), np.frombuffer(text.encode(), np.uint8))[0].decode()

    def rows(self, offsets: np.ndarray, data: np.ndarray) -> list[bytes]:
        """The rows of a block, restored. Only what stands around a suspect is read closely."""
        base, stop = int(offsets[0]), int(offsets[-1])
        part = data[base:stop]
        said, cuts = part.tobytes(), offsets - base
        places = suspects(part)
        blanks = np.flatnonzero(_IS_BLANK[part])
        rows = np.searchsorted(cuts, places, "right") - 1
        begins = np.concatenate([[0], blanks + 1])[np.searchsorted(blanks, places)]
        ahead = np.minimum(places + 2 * _LONGEST, len(part))
        spaced = _IS_BLANK[part[np.minimum(places + 1, max(len(part) - 1, 0))]] if len(part) else np.zeros(0, bool)
        ends = np.concatenate([blanks, [len(part)]])[np.searchsorted(blanks, np.where(spaced, ahead, places))]
        out, k = [], 0
        for row in range(len(cuts) - 1):
            first, last = int(cuts[row]), int(cuts[row + 1])
            if k >= len(places) or rows[k] != row:
                out.append(said[first:last])
                continue
            pieces, done = [], first
            while k < len(places) and rows[k] == row:
                begin, end = max(int(begins[k]), done), min(int(ends[k]), last)
                while k + 1 < len(places) and rows[k + 1] == row and begins[k + 1] <= end:
                    k += 1
                    end = max(end, min(int(ends[k]), last))
                k += 1
                if end > begin:
                    near = said[begin:end].decode("utf-8", "replace")
                    pieces += [said[done:begin], _DISGUISED.sub(self._one, near).encode()]
                    done = end
            out.append(b"".join([*pieces, said[done:last]]))
        return out


def _restorer(model: np.ndarray) -> Restorer:
    """The restorer of this Python worker, so that later tasks know the words of earlier ones."""
    key = sha256(model.tobytes()).hexdigest()
    return held("toxicity", key, lambda: Restorer(model))


def _features(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of restored texts: row, hashes of the word and its beginnings, number of words by row."""
    offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
    rows, starts, ends, rolling = words_of(offsets, np.frombuffer(b"".join(encoded), np.uint8))
    whole = rolling.of(starts, ends)
    found = [whole]
    for size in _BEGINNINGS:
        cut = np.minimum(starts + size, ends)
        found.append(np.where(ends - starts > size, rolling.of(starts, cut) ^ np.uint64(size), whole))
    return rows, np.stack(found, 1), np.diff(per_row(rows, len(encoded)))


def _restored_blocks(batch: pa.RecordBatch, restorer: Restorer) -> Iterator[tuple[int, int, list[bytes]]]:
    offsets, data = columns(batch, "text")
    for first, last in row_blocks(offsets):
        yield first, last, restorer.rows(offsets[first : last + 1], data)


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """At most ``sample`` documents of each class, those with the smallest hashed ids."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("label"))
    known = known.groupBy(key).agg(F.max("label").alias("label"))
    order = (F.xxhash64(key), F.col(key))
    few = known.filter("label = 1").orderBy(*order).limit(sample).unionByName(known.filter("label = 0").orderBy(*order).limit(sample))
    # At most two times ``sample`` rows of two numbers.
    return docs.join(F.broadcast(few.withColumnRenamed(key, "_labelled")), F.col(key) == F.col("_labelled")).drop("_labelled")


class Scorer:
    """Hashes with their weights, sorted, and the coefficients of the regression."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, coefficients: np.ndarray):
        self.hashes, self.weights, self.coefficients = hashes, weights, coefficients

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Per text: largest weight, sum over different hits, number of hits, hits per 100 words (logs)."""
        out = np.zeros((len(texts), 4))
        if not len(self.hashes):
            return out
        rows, hashes, words = _features(texts)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        weights = np.where(self.hashes[at] == hashes, self.weights[at], 0.0).max(1) if len(hashes) else np.zeros(0)
        hit = weights > 0
        rows, weights, whole = rows[hit], weights[hit], hashes[hit][:, 0] if len(hashes) else np.zeros(0)
        np.maximum.at(out[:, 0], rows, weights)
        once = np.unique(np.stack([rows.astype(np.uint64), whole.astype(np.uint64)], 1), axis=0, return_index=True)[1] if len(rows) else []
        np.add.at(out[:, 1], rows[once], weights[once]) if len(rows) else None
        counts = np.bincount(rows, minlength=len(texts))
        out[:, 1] = np.log1p(out[:, 1])
        out[:, 2] = np.log1p(counts)
        out[:, 3] = np.log1p(100 * counts / np.maximum(words, 1))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.coefficients):
            return np.zeros(len(texts))
        z = self.evidence(texts) @ self.coefficients[1:] + self.coefficients[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Coefficients, constant first, by Newton's method; both classes weigh as they occur."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, label: str = "toxic", sample: int = SAMPLE,
        key: str = "doc_id", text: str = "text") -> Scorer:
    """Learns weights and coefficients from the labelled rows handed over."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    known = labelled(docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text")), labels, label, sample, key)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(shared.value)
        for batch in batches:
            marks = np.asarray(batch.column("label").to_pylist(), np.int64)
            for first, last, texts in _restored_blocks(batch, restorer):
                rows, hashes, _ = _features(texts)
                if not len(rows):
                    continue
                flat = np.stack([np.repeat(rows.astype(np.uint64), hashes.shape[1]), hashes.ravel()], 1)
                flat = flat[np.lexsort((flat[:, 1], flat[:, 0]))]
                flat = flat[np.concatenate([[True], (flat[1:] != flat[:-1]).any(1)])]  # once a text
                toxic = marks[first:last][flat[:, 0].astype(np.int64)]
                found, at = np.unique(flat[:, 1], return_inverse=True)
                ones = np.bincount(at, toxic, len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(ones), pa.array(np.bincount(at, minlength=len(found)) - ones)], names=["hash", "ones", "zeros"]
                )

    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n_ones, n_zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not n_ones or not n_zeros:
        return Scorer(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    odds = F.log((F.col("ones") + 0.5) / (n_ones + 1)) - F.log((F.col("zeros") + 0.5) / (n_zeros + 1))
    # No more rows than the bounded sample has words.
    kept = (
        known.select("text", "label").mapInArrow(counted, "hash long, ones long, zeros long").groupBy("hash").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        .filter(F.col("ones") >= min(_LEAST_SEEN, 1 + n_ones // 10)).withColumn("weight", odds).filter(F.col("weight") >= _LEAST_ODDS).toPandas()
    )
    hashes = kept["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    scorer = Scorer(hashes[order], kept["weight"].to_numpy(float)[order], np.zeros(0))
    handed = spark.sparkContext.broadcast(scorer)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(shared.value)
        for batch in batches:
            marks = batch.column("label").to_pylist()
            for first, last, texts in _restored_blocks(batch, restorer):
                x = handed.value.evidence(texts)
                yield pa.RecordBatch.from_arrays([pa.array(marks[first:last], pa.int32()), *[pa.array(x[:, k]) for k in range(4)]], names=["label", "a", "b", "c", "d"])

    shown = known.select("text", "label").mapInArrow(seen, "label int, a double, b double, c double, d double").toPandas()
    scorer.coefficients = logistic(shown[["a", "b", "c", "d"]].to_numpy(float), shown["label"].to_numpy(float))
    return scorer


def score(docs: DataFrame, model: np.ndarray, scorer: Scorer, to: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of being toxic in the column ``to``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, scorer))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, trained = shared.value
        restorer = _restorer(table)
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(batch.tolist(), pa.string())], names=["text"])
            out = [trained.score(texts) for _, _, texts in _restored_blocks(rows, restorer)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(to, F.pandas_udf(run, "double")(F.col(text).cast("string")))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn_from=None, to: str = "score") -> DataFrame:
    """Gathers the character model from all of ``docs``, learns from ``labels`` (those
    ``learn_from`` allows) and scores every row."""
    model = log_model(trigram_counts(docs))
    allowed = labels if learn_from is None else labels.filter(learn_from)
    return score(docs, model, fit(docs, allowed, model), to)
