"""Language identification with error-correcting output codes.

Every language has a codeword of bits; for each bit one binary classifier over hashed
byte trigrams (log-odds of the languages whose bit is 1 against the others) predicts the bit
from the whole text. Decoding compares the margins with every codeword: each bit that disagrees costs a
logistic loss, weighted by how far apart the classifier keeps its two sides, and the cheapest codeword
wins. A text whose two cheapest codewords are close is flagged as ambiguous.

The classifiers are computed from trigram counts over all rows with a language; the
driver sees at most ``BINS`` numbers for each language.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows without a language teach
nothing; without any language to learn every text is ``und``; repeated rows are predicted each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.arrow_text import columns, row_blocks

BINS = 1 << 16
AMBIGUOUS = 0.8
_SMOOTHING = 0.5
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 0x20
_PLAIN[0x41:0x5B] = _PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)


def codewords(count: int) -> np.ndarray:
    """A codeword of +1 and -1 for each language: every split into two sides up to five
    languages, beyond that the widest apart of a fixed sequence of random codes."""
    if count <= 1:
        return np.ones((count, 1))
    if count <= 5:
        splits = range(1, 1 << (count - 1))
        return np.array([[1.0 if language == 0 or not split >> (language - 1) & 1 else -1.0 for split in splits] for language in range(count)])
    draw, best, apart = np.random.default_rng(1), None, -1
    for _ in range(50):
        code = np.where(draw.random((count, 15 * int(np.ceil(np.log2(count))))) < 0.5, 1.0, -1.0)
        closest = min(int((code[i] != code[j]).sum()) for i in range(count) for j in range(i))
        if closest > apart and (np.abs(code.sum(0)) < count).all():
            best, apart = code, closest
    return best


def trigrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row boundaries and bins of the trigrams of a block; those without a letter are left out."""
    base = int(offsets[0])
    part = _PLAIN[data[base : int(offsets[-1])]].astype(np.uint32)
    if len(part) < 3:
        return np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    code = ((part[:-2] << 16) | (part[1:-1] << 8) | part[2:]) * np.uint32(2654435761) >> np.uint32(16)
    cuts = offsets - base
    good = part[1:-1] != 0x20
    for back in (2, 1):
        over = cuts[1:-1] - back
        good[over[(over >= 0) & (over < len(good))]] = False
    at = np.flatnonzero(good)
    return np.searchsorted(at, cuts), code[at].astype(np.int64)


def counts(docs: DataFrame, names: list[str], text: str = "text", language: str = "lang") -> np.ndarray:
    """Trigram counts of each language over all texts."""
    place = {name: k for k, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BINS), np.int64)
        for batch in batches:
            offsets, data = columns(batch, "text")
            own = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, b in row_blocks(offsets):
                bounds, bins = trigrams(offsets[a : b + 1], data)
                which = np.repeat(own[a:b], np.diff(bounds))
                total += np.bincount(which * BINS + bins, minlength=total.size).reshape(total.shape)
        found, bins = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(total[found, bins])], names=["lang", "bin", "n"])

    known = docs.filter(F.col(language).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(language).alias("lang"))
    table = np.zeros((len(names), BINS))
    for row in known.mapInArrow(run, "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        table[row["lang"], row["bin"]] = row["n"]
    return table


class Decoder:
    """Weights of the binary classifiers, codewords, and weights of the bits."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.code = names, codewords(len(names))
        shares = (table + _SMOOTHING / len(names)) / (table.sum(1, keepdims=True) + _SMOOTHING * BINS / len(names))
        ones = (self.code > 0).astype(float)
        sides = [(s.T @ shares) / np.maximum(s.sum(0), 1)[:, None] for s in (ones, 1 - ones)]
        floor = shares.min()
        self.weights = (np.log(np.maximum(sides[0], floor)) - np.log(np.maximum(sides[1], floor))).astype(np.float32)
        usual = shares @ self.weights.T  # margin of each bit in an average text of each language
        self.scale = np.maximum(np.abs(usual).mean(0), 1e-9)
        self.trust = np.maximum((usual * self.code).min(0) / self.scale, 0.05) if len(names) > 1 else np.ones(1)

    def decode(self, bounds: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each row."""
        n = np.diff(bounds)
        margins = np.zeros((len(n), len(self.weights)))
        for k, weight in enumerate(self.weights):
            sums = np.concatenate([[0.0], np.cumsum(weight[bins], dtype=float)])
            margins[:, k] = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1) / self.scale[k]
        # The longer the text, the surer a margin.
        margins *= np.minimum(np.sqrt(n / 10), 6)[:, None]
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        odds = np.exp(-(loss - loss.min(1, keepdims=True)))
        odds /= odds.sum(1, keepdims=True)
        best = odds.argmax(1)
        top = odds[np.arange(len(n)), best]
        return best, top, top < AMBIGUOUS


def predicted(docs: DataFrame, learn_from=None, text: str = "text", language: str = "lang") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous."""
    known = docs.filter(F.col(language).isNotNull() if learn_from is None else F.col(language).isNotNull() & learn_from)
    names = sorted(r[0] for r in known.select(language).distinct().collect())  # languages, not documents
    model = Decoder(names, counts(known, names, text, language)) if names else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = shared.value
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(batch.tolist(), pa.string())], names=["text"])
            offsets, data = columns(rows, "text")
            made = []
            for a, b in row_blocks(offsets) if decoder else ():
                best, score, close = decoder.decode(*trigrams(offsets[a : b + 1], data))
                made.append(pd.DataFrame({"lang_pred": [decoder.names[k] for k in best], "score": score, "ambiguous": close}))
            if not made:
                made = [pd.DataFrame({"lang_pred": [None] * len(batch), "score": [0.0] * len(batch), "ambiguous": [True] * len(batch)})]
            yield pd.concat(made, ignore_index=True)

    told = docs.withColumn("_told", run(F.col(text).cast("string"))).withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    sure = F.col("_letters") & F.col("_told.lang_pred").isNotNull()
    return told.withColumns({
        "lang_pred": F.when(sure, F.col("_told.lang_pred")).otherwise("und"), "score": F.when(sure, F.col("_told.score")).otherwise(0.0),
        "ambiguous": F.when(sure, F.col("_told.ambiguous")).otherwise(True),
    }).drop("_told", "_letters")
