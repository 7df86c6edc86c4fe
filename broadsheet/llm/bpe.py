"""Byte-pair encoding and decoding by a depth-first walk over the trie of distinct words.

The encoding of a prefix is known from its last token alone: that token ends the
prefix, and the rest is the encoding of a shorter prefix, which the walk has
already passed. A token may follow another if merging the two texts together
would not merge across the seam, and exactly one token that ends a prefix fits
the prefix before it. Words in sorted order visit the trie depth first, so the
states of a shared prefix are computed once and live on a stack.

The vocabulary file is read on the driver and broadcast; its size (a few
megabytes) doesn't depend on the data. Tasks keep encodings of at most
``WORDS_KEPT`` words.

Defined cases: null text is the empty text and has no tokens; repeated rows are
encoded each on its own; extra columns pass through ``encode`` untouched.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from broadsheet.llm.arrow_text import held

WORDS_KEPT = 100_000
_SEAMS_KEPT = 250_000
_ROWS = 128  # texts looked at together
_NEVER = 1 << 30
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Fixed value: how the vocabulary's tokenizer splits lower-case text.
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
# The same with the classes written out for texts of the first 256 code points, which is faster.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SHORT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Vocabulary:
    """What a tokenizer file of kind BPE with word ends says, as plain tables."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        self.digest = sha256(raw).hexdigest()
        said = json.loads(raw)
        model = said["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in said["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): k for k, (a, b) in enumerate(pairs)}
        self.merged = {pair: self.ids[a + b] for pair, (a, b) in zip(self.ranks, pairs, strict=True)}


class TrieEncoder:
    """Encodings of words, computed for many words at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self._v = vocabulary
        self._text = {i: t for t, i in vocabulary.ids.items()} | {i: t for t, i in vocabulary.specials.items()}
        self._letters = {b: c for b, c in byte_letters().items()}
        self._halves: dict[int, tuple[int, int, int]] = {}
        self._whole: set[int] = set()
        end = vocabulary.end
        self._inner: dict[str, int] = {}
        self._final: dict[str, int] = {}
        for text, token in vocabulary.ids.items():
            stem, last = (text[: -len(end)], True) if end and text.endswith(end) and text != end else (text, False)
            if self._reaches(stem, last, token):
                (self._final if last else self._inner)[stem] = token
        if not end:
            self._final = self._inner
        self._starts = {stem[:k] for table in (self._inner, self._final) for stem in table for k in range(1, len(stem) + 1)}
        self._edges: tuple[dict, dict] = ({}, {})
        self._seams: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[str, str]] = {}

    def _reaches(self, stem: str, last: bool, token: int) -> bool:
        """Whether merging this token's own text gives the token; keeps its last merge."""
        v = self._v
        parts = [v.ids.get(c + (v.end if last and k == len(stem) - 1 else ""), -1) for k, c in enumerate(stem)]
        while len(parts) > 1:
            rank, at = min((v.ranks.get(pair, _NEVER), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _NEVER:
                return False
            pair = (parts[at], parts[at + 1])
            parts[at : at + 2] = [made := v.merged[pair]]
            self._halves.setdefault(made, (*pair, rank))
        return parts == [token]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces on the left (0) or right (1) edge of a token, the smallest
        first, each with the rank of the merge that takes it in."""
        known = self._edges[side].get(token)
        if known is None:
            known, piece, taken = [], token, _NEVER
            while True:
                known.append((piece, taken))
                if piece not in self._halves:
                    break
                taken = self._halves[piece][2]
                piece = self._halves[piece][side]
            known.reverse()
            self._edges[side][token] = known
        return known

    def _may_follow(self, before: int, after: int) -> bool:
        """Whether merging keeps the seam between two tokens open until both are whole."""
        known = self._seams.get((before, after))
        if known is not None:
            return known
        left, right, ranks = self._edge(before, 1), self._edge(after, 0), self._v.ranks
        i = j = 0
        while True:
            (a, a_taken), (b, b_taken) = left[i], right[j]
            rank = ranks.get((a, b), _NEVER)
            # Equal ranks: the leftmost pair is merged first.
            if rank < a_taken and rank <= b_taken and rank != _NEVER:
                fits = False
                break
            if a_taken == b_taken == _NEVER:
                fits = True
                break
            i, j = i + (a_taken <= b_taken), j + (b_taken <= a_taken)
        if len(self._seams) >= _SEAMS_KEPT:
            self._seams.clear()
        self._seams[before, after] = fits
        return fits

    def learn(self, words: Iterable[str]) -> None:
        """Adds the encodings of ``words`` to ``known``."""
        letters, text = self._letters, self._text
        spelled = sorted(("".join([letters[b] for b in w.encode("utf-8", "replace")]) if not w.isascii() or not w.isprintable() else w, w) for w in words)
        inner, final, follows = self._inner, self._final, self._may_follow
        starts = self._starts
        # Of each prefix of the word before: its last token, and where the longest token begins that may still grow.
        last, grows = [0], [0]
        before = ""
        for word, said in spelled:
            n = len(word)
            shared, most = 0, min(len(before), n - 1, len(last) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], grows[shared + 1 :]
            low = grows[shared]
            for depth in range(shared + 1, n):
                while word[low:depth] not in starts:
                    low += 1
                for start in range(low, depth):
                    token = inner.get(word[start:depth])
                    if token is not None and (start == 0 or follows(last[start], token)):
                        break
                last.append(token)
                grows.append(low)
            for start in range(low, n):
                token = final.get(word[start:])
                if token is not None and (start == 0 or follows(last[start], token)):
                    break
            last.append(token)
            tokens, depth = [], n
            ending = True
            while depth:
                token = last[depth]
                tokens.append(token)
                size = len(text[token]) - (len(self._v.end) if ending else 0)
                depth, ending = depth - size, False
            last.pop()  # the state of a whole word holds its word end: longer words start one letter before
            tokens.reverse()
            self.known[said] = (" ".join(map(str, tokens)), " ".join([text[t] for t in tokens]))
            before = word

    def split(self, text: str) -> list[str]:
        """Special tokens and lower-case words of a text, in order."""
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # lower case letter by letter, whatever stands around it
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _PIECES.findall(text)
        return _SHORT.findall(text)

    def pieces(self, texts: Iterable[str]) -> list[list[str]]:
        specials = self._v.specials
        mark = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        out = []
        for text in texts:
            if mark and any(s in text for s in specials):
                parts = []
                for k, part in enumerate(mark.split(text)):
                    parts.extend([f"\0{part}"] if k % 2 else self.split(part))
                out.append(parts)
            else:
                out.append(self.split(text))
        fresh = set().union(*out) - self.known.keys() if out else set()
        if len(self.known) + len(fresh) > WORDS_KEPT:
            self.known.clear()
            fresh = set().union(*out)
        for name, token in specials.items():
            self.known["\0" + name] = (str(token), name)
        self.learn(fresh - self.known.keys())
        return out


def _encoder(shared) -> TrieEncoder:
    """The encoder of this Python worker; its tables are built once."""
    vocabulary = shared.value
    return held("bpe", vocabulary.digest, lambda: TrieEncoder(vocabulary))


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each whole text in the array column ``to``."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                said = [" ".join([encoder.known[w][0] for w in words]) for words in encoder.pieces([t or "" for t in part.column(names.index(text)).to_pylist()])]
                counts = [ids.count(" ") + 1 if ids else 0 for ids in said]
                flat = np.array(" ".join([x for x in said if x]).split(), dtype=np.int32)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*names, to])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text of an id column: the tokens' texts, joined by one space."""
    vocabulary = Vocabulary(path)
    texts = {i: t for t, i in vocabulary.ids.items()} | {i: t for t, i in vocabulary.specials.items()}
    shared = rows.sparkSession.sparkContext.broadcast(texts)

    @F.pandas_udf(T.StringType())
    def decoded(series: pd.Series) -> pd.Series:
        return series.map(lambda row: " ".join([shared.value[i] for i in row]) if row is not None else "")

    return rows.withColumn(to, decoded(F.col(ids)))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of tokens and digests of its ids and of the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            counts, of_ids, of_texts = [], [], []
            for first in range(0, batch.num_rows, _ROWS):
                for words in encoder.pieces([t or "" for t in batch.column("text").slice(first, _ROWS).to_pylist()]):
                    entries = [encoder.known[w] for w in words]
                    ids = " ".join([e[0] for e in entries])
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    of_ids.append(sha256(ids.encode()).hexdigest())
                    of_texts.append(sha256(" ".join([e[1] for e in entries]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
