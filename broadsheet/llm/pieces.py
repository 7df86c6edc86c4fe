"""SentencePiece encoding of merge type (BPE with byte fallback), exact, by backtracking; and decoding.

The reference order of merges need not be replayed over a text. A sequence of pieces is its encoding
exactly if each two neighbours are: merging their joint text again must give these two pieces. So:

1.  An Aho-Corasick automaton over the reversed pieces gives the longest piece that starts at each position.
2.  From the left, the longest piece that may follow the last one is taken, else the next shorter piece that is its prefix.
    Whether two pieces may follow each other is found by merging them again, and remembered.
3.  Where none fits, the last piece is taken back and a bitfield marks its end as a failed position, which is never
    entered again; so every position fails at most once and the work is linear in the text.

Characters outside the vocabulary become byte pieces. Texts are cut where no merge can reach across, because no piece
holds the two characters side by side: around byte pieces, and behind letters before signs and word marks (a vocabulary
with such pieces keeps texts whole). A worker remembers the encodings of short chunks, within ``CHARACTERS_KEPT``.

The model file is read on the driver and broadcast; its size doesn't depend on the data. Defined cases: null and empty
texts have no ids; texts of any length are encoded whole; repeated rows each for itself; extra columns pass through
``encode`` and ``decode`` untouched (a column of the name ``to`` is an error); an empty table gives an empty one.
Ids outside the vocabulary can't be decoded and raise an error; a null list decodes to the empty text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from broadsheet.llm.arrow_text import held

MARK = "▁"  # stands for a space
CHARACTERS_KEPT = 4_000_000
_PAIRS_KEPT = 400_000
_CHUNK_KEPT = 48  # longer chunks are encoded anew each time
# Kinds of pieces in a model file.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else number()
        yield tag >> 3, data[at : at + size]
        at += size


class Pieces:
    """What a model file says, as plain tables."""

    def __init__(self, raw: bytes):
        self.digest = sha256(raw).hexdigest()
        self.texts: list[str] = []
        self.kinds: list[int] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: dict[int, int] = {}
        trainer: dict = {}
        spec: dict = {}
        for field, value in _fields(raw):
            if field == 1:
                said = dict(_fields(value))
                self._add(said[1].decode(), struct.unpack("<f", said.get(2, b"\0\0\0\0"))[0], said.get(3, _NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                spec = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or len(self.bytes_of) != 256:
            raise ValueError("not a model of merge type with byte fallback")
        if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1) or trainer.get(24):
            raise ValueError("models that normalise texts are not supported")
        self.prefixed = bool(spec.get(3, 1))
        self.unknown = trainer.get(44, " ⁇ ".encode()).decode()
        alphabet = {c for t in self.ids for c in t}
        if not alphabet <= self.ids.keys():
            raise ValueError("each character of a piece must be a piece")
        self.chunks = re.compile(self._pattern(alphabet), re.DOTALL)

    def _pattern(self, alphabet: set[str]) -> str:
        """Chunks whose seams no merge can close, as no piece holds the two characters side by side."""

        def one_of(characters: set[str]) -> str:
            return "[" + "".join(map(re.escape, sorted(characters))) + "]"

        seams = {(a, b) for t in self.ids for a, b in zip(t, t[1:], strict=False)}
        alone = alphabet - {c for pair in seams for c in pair}
        letters = {c for c in alphabet - alone if c.isalpha()}
        while grown := {b for a, b in seams if a in letters} - letters:  # what stands behind letters counts as one
            letters |= grown
        signs = alphabet - alone - letters - {MARK}
        if MARK in letters or not (alone and letters and signs) or any(a in signs and b == MARK for a, b in seams):
            return f"{one_of(alphabet)}+|."
        return f"{one_of(alone)}|{MARK}*{one_of(signs)}*{one_of(letters)}+|{MARK}*{one_of(signs)}+|{MARK}+|."

    def _add(self, text: str, score: float, kind: int) -> None:
        if kind == _NORMAL:
            self.ids[text] = len(self.texts)
            self.scores[text] = score
        elif kind == _BYTE:
            self.bytes_of[len(self.texts)] = int(text[1:-1], 16)
        elif kind not in (_UNKNOWN, _CONTROL):
            raise ValueError("user-defined and unused pieces are not supported")
        self.texts.append(text)
        self.kinds.append(kind)


class Backtracker:
    """Encodes and decodes texts."""

    def __init__(self, pieces: Pieces):
        self._p = pieces
        self._longest = ahocorasick.Automaton()
        for text, piece in pieces.ids.items():
            self._longest.add_word(text[::-1], piece)
        self._longest.make_automaton()
        self._byte_ids = {b: i for i, b in pieces.bytes_of.items()}
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._kept: dict[str, list[int]] = {}
        self._room = CHARACTERS_KEPT
        self._out = [t.replace(MARK, " ").encode() if k == _NORMAL else b"" for t, k in zip(pieces.texts, pieces.kinds, strict=True)]
        for i, b in pieces.bytes_of.items():
            self._out[i] = bytes([b])
        for i, k in enumerate(pieces.kinds):
            if k == _UNKNOWN:
                self._out[i] = pieces.unknown.encode()
        self._controls = {i for i, k in enumerate(pieces.kinds) if k == _CONTROL}

    def merged(self, text: str) -> list[str]:
        """The plain definition: the best-scored pair first, the leftmost of equals, until none merges."""
        parts, scores = list(text), self._p.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, before: int, after: int) -> bool:
        """Whether merging the two pieces again gives the two; ``before`` -1: whether the piece gives itself."""
        known = self._fits.get((before, after))
        if known is None:
            texts = self._p.texts
            both = [texts[after]] if before < 0 else [texts[before], texts[after]]
            known = self.merged("".join(both)) == both
            if len(self._fits) >= _PAIRS_KEPT:
                self._fits.clear()
            self._fits[before, after] = known
        return known

    def _next(self, piece: int) -> int:
        """The longest piece that is a proper prefix of this one, or -1."""
        found = self._shorter.get(piece)
        if found is None:
            text, ids = self._p.texts[piece], self._p.ids
            found = self._shorter[piece] = next((ids[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in ids), -1)
        return found

    def _backtrack(self, chunk: str) -> list[int]:
        n, texts, fits = len(chunk), self._p.texts, self._may_follow
        longest = [-1] * n
        for end, piece in self._longest.iter(chunk[::-1]):
            if longest[n - 1 - end] < 0:  # of the pieces that start here the longest is reported first
                longest[n - 1 - end] = piece
        failed = bytearray(n // 8 + 1)
        taken: list[int] = []
        at, last, piece = 0, -1, longest[0]
        while True:
            while piece >= 0:
                end = at + len(texts[piece])
                if not failed[end >> 3] >> (end & 7) & 1 and fits(last, piece):
                    break
                piece = self._next(piece)
            if piece >= 0:
                taken.append(piece)
                if end == n:
                    return taken
                at, last, piece = end, piece, longest[end]
            else:
                if not taken:
                    raise ValueError("the model's pieces can't be put together")
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= len(texts[piece])
                last = taken[-1] if taken else -1

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        said = text.replace(" ", MARK)
        ids: list[int] = []
        kept = self._kept
        for chunk in self._p.chunks.findall(MARK + said if self._p.prefixed else said):
            found = kept.get(chunk)
            if found is None:
                if chunk[-1] in self._p.ids:
                    found = self._backtrack(chunk)
                else:
                    found = [self._byte_ids[b] for b in chunk.encode("utf-8", "replace")]
                if len(chunk) <= _CHUNK_KEPT:
                    self._room -= len(chunk) + 8
                    if self._room < 0:
                        kept.clear()
                        self._room = CHARACTERS_KEPT
                    kept[chunk] = found
            ids += found
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        p = self._p
        if len(ids) and (min(ids) < 0 or max(ids) >= len(p.texts)):
            raise ValueError("no such piece")
        if not self._controls.isdisjoint(ids):
            return self._mended(ids)
        out = b"".join([self._out[i] for i in ids])
        if p.prefixed and len(ids) and p.kinds[ids[0]] == _NORMAL and out.startswith(b" "):
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._mended(ids)

    def _mended(self, ids: Sequence[int]) -> str:
        """Piece by piece: bytes of a run that are no character become one replacement character each."""
        out: list[str] = []
        held = bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(held[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            held.clear()

        bare = self._p.prefixed
        for i in ids:
            kind = self._p.kinds[i]
            if kind == _BYTE:
                held.append(self._p.bytes_of[i])
                bare = False
                continue
            flush()
            said = self._out[i].decode()
            if bare and kind == _NORMAL and said.startswith(" "):
                said = said[1:]
            bare = bare and kind == _CONTROL
            out.append(said)
        flush()
        return "".join(out)


def _coder(shared) -> Backtracker:
    """The coder of this Python worker; its tables are built once."""
    pieces = shared.value
    return held("pieces", pieces.digest, lambda: Backtracker(pieces))


def _shared(rows: DataFrame, path: str):
    with open(path, "rb") as file:
        return rows.sparkSession.sparkContext.broadcast(Pieces(file.read()))


def _added(rows: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"there is a column {name!r} already")
    return T.StructType([*rows.schema.fields, T.StructField(name, kind)])


def _texts(column: pa.Array, first: int, last: int) -> Iterable[str]:
    return (t or "" for t in column.slice(first, last - first).to_pylist())


_ROWS = 256


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of each whole text in the array column ``to``."""
    shared, names, schema = _shared(docs, path), docs.columns, _added(docs, to, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                ids = [coder.encode(t) for t in _texts(part.column(names.index(text)), 0, part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*names, to])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text of an id column in ``to``."""
    shared, names, schema = _shared(rows, path), rows.columns, _added(rows, to, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                said = [coder.decode(x or []) for x in part.column(names.index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string())], names=[*names, to])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the text decoded from them."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            counts, of_ids, of_texts = [], [], []
            for first in range(0, batch.num_rows, _ROWS):
                for said in _texts(batch.column("text"), first, min(first + _ROWS, batch.num_rows)):
                    ids = coder.encode(said)
                    counts.append(len(ids))
                    of_ids.append(sha256(",".join(map(str, ids)).encode()).hexdigest())
                    of_texts.append(sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(counts, np.int64)), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
