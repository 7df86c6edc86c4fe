"""Fill-in-the-middle transformation with piece tables.

A document is a list of descriptors (buffer, start, end) over two immutable buffers: its own
bytes and those of the sentinels. Cutting splits a descriptor, an arrangement permutes descriptors, and
texts and digests are read off by streaming the descriptors; bytes are never moved in between. Restoring is the
same the other way round: the output is cut at its sentinels, these are dropped, and the inverse permutation puts the
descriptors back in order.

A text is cut behind units ``[space]*[other]+|[space]+`` (space: U+0020 and U+0009 to U+000D), drawn by four numbers of
the digest of seed and id, so each document's cuts are the same in every run and on every task.

Defined cases: null text is the empty text; empty texts and texts that hold a sentinel stay plain; a null id draws as the
empty id; repeated rows are transformed each for itself; texts of any length are worked on whole, as bytes of their Arrow
batch; extra columns pass through ``transformed`` untouched (a column with one of the added names is an error); an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from broadsheet.llm.arrow_text import columns, unused

SEED = 42
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_SENTINELS = PREFIX + SUFFIX + MIDDLE
#: Of 100 documents so many are transformed, and of 100 of those so many with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
TEXT, MARKS = 0, 1  # buffers
#: Arrangements: sentinels as they are, parts (0 prefix, 1 middle, 2 suffix) by number.
FORMS: dict[str, tuple[bytes | int, ...]] = {"psm": (PREFIX, 0, SUFFIX, 2, MIDDLE, 1), "spm": (SUFFIX, 2, PREFIX, 0, MIDDLE, 1)}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class PieceTable:
    """A document as descriptors over immutable buffers."""

    text: memoryview
    pieces: list[tuple[int, int, int]] = field(default_factory=list)

    @classmethod
    def whole(cls, text: bytes | memoryview) -> PieceTable:
        view = memoryview(text)
        return cls(view, [(TEXT, 0, len(view))])

    def cut(self, *places: int) -> PieceTable:
        """Descriptors split at places of the document (ascending), one part for each stretch between them, empty ones too."""
        out, rest = [], list(self.pieces)
        done = 0
        for place in places:
            while rest and done + rest[0][2] - rest[0][1] < place:
                buffer, start, end = rest.pop(0)
                out.append((buffer, start, end))
                done += end - start
            buffer, start, end = rest.pop(0)
            out.append((buffer, start, start + place - done))
            rest.insert(0, (buffer, start + place - done, end))
            done = place
        return PieceTable(self.text, out + rest)

    def arranged(self, form: str) -> PieceTable:
        """Three parts in the order of a form, with its sentinels."""
        out = []
        for item in FORMS[form]:
            if isinstance(item, bytes):
                start = _SENTINELS.index(item)
                out.append((MARKS, start, start + len(item)))
            else:
                out.append(self.pieces[item])
        return PieceTable(self.text, out)

    def stream(self) -> Iterator[memoryview]:
        marks = memoryview(_SENTINELS)
        for buffer, start, end in self.pieces:
            if end > start:
                yield (self.text if buffer == TEXT else marks)[start:end]

    def digest(self) -> str:
        made = sha256()
        for part in self.stream():
            made.update(part)
        return made.hexdigest()

    def joined(self) -> bytes:
        return b"".join(self.stream())


def restored(output: bytes, form: str) -> PieceTable:
    """The document a transformed text came from, as descriptors over the output."""
    table = PieceTable.whole(output)
    if form not in FORMS:
        return table
    order = FORMS[form]
    parts: dict[int, tuple[int, int, int]] = {}
    at = 0
    for k in range(0, len(order), 2):
        if output[at : at + len(order[k])] != order[k]:
            raise ValueError(f"not a text of form {form}")
        start = at + len(order[k])
        # Texts that hold a sentinel are never transformed, and sentinels don't overlap, so the next one is the first found.
        at = output.find(order[k + 2], start) if k + 2 < len(order) else len(output)
        if at < 0:
            raise ValueError(f"not a text of form {form}")
        parts[order[k + 1]] = (TEXT, start, at)
    return PieceTable(table.text, [parts[k] for k in sorted(parts)])


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Where the units of a text end, in bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(data))


def draws(key: Column, seed: int = SEED) -> Column:
    """Four numbers of 32 bits for an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))


def cut_and_arranged(text: bytes, data: np.ndarray, drawn: list[int]) -> tuple[int, str, PieceTable, tuple[int, int] | None]:
    """Number of units, form, the transformed document, and where prefix and middle end in the text."""
    ends = unit_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = drawn
    if not text or h3 % 100 >= RATE or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", PieceTable.whole(text), None
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    places = tuple(int(ends[k - 1]) if k else 0 for k in (one, two))
    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    return n, form, PieceTable.whole(text).cut(*places).arranged(form), places


def _rows(docs: DataFrame, key: str, text: str, seed: int, schema: T.StructType, made: Callable) -> DataFrame:
    """``docs`` with columns that ``made`` computes for each text (bytes), its data and draws."""
    names, added = docs.columns, schema.fieldNames()
    clash = {c.lower() for c in names} & {c.lower() for c in added}
    if clash:
        raise ValueError(f"there are columns {sorted(clash)} already")
    at, kinds = names.index(text), [pa.int64() if f.dataType == T.LongType() else pa.string() for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = batch.column(len(names)).to_pylist()
            offsets, data = columns(pa.RecordBatch.from_arrays([batch.column(at)], names=["text"]), "text")
            rows = []
            for k in range(batch.num_rows):
                part = data[offsets[k] : offsets[k + 1]]
                rows.append(made(part.tobytes(), part, drawn[k]))
            new = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*names, *added])

    drawn = docs.withColumn(unused(names, "draws"), draws(docs[key], seed))
    return drawn.mapInArrow(run, T.StructType([*docs.schema.fields, *schema.fields]))


def _added(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` with ``fim_text`` and ``fim_form``."""

    def made(said: bytes, data: np.ndarray, drawn: list[int]) -> tuple:
        _, form, table, _ = cut_and_arranged(said, data, drawn)
        return table.joined().decode(), form

    return _rows(docs, key, text, seed, _added(fim_text=T.StringType(), fim_form=T.StringType()), made)


def originals(rows: DataFrame, text: str = "fim_text", form: str = "fim_form", to: str = "restored") -> DataFrame:
    """``rows`` with the text each came from in ``to``."""
    names = rows.columns
    if to.lower() in (c.lower() for c in names):
        raise ValueError(f"there is a column {to!r} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, forms = (batch.column(names.index(c)).to_pylist() for c in (text, form))
            back = [restored((t or "").encode(), f).joined().decode() for t, f in zip(said, forms, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*names, to])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())]))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Per document its units, form, lengths of prefix and middle, and digests of the output and of the text restored from it."""

    def made(said: bytes, data: np.ndarray, drawn: list[int]) -> tuple:
        n, form, table, places = cut_and_arranged(said, data, drawn)
        output = table.joined()
        lengths = (None, None)
        if places:
            starts = (data & 0xC0) != 0x80  # first bytes of code points
            lengths = tuple(int(np.count_nonzero(starts[i:j])) for i, j in ((0, places[0]), places))
        return n, form, *lengths, table.digest(), restored(output, form).digest()

    kinds = _added(n=T.LongType(), form=T.StringType(), prefix_chars=T.LongType(), middle_chars=T.LongType(), output_sha256=T.StringType(), restored_sha256=T.StringType())
    chosen = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return _rows(chosen, "doc_id", "text", seed, kinds, made).drop("text")


def oracle_sql() -> str:
    """The digests in SQL."""
    space = r"[\x20\x09-\x0D]"
    return rf"""
    WITH drawn AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
               regexp_extract_all(coalesce(text, ''), '{space}*[^\x20\x09-\x0D]+|{space}+') AS units
        FROM documents),
    numbers AS (
        SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
               CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
               CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
        FROM drawn),
    parts AS (
        SELECT doc_id, text, n,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
               array_to_string(units[1 : least(a, b)], '') AS prefix,
               array_to_string(units[least(a, b) + 1 : greatest(a, b)], '') AS middle,
               array_to_string(units[greatest(a, b) + 1 : n], '') AS suffix
        FROM numbers)
    SELECT doc_id, n, form,
           CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
    FROM parts"""
