"""Text columns as byte arrays: what the vectorised operators share inside Arrow tasks.

Every function works on one block of bounded size, so a task holds a few
megabytes at a time whatever the size of its partition.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20


_held: dict[tuple[str, str], object] = {}


def held(operator: str, key: str, make: Callable[[], object]) -> object:
    """What an operator keeps in this Python worker, made once. Spark hands a worker from operator to
    operator, so it keeps what belongs to one of them at a time."""
    if (operator, key) not in _held:
        let_go()
        _held[operator, key] = make()
    return _held[operator, key]


def let_go() -> None:
    """Gives back the memory of operators that this Python worker ran before, also what only its allocators still hold."""
    _held.clear()
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def unused(names: list[str], wish: str) -> str:
    """A column name that none of ``names`` clashes with."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish += "_"
    return wish


_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def scramble(values: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values with well spread bits (the splitmix finaliser)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    room = 1 << max(16, int(size).bit_length())
    if room not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            _powers[room] = tuple(
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(room, np.uint64(base), np.uint64)])) for base in (_ODD, _INVERSE)
            )
    return _powers[room]


class Rolling:
    """Hashes of any stretch of ``data`` in constant time; equal bytes give equal hashes."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power_tables(len(data))
        with np.errstate(over="ignore"):
            self._sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_CODE[data] * up[: len(data)], dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            plain = (self._sums[ends] - self._sums[starts]) * self._down[starts]
            return scramble(plain ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))

    def every(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each position on."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return scramble((self._sums[width:] - self._sums[:n]) * self._down[:n])


def columns(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is the empty text."""
    column = batch.column(name).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return offsets, data


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[:128] = False
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """Words of a block of rows: row, start and end in the block's bytes; and hashes of its lower-case bytes.

    A word is a run of ASCII letters and digits and bytes of 128 and more; A-Z count as a-z.
    """
    base, stop = int(offsets[0]), int(offsets[-1])
    part = _LOWER[data[base:stop]]
    cuts = (offsets - base).astype(np.int64)
    inside = _WORD_BYTE[part]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    heads = cuts[:-1][cuts[:-1] < len(part)]
    begins[heads] = inside[heads]
    tails = cuts[1:][cuts[1:] > 0] - 1
    finishes[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    rows = np.searchsorted(cuts, starts, "right") - 1
    return rows, starts, ends, Rolling(part)


def per_row(rows: np.ndarray, count: int) -> np.ndarray:
    """Boundaries of each row's stretch in an array that is ordered by row."""
    return np.searchsorted(rows, np.arange(count + 1))
