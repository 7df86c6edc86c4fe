"""Near-duplicate documents by Order MinHash and banded alignment.

Two documents are linked if the alignment of their words, in order and within the band that the threshold
leaves open, matches at least ``SIMILARITY`` of the words of the longer one.

1.  Equal texts (by MD5) are one from the start; only one of each goes on, under 64 bits of its digest.
2.  Order MinHash: ``BANDS`` times the ``PICKED`` smallest hashes of ``WORDS``-word runs, each labelled with its occurrence
    number, are put in text order and make a key. Texts that differ in every fifth word share a key with probability 0.12,
    so they miss all 24 with 0.05; in every tenth word with 0.0004.
    A bucket is a key and a band of lengths, each text in two bands, as texts of too different lengths can't match.
3.  In a bucket all members are compared with its head (its first in an order common to all buckets), not with each other, and linked documents are merged to
    components. So pairs are linear in members.
4.  Members that are in no component of their bucket's head, such as texts of many families that share a passage, get new keys from
    runs that stand in fewer of them than half their bucket holds: families part, and go through 3 again, level by level,
    until none is apart or ``LEVELS`` are done.
5.  Members of one bucket, of any level, that are still in different components are all compared with each other: block by block
    by the words two texts have in common, in any order, then by alignment where those allow a link. A pair that shares several buckets
    meets in one of them; of buckets with the same members one is enough. A task hands on only links between what it hasn't connected yet,
    fewer than it got rows, and no pairs. A member goes to as many deals as its bucket has blocks. Where its words that are rarest in crowded
    buckets, of which similar texts share one, are fewer than that, the bucket is parted by those words instead, so that rows stay within the
    words of the texts, unless many blocks share one of their rarest words, too. So no link between texts that share a bucket is lost.
    The comparisons, inside tasks, grow with the square of what a bucket, or a part, holds of different components.
6.  Linked documents form classes (connected components, with pointer jumping).

Defined cases: words are those of ``arrow_text.words_of``; texts of fewer words than a run are one
run; texts without a word (null, empty) are copies only of equal texts, null counting as empty; rows
without an id come back with class null and stay; rows that repeat id and text count as one document, different texts under one id
as different documents; very long texts are read and aligned whole; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import gc
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.llm.arrow_text import columns, let_go, per_row, row_blocks, scramble, unused, words_of
from broadsheet.session import cut_lineage, spread

WORDS = 3
SIMILARITY = 0.8
BANDS, ROWS, PICKED = 24, 1, 2
#: How often the members of buckets that are still apart get new keys.
LEVELS = 2
_ENOUGH = 64  # runs of a text that new keys are drawn from, at least
_STEP = 1.26  # length bands; texts similar enough differ by a factor of 1 / SIMILARITY at most
_FOREST = 1 << 17  # edges that a task merges on its own
_BLOCK, _BLOCK_BYTES = 512, 1 << 21  # members of a bucket, and bytes of their words, that meet as many others at a time
_SLOTS = 16  # bits of a word's hash under which it is counted


def shingles(rows: np.ndarray, words: np.ndarray, count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of ``size`` words; a shorter row is one run."""
    bounds = per_row(rows, count)
    lengths = np.diff(bounds)
    at = np.flatnonzero((np.arange(len(words)) - bounds[rows] <= np.maximum(lengths[rows] - size, 0))) if len(words) else np.zeros(0, np.int64)
    made = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            there = at + k < bounds[rows[at] + 1]
            word = np.where(there, words[np.minimum(at + k, len(words) - 1)], np.uint64(0)) if len(at) else made
            made = scramble(made * np.uint64(31) + word)
    return rows[at], made


def _occurrences(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many equal shingles of the row stand before each."""
    order = np.lexsort((np.arange(len(rows)), hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(rows), np.int64)
    out[order] = np.arange(len(rows)) - first
    return out


def _labelled(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Shingles told apart by their occurrence number."""
    with np.errstate(over="ignore"):
        return scramble(hashes ^ (_occurrences(rows, hashes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def order_minhash(rows: np.ndarray, hashes: np.ndarray, count: int, bands: int = BANDS, tuples: int = ROWS, picked: int = PICKED) -> np.ndarray:
    """Keys of each row, one for each band; rows without a shingle get zeros."""
    keys = np.zeros((count, bands), np.uint64)
    if not len(rows):
        return keys
    bounds = per_row(rows, count)
    full = np.flatnonzero(np.diff(bounds))
    with np.errstate(over="ignore"):
        marked = _labelled(rows, hashes)
        bits = np.uint64(int(len(rows)).bit_length())
        low = np.uint64((1 << int(bits)) - 1)
        place = np.arange(len(rows), dtype=np.uint64)
        seeds = scramble(np.arange(1, bands * tuples + 1, dtype=np.uint64)) | np.uint64(1)
        for k, seed in enumerate(seeds):
            drawn = marked * seed
            drawn ^= drawn >> np.uint64(29)
            drawn *= seed
            drawn = (drawn & ~low) | place
            smallest = []
            for _ in range(picked):
                best = np.minimum.reduceat(drawn, bounds[full])
                at = (best & low).astype(np.int64)
                smallest.append(at)
                drawn[at] = np.uint64(0xFFFFFFFFFFFFFFFF) ^ low | at.astype(np.uint64)
            made = np.full(len(full), seed, np.uint64)
            for at in np.sort(np.stack(smallest), 0):  # in text order
                made = scramble(made + marked[at])
            keys[full, k // tuples] = scramble(keys[full, k // tuples] ^ made)
    return keys


def matched(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest alignment of equal elements that stays within ``band`` of the diagonal.

    The column of the alignment matrix is a number with a bit for each row within
    the band, zero where the score rises; a step adds one element of ``b``.
    """
    positions: dict[int, int] = {}
    for k, x in enumerate(a):
        positions[x] = positions.get(x, 0) | (1 << k)
    width = 2 * band + 1
    full = (1 << width) - 1
    column, done = full, 0
    for j, x in enumerate(b):
        low = j - band  # row of the lowest bit
        places = positions.get(x, 0)
        seen = (places >> low if low >= 0 else places << -low) & full & column
        if seen:
            column = ((column + seen) | (column - seen)) & full
        if not column & 1:
            done += 1
        column = (column >> 1) | (1 << (width - 1))
    return done + width - column.bit_count()


def _in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two texts have in common, in any order: never fewer than an alignment matches."""
    (u, many), (v, much) = (np.unique(x, return_counts=True) for x in (a, b))
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    return int(np.where(v[at] == u, np.minimum(many, much[at]), 0).sum())


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Share of the longer text's words that an alignment matches, 0 where it can't reach ``least``."""
    n, m = len(a), len(b)
    short, long = min(n, m), max(n, m)
    if not short or short < least * long:
        return 0.0
    unequal = np.flatnonzero(a[:short] != b[:short])
    head = int(unequal[0]) if len(unequal) else short
    tail_unequal = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(tail_unequal[0]) if len(tail_unequal) else short - head
    x, y = a[head : n - tail], b[head : m - tail]
    both = head + tail
    if len(x) and len(y):
        if both + _in_common(x, y) < least * long - 1e-9:
            return 0.0
        # A matched pair of words is off the diagonal by no more words than the longer text may have unmatched.
        both += matched(x.tolist(), y.tolist(), int(long * (1 - least) + 1e-9))
    share = both / long
    return share if share >= least - 1e-12 else 0.0


def _node() -> Column:
    """Identity of a text: 64 bits of its digest."""
    return F.xxhash64("digest")


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def sketches(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc, digest of the text, keys (empty for texts without a word), number of words. ``docs`` has doc and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            keys, sizes = [], []
            offsets, data = columns(batch, "text")
            for first, last in row_blocks(offsets):
                rows, starts, ends, rolling = words_of(offsets[first : last + 1], data)
                made = order_minhash(*shingles(rows, rolling.of(starts, ends), last - first, size), last - first).view(np.int64)
                count = np.diff(per_row(rows, last - first))
                keys += [k if n else [] for k, n in zip(made.tolist(), count, strict=True)]
                sizes += count.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("digest"), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["doc", "digest", "keys", "size"]
            )

    return docs.select("doc", "text", _digest("text").alias("digest")).mapInArrow(run, "doc long, digest string, keys array<long>, size long")


def _sequences(texts: DataFrame) -> DataFrame:
    """node and the words of its text in order, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said: list[bytes] = []
            offsets, data = columns(batch, "text")
            for first, last in row_blocks(offsets):
                rows, starts, ends, rolling = words_of(offsets[first : last + 1], data)
                bounds = per_row(rows, last - first)
                short = (rolling.of(starts, ends) >> np.uint64(32)).astype(np.uint32)
                said += [short[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(said, pa.binary())], names=["node", "said"])

    return texts.mapInArrow(run, "node long, said binary")


def verified(pairs: DataFrame, sequences: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts are similar enough."""

    @F.pandas_udf("double")
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) for x, y in zip(a, b, strict=True)], dtype=float)

    left = sequences.select(F.col("node").alias("a"), F.col("said").alias("said_a"))
    right = sequences.select(F.col("node").alias("b"), F.col("said").alias("said_b"))
    both = _join(_join(pairs, left, "a"), right, "b")
    sizes = F.length("said_a"), F.length("said_b")
    close = both.filter(F.least(*sizes) >= least * F.greatest(*sizes))
    return close.select("a", "b", compared("said_a", "said_b").alias("similarity")).filter(F.col("similarity") > 0)


def _placed(members: DataFrame, salt: int, least: float) -> DataFrame:
    """bucket and node: the buckets of ``members`` (node, keys, size) that hold several."""
    scale = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / math.log(max(_STEP, 1.01 / least)))
    each = members.withColumn("scale", F.explode(F.array(scale, scale + 1))).select("node", "scale", F.posexplode("keys").alias("band", "key"))
    placed = each.select("node", F.xxhash64("band", "key", "scale", F.lit(salt)).alias("bucket"))
    several = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    return _join(placed, several, "bucket").select("bucket", "node")


def _release(rows: DataFrame) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps that are done: it acts on what has been collected as garbage."""
    gc.collect()
    rows.sparkSession.sparkContext._jvm.System.gc()


def _join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join: many small tables, each broadcast anew, would pile up on the driver."""
    return left.join(right.hint("merge"), on, how)


def _rooted(rows: DataFrame, roots: DataFrame | None, name: str = "node", to: str = "root") -> DataFrame:
    if roots is None:
        return rows.withColumn(to, F.col(name))
    return _join(rows, roots.select(F.col("node").alias(name), F.col("root").alias(to)), name, "left").withColumn(to, F.coalesce(to, name))


def _several(rest: DataFrame) -> DataFrame:
    """Rows (bucket, node, root and others) of buckets that hold several components; of buckets with the same members those of one."""
    members = F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("other")
    several = rest.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), *members).filter("low < high")
    return _join(rest, several.groupBy("n", "one", "other").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket")


def _apart(left: DataFrame, tried: DataFrame | None, roots: DataFrame | None) -> DataFrame:
    """bucket, node and root of members in no component of a head their bucket was compared with, where these are several."""
    rest = _rooted(left, roots)
    if tried is not None:
        rest = _join(rest, _rooted(tried, roots, "head").select("bucket", "root").distinct(), ["bucket", "root"], "left_anti")
    return cut_lineage(_several(rest).select("bucket", "node", "root"))


def _linked(roots: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """Components (node, root) after linking pairs (a, b) too; only what the pairs touch is worked on."""
    if roots is None:
        return components(pairs)
    between = _rooted(_rooted(pairs, roots, "a", "x"), roots, "b", "y").filter("x <> y")
    up = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")))
    moved = _join(roots, up.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return cut_lineage(moved.unionByName(_join(up, roots.select("node"), "node", "left_anti")))


def _with_links(roots: DataFrame | None, pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame | None:
    """Components after linking those of the distinct pairs (a, b) that are similar."""
    more = cut_lineage(verified(pairs, sequences, least).select("a", "b"))
    _release(more)
    if not more.isEmpty():
        roots = _linked(roots, more)
        _release(roots)
    return roots


def _with_heads(placed: DataFrame, roots: DataFrame | None, sequences: DataFrame, least: float, turn: int) -> tuple[DataFrame | None, DataFrame]:
    """(components so far, members still apart in their buckets) after comparing members with a head of their bucket."""
    left = _apart(placed, None, roots)
    # One order of nodes for all buckets of a turn, so that those a large group fills have mostly the same head, and another one each turn.
    first = F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(turn))).alias("first")
    heads = cut_lineage(left.groupBy("bucket").agg(first).select("bucket", F.col("first.node").alias("head"), F.col("first.root").alias("own")))
    pairs = _join(left, heads, "bucket").filter("root <> own").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    roots = _with_links(roots, pairs, sequences, least)
    return roots, _apart(left.select("bucket", "node"), heads.select("bucket", "head"), roots)


def _keyed_anew(left: DataFrame, sequences: DataFrame, size: int, salt: int) -> DataFrame:
    """node, keys and size of the members of ``left`` (bucket, node), from runs that stand in fewer of
    them than half the largest bucket of the member holds."""
    crowd = _join(left, left.groupBy("bucket").agg(F.count("*").alias("n")), "bucket").groupBy("node").agg(F.max("n").alias("n"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = columns(batch, "said")
            crowds, nodes = batch.column("n").to_numpy(), batch.column("node").to_numpy()
            for first, last in row_blocks(offsets):
                words = np.frombuffer(data[offsets[first] : offsets[last]].tobytes(), np.uint32).astype(np.uint64)
                sizes = np.diff(offsets[first : last + 1]) // 4
                rows, made = shingles(np.repeat(np.arange(last - first), sizes), words, last - first, size)
                at = np.arange(len(rows)) - per_row(rows, last - first)[rows]
                made = _labelled(rows, made)
                # Of long texts the runs whose hash a power of two divides, _ENOUGH to 2 * _ENOUGH of them; texts of other lengths agree on those.
                rate = np.uint64(1) << np.log2(np.maximum(sizes // _ENOUGH, 1)).astype(np.uint64)
                kept = (scramble(made) & (rate[rows] - np.uint64(1))) == 0
                rows, at, made = rows[kept], at[kept], made[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[first:last][rows]), pa.array(crowds[first:last][rows]), pa.array(sizes[rows].astype(np.int64)), pa.array(at), pa.array(made.view(np.int64))],
                    names=["node", "n", "size", "at", "run"],
                )

    each = _join(sequences, crowd, "node").select("node", "n", "said").mapInArrow(runs, "node long, n long, size long, at long, run long")
    # Counted before the shuffle; adaptive execution splits a run that very many members hold.
    shared = each.groupBy("run").agg(F.count("*").alias("held")).filter("held > 1")
    rare = _join(each, shared, "run").filter("held < greatest(n / 2, 3)")
    listed = rare.groupBy("node").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("at", "run"))).alias("runs"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array([r["run"] for r in row], np.int64).view(np.uint64) for row in batch.column("runs").to_pylist()]
            rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            hashes = scramble(np.concatenate(lists) ^ np.uint64(salt)) if lists else np.zeros(0, np.uint64)
            keys = order_minhash(rows, hashes, len(lists)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["node", "size", "keys"])

    return listed.mapInArrow(keyed, "node long, size long, keys array<long>")


def _filled(rest: DataFrame) -> DataFrame:
    """How many members, bytes and blocks of them (a fraction below one) each component has in each bucket of ``rest``."""
    fills = F.greatest(F.count("*") / F.lit(_BLOCK), F.sum("bytes") / F.lit(_BLOCK_BYTES)).alias("fills")
    return rest.groupBy("bucket", "root").agg(fills, F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def _crowded(rest: DataFrame, least: float) -> DataFrame:
    """Buckets whose members would go to more deals than similar texts have words of which they share one."""
    own = F.when(F.col("fills") < 1, 0).otherwise(F.ceil("fills"))
    mixed = F.ceil(F.sum(F.when(F.col("fills") < 1, F.col("fills")).otherwise(0.0)))
    sums = _filled(rest).withColumn("own", own).groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum(F.col("n") * F.col("own")).alias("spared"), (F.sum("own") + mixed).alias("blocks")
    )
    return sums.filter(F.col("n") * F.col("blocks") - F.col("spared") > F.col("n") * 2 + F.col("bytes") / 4 * (1 - least)).select("bucket")


def _marked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Words of the texts in ``said``, told apart by their occurrence number, and their rows: block by block."""
    offsets, data = columns(batch, "said")
    for first, last in row_blocks(offsets):
        words = np.frombuffer(data[offsets[first] : offsets[last]].tobytes(), np.uint32).astype(np.uint64)
        rows = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]) // 4)
        yield first, last, rows, _labelled(rows, words) if len(rows) else words


def _rarest(sequences: DataFrame, least: float) -> DataFrame:
    """node and those words of each of ``sequences`` that come first in one order of all words, the rare ones before: so many that
    similar texts, which share ``least`` of the longer one's words, share one of these."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _SLOTS, np.int64)
        for batch in batches:
            for _, _, _, words in _marked(batch):
                counts += np.bincount((words >> np.uint64(64 - _SLOTS)).astype(np.int64), minlength=len(counts))
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])

    # No more rows than there are slots. Any order is right; a good one makes small parts.
    found = sequences.select("said").mapInArrow(seen, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(1 << _SLOTS, np.int64)
    held[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    shared = sequences.sparkSession.sparkContext.broadcast(held)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for first, last, rows, words in _marked(batch):
                order = np.lexsort((words, shared.value[(words >> np.uint64(64 - _SLOTS)).astype(np.int64)], rows))
                bounds = per_row(rows, last - first)
                sizes = np.diff(bounds)
                kept = np.arange(len(rows)) - bounds[rows] <= (sizes - np.ceil(least * sizes - 1e-9))[rows]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[first:last][rows[kept]]), pa.array(words[order[kept]].view(np.int64))], names=["node", "word"])

    return sequences.select("node", "said").mapInArrow(rarest, "node long, word long")


def _parted(rest: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """``rest`` (bucket, node, root, bytes) with crowded buckets parted by the rarest words of their members: parts are buckets, too."""
    crowded = cut_lineage(_crowded(rest, least))
    if crowded.isEmpty():
        return rest
    dealt = cut_lineage(_join(rest, crowded, "bucket", "left_semi"))
    words = _rarest(_join(sequences, dealt.select("node").distinct(), "node", "left_semi"), least)
    parts = _join(dealt, words, "node").select(F.xxhash64("bucket", "word").alias("bucket"), "node", "root", "bytes")
    return cut_lineage(_several(_join(rest, crowded, "bucket", "left_anti").unionByName(parts)))


def _blocks(rest: DataFrame) -> DataFrame:
    """deal, side, bucket, node and root: who of ``rest`` (bucket, node, root, bytes) meets whom. In a deal all of side 0 meet all of
    side 1, those of side 2 each other. A component that fills blocks of its own isn't compared with itself."""
    held = _filled(rest).select("bucket", "root", "fills")
    mixed = held.groupBy("bucket").agg(F.sum(F.when(F.col("fills") < 1, F.col("fills"))).alias("mixed"))
    own = F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil("fills")))
    shared = F.xxhash64(F.pmod(F.xxhash64("root"), F.ceil("mixed")))
    placed = _join(_join(rest, held, ["bucket", "root"]), mixed, "bucket")
    placed = cut_lineage(placed.select("bucket", "node", "root", F.when(F.col("fills") < 1, shared).otherwise(own).alias("block")))
    some = placed.groupBy("bucket", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    first, second = (some.select("bucket", F.struct("block", "low", "high").alias(name)) for name in ("x", "y"))
    met = _join(first, second, "bucket").filter("x.block <= y.block AND least(x.low, y.low) < greatest(x.high, y.high)")
    seat = lambda name, side: F.struct(F.col(f"{name}.block").alias("block"), F.lit(side).alias("side"))
    seats = F.when(F.col("x.block") == F.col("y.block"), F.array(seat("x", 2))).otherwise(F.array(seat("x", 0), seat("y", 1)))
    deals = met.select("bucket", F.xxhash64("bucket", "x.block", "y.block").alias("deal"), F.explode(seats).alias("seat")).select("bucket", "deal", "seat.*")
    return _join(placed, deals, ["bucket", "block"]).select("deal", "side", "bucket", "node", "root")


class _Common:
    """How many values lists have in common; each list holds a value once."""

    def __init__(self, rows: np.ndarray, values: np.ndarray, count: int):
        found, at, held = np.unique(values, return_inverse=True, return_counts=True)
        several = held[at] > 1
        self._ids, self._bounds = at[several], per_row(rows[several], count)
        self._mark = np.zeros(len(found), bool)

    def of(self, row: int, begin: int) -> np.ndarray:
        """With list ``row``, for each list from ``begin`` on."""
        own = self._ids[self._bounds[row] : self._bounds[row + 1]]
        self._mark[own] = True
        sums = np.concatenate([[0], np.cumsum(self._mark[self._ids[self._bounds[begin] :]])])
        self._mark[own] = False
        bounds = self._bounds[begin:] - self._bounds[begin]
        return sums[bounds[1:]] - sums[bounds[:-1]]


def _meeting(rows: list[dict], least: float) -> pa.RecordBatch:
    """Links (a, b) that connect whatever the similar pairs of a deal connect: fewer than it has components. Pairs that meet
    in an earlier bucket too are left to that one."""
    rows = sorted(rows, key=lambda r: r["side"])
    texts = [np.frombuffer(r["said"], np.uint32) for r in rows]
    nodes, roots, sides = (np.array([r[c] for r in rows], np.int64) for c in ("node", "root", "side"))
    sizes = np.array([len(x) for x in texts])
    at = np.repeat(np.arange(len(rows)), sizes)
    words = _Common(at, _labelled(at, np.concatenate(texts).astype(np.uint64)), len(rows))
    earlier = [np.array(r["earlier"], np.int64) for r in rows]
    met = _Common(np.repeat(np.arange(len(rows)), [len(x) for x in earlier]), np.concatenate(earlier), len(rows))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(sides != 1):
        begin = i + 1 if sides[i] == 2 else int(np.searchsorted(sides, 1))
        longer = np.maximum(sizes[begin:], sizes[i])
        open_ = (roots[begin:] != roots[i]) & (np.minimum(sizes[begin:], sizes[i]) >= least * longer - 1e-9)
        if open_.any():
            open_ &= met.of(i, begin) == 0
        if open_.any():
            bound = words.of(i, begin) / longer
            close = np.flatnonzero(open_ & (bound >= least - 1e-9))
            found.append((np.full(len(close), i), close + begin, bound[close]))
    i, j, bound = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    # The likeliest pairs first: what they link settles others.
    order = np.argsort(-bound, kind="stable")
    up = np.unique(roots, return_inverse=True)[1].tolist()
    mine, above = list(up), list(range(max(up) + 1))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    links: list[tuple[int, int]] = []
    for k, m in zip(i[order].tolist(), j[order].tolist(), strict=True):
        x, y = top(mine[k]), top(mine[m])
        if x != y and similarity(texts[k], texts[m], least):
            above[max(x, y)] = min(x, y)
            links.append((nodes[k], nodes[m]))
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _sized(sequences: DataFrame) -> DataFrame:
    return sequences.select("node", F.length("said").alias("bytes"))


def _links(rest: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that connect what the similar pairs of each bucket in ``rest`` (bucket, node, root, bytes if known) connect: fewer than it
    has rows in deals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(0, batch.num_rows, 64) for row in batch.slice(k, 64).to_pylist())
        for _, deal in itertools.groupby(rows, key=lambda r: r["deal"]):
            yield _meeting(list(deal), least)

    if "bytes" not in rest.columns:
        rest = cut_lineage(_join(rest, _sized(sequences), "node"))
    buckets = rest.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
    seated = _join(_blocks(rest), _join(sequences, buckets, "node"), "node")
    seated = seated.select("deal", "side", "node", "root", "said", F.filter("buckets", lambda x: x < F.col("bucket")).alias("earlier"))
    return spread(seated, "deal").sortWithinPartitions("deal").mapInArrow(run, "a long, b long")


def _settled(placed: DataFrame, roots: DataFrame | None, sequences: DataFrame, least: float) -> DataFrame | None:
    """Components after comparing all members of the buckets ``placed`` (bucket, node) that are in different ones."""
    rest = cut_lineage(_several(_join(placed, _rooted(_sized(sequences), roots), "node", "left")))
    if rest.isEmpty():
        return roots
    links = cut_lineage(_links(_parted(rest, sequences, least), sequences, least))
    _release(links)
    return roots if links.isEmpty() else _linked(roots, links)


def linked(members: DataFrame, docs: DataFrame, size: int = WORDS, least: float = SIMILARITY) -> DataFrame | None:
    """Components (node, root) of what is similar among ``members`` (node, keys, size, digest, first); those alone may be left out.
    ``docs``: doc, digest and text; the text of a member is that of its ``first``."""
    placed = cut_lineage(_placed(members, 0, least))
    wanted = _join(members.select("node", "digest", "first"), placed.select("node").distinct(), "node", "left_semi")
    # Texts are shuffled once; rows that repeat id and text go where they are.
    texts = _join(docs, wanted, "digest").filter("doc = first").dropDuplicates(["digest"])
    sequences = cut_lineage(_sequences(texts.select("node", "text")))
    _release(sequences)
    roots, left = _with_heads(placed, None, sequences, least, 0)
    every = placed
    for level in range(1, LEVELS + 1):
        if left.isEmpty():
            break
        anew = cut_lineage(_placed(_keyed_anew(left, sequences, size, level), level, least))
        _release(anew)
        if anew.isEmpty():
            break
        roots, left = _with_heads(anew, roots, sequences, least, level)
        every = every.unionByName(anew)
    return _settled(every, roots, sequences, least)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and of each the smallest node these edges connect it with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while (up[x] != up[y]).any():
        was, low = up.copy(), np.minimum(up[x], up[y])
        np.minimum.at(up, was[x], low)
        np.minimum.at(up, was[y], low)
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


def _forests(edges: DataFrame) -> DataFrame:
    """node and root of what the edges (a, b) of each task connect, ``_FOREST`` of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def merged() -> pa.RecordBatch:
            nodes, roots = _forest(*np.concatenate(held, axis=1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

        for batch in batches:
            held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
            if sum(x.shape[1] for x in held) >= _FOREST:
                yield merged()
        if held:
            yield merged()

    return edges.select("a", "b").mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest member) of everything that edges (a, b) connect."""
    # Tasks merge what they hold first. Where that leaves each node one root it is done, else stars are merged by
    # rounds of joins: many small rounds cost the driver more than the work itself.
    edges = cut_lineage(edges.select("a", "b"))
    many = math.ceil(edges.count() / _FOREST)
    stars = cut_lineage(_forests(edges.coalesce(max(1, many))))
    if many < 2:
        return stars
    labels = cut_lineage(stars.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("high")))
    if labels.filter("root <> high").isEmpty():
        return labels.select("node", "root")
    return _joined_up(stars.select(F.col("node").alias("a"), F.col("root").alias("b")))


def _joined_up(edges: DataFrame) -> DataFrame:
    """The same by rounds of joins, however many edges there are; a node's edge to itself connects nothing but keeps it."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = _join(both, labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = _join(labels, near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        # The root a node had moves with it, as all that hang on it do: else a path in mixed order takes as many rounds as it is long.
        moves = lower.unionByName(lower.select(F.col("old").alias("node"), "root", F.lit(None).cast("long").alias("old")))
        lower = moves.groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        roots = lower.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = cut_lineage(_join(lower, roots, "root").select("node", F.least("root", "up").alias("root"), "old"))
        if moved.filter("root <> old").isEmpty():
            return moved.select("node", "root")
        labels = moved.select("node", "root")


def _classed(docs: DataFrame, key: str, text: str, size: int, least: float) -> DataFrame:
    """doc, digest, class_id (smallest id of the class) and is_kept, one row for each distinct id and text."""
    named = docs.select(docs[key].cast("long").alias("doc"), docs[text].cast("string").alias("text")).filter("doc IS NOT NULL")
    drawn = cut_lineage(sketches(named, size).groupBy("doc", "digest").agg(F.min("keys").alias("keys"), F.min("size").alias("size")))
    texts = drawn.groupBy("digest").agg(F.min("doc").alias("first"), F.min("keys").alias("keys"), F.min("size").alias("size"))
    texts = cut_lineage(texts.withColumn("node", _node()))
    roots = linked(texts, named.withColumn("digest", _digest("text")), size, least)
    rooted = _rooted(texts.select("digest", "first", "node"), roots).select("digest", "first", "root")
    # The kept row of a class: its smallest id, and of that id's texts the one with the smallest digest.
    best = rooted.groupBy("root").agg(F.min(F.struct("first", "digest")).alias("best"))
    answers = _join(rooted, best, "root").select("digest", F.col("best.first").alias("class_id"), F.col("best.digest").alias("kept"))
    return _join(drawn.select("doc", "digest"), answers, "digest").select(
        "doc", "digest", "class_id", ((F.col("doc") == F.col("class_id")) & (F.col("digest") == F.col("kept"))).alias("is_kept")
    )


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and is_kept, one row for each distinct id and text, and each row without an id."""
    out = _classed(docs, key, text, size, least).select(F.col("doc").alias("doc_id"), "class_id", "is_kept")
    nobody = F.lit(None).cast("long")
    nameless = docs.filter(docs[key].isNull()).select(nobody.alias("doc_id"), nobody.alias("class_id"), F.lit(True).alias("is_kept"))
    return out.unionByName(nameless)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the first document of each class; rows without an id stay."""
    kept = _classed(docs, key, text, WORDS, SIMILARITY).filter("is_kept").select("doc", "digest")
    doc, digest = unused(docs.columns, "doc"), unused(docs.columns, "digest")
    known = docs.filter(docs[key].isNotNull()).withColumns({doc: docs[key].cast("long"), digest: _digest(text)})
    named = known.join(kept.select(F.col("doc").alias(doc), F.col("digest").alias(digest)).hint("merge"), [doc, digest], "left_semi")
    return named.dropDuplicates([doc, digest]).select(*docs.columns).unionByName(docs.filter(docs[key].isNull()))
