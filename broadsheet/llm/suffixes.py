"""Removal of repeated byte strings: suffix sorting, one bucket at a time, with a difference cover.

Every text is read as UTF-8 bytes; a byte goes if a string of ``LENGTH`` bytes
around it also starts earlier (in a document with a smaller id, or earlier in
the same one). A global sort of all suffixes would move every byte many times,
so the work is cut into buckets that hold all suffixes that can be equal:

1.  *Buckets.* Of the ``GRAM``-byte strings within the ``LENGTH`` bytes after a position the one
    with the smallest hash names the suffix's bucket. Equal strings have equal
    names, and neighbouring suffixes mostly share one, so a run of them (a *span*,
    on average 37 suffixes) travels as one row of hashes and offsets, without text.
2.  *Whole spans.* Equal spans are equal suffix by suffix: of each kind the first
    stays and all later ones are repeats. Tasks drop repeats of their own rows
    before the shuffle, so a text that a third of all rows share sends one row a task.
3.  *Sorting a bucket.* Only buckets that hold different spans need their bytes.
    Their suffixes are compared by the first and last ``PERIOD`` bytes; ties, which in such
    buckets run long, are resolved by ranks computed beforehand for the positions of a
    difference cover: any two positions i and j have a shift k below ``PERIOD`` at which i + k
    and j + k both belong to the cover, so one comparison of ranks settles what lies between.
    Buckets are sorted in batches of about ``BATCH`` spans. A bucket of more than ``HOT`` spans, such as that of a
    phrase that many texts embed in words of their own, isn't sorted in one task: its suffixes are dealt anew, each by the
    hash of its own ``LENGTH`` bytes, and of equal ones the first is found by an aggregate that starts before the shuffle.

Document ids order the documents. Defined cases: null text is the empty text;
rows whose id is null are returned unchanged and are nobody's source; rows that
repeat both id and text count as one document and get the same result; different texts
under one id are told apart by a checksum of the text and ordered by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.arrow_text import BLOCK_BYTES, Rolling, columns, let_go, row_blocks
from broadsheet.session import cut_lineage

LENGTH = 100
GRAM = 28
#: A difference cover of the numbers modulo 7: each difference occurs among 1, 2 and 4.
PERIOD, COVER = 7, (1, 2, 4)
BATCH = 4_000
HOT = 2_000
_HELD = 400_000
_LOW = 20  # bits of a position inside a block


def shifts() -> np.ndarray:
    """For residues r and s the smallest k with r + k and s + k in the cover."""
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for r in range(PERIOD):
        for s in range(PERIOD):
            table[r, s] = next(k for k in range(PERIOD) if (r + k) % PERIOD in COVER and (s + k) % PERIOD in COVER)
    return table


_SHIFTS = shifts()


def _pieces(offsets: np.ndarray, length: int, limit: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Blocks of (row, first byte in the row, begin, end) of at most ``limit`` bytes, long rows in overlapping parts."""
    block, held = [], 0
    for row in np.flatnonzero(np.diff(offsets) >= length):
        begin, stop = int(offsets[row]), int(offsets[row + 1])
        at = begin
        while stop - at >= length:
            end = min(stop, at + limit)
            if held + end - at > limit and block:
                yield block
                block, held = [], 0
            block.append((int(row), at - begin, at, end))
            held += end - at
            at = end - length + 1
    if block:
        yield block


def spans(part: np.ndarray, cuts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Spans of the pieces in ``part``: piece, first and last suffix, bucket name, hash of the span's bytes."""
    rolling = Rolling(part)
    names = rolling.every(gram)
    mask = np.uint64((1 << _LOW) - 1)
    keys = (names & ~mask) | np.arange(len(names), dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while reach < width:  # smallest key of each window, doubling what has been looked at
        step = min(reach, width - reach)
        keys = np.minimum(keys[:-step], keys[step:])
        reach += step
    chosen = (keys & mask).astype(np.int64)
    piece = np.searchsorted(cuts, np.arange(len(chosen)), "right") - 1
    inside = np.arange(len(chosen)) + length <= cuts[piece + 1]
    at = np.flatnonzero(inside)
    new = np.concatenate([[True], (chosen[at][1:] != chosen[at][:-1]) | (piece[at][1:] != piece[at][:-1])])
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    return piece[first], first, last, names[chosen[first]], rolling.of(first, last + length)


_SPAN = "bucket long, span long, doc long, place long, more int, sure boolean"


def _tag(text: str):
    """Tells apart texts under one id: 15 bits above the offset in ``place``."""
    return F.shiftleft(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(0x7FFF), 48)


def _span_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            """Held spans without those that repeat another of them; these are told at once."""
            bucket, span, doc, place, more = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((place, doc, span, bucket))
            bucket, span, doc, place, more = (c[order] for c in (bucket, span, doc, place, more))
            again = np.concatenate([[False], (bucket[1:] == bucket[:-1]) & (span[1:] == span[:-1])])
            same = again & np.concatenate([[False], (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])])
            # Sure repeats in a row of a document are one stretch.
            d, p, m = doc[again & ~same], place[again & ~same], more[again & ~same]
            order = np.lexsort((p, d))
            d, p, m = d[order], p[order], m[order].astype(np.int64)
            if len(d):
                starts = np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + m[:-1] + 1)])
                first = np.flatnonzero(starts)
                last = np.concatenate([first[1:] - 1, [len(d) - 1]])
                d, p, m = d[first], p[first], p[last] + m[last] - p[first]
            keep = ~again
            spread = (d * -7046029254386353131) ^ p  # anywhere, evenly
            n = int(keep.sum())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([bucket[keep].view(np.int64), spread])),
                    pa.array(np.concatenate([span[keep].view(np.int64), np.zeros(len(d), np.int64)])),
                    pa.array(np.concatenate([doc[keep], d])), pa.array(np.concatenate([place[keep], p])),
                    pa.array(np.concatenate([more[keep], m]).astype(np.int32)), pa.array(np.arange(n + len(d)) >= n),
                ],
                names=["bucket", "span", "doc", "place", "more", "sure"],
            )

        for batch in batches:
            offsets, data = columns(batch, "text")
            ids = np.asarray(batch.column("doc").to_numpy(zero_copy_only=False), np.int64)
            tags = np.asarray(batch.column("tag").to_numpy(zero_copy_only=False), np.int64)
            for block in _pieces(offsets, length, BLOCK_BYTES):
                part = np.concatenate([data[b:e] for _, _, b, e in block])
                cuts = np.concatenate([[0], np.cumsum([e - b for _, _, b, e in block])])
                piece, first, last, bucket, span = spans(part, cuts, length, gram)
                rows, shift = np.array([x[0] for x in block]), np.array([x[1] for x in block])
                held.append((bucket, span, ids[rows[piece]], tags[rows[piece]] + shift[piece] + first - cuts[piece], last - first))
                size += len(piece)
                if size >= _HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _whole_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by bucket, span and place: later ones of a kind are repeats; of
    buckets with several kinds the first of each goes on."""
    # Of the bucket in progress: its name, the last kind and place, the only first one so far.
    carry: tuple | None = None

    def out(bucket, doc, place, more, sure):
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket), pa.array(doc), pa.array(place), pa.array(more.astype(np.int32)), pa.array(sure)],
            names=["bucket", "doc", "place", "more", "sure"],
        )

    for batch in batches:
        bucket, span, doc, place, more = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "span", "doc", "place", "more"))
        told = np.asarray(batch.column("sure").to_pylist(), bool)
        if told.any():
            yield out(bucket[told], doc[told], place[told], more[told], told[told])
        bucket, span, doc, place, more = (c[~told] for c in (bucket, span, doc, place, more))
        n = len(bucket)
        if not n:
            continue
        new_bucket = np.concatenate([[carry is None or carry[0] != bucket[0]], bucket[1:] != bucket[:-1]])
        new_kind = new_bucket | np.concatenate([[carry is None or carry[1] != span[0]], span[1:] != span[:-1]])
        same = ~new_kind & np.concatenate([[carry is not None and carry[2] == (doc[0], place[0])], (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])])
        again = ~new_kind & ~same
        yield out(bucket[again], doc[again], place[again], more[again], np.ones(int(again.sum()), bool))
        group = np.cumsum(new_bucket)  # 0: the bucket in progress
        firsts = np.flatnonzero(new_kind)
        kinds = np.bincount(group[firsts], minlength=int(group[-1]) + 1)
        seen, pending = (carry[3], carry[4]) if carry else (0, None)
        kinds[0] += seen
        if pending is not None and kinds[0] > 1:
            yield out(*(np.array([x]) for x in pending), np.zeros(1, bool))
        go = firsts[kinds[group[firsts]] > 1]
        yield out(bucket[go], doc[go], place[go], more[go], np.zeros(len(go), bool))
        kept = None
        if kinds[group[-1]] == 1:
            own = firsts[group[firsts] == group[-1]]
            kept = (bucket[own[0]], doc[own[0]], place[own[0]], more[own[0]]) if len(own) else pending
        carry = (bucket[-1], span[-1], (doc[-1], place[-1]), int(kinds[group[-1]]), kept)


def sort_bucket(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups the suffixes of a bucket's spans by their first ``length`` bytes.

    Returns for each suffix its span, its offset in the span and the number of its group.
    """
    data = np.frombuffer(b"".join(texts) + b"\0" * length, np.uint8)
    sizes = np.array([len(t) for t in texts])
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = cuts[:-1][owner] + inner
    # Cover sample: ranks of the bytes between the first and the last PERIOD of a suffix.
    middle = length - PERIOD
    positions = np.arange(len(data) - length + 1)
    sample = positions[np.isin(positions % PERIOD, COVER)]
    needed = np.zeros(len(data), bool)
    for k in range(PERIOD):
        needed[at + k] = True
    sample = sample[needed[sample]]
    strings = np.lib.stride_tricks.sliding_window_view(data, middle)[sample]
    _, ranks = np.unique(np.ascontiguousarray(strings).view(np.dtype((np.void, middle))).ravel(), return_inverse=True)
    rank = np.zeros(len(data) + PERIOD, np.int64)
    rank[sample] = ranks
    # Prefix of a suffix: its first and last PERIOD bytes, as numbers.
    window = np.lib.stride_tricks.sliding_window_view(data, PERIOD)
    weights = np.uint64(256) ** np.arange(PERIOD - 1, -1, -1, dtype=np.uint64)
    head = (window[at].astype(np.uint64) * weights).sum(1, dtype=np.uint64)
    tail = (window[at + length - PERIOD].astype(np.uint64) * weights).sum(1, dtype=np.uint64)
    _, prefix = np.unique(np.stack([head, tail], 1), axis=0, return_inverse=True)
    prefix = prefix.ravel()
    residue = at % PERIOD
    # Ties among suffixes of one residue: the ranks at the same shift.
    own = rank[at + _SHIFTS[residue, residue]]
    _, kind_first, kind = np.unique(np.stack([prefix, residue, own], 1), axis=0, return_index=True, return_inverse=True)
    kind = kind.ravel()
    # Ties across residues: ranks at the shift of each pair, between one suffix of each kind.
    rep, group = at[kind_first], np.arange(len(kind_first))
    p, r = prefix[kind_first], residue[kind_first]
    for a in range(PERIOD):
        for b in range(a + 1, PERIOD):
            k = _SHIFTS[a, b]
            left, right = np.flatnonzero(r == a), np.flatnonzero(r == b)
            if not len(left) or not len(right):
                continue
            code_left, code_right = (p[x] * (len(ranks) + 1) + rank[rep[x] + k] for x in (left, right))
            order = np.argsort(code_left)
            found = np.minimum(np.searchsorted(code_left[order], code_right), len(left) - 1)
            equal = code_left[order][found] == code_right
            x, y = left[order][found[equal]], right[equal]
            low = np.minimum(group[x], group[y])
            np.minimum.at(group, x, low)
            np.minimum.at(group, y, low)
    return owner, inner, group[group[kind]]


def _settled(rows: list[tuple[int, int, bytes]], length: int) -> tuple[list[int], list[int], list[int]]:
    """Runs of repeats among spans (doc, place, bytes)."""
    rows = sorted(rows, key=lambda x: x[:2])
    owner, inner, group = sort_bucket([x[2] for x in rows], length)
    # Spans are in order of place, and so are their suffixes, unless spans of one text overlap.
    docs = np.array([x[0] for x in rows])[owner]
    places = np.array([x[1] for x in rows])[owner] + inner
    order = np.lexsort((places, docs, group))
    g, d, p = group[order], docs[order], places[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = (d != d[head]) | (p != p[head])
    repeat = np.zeros(len(order), bool)
    repeat[order[again]] = True
    # Runs of repeats inside a span.
    edge = np.concatenate([[True], (owner[1:] != owner[:-1])])
    begin = np.flatnonzero(repeat & (edge | ~np.concatenate([[False], repeat[:-1]])))
    stop = np.flatnonzero(repeat & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([repeat[1:], [False]])))
    return docs[begin].tolist(), places[begin].tolist(), (stop - begin).tolist()


def _bucket_repeats(length: int):
    def settled(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        docs, places, more = _settled(rows, length) if len(rows) > 1 else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(more, pa.int32())], names=["doc", "place", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for name, doc, place, said in zip(*(batch.column(k).to_pylist() for k in ("bucket", "doc", "place", "bytes")), strict=True):
                if name != bucket and len(rows) >= BATCH:
                    yield settled(rows)
                    rows = []
                bucket = name
                rows.append((doc, place, said))
        yield settled(rows)
        rows.clear()
        let_go()

    return run


def _each_suffix(length: int):
    """Hash and place of every suffix of the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = columns(batch, "bytes")
            docs, places = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in ("doc", "place"))
            for first, last in row_blocks(offsets):
                cuts = offsets[first : last + 1] - offsets[first]
                hashes = Rolling(data[offsets[first] : offsets[last]]).every(length)
                at = np.arange(len(hashes))
                owner = np.searchsorted(cuts, at, "right") - 1
                inside = at + length <= cuts[owner + 1]
                at, owner = at[inside], owner[inside]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[at].view(np.int64)), pa.array(docs[first:last][owner]), pa.array(places[first:last][owner] + at - cuts[owner])], names=["hash", "doc", "place"]
                )

    return run


def _hot_repeats(spans_with_bytes: DataFrame, length: int) -> DataFrame:
    """Repeats (doc, place, more) among the suffixes of hot buckets."""
    each = spans_with_bytes.select("doc", "place", "bytes").mapInArrow(_each_suffix(length), "hash long, doc long, place long")
    # Merged before the shuffle, so a suffix in a third of all rows sends one row a task.
    first = each.groupBy("hash").agg(F.min(F.struct("doc", "place")).alias("first"), F.max(F.struct("doc", "place")).alias("last"))
    several = first.filter("first <> last").select("hash", "first")
    # Adaptive execution splits a hash with very many suffixes, which a sort-merge join allows.
    met = each.join(several.hint("merge"), "hash").filter(F.struct("doc", "place") != F.col("first"))
    return met.select("doc", "place", F.lit(0).alias("more"))


def _known(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with an id, and a column that tells apart different texts under one."""
    return docs.filter(F.col(key).isNotNull()).withColumn("_tag", _tag(text))


def repeats(known: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs of repeated suffixes: id, _tag, place (of the first, with the tag), more (how many follow)."""
    texts = known.select(F.col(key).cast("long").alias("doc"), F.col("_tag").alias("tag"), F.col(text).cast("string").alias("text"))
    sent = texts.mapInArrow(_span_rows(length, gram), _SPAN)
    ordered = sent.repartition("bucket").sortWithinPartitions("bucket", "span", "doc", "place")
    told = cut_lineage(ordered.mapInArrow(_whole_spans, "bucket long, doc long, place long, more int, sure boolean"))
    tag = F.shiftleft(F.shiftright("place", 48), 48).alias("_tag")
    open_spans = told.filter("NOT sure").select("bucket", F.col("doc").alias(key), tag, "place", "more")
    offset = f"int(place & {(1 << 48) - 1})"

    def with_bytes(some: DataFrame) -> DataFrame:
        # The columns that ``digests`` has, in its order, so that this join and its last one read the same shuffled documents;
        # others stay out, as their names may be those of the spans.
        return some.join(known.select(key, text, "_tag").hint("merge"), [key, "_tag"]).select(
            "bucket", F.col(key).cast("long").alias("doc"), "place",
            F.expr(f"substring(cast(`{text}` AS binary), {offset} + 1, more + {length})").alias("bytes"),
        )

    hot = cut_lineage(open_spans.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("bucket"))
    any_hot = not hot.isEmpty()
    sorted_buckets = with_bytes(open_spans.join(hot, "bucket", "left_anti") if any_hot else open_spans).repartition("bucket").sortWithinPartitions("bucket", "doc", "place")
    settled = sorted_buckets.mapInArrow(_bucket_repeats(length), "doc long, place long, more int")
    if any_hot:
        settled = settled.unionByName(_hot_repeats(with_bytes(open_spans.join(hot, "bucket", "left_semi")), length))
    return told.filter("sure").select("doc", "place", "more").unionByName(settled).select(F.col("doc").alias(key), tag, "place", "more")


def _cut(said: bytes, stretches: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """Remaining bytes, number of removed bytes and of removed runs."""
    kept, done, removed, runs, end = [], 0, 0, 0, -1
    for first, more in sorted(stretches):
        stop = first + more + length
        if first > end:
            runs += 1
            kept.append(said[done:first])
            removed += stop - first
        else:
            removed += max(0, stop - end)
        end = max(end, stop)
        done = end
    kept.append(said[done:])
    return b"".join(kept), removed, runs


def _with_stretches(docs: DataFrame, key: str, text: str, length: int, gram: int) -> DataFrame:
    """``docs`` with the repeated stretches of each text in the column ``_stretches``, null if it has none."""
    known = _known(docs, key, text)
    first = F.col("place").bitwiseAND(F.lit((1 << 48) - 1)).alias("first")
    stretches = repeats(known, key, text, length, gram).groupBy(key, "_tag").agg(F.collect_list(F.struct(first, "more")).alias("_stretches"))
    # Both joins read the same shuffled documents.
    found = known.hint("merge").join(stretches, [key, "_tag"], "left").drop("_tag")
    nameless = docs.filter(F.col(key).isNull()).withColumn("_stretches", F.lit(None).cast(stretches.schema["_stretches"].dataType))
    return found.unionByName(nameless)


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the columns ``kept`` (remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``."""

    @F.pandas_udf("kept binary, n_bytes long, n_removed long, n_spans long")
    def cut(text: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for value, some in zip(text, found, strict=True):
            said = (value or "").encode("utf-8")
            kept, gone, runs = _cut(said, [(s["first"], s["more"]) for s in some], length) if some is not None else (said, 0, 0)
            rows.append((kept, len(said), gone, runs))
        return pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans"])

    rows = _with_stretches(docs, key, text, length, gram)
    return rows.withColumn("_cut", cut(F.col(text).cast("string"), "_stretches")).select(*docs.columns, "_cut.*")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document the counts and a digest of the remaining bytes."""
    return removed(docs.select(key, text), key, text, length).select(
        F.col(key).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of the text; halves of a character at a cut go too."""

    # One step of Python: a second one behind it would take a worker more for each task.
    @F.pandas_udf("string")
    def remaining(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series(
            [None if some is None else _cut((value or "").encode("utf-8"), [(s["first"], s["more"]) for s in some], length)[0].decode("utf-8", "ignore") for value, some in zip(text, found, strict=True)],
            dtype=object,
        )

    rows = _with_stretches(docs, key, text, length, GRAM)
    changed = F.coalesce(remaining(F.col(text).cast("string"), "_stretches"), F.col(text))
    return rows.withColumn(text, changed).select(*docs.columns)


def brute(texts: dict[int, bytes], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all strings, for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(texts):
        said = texts[doc]
        gone = np.zeros(len(said) + 1, bool)
        for k in range(len(said) - length + 1):
            if said[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(said[k : k + length])
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(said) else 0
        kept = bytes(b for b, g in zip(said, gone, strict=False) if not g)
        out[doc] = (len(said), int(gone.sum()), runs, sha256(kept).hexdigest())
    return out
