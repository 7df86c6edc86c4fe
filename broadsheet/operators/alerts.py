"""Saved searches against articles: alerts, seeding and top-k per search.

Every article must be scored against every search, so the dense part is one
matrix product per Arrow batch. Articles are never shuffled: a partition sends
on one partial row per search (or k of them), and Spark merges the partials.
The searches travel to the tasks as a broadcast up to ``MAX_BROADCAST_BYTES``. A larger
set stays on the executors: articles and searches are dealt to the cells of a grid
(article blocks x search blocks), each cell is one bounded matrix product, and the
articles are still scanned once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from broadsheet.functions import dates
from broadsheet.operators.search import vector_column
from broadsheet.session import cut_lineage

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
#: Articles of one matrix product, fewer where the searches are many: a product has at most so many cells.
_ROWS_PER_PRODUCT, _CELLS = 2048, 4_000_000
_EPOCH = "1970-01-01 00:00:00"


@dataclass(frozen=True)
class _Searches:
    ids: list
    vectors: np.ndarray
    norms: np.ndarray
    thresholds: np.ndarray
    since: np.ndarray  # microseconds


def with_watermark(searches: DataFrame, articles: DataFrame, by: str = "datetime") -> DataFrame:
    """Adds ``since``: the time of each search's newest known article, else 1970."""
    known = searches.filter("latest_id is not null and latest_id != ''").select("latest_id").distinct()
    times = articles.select(F.col("uid").alias("latest_id"), F.col(by).alias("since"))
    times = times.join(known, "latest_id", "left_semi").groupBy("latest_id").agg(F.max("since").alias("since"))
    joined = searches.join(times, "latest_id", "left")
    return joined.withColumn("since", F.coalesce("since", F.lit(_EPOCH).cast("timestamp_ntz")))


def _size(searches: DataFrame) -> tuple[int, int]:
    """Number of searches and length of their vectors."""
    size = searches.agg(F.count("*"), F.max(F.size("query_vector"))).first()
    return size[0], max(1, size[1] or 1)


def _arranged(table: pa.Table) -> _Searches:
    """Searches of a table (id, query_vector, threshold, since in microseconds) as one matrix."""
    lists = table.column("query_vector").combine_chunks()
    width = len(lists[0])
    if (lists.value_lengths().to_numpy(zero_copy_only=False) != width).any():
        raise ValueError("query vectors differ in length")
    vectors = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    norms[norms == 0] = 1.0
    return _Searches(
        table.column("id").to_pylist(), vectors, norms,
        table.column("threshold").to_numpy().astype(np.float64), table.column("since").to_numpy().astype(np.int64),
    )


def _plain(searches: DataFrame) -> DataFrame:
    return searches.select("id", "query_vector", "threshold", F.unix_micros(dates.utc_instant(F.col("since"))).alias("since"))


def _scored_slices(searches: _Searches, batches: Iterator[pa.RecordBatch]):
    """(rows, microseconds, cosine matrix) of at most _ROWS_PER_PRODUCT articles."""
    width = searches.vectors.shape[1]
    step = max(1, min(_ROWS_PER_PRODUCT, _CELLS // len(searches.ids)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            vectors = part.column("vector")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            if (lengths != width).any():
                raise ValueError(f"article vector length differs from query length {width}")
            matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = (matrix @ searches.vectors.T) / (norms[:, None] * searches.norms)
            yield part, part.column("at").to_numpy(zero_copy_only=False), np.nan_to_num(scores, nan=0.0, posinf=0.0, neginf=0.0)


def _candidates(articles: DataFrame, space: str, by: str) -> DataFrame:
    vector = F.col(vector_column(space))
    return articles.filter(vector.isNotNull()).select(
        "uid", "title", F.unix_micros(dates.utc_instant(F.col(by))).alias("at"), vector.alias("vector")
    )


def _better(a: tuple | None, b: tuple) -> tuple:
    """Newest first, then most similar, then smallest uid."""
    if a is None or (b[0], b[1]) > (a[0], a[1]):
        return b
    return b if (b[0], b[1]) == (a[0], a[1]) and b[2] < a[2] else a


def _count_matches(searches: _Searches, batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    count = np.zeros(len(searches.ids), dtype=np.int64)
    newest: list[tuple | None] = [None] * len(searches.ids)
    for part, at, scores in _scored_slices(searches, batches):
        uids, titles = part.column("uid"), part.column("title")
        matching = (scores >= searches.thresholds) & (at[:, None] > searches.since)
        found = matching.sum(axis=0)
        count += found
        for s in np.flatnonzero(found):
            rows = np.flatnonzero(matching[:, s])
            last = at[rows].max()
            for r in rows[at[rows] == last]:
                option = (int(at[r]), round(float(scores[r, s]), 6), uids[r].as_py(), titles[r].as_py())
                newest[s] = _better(newest[s], option)
    hit = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([searches.ids[s] for s in hit], type=schema.field(0).type),
            pa.array(count[hit], type=pa.int64()),
            pa.array([newest[s][0] for s in hit], type=pa.int64()),
            pa.array([newest[s][1] for s in hit], type=pa.float64()),
            pa.array([newest[s][2] for s in hit], type=pa.string()),
            pa.array([newest[s][3] for s in hit], type=pa.string()),
        ],
        schema=schema,
    )


def _nearest(searches: _Searches, batches: Iterator[pa.RecordBatch], schema: pa.Schema, k: int):
    best: list[list[tuple]] = [[] for _ in searches.ids]
    worst = np.full(len(searches.ids), -np.inf)  # of the k best so far, where there are k
    for part, _, scores in _scored_slices(searches, batches):
        uids, titles, n = part.column("uid"), part.column("title"), len(scores)
        rounded = np.round(scores, 6)
        least = np.maximum(worst, np.partition(rounded, n - k, axis=0)[n - k]) if n > k else worst
        of, rows = np.nonzero((rounded >= least).T)
        for some, s in zip(np.split(rows, np.flatnonzero(np.diff(of)) + 1), np.unique(of), strict=False):
            options = best[s] + [(-rounded[r, s], uids[r].as_py(), float(scores[r, s]), titles[r].as_py()) for r in some]
            best[s] = sorted(options, key=lambda o: o[:2])[:k]
            if len(best[s]) == k:
                worst[s] = -best[s][-1][0]
    flat = [(searches.ids[s], o) for s in range(len(searches.ids)) for o in best[s]]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in flat], type=schema.field(0).type),
            pa.array([o[1] for _, o in flat], type=pa.string()),
            pa.array([o[3] for _, o in flat], type=pa.string()),
            pa.array([o[2] for _, o in flat], type=pa.float64()),
        ],
        schema=schema,
    )


def _partials(searches: DataFrame, articles: DataFrame, by: str, work, columns, max_bytes: int) -> DataFrame:
    """Partial rows of all searches, by space."""
    id_type = searches.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), *[T.StructField(n, t) for n, t in columns]])
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type.simpleString()]
    arrow_kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    arrow = pa.schema([("id", arrow_id), *[(n, arrow_kinds[t.simpleString()]) for n, t in columns]])
    # Sized first and read afterwards, so computed once.
    searches = cut_lineage(searches)
    partials = []
    for space in ("english", "multilingual"):
        in_space = searches.filter((F.col("space") == "english") == F.lit(space == "english"))
        count, width = _size(in_space)
        if not count:
            continue
        # Nothing older than the oldest watermark can match; this reaches the scan.
        oldest = in_space.agg(F.min("since")).first()[0] if work is _count_matches else None
        rows = articles if oldest is None else articles.filter(F.col(by) > F.lit(oldest.isoformat(sep=" ")).cast("timestamp_ntz"))
        candidates = _candidates(rows, space, by)
        blocks = -(-count * width * 8 // max_bytes)
        if blocks == 1:
            shared = searches.sparkSession.sparkContext.broadcast(_arranged(_plain(in_space).toArrow()))
            partials.append(candidates.mapInArrow(functools.partial(_run, work, shared, arrow), schema))
        else:
            partials.append(_in_cells(candidates, _plain(in_space), blocks, max_bytes // (4 * width), work, arrow, schema))
    if not partials:
        return searches.sparkSession.createDataFrame([], schema)
    return functools.reduce(DataFrame.unionByName, partials)


def _run(work, shared, arrow, batches):
    yield from work(shared.value, batches, arrow)


def _in_cells(articles: DataFrame, searches: DataFrame, blocks: int, per_cell: int, work, arrow: pa.Schema, schema: T.StructType) -> DataFrame:
    """Partial rows of all searches from a grid of article blocks and search blocks.

    An article goes to one cell of each search block and a search to one of each article block, so a cell
    holds about as many bytes of both as a block may have, however many there are.
    """
    slices = max(1, -(-articles.count() // max(1, per_cell)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = articles.select("*", dealt("uid", slices).alias("slice"), every(blocks).alias("block"))
    right = searches.select("*", dealt("id", blocks).alias("block"), every(slices).alias("slice"))

    def cell(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not some.num_rows or not asked.num_rows:
            return arrow.empty_table()
        return pa.Table.from_batches(list(work(_arranged(asked), some.combine_chunks().to_batches(), arrow)), arrow)

    return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(cell, schema)


def matches(searches: DataFrame, articles: DataFrame, by: str = "datetime",
            max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Per saved search with ``since``: number of newer matches and the newest one.

    ``by='datetime'`` compares publication times, strictly newer; an article
    published late stays unseen. ``by='ingested_at'`` looks at arrival instead.
    """
    columns = [("n", T.LongType()), ("at", T.LongType()), ("similarity", T.DoubleType()),
               ("uid", T.StringType()), ("title", T.StringType())]
    partial = _partials(searches, articles, by, _count_matches, columns, max_bytes)
    # One row per search and task goes in; aggregates merge before the shuffle, unlike a window.
    place = F.struct((-F.col("at")).alias("at"), (-F.col("similarity")).alias("similarity"), "uid")
    newest = partial.groupBy("id").agg(
        F.sum("n").alias("new_results_count"), F.min_by(F.struct("uid", "title", "at"), place).alias("newest")
    )
    return newest.select(
        "id", "new_results_count", F.col("newest.uid").alias("newest_uid"), F.col("newest.title").alias("newest_title"),
        dates.utc_wall(F.timestamp_micros("newest.at")).alias("newest_at"),
    )


def check_alerts(searches: DataFrame, articles: DataFrame, now: Column, by: str = "datetime"):
    """(notifications, searches with their advanced ``latest_id``) of one check."""
    found = matches(with_watermark(searches, articles, by), articles, by)
    joined = searches.join(found, "id", "left")
    notifications = joined.filter("new_results_count is not null").select(
        F.col("id").alias("search_id"), "username", "search_text", "new_results_count", "newest_title",
        now.cast("timestamp_ntz").alias("created_at"), F.lit(False).alias("is_read"),
    )
    advanced = joined.withColumn("latest_id", F.coalesce("newest_uid", "latest_id")).select(searches.columns)
    return notifications, advanced


def seed_searches(new_searches: DataFrame, articles: DataFrame) -> DataFrame:
    """``latest_id`` of freshly saved searches: their newest match, '' if none."""
    never = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    found = matches(new_searches.drop("latest_id").withColumn("since", never), articles)
    seeded = new_searches.drop("latest_id").join(found.select("id", "newest_uid"), "id", "left")
    return seeded.withColumn("latest_id", F.coalesce("newest_uid", F.lit(""))).drop("newest_uid")


def nearest_articles(searches: DataFrame, articles: DataFrame, k: int,
                     max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The k most similar articles of every search."""
    columns = [("uid", T.StringType()), ("title", T.StringType()), ("similarity", T.DoubleType())]
    since = searches.withColumn("since", F.lit(_EPOCH).cast("timestamp_ntz"))
    partial = _partials(since, articles, "datetime", functools.partial(_nearest, k=k), columns, max_bytes)
    window = Window.partitionBy("id").orderBy(F.round("similarity", 6).desc(), F.asc("uid"))
    ranked = partial.withColumn("rank", F.row_number().over(window))
    return ranked.filter(F.col("rank") <= k)
