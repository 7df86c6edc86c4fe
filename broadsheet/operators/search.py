"""Semantic and keyword search over the article table."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions import keyword, textclean, vectors
from broadsheet.session import cut_lineage

# Fixed values of the search page.
PAGE_SIZE = 20
MAX_LIMIT = 10_000
MAIL_TYPES = ("email", "gmail", "imap")
RESULT_COLUMNS = (
    "uid", "datetime", "source", "sender", "title", "url", "summary",
    "original_language_summary", "detected_language", "content_type",
    "topics", "themes", "keywords",
)


@dataclass(frozen=True)
class SearchRequest:
    """One search: give ``query_vector`` for semantic or ``text`` for keyword search."""

    query_vector: Sequence[float] | None = None
    text: str | None = None
    space: str = "english"
    content_type: str | None = None
    sort_by: str = "similarity"
    start_date: str | None = None
    end_date: str | None = None
    end_inclusive_day: bool = False
    language: str | None = None
    threshold: float = 0.0
    limit: int = PAGE_SIZE
    offset: int = 0

    def __post_init__(self):
        if (self.query_vector is None) == (self.text is None):
            raise ValueError("give either query_vector or text")
        if self.space not in ("english", "multilingual"):
            raise ValueError("space is 'english' or 'multilingual'")
        if self.sort_by not in ("similarity", "date"):
            raise ValueError("sort_by is 'similarity' or 'date'")
        if not 1 <= self.limit <= MAX_LIMIT or self.offset < 0 or not 0 <= self.threshold <= 1:
            raise ValueError("limit, offset or threshold out of range")

    @property
    def is_keyword(self) -> bool:
        return self.text is not None


def vector_column(space: str) -> str:
    return "english_embedding" if space == "english" else "multilingual_embedding"


def norm_column(space: str) -> str:
    return "english_norm" if space == "english" else "multilingual_norm"


def with_norms(articles: DataFrame) -> DataFrame:
    """Adds the stored vector norms, which halve the work of every later search."""
    return articles.withColumns(
        {norm_column(s): vectors.norm(F.col(vector_column(s))) for s in ("english", "multilingual")}
    )


def similarity(request: SearchRequest, columns: Sequence[str] = ()) -> Column:
    """Score of a row; ``columns`` tells whether the table stores norms."""
    if request.is_keyword:
        return F.lit(1.0)
    name = norm_column(request.space)
    stored = F.col(name) if name in columns else None
    return vectors.batch_cosine_to(F.col(vector_column(request.space)), request.query_vector, stored)


def content_types(requested: str | None) -> list[str]:
    names = [t.strip().lower() for t in (requested or "").split(",")]
    names = [t for t in names if t]
    return [] if "all" in names else names


def predicates(request: SearchRequest, columns: Sequence[str] = ()) -> list[Column]:
    """Cheap, pushable conditions first, text last; the threshold is for ``hits``.

    A table partitioned by ``day`` also gets the dates as partition filters.
    """
    found = [F.col(vector_column(request.space)).isNotNull()]
    kinds = content_types(request.content_type)
    if kinds:
        found.append(F.col("content_type").isin(kinds))
    if request.start_date:
        start = F.lit(request.start_date).cast("timestamp_ntz")
        found.append(F.col("datetime") >= start)
        if "day" in columns:
            found.append(F.col("day") >= F.to_date(start))
    if request.end_date:
        end = F.lit(request.end_date).cast("timestamp_ntz")
        if request.end_inclusive_day:
            found.append(F.col("datetime") < end + F.expr("INTERVAL 1 DAY"))
        else:
            # A bare date means its midnight, so the rest of that day is outside.
            found.append(F.col("datetime") <= end)
        if "day" in columns:
            found.append(F.col("day") <= F.to_date(end))
    if request.language and request.language.lower() != "all":
        found.append(F.col("detected_language") == request.language.lower())
    if request.is_keyword:
        found.append(keyword.matches(request.text, request.space))
    return found


def hits(articles: DataFrame, request: SearchRequest) -> DataFrame:
    """Every matching article with its similarity."""
    columns = articles.columns
    matching = articles.filter(functools.reduce(operator.and_, predicates(request, columns)))
    scored = matching.withColumn("similarity", similarity(request, columns))
    if request.is_keyword or request.threshold <= 0:
        return scored
    return scored.filter(F.col("similarity") >= request.threshold)


def total(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total_count"))


def timeline(found: DataFrame) -> DataFrame:
    return found.groupBy(F.to_date("datetime").alias("dt")).agg(F.count("*").alias("cnt"))


def gap_filled(days: DataFrame) -> DataFrame:
    """Every day from the first to the last one, missing days with 0."""
    ends = days.agg(F.min("dt").alias("first"), F.max("dt").alias("last"))
    spine = ends.filter("first is not null").select(F.explode(F.sequence("first", "last")).alias("dt"))
    return spine.join(days, "dt", "left").select("dt", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def _order(request: SearchRequest) -> list[Column]:
    if request.is_keyword or request.sort_by == "date":
        return [F.desc("datetime"), F.asc("uid")]
    return [F.desc("similarity"), F.asc("uid")]


def page(found: DataFrame, request: SearchRequest) -> DataFrame:
    """One result page; ties go by uid so that pages never overlap."""
    return found.orderBy(*_order(request)).offset(request.offset).limit(request.limit)


#: Digits of a similarity that order seek pages; scores of one article may differ behind them from run to run.
SEEK_DIGITS = 12


def _seek_key(request: SearchRequest) -> Column:
    by_date = request.is_keyword or request.sort_by == "date"
    return F.col("datetime") if by_date else F.round("similarity", SEEK_DIGITS)


def page_after(found: DataFrame, request: SearchRequest, cursor: tuple[object, str] | None = None) -> DataFrame:
    """The page behind ``cursor``, the first one without.

    Every page costs the same: no row before it is sorted or sent anywhere. Articles without a date come last.
    """
    rows = found.withColumn("_at", _seek_key(request))
    if cursor is not None:
        at, uid = cursor
        same_at = F.col("uid") > uid
        if at is None:
            rows = rows.filter(F.col("_at").isNull() & same_at)
        else:
            there = F.lit(at).cast(rows.schema["_at"].dataType)
            rows = rows.filter((F.col("_at") < there) | F.col("_at").isNull() | ((F.col("_at") == there) & same_at))
    return rows.orderBy(F.desc_nulls_last("_at"), F.asc("uid")).limit(request.limit).drop("_at")


def cursor_after(shown: DataFrame, request: SearchRequest) -> tuple[object, str] | None:
    """Where a (materialised) page of at most ``request.limit`` rows ends; None for an empty one."""
    last = shown.select(_seek_key(request).alias("at"), "uid").orderBy(F.desc_nulls_last("at"), F.asc("uid")).tail(1)
    return (last[0]["at"], last[0]["uid"]) if last else None


def page_numbers(totals: DataFrame, offset: int, page_size: int = PAGE_SIZE) -> DataFrame:
    last = F.greatest(F.ceil(F.col("total_count") / page_size), F.lit(1))
    return totals.select(
        "total_count",
        F.ceil(F.col("total_count") / page_size).cast("long").alias("total_pages"),
        F.lit(offset // page_size + 1).cast("long").alias("current_page"),
        F.when(F.lit(offset > 0), F.lit(max(offset - page_size, 0))).cast("long").alias("previous_offset"),
        F.when(F.col("total_count") > offset + page_size, F.lit(offset + page_size)).cast("long").alias("next_offset"),
        ((last - 1) * page_size).cast("long").alias("last_offset"),
    )


def entity_counts(entities: DataFrame) -> DataFrame:
    """Mentions per article and entity: the form that survives a hot article."""
    return entities.groupBy("uid", "canonical_name", "entity_type").agg(F.count("*").alias("mentions"))


def entity_arrays(counts: DataFrame) -> DataFrame:
    """Per article its distinct entities, sorted, each with its number of mentions."""
    entry = F.struct(
        F.concat_ws(":", "canonical_name", "entity_type").alias("label"), F.col("canonical_name").alias("name"),
        F.col("entity_type").alias("type"), "mentions",
    )
    grouped = counts.groupBy("uid").agg(F.array_sort(F.collect_list(entry)).alias("entities"))
    return grouped.withColumn(
        "entities", F.transform("entities", lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), e["mentions"].alias("mentions")))
    )


def with_entities(rows: DataFrame, entities: DataFrame, is_page: bool = True) -> DataFrame:
    """Adds ``entities`` to materialised results.

    Only their own articles are aggregated. A page has at most MAX_LIMIT
    rows, which is what bounds the broadcast of its uids; other results are joined by shuffle.
    """
    uids = rows.select("uid").distinct()
    wanted = F.broadcast(uids) if is_page else uids.hint("merge")
    arrays = entity_arrays(entity_counts(entities.join(wanted, "uid", "left_semi")))
    empty = F.array().cast("array<struct<name:string,type:string,mentions:bigint>>")
    return rows.join(arrays, "uid", "left").withColumn("entities", F.coalesce("entities", empty))


def entity_text(entities: Column) -> Column:
    """``name:type`` once per mention, joined by ';'."""
    repeated = F.transform(
        entities, lambda e: F.array_repeat(F.concat(e["name"], F.lit(":"), e["type"]), e["mentions"].cast("int"))
    )
    return F.array_join(F.flatten(repeated), ";")


def results(articles: DataFrame, entities: DataFrame, request: SearchRequest) -> DataFrame:
    """The result page as the search box shows it.

    The page is materialised once (at most MAX_LIMIT rows), as looking up its
    entities would otherwise scan and score the articles a second time.
    """
    rows = cut_lineage(_shown(page(hits(articles, request), request)))
    return with_entities(rows, entities).orderBy(*_order(request))


def every_result(articles: DataFrame, entities: DataFrame, request: SearchRequest) -> DataFrame:
    """All matching articles in the form of a result page, in no order and without limit."""
    return with_entities(cut_lineage(_shown(hits(articles, request))), entities, is_page=False)


def _shown(found: DataFrame) -> DataFrame:
    return found.select(
        *RESULT_COLUMNS,
        "similarity",
        (F.coalesce(F.col("raw_email"), F.lit("")) != "").alias("has_raw_email"),
        "flag_status",
    )


def search(articles: DataFrame, entities: DataFrame, request: SearchRequest) -> dict[str, DataFrame]:
    """The full response: total, timeline and page over the same filter."""
    found = hits(articles, request)
    days = timeline(found)
    return {
        "total": days.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_count")),
        "timeline": days.orderBy("dt"),
        "results": results(articles, entities, request),
    }


def highlighted(rows: DataFrame, query: str, columns: Sequence[str] = ("title", "summary")) -> DataFrame:
    return rows.withColumns({c: keyword.highlight(F.col(c), query) for c in columns})


def top_similar(articles: DataFrame, request: SearchRequest) -> DataFrame:
    """uid, title and similarity percent of a semantic page."""
    return page(hits(articles, request), request).select(
        "uid", "title", "similarity", textclean.similarity_percent(F.col("similarity")).alias("percent")
    )
