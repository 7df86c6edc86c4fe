"""Exports and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from broadsheet.functions import textclean
from broadsheet.operators import registry, search

# Column titles of the result export and the byte-order mark.
RESULT_TITLES = (
    "UID", "Date", "Source", "Sender", "Title", "URL", "English Summary", "Original Summary",
    "Detected Language", "Content Type", "Topics", "Themes", "Keywords",
    "Cosine Similarity Score", "Resolved Entities",
)
BOM = chr(0xFEFF)


def _export_columns() -> list[Column]:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = lambda c: F.coalesce(F.array_join(c, ";"), F.lit(""))
    columns = [text(c) for c in search.RESULT_COLUMNS[:10]]
    columns += [listed(c) for c in ("topics", "themes", "keywords")]
    columns += [F.format_string("%.4f", F.col("similarity")), search.entity_text(F.col("entities"))]
    return [c.alias(title) for c, title in zip(columns, RESULT_TITLES, strict=True)]


def result_rows(rows: DataFrame) -> DataFrame:
    """A result page (see ``search.results``) as export columns, all text."""
    return rows.select(*_export_columns())


def result_export(articles: DataFrame, entities: DataFrame, request: search.SearchRequest,
                  limit: int | None = search.MAX_LIMIT) -> DataFrame:
    """Export rows of a search, never filtered by language: the first ``limit``, or all of them for ``None``.

    All rows come unordered (see ``write_ordered_csv``); a limited export is a page in its order.
    """
    wide = {**request.__dict__, "language": None, "offset": 0}
    if limit is None:
        return result_rows(search.every_result(articles, entities, search.SearchRequest(**wide)))
    return result_rows(search.results(articles, entities, search.SearchRequest(**{**wide, "limit": limit})))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def write_single_csv(rows: DataFrame, path: str) -> None:
    """One quoted CSV file with byte-order mark; for page-sized exports only."""
    lines = rows.select(F.concat_ws(",", *[_quoted(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in rows.columns]).alias("value"))
    header = BOM + ",".join(rows.columns)
    numbered = lines.coalesce(1).withColumn("at", F.monotonically_increasing_id())
    first = rows.sparkSession.range(1).select(F.lit(header).alias("value"), F.lit(-1).cast("long").alias("at"))
    whole = first.unionByName(numbered).repartition(1).sortWithinPartitions("at")
    whole.select("value").write.mode("overwrite").text(path)


def write_ordered_csv(articles: DataFrame, entities: DataFrame, request: search.SearchRequest, path: str) -> None:
    """All results of a search, in its order, as CSV parts: their files in the order of their names are one file with one header.

    Parts are ranges of the order, so no task sees more than its own; values may hold line breaks.
    """
    wide = search.SearchRequest(**{**request.__dict__, "language": None, "offset": 0})
    rows = search.every_result(articles, entities, wide)
    keys = [F.col("similarity").alias("_similarity"), F.col("datetime").alias("_datetime"), F.col("uid").alias("_uid")]
    made = rows.select(*_export_columns(), *keys)
    quoted = [_quoted(F.coalesce(F.col(f"`{title}`"), F.lit(""))) for title in RESULT_TITLES]
    lines = made.select(F.concat_ws(",", *quoted).alias("value"), F.lit(1).alias("_part"), "_similarity", "_datetime", "_uid")
    head = BOM + ",".join(f'"{title}"' for title in RESULT_TITLES)
    header = rows.sparkSession.range(1).select(F.lit(head).alias("value"), F.lit(0).alias("_part"))
    by_date = wide.is_keyword or wide.sort_by == "date"
    order = [F.asc("_part"), F.desc("_datetime" if by_date else "_similarity"), F.asc("_uid")]
    header.unionByName(lines, allowMissingColumns=True).orderBy(*order).select("value").write.text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an export, without its header."""
    schema = ", ".join(f"`{title}` string" for title in RESULT_TITLES)
    rows = spark.read.csv(path, schema=schema, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.filter(~F.col("UID").isin(BOM + '"UID"', BOM + "UID", "UID")).na.fill("")


def registry_export(sources: DataFrame, input_by: str | None = None) -> DataFrame:
    return registry.listed(sources, include_deleted=True, input_by=input_by)


def raw_exports(articles: DataFrame) -> DataFrame:
    """Downloadable raw payloads: file name, media type and content."""
    kind = F.lower(F.coalesce(F.nullif(F.col("content_type"), F.lit("")), F.lit("email")))
    is_mail = kind.isin(*search.MAIL_TYPES)
    present = articles.filter("raw_email is not null and raw_email != ''")
    return present.select(
        "uid",
        textclean.safe_filename(F.col("title"), is_mail).alias("filename"),
        F.when(is_mail, "message/rfc822").otherwise("text/plain").alias("mime_type"),
        F.col("raw_email").alias("content"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Appends log rows (with a ``day`` column) partitioned by day."""
    rows.write.mode("append").partitionBy("day").parquet(path)


def registry_activity(changes: DataFrame) -> DataFrame:
    """Registry change log as activity rows: who did what to which source, when."""
    return changes.select("ts", F.to_date("ts").alias("day"), "actor", "action", "source_id")
