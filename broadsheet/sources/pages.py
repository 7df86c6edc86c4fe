"""Landed web pages to article text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions import dates, textclean
from broadsheet.sources import markup

# Containers that hold the article text.
SUBSCRIPTION_CONTAINERS = (".available-content-body", ".gh-content", ".post-content", "article")
LINKED_CONTAINERS = ("article", ".post-content", ".article-content", ".entry-content")
UNTITLED = "Untitled Article"

_PARTS = "struct<title:string,container:string,paragraphs:string,published:string>"


def page_parts(html: Column, containers: tuple[str, ...]) -> Column:
    """First heading, first container text, all paragraphs and the first time stamp."""

    @F.pandas_udf(_PARTS)
    def parts(pages: pd.Series) -> pd.DataFrame:
        is_container = markup.selector(*containers)
        rows = []
        for page in pages:
            root = markup.tree(page or "")
            heading = root.find(markup.selector("h1"))
            body = root.find(is_container)
            time = root.find(markup.selector("time"))
            paragraphs = None
            if body is None:
                found = [p.text() for p in root.find_all(markup.selector("p"))]
                paragraphs = "\n\n".join(found)
            rows.append((
                heading.text() if heading is not None else None,
                body.text() if body is not None else None,
                paragraphs,
                time.attrs.get("datetime") if time is not None else None,
            ))
        return pd.DataFrame(rows, columns=["title", "container", "paragraphs", "published"])

    # Kept from being repeated inside pushed-down filters.
    return parts.asNondeterministic()(html)


def _text(parts: Column) -> Column:
    return textclean.squish(F.coalesce(parts["container"], parts["paragraphs"]))


def subscription_articles(pages: DataFrame, publisher: Column, containers=SUBSCRIPTION_CONTAINERS) -> DataFrame:
    """Pages (url, html) to raw articles."""
    found = pages.withColumn("publisher", publisher).withColumn("parts", page_parts(F.col("html"), containers))
    parts = F.col("parts")
    published = F.when(parts["published"].rlike(r"^\d{4}-\d{2}-\d{2}$"),
                       F.concat(parts["published"], F.lit(" 00:00:00"))).otherwise(parts["published"])
    title = F.when(F.coalesce(parts["title"], F.lit("")) == "", F.lit(UNTITLED))
    return found.select(
        textclean.link_uid(F.col("url")).alias("uid"),
        dates.parse_date(published).alias("datetime"),
        F.col("publisher").alias("source"),
        F.col("publisher").alias("sender"),
        title.otherwise(textclean.squish_ends(parts["title"])).alias("title"),
        F.col("url"),
        _text(parts).alias("body"),
        F.lit("subscription").alias("platform"),
        F.col("html").alias("raw_source"),
        F.lit(None).cast("string").alias("image_url"),
    )


def linked_texts(pages: DataFrame, containers=LINKED_CONTAINERS) -> DataFrame:
    """(url, text) of landed pages that have any text."""
    parts = page_parts(F.col("html"), containers)
    texts = pages.select("url", parts.alias("parts")).select("url", _text(F.col("parts")).alias("text"))
    return texts.filter(F.col("text") != "")
