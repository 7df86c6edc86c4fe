"""Fediverse posts, with the text of the article each one links to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from broadsheet.functions import dates, textclean
from broadsheet.session import cut_lineage
from broadsheet.sources import feeds as feed_source
from broadsheet.sources import pages as page_source


def with_linked_text(posts: DataFrame, texts: DataFrame) -> DataFrame:
    """Left join posts (target_link, body, url) to landed texts (url, text).

    Posts without a link get a key of their own that matches nothing, so they
    cannot pile up in one task.
    """
    one_text = texts.groupBy(F.col("url").alias("_key")).agg(F.min("text").alias("_linked"))
    own_key = F.concat(F.lit("no link "), F.xxhash64("body", "url").cast("string"))
    linked = posts.withColumn("_key", F.coalesce("target_link", own_key)).join(one_text, "_key", "left")
    found = F.col("_linked").isNotNull()
    augmented = F.concat(
        F.lit("[Fediverse Update]: "), F.col("body"),
        F.lit("\n\n[Scraped Article Content from "), F.col("target_link"), F.lit("]:\n"), F.col("_linked"),
    )
    return linked.withColumns({
        "body": F.when(found, augmented).otherwise(F.col("body")),
        "url": F.when(found, F.col("target_link")).otherwise(F.col("url")),
    }).drop("_key", "_linked")


def posts_with_links(feeds: DataFrame) -> DataFrame:
    rows = feed_source.feed_rows(feeds).withColumn("account", textclean.fediverse_handle(F.col("handle")))
    account = F.col("account")
    return rows.filter(account.isNotNull()).select(
        feed_source.entry_uid(F.col("handle")).alias("uid"),
        dates.parse_date(F.col("date_text")).alias("datetime"),
        F.concat(F.lit("Fediverse: @"), account["username"], F.lit("@"), account["domain"]).alias("source"),
        account["username"].alias("sender"),
        textclean.display_title(
            F.col("title"), F.concat(F.lit("Fediverse post by @"), account["username"])
        ).alias("title"),
        F.col("link").alias("url"),
        textclean.clean_html(F.col("markup")).alias("body"),
        F.lit("fediverse").alias("platform"),
        F.col("markup").alias("raw_source"),
        F.lit(None).cast("string").alias("image_url"),
        textclean.first_article_link(F.col("markup")).alias("target_link"),
    )


def fediverse_articles(feeds: DataFrame, pages: DataFrame) -> DataFrame:
    """Feeds (handle, content) and landed pages (url, html) to raw articles.

    Posts are materialised, so the feeds are parsed once; of the pages only
    those a post links to are read as HTML.
    """
    posts = cut_lineage(posts_with_links(feeds))
    wanted = posts.select(F.col("target_link").alias("url")).filter("url is not null").distinct()
    texts = page_source.linked_texts(pages.join(wanted, "url", "left_semi"))
    return with_linked_text(posts, texts).drop("target_link")
