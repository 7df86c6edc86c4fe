"""Landed Telegram channel previews to one row per message."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions import dates, textclean
from broadsheet.sources import markup

# Class names of the preview page and the image rule.
WRAP, MESSAGE = ".tgme_widget_message_wrap", ".tgme_widget_message"
PHOTO, TEXT, STAMP = (
    ".tgme_widget_message_photo_wrap", ".tgme_widget_message_text", ".tgme_widget_message_date"
)
IMAGE_RULE = r"background-image:\s*url\(\s*['\"]?(.*?)['\"]?\s*\)"
PHOTO_ONLY = "[Photo-Only Update]"

_MESSAGES = "array<struct<text:string,style:string,published:string,link:string>>"


def messages(html: Column) -> Column:
    @F.pandas_udf(_MESSAGES)
    def read(pages: pd.Series) -> pd.Series:
        return pd.Series([_read_page(page or "") for page in pages])

    # Kept from being repeated inside pushed-down filters.
    return read.asNondeterministic()(html)


def _read_page(page: str) -> list[dict]:
    root = markup.tree(page)
    found = list(root.find_all(markup.selector(WRAP))) or list(root.find_all(markup.selector(MESSAGE)))
    rows = []
    for message in found:
        text = message.find(markup.selector(TEXT))
        photo = message.find(markup.selector(PHOTO))
        time = message.find(markup.selector("time"))
        stamp = message.find(markup.selector(STAMP))
        rows.append({
            "text": text.text() if text is not None else None,
            "style": photo.attrs.get("style") if photo is not None else None,
            "published": time.attrs.get("datetime") if time is not None else None,
            "link": stamp.attrs.get("href") if stamp is not None else None,
        })
    return rows


def channel_articles(previews: DataFrame) -> DataFrame:
    """Previews (channel, html) to raw articles; service messages are skipped."""
    rows = previews.select("channel", F.explode(messages(F.col("html"))).alias("m")).select("channel", "m.*")
    image = F.nullif(F.regexp_extract("style", IMAGE_RULE, 1), F.lit(""))
    rows = rows.withColumn("image_url", image).filter(F.col("text").isNotNull() | F.col("image_url").isNotNull())
    body = F.coalesce(textclean.squish(F.col("text")), F.lit(""))
    hashed = F.md5(F.coalesce(F.nullif(body, F.lit("")), F.col("image_url"), F.lit("")))
    link = F.coalesce(
        F.nullif(F.col("link"), F.lit("")),
        F.concat(F.lit("https://t.me/"), F.col("channel"), F.lit("/"), hashed),
    )
    return rows.withColumn("link", link).select(
        textclean.link_uid(F.col("link")).alias("uid"),
        dates.parse_date(F.col("published")).alias("datetime"),
        F.concat(F.lit("Telegram: @"), F.col("channel")).alias("source"),
        F.col("channel").alias("sender"),
        F.concat(F.lit("Telegram Post - @"), F.col("channel")).alias("title"),
        F.col("link").alias("url"),
        body.alias("body"),
        F.lit("telegram").alias("platform"),
        F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit(PHOTO_ONLY)).alias("raw_source"),
        F.col("image_url"),
    )
