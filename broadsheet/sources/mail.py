"""Landed mail (RFC 822 text) to raw articles."""

from __future__ import annotations

import email
import re
from email import policy
from email.message import Message

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions import dates, textclean
from broadsheet.sources import markup

# Tags whose text is skipped (those that have no end hold none) and the anchor texts of a browser link.
SKIPPED_TAGS = frozenset(("style", "script", "head", "title"))
BROWSER_PHRASES = (
    "view in browser", "view online", "read online", "read in browser",
    "view this email in your browser", "view this post in your browser", "open in browser",
    "view on web", "read on the web", "read on substack", "read on ghost", "view on substack",
)

_FIELDS = ["subject", "sender", "date", "body", "browser_url"]
_MAIL = "struct<" + ",".join(f"{f}:string" for f in _FIELDS) + ">"


def html_mail_text(source: str, pick: str = "last") -> tuple[str, str | None]:
    """Text runs joined by a space, and the address behind a view-in-browser anchor."""
    runs: list[str] = []
    links: list[str] = []
    # Nodes still to read, each with the address it stands under and whether it shows.
    waiting = [(markup.tree(source), None, True)]
    while waiting:
        node, href, shown = waiting.pop()
        if isinstance(node, markup.Element):
            if node.tag == "a":
                href = node.attrs.get("href")
            # A head that is never closed ends where the body begins.
            shown = node.tag == "body" or (shown and node.tag not in SKIPPED_TAGS)
            waiting += [(child, href, shown) for child in reversed(node.children)]
        elif shown and (run := node.strip()):
            runs.append(run)
            if href and any(phrase in run.lower() for phrase in BROWSER_PHRASES):
                links.append(href)
    return " ".join(runs), (links[0 if pick == "first" else -1] if links else None)


def decoded_header(value: str | None) -> str:
    """Unfolded header with its RFC 2047 words decoded."""
    if not value:
        return ""
    try:
        return str(policy.default.header_fetch_parse("subject", str(value)))
    except (LookupError, ValueError):
        return str(value)


def _part_text(part: Message) -> str:
    payload = part.get_payload(decode=True) or b""
    try:
        return payload.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def read_mail(raw: str | bytes, prefer: str, pick: str) -> tuple:
    message = email.message_from_bytes(raw if isinstance(raw, bytes) else raw.encode("utf-8", "surrogateescape"))
    parts = [p for p in message.walk() if p.get_content_disposition() != "attachment"]
    plain = [p for p in parts if p.get_content_type() == "text/plain"]
    marked = [p for p in parts if p.get_content_type() == "text/html"]
    # The HTML-first rule takes the last part of a kind, the plain-first rule the first.
    at = -1 if prefer == "html" else 0
    order = (marked, plain) if prefer == "html" else (plain, marked)
    chosen = next((group[at] for group in order if group), None)
    body, url = "", None
    if chosen is None:
        whole = raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw
        body = re.split(r"\r?\n\r?\n", whole, maxsplit=1)[-1]
    elif chosen.get_content_type() == "text/html":
        body, url = html_mail_text(_part_text(chosen), pick)
    else:
        body = _part_text(chosen)
    return decoded_header(message["subject"]), decoded_header(message["from"]), message["date"], body, url


def mail_parts(raw: Column, prefer: str = "html", pick: str = "last") -> Column:
    @F.pandas_udf(_MAIL)
    def read(mails: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_mail(m or "", prefer, pick) for m in mails], columns=_FIELDS)

    # Kept from being repeated inside pushed-down filters.
    return read.asNondeterministic()(raw)


def mail_articles(mails: DataFrame, prefer: str = "html", pick: str = "last") -> DataFrame:
    """Mails (uid, content as bytes or text) to raw articles."""
    if prefer not in ("html", "plain") or pick not in ("last", "first"):
        raise ValueError("prefer is 'html' or 'plain', pick is 'last' or 'first'")
    rows = mails.withColumn("m", mail_parts(F.col("content"), prefer, pick))
    sender = F.coalesce(F.nullif(F.col("m.sender"), F.lit("")), F.lit("Unknown Sender"))
    body = textclean.drop_mime_header_lines(textclean.drop_invisible(F.col("m.body")))
    return rows.select(
        F.col("uid"),
        dates.parse_date(F.col("m.date")).alias("datetime"),
        textclean.sender_publisher(sender).alias("source"),
        textclean.sender_address(sender).alias("sender"),
        F.col("m.subject").alias("title"),
        F.col("m.browser_url").alias("url"),
        textclean.squish_ends(body).alias("body"),
        F.lit("email").alias("platform"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("raw_source"),
        F.lit(None).cast("string").alias("image_url"),
    )
