"""Landed RSS and Atom documents to raw articles."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions import dates, textclean

# Element names of the two feed formats.
_LINK = "array<struct<_VALUE:string,_href:string,_rel:string>>"
_TEXT = "struct<_VALUE:string>"
ENTRY_SCHEMA = (
    f"title array<{_TEXT}>, link {_LINK}, description array<{_TEXT}>, content array<{_TEXT}>, "
    f"summary array<{_TEXT}>, pubDate array<string>, published array<string>, updated array<string>, "
    f"encoded array<{_TEXT}>, guid array<{_TEXT}>, id array<{_TEXT}>"
)
_XML_NAMES = ("amp", "lt", "gt", "quot", "apos")


def _elements(payload: Column, name: str) -> Column:
    return F.regexp_extract_all(payload, F.lit(rf"(?s)<{name}[\s>].*?</{name}>"), F.lit(0))


def feed_entries(payload: Column, atom: bool = True) -> Column:
    """Array of entry XML: the RSS items or, when there is none, the Atom entries."""
    items = _elements(payload, "item")
    if not atom:
        return items
    return F.when(F.size(items) > 0, items).otherwise(_elements(payload, "entry"))


def _entry(xml: Column) -> Column:
    # The content module's element becomes a plain name, as a cut-out item no
    # longer carries the namespace declarations of its document.
    plain = F.regexp_replace(xml, r"(</?)content:encoded", "$1encoded")
    plain = F.regexp_replace(plain, r"<(/?)[A-Za-z0-9]+:[A-Za-z0-9_.-]+", "<$1other")
    plain = F.regexp_replace(plain, r"\s[A-Za-z0-9]+:[A-Za-z0-9_.-]+=(\"[^\"]*\"|'[^']*')", " ")
    read = _parsed(plain)
    # Only what XML can't read is looked at again, with HTML's entities resolved.
    return F.when(_is_readable(read), read).otherwise(_parsed(_without_html_entities(plain)))


def _parsed(xml: Column) -> Column:
    return F.from_xml(xml, ENTRY_SCHEMA, {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"})


def _is_readable(entry: Column) -> Column:
    fields = ("title", "link", "description", "content", "summary", "encoded", "guid", "id")
    return F.coalesce(F.coalesce(*[F.size(entry[f]) for f in fields]) > 0, F.lit(False))


def _without_html_entities(xml: Column) -> Column:
    """HTML's named entities as numbers and stray ampersands escaped, outside of CDATA."""
    codes = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, f"&#{code};")])

    def resolved(part: Column) -> Column:
        names = F.array_except(F.regexp_extract_all(part, F.lit(r"&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)), F.array(*[F.lit(n) for n in _XML_NAMES]))
        named = F.aggregate(names, part, lambda text, name: F.replace(
            text, F.concat(F.lit("&"), name, F.lit(";")), F.coalesce(F.try_element_at(codes, name), F.concat(F.lit("&amp;"), name, F.lit(";")))))
        return F.regexp_replace(named, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")

    parts = F.split(xml, r"(?=<!\[CDATA\[)|(?<=\]\]>)")
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<![CDATA["), p).otherwise(resolved(p))), "")


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _link(entry: Column) -> Column:
    text = textclean.blank_to_null(_first(entry["link"])["_VALUE"])
    alternate = _first(F.filter(entry["link"], lambda l: l["_rel"] == "alternate"))["_href"]
    return F.trim(F.coalesce(text, alternate, _first(entry["link"])["_href"]))


def _present(items: Column) -> Column:
    """Text of the first such element: empty when it has none, NULL without element."""
    return F.when(F.size(items) > 0, F.coalesce(_first(items)["_VALUE"], F.lit("")))


def _entries(feeds: DataFrame, atom: bool) -> DataFrame:
    return feeds.select(
        *[c for c in feeds.columns if c != "content"],
        F.explode(feed_entries(F.col("content"), atom)).alias("xml"),
    ).withColumn("entry", _entry(F.col("xml")))


def unreadable_items(feeds: DataFrame, atom: bool = True) -> DataFrame:
    """The dead letters of a feed: entries that can't be read as XML, with the feed's own columns."""
    return _entries(feeds, atom).filter(~_is_readable(F.col("entry"))).drop("entry")


def feed_rows(feeds: DataFrame, atom: bool = True) -> DataFrame:
    """One row per readable entry: title, link, id, markup, date text, plus the feed's own columns."""
    rows = _entries(feeds, atom).drop("xml")
    rows = rows.filter(_is_readable(F.col("entry")))
    entry = F.col("entry")
    markup = (
        F.coalesce(_present(entry["description"]), _present(entry["content"]), _present(entry["summary"]))
        if atom
        else F.coalesce(_present(entry["encoded"]), _present(entry["description"]))
    )
    date = F.coalesce(_first(entry["pubDate"]), _first(entry["published"]), _first(entry["updated"]))
    return rows.select(
        *[c for c in rows.columns if c != "entry"],
        F.trim(_first(entry["title"])["_VALUE"]).alias("title"),
        _link(entry).alias("link"),
        textclean.blank_to_null(F.trim(F.coalesce(_first(entry["guid"])["_VALUE"], _first(entry["id"])["_VALUE"]))).alias("guid"),
        markup.alias("markup"),
        (date if atom else _first(entry["pubDate"])).alias("date_text"),
    )


def entry_uid(source: Column) -> Column:
    """Hash of the link, else of the entry's own id, else of what else tells entries apart."""
    rest = F.concat_ws("\u0001", source, "title", "date_text", F.when(F.col("title").isNull(), F.col("markup")))
    return textclean.link_uid(F.coalesce(textclean.blank_to_null(F.col("link")), F.col("guid"), rest))


def feed_articles(feeds: DataFrame) -> DataFrame:
    """Feeds (source_name, content) to raw articles."""
    return _articles(feed_rows(feeds), "rss", textclean.ENTITY_REPLACEMENTS)


def subscription_feed_articles(feeds: DataFrame) -> DataFrame:
    """As above for subscription feeds: items only, full content first."""
    xml_only = feeds.filter(F.col("content").rlike(r"^\s*<"))
    return _articles(feed_rows(xml_only, atom=False), "subscription", textclean.SUBSCRIPTION_ENTITY_REPLACEMENTS)


def _articles(rows: DataFrame, platform: str, replacements) -> DataFrame:
    return rows.select(
        entry_uid(F.col("source_name")).alias("uid"),
        dates.parse_date(F.col("date_text")).alias("datetime"),
        F.col("source_name").alias("source"),
        F.col("source_name").alias("sender"),
        F.col("title"),
        F.col("link").alias("url"),
        textclean.clean_html(F.col("markup"), replacements).alias("body"),
        F.lit(platform).alias("platform"),
        F.col("markup").alias("raw_source"),
        F.lit(None).cast("string").alias("image_url"),
    )
