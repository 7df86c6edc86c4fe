"""Registered text-rule and source-adapter queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import dates, repetition, textclean
from broadsheet.plans import bindings as b
from broadsheet.plans.bindings import date_text, escaped, sql_date_text, with_views
from broadsheet.session import widen
from broadsheet.sources import fediverse, feeds, mail, pages, telegram

SPACE = r"[\s\p{Z}]+"


def sql_squish(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


def sql_clean(x: str, replacements=textclean.ENTITY_REPLACEMENTS) -> str:
    text = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, plain in replacements:
        text = f"replace({text}, '{entity}', '{plain}')"
    return f"coalesce({sql_squish(text)}, '')"


def sql_escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def sql_date(x: str) -> str:
    text = f"regexp_replace(regexp_replace(trim({x}), '\\s*\\([^)]+\\)$', ''), '^[A-Za-z]{{3}},?\\s+', '')"
    return (
        f"coalesce(make_timestamp(epoch_us(try_strptime({text}, '%d %b %Y %H:%M:%S %z'))),"
        f" try_strptime({text}, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%SZ']))"
    )


def _documents(spark, sf):
    return widen(b.table(spark, sf, "documents"))


def _pages(spark, sf):
    return widen(b.table(spark, sf, "pages"))


def html_clean(spark, sf):
    return _pages(spark, sf).select("page_id", textclean.clean_html(F.col("html")).alias("text"))


def html_clean_subscription(spark, sf):
    cleaned = textclean.clean_html(F.col("html"), textclean.SUBSCRIPTION_ENTITY_REPLACEMENTS)
    return _pages(spark, sf).select("page_id", cleaned.alias("text"))


def _with_marks(text):
    """Text with zero-width marks after every 'e ' and a header line in front."""
    marked = F.replace(text, F.lit("e "), F.lit("e" + chr(0x200B) + chr(0xFEFF) + " "))
    return F.concat(F.lit("Content-Type: text/html\n  content-transfer-encoding: 8bit\n"), marked)


def invisible_and_headers(spark, sf):
    text = _with_marks(F.col("text"))
    cleaned = textclean.drop_mime_header_lines(textclean.drop_invisible(text))
    return _documents(spark, sf).select("doc_id", textclean.squish(cleaned).alias("text"))


def _sender():
    """A sender line per customer in one of four spellings."""
    key, name = F.col("c_custkey"), F.col("c_name")
    address = F.concat(F.lit("c"), key.cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
    return (
        F.when(key % 4 == 0, F.concat(F.lit('"'), name, F.lit('" <'), address, F.lit(">")))
        .when(key % 4 == 1, F.concat(F.lit("<"), address, F.lit(">")))
        .when(key % 4 == 2, address)
        .otherwise(F.concat(F.lit("<"), key.cast("string"), F.lit(">")))
    )


def sender_parts(spark, sf):
    rows = b.table(spark, sf, "customer").select("c_custkey", _sender().alias("sender"))
    return rows.select(
        "c_custkey", textclean.sender_address(F.col("sender")).alias("address"),
        textclean.sender_publisher(F.col("sender")).alias("publisher"),
    )


def date_parse(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", date_text(F.col("event_id"), F.col("ts")).alias("raw"))
    return rows.select("event_id", dates.parse_date(F.col("raw")).alias("parsed"), dates.date_failed(F.col("raw")).alias("failed"))


def uid_hashes(spark, sf):
    key = textclean.translation_key(F.col("text"), F.col("lang"), F.lit("model-a"))
    return _documents(spark, sf).select("doc_id", textclean.link_uid(F.col("text")).alias("uid"), key.alias("cache_key"))


def handle_parse(spark, sf):
    """Customer names as handles; some have one part, some three."""
    key, segment = F.col("c_custkey"), F.lower("c_mktsegment")
    handle = (
        F.when(key % 5 == 0, F.concat(F.lit(" @"), "c_name", F.lit("@"), segment))
        .when(key % 5 == 1, F.concat("c_name", F.lit("@"), segment))
        .when(key % 5 == 2, F.concat("c_name", F.lit("@"), segment, F.lit("@x")))
        .when(key % 5 == 3, F.col("c_name"))
        .otherwise(F.concat(F.lit("@index@www."), segment, F.lit(".co.za")))
    )
    parsed = textclean.fediverse_handle(handle)
    return b.table(spark, sf, "customer").select("c_custkey", parsed["username"].alias("username"), parsed["domain"].alias("domain"))


def link_extract(spark, sf):
    html = F.col("html")
    return _pages(spark, sf).select(
        "page_id", F.array_join(textclean.links(html), " ").alias("links"),
        textclean.first_article_link(F.concat(F.lit('<a href="/@me"></a> <a href="'), "url", F.lit('">x</a>'), html)).alias("first_link"),
        textclean.is_article_link(F.replace("url", F.lit("/en/"), F.lit("/Tags/"))).alias("is_article"),
    )


def display_title(spark, sf):
    title = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
    return _documents(spark, sf).select("doc_id", textclean.display_title(title, F.lit("Fediverse post by @x")).alias("title"))


def embedding_text(spark, sf):
    rows = b.articles(spark, sf, vectors=False, labels=False)
    return rows.select(
        "uid", textclean.embedding_text(F.col("summary"), F.col("topics"), F.col("themes")).alias("text"),
        textclean.analysis_prompt(F.col("title"), F.col("sender"), F.col("original_language_summary")).alias("prompt"),
    )


def list_text(spark, sf):
    split = textclean.split_list(F.col("text"))
    return _documents(spark, sf).select("doc_id", F.size(split).alias("n"), textclean.join_list(split).alias("joined"))


def degenerate_output(spark, sf):
    """Documents as responses; every tenth ends in a chunk repeated nine times."""
    tail = F.when(F.col("doc_id") % 10 == 0, F.repeat(F.lit("loop "), 9)).otherwise(F.lit(""))
    return _documents(spark, sf).select("doc_id", repetition.is_repetitive(F.concat("text", tail)).alias("is_repetitive"))


# --- adapters over payloads built from the tables ----------------------------------------


def _published():
    return F.expr(b.START) + F.make_dt_interval(mins=(F.col("doc_id") * 37 % 43200).cast("int"))


_SQL_PUBLISHED = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 37 % 43200 AS BIGINT))"
_SQL_DATED = sql_date(sql_date_text("doc_id", _SQL_PUBLISHED))
_FIRST_LINE = "split_part(text, chr(10), 1)"


def _rss(spark, sf):
    """One RSS document per text with two items, the second without title and date."""
    link = F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string"))
    body = escaped(F.concat(F.lit("<p>"), escaped(F.col("text")), F.lit("</p>")))
    content = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title><item><title> '),
        escaped(F.split_part("text", F.lit("\n"), F.lit(1))), F.lit("</title><link>"), link,
        F.lit("</link><description>"), body, F.lit("</description><pubDate>"),
        date_text(F.col("doc_id"), _published()),
        F.lit("</pubDate></item><item><link>"), link, F.lit("/2</link><summary>short</summary></item></channel></rss>"),
    )
    return _documents(spark, sf).select(F.col("source").alias("source_name"), content.alias("content"))


def rss_articles(spark, sf):
    return feeds.feed_articles(_rss(spark, sf)).drop("image_url")


def atom_articles(spark, sf):
    link = F.concat(F.lit("https://atom.example/"), F.col("doc_id").cast("string"))
    content = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:m="urn:m"><entry m:x="1"><title>'),
        escaped(F.split_part("text", F.lit("\n"), F.lit(1))),
        F.lit('</title><link rel="self" href="'), link, F.lit('/self"/><link rel="alternate" href="'), link,
        F.lit('"/><m:other>z</m:other><content type="html">'), escaped(F.col("text")), F.lit("</content><summary>s</summary><updated>"),
        date_text(F.col("doc_id"), _published()), F.lit("</updated></entry></feed>"),
    )
    rows = _documents(spark, sf).select(F.col("source").alias("source_name"), content.alias("content"))
    return feeds.feed_articles(rows).drop("image_url")


def subscription_feed(spark, sf):
    """Every seventh payload is not XML and yields nothing."""
    link = F.concat(F.lit("https://sub.example/"), F.col("doc_id").cast("string"))
    content = F.concat(
        F.when(F.col("doc_id") % 7 == 0, "Not found ").otherwise("  "),
        F.lit('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><title>'),
        escaped(F.split_part("text", F.lit("\n"), F.lit(1))), F.lit("</title><link>"), link,
        F.lit("</link><description>teaser</description><content:encoded>"), escaped(F.col("text")),
        F.lit("</content:encoded><pubDate>"), date_text(F.col("doc_id"), _published()), F.lit("</pubDate></item></channel></rss>"),
    )
    rows = _documents(spark, sf).select(F.col("source").alias("source_name"), content.alias("content"))
    return feeds.subscription_feed_articles(rows).drop("image_url")


def page_articles(spark, sf):
    found = pages.subscription_articles(_pages(spark, sf), F.lit("Publisher"))
    return found.select("uid", "title", "url", "body", "raw_source", "platform")


def linked_texts(spark, sf):
    return pages.linked_texts(_pages(spark, sf))


def _posts(spark, sf):
    """One feed per document, linking to the page of the same number if there is one."""
    rows = _documents(spark, sf).join(
        _pages(spark, sf).select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left"
    )
    markup = F.concat(
        F.lit('<p>'), escaped(F.col("text")), F.lit('</p><a href="https://x.example/@me">me</a>'),
        F.when(F.col("url").isNotNull(), F.concat(F.lit('<a href="'), "url", F.lit('">more</a>'))).otherwise(F.lit("")),
    )
    content = F.concat(
        F.lit("<rss><channel><item><title>"), escaped(F.split_part("text", F.lit("\n"), F.lit(1))),
        F.lit("</title><link>https://x.example/@me/"), F.col("doc_id").cast("string"),
        F.lit("</link><description>"), escaped(markup), F.lit("</description></item></channel></rss>"),
    )
    return rows.select(F.concat(F.lit("@"), "source", F.lit("@x.example")).alias("handle"), content.alias("content"))


def fediverse_articles(spark, sf):
    found = fediverse.fediverse_articles(_posts(spark, sf), _pages(spark, sf))
    return found.select("uid", "source", "sender", "title", "url", "body", "platform")


def linked_text_join(spark, sf):
    posts = _documents(spark, sf).select(
        "doc_id", F.col("text").alias("body"), F.concat(F.lit("https://x.example/"), "source").alias("url"),
    ).join(_pages(spark, sf).select(F.col("page_id").alias("doc_id"), F.col("url").alias("target_link")), "doc_id", "left")
    texts = _pages(spark, sf).select("url", F.col("html").alias("text"))
    return fediverse.with_linked_text(posts, texts).select("doc_id", "url", "body")


def _previews(spark, sf):
    """A channel preview per document: a text message, a photo and a service message."""
    doc = F.col("doc_id").cast("string")
    stamp = F.date_format(_published(), "yyyy-MM-dd'T'HH:mm:ss")
    wrap = '<div class="tgme_widget_message_wrap js-x"><div class="tgme_widget_message">'
    html = F.concat(
        F.lit(f'<html><body>{wrap}<div class="tgme_widget_message_text"><b></b>'), escaped(F.col("text")),
        F.lit('</div><time datetime="'), stamp, F.lit('+02:00">x</time>'),
        F.when(F.col("doc_id") % 2 == 0, F.concat(
            F.lit('<a class="tgme_widget_message_date" href="https://t.me/'), "source", F.lit("/"), doc, F.lit('">now</a>')
        )).otherwise(F.lit("")),
        F.lit(f"</div></div>{wrap}<a class='tgme_widget_message_photo_wrap' style=\"width:1px;background-image:url('https://cdn.example/"),
        doc, F.lit(f".jpg')\"></a></div></div>{wrap}<div>channel created</div></div></div></body></html>"),
    )
    return _documents(spark, sf).select(F.col("source").alias("channel"), html.alias("html"))


def telegram_extract(spark, sf):
    return telegram.channel_articles(_previews(spark, sf))


def _mails(spark, sf):
    """Every conversation turn as a mail: multipart with attachment, plain, or HTML with a browser link."""
    number = F.col("conv_id") * 100 + F.col("turn")
    encoded = lambda t: F.regexp_replace(F.base64(F.encode(t, "UTF-8")), r"\s", "")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    html = F.concat(
        F.lit("<html><head><title>skip</title><style>p{}</style></head><body><p> "), escaped(F.col("text")),
        F.lit(' </p><a href="https://mail.example/'), number.cast("string"), F.lit('">View in Browser</a></body></html>'),
    )
    head = F.concat(
        F.lit('From: "Desk '), "role", F.lit('" <'), "role", F.lit("@talk.example>\nSubject: =?utf-8?B?"), encoded(first),
        F.lit("?=\nDate: "), date_text(number, F.expr(b.START) + F.make_dt_interval(mins=number.cast("int"))), F.lit("\nMIME-Version: 1.0\n"),
    )
    part = "--cut\nContent-Type: text/{}; charset=utf-8\nContent-Transfer-Encoding: base64\n{}\n"
    multipart = F.concat(
        F.lit("Content-Type: multipart/mixed; boundary=cut\n\n" + part.format("plain", "")), encoded(F.lit("plain text")),
        F.lit("\n" + part.format("html", "")), encoded(html),
        F.lit("\n" + part.format("html", "Content-Disposition: attachment; filename=a.html\n")), encoded(F.lit("<p>attached</p>")),
        F.lit("\n--cut--\n"),
    )
    content = F.concat(
        head,
        F.when(number % 3 == 0, multipart)
        .when(number % 3 == 1, F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), encoded(F.col("text"))))
        .otherwise(F.concat(F.lit("Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), encoded(html))),
    )
    return widen(b.table(spark, sf, "conversations")).select(number.cast("string").alias("uid"), content.alias("content"))


def mail_extract(spark, sf):
    return mail.mail_articles(_mails(spark, sf)).drop("raw_source", "image_url")


_ARTICLE = r"regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"


def _sql_text(x: str) -> str:
    """Tags dropped, then the character references that occur in the pages."""
    bare = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    return f"regexp_replace(regexp_replace({bare}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


_HEADING = _sql_text(r"regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
_TAGS = r"'(?i)/tags/|/explore/|/media/|/files/|/assets/'"


def _sql_is_article(url: str) -> str:
    return (
        f"(regexp_matches({url}, '^https?://') AND NOT regexp_matches({url}, {_TAGS}) AND NOT contains({url}, '/@')"
        f" AND NOT contains({url}, '/users/') AND NOT contains({url}, '/statuses/'))"
    )


_MAIL_SQL = f"""WITH m AS (SELECT *, conv_id * 100 + turn AS number FROM conversations)
SELECT CAST(number AS VARCHAR) AS uid,
 {sql_date(sql_date_text('number', "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(number)"))} AS datetime,
 'Desk ' || role AS source, role || '@talk.example' AS sender, {_FIRST_LINE} AS title,
 CASE WHEN number % 3 <> 1 THEN 'https://mail.example/' || number END AS url,
 CASE WHEN number % 3 = 1 THEN {sql_strip('text')} ELSE {sql_strip('text')} || ' View in Browser' END AS body,
 'email' AS platform FROM m"""

_LINK = "'https://news.example/' || doc_id"

QUERIES = {
    "html_clean": (html_clean, f"SELECT page_id, {sql_clean('html')} AS text FROM pages"),
    "html_clean_subscription": (html_clean_subscription,
        f"SELECT page_id, {sql_clean('html', textclean.SUBSCRIPTION_ENTITY_REPLACEMENTS)} AS text FROM pages"),
    "invisible_and_headers": (invisible_and_headers, f"""
SELECT doc_id, {sql_squish("replace(text, 'e ', 'e  ')")} AS text FROM documents"""),
    "sender_parts": (sender_parts, """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN CAST(c_custkey AS VARCHAR) ELSE address END AS address,
 CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN lower(c_mktsegment) || '.example' WHEN 2 THEN address ELSE 'Email Intake' END AS publisher
FROM (SELECT *, 'c' || c_custkey || '@' || lower(c_mktsegment) || '.example' AS address FROM customer)"""),
    "date_parse": (date_parse, f"""
SELECT event_id, p AS parsed, p IS NULL AS failed FROM (SELECT event_id, {sql_date(sql_date_text('event_id', 'ts'))} AS p FROM events)"""),
    "uid_hashes": (uid_hashes, """
SELECT doc_id, md5(text) AS uid, sha256(text || chr(1) || lang || chr(1) || 'model-a') AS cache_key FROM documents"""),
    "handle_parse": (handle_parse, """
SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) THEN c_name WHEN c_custkey % 5 = 4 THEN 'index' END AS username,
 CASE WHEN c_custkey % 5 IN (0, 1) THEN lower(c_mktsegment) WHEN c_custkey % 5 = 4 THEN 'www.' || lower(c_mktsegment) || '.co.za' END AS domain
FROM customer"""),
    "link_extract": (link_extract, f"""
SELECT page_id, array_to_string(regexp_extract_all(html, 'href="([^"]+)"', 1), ' ') AS links,
 list_filter(list_concat(['/@me', url], regexp_extract_all(html, 'href="([^"]+)"', 1)), lambda u: {_sql_is_article('u')})[1] AS first_link,
 {_sql_is_article("replace(url, '/en/', '/Tags/')")} AS is_article FROM pages"""),
    "display_title": (display_title, f"""
SELECT doc_id, CASE WHEN t = '' THEN 'Fediverse post by @x' WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS title
FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE {_FIRST_LINE} END AS t FROM documents)"""),
    "embedding_text": (embedding_text, with_views("articles", """
SELECT uid, summary || chr(10) || 'Topics: ' || array_to_string(topics, ', ') || chr(10) || 'Themes: ' || array_to_string(themes, ', ') AS text,
 'TITLE: ' || title || chr(10) || 'SENDER/SOURCE: ' || sender || chr(10) || 'CONTENT:' || chr(10) || coalesce(original_language_summary, '') AS prompt
FROM articles""")),
    "list_text": (list_text, f"""
SELECT doc_id, CAST(len(l) AS INTEGER) AS n, array_to_string(l, ', ') AS joined
FROM (SELECT doc_id, list_transform(string_split(text, ','), lambda x: {sql_strip('x')}) AS l FROM documents)"""),
    "degenerate_output": (degenerate_output, None),
    "rss_articles": (rss_articles, f"""
SELECT md5({_LINK}) AS uid, {_SQL_DATED} AS datetime, source, source AS sender, trim({_FIRST_LINE}) AS title, {_LINK} AS url,
 {sql_clean("'<p>' || " + sql_escaped('text') + " || '</p>'")} AS body, 'rss' AS platform,
 '<p>' || {sql_escaped('text')} || '</p>' AS raw_source FROM documents
UNION ALL SELECT md5({_LINK} || '/2'), NULL, source, source, NULL, {_LINK} || '/2', 'short', 'rss', 'short' FROM documents"""),
    "atom_articles": (atom_articles, f"""
SELECT md5('https://atom.example/' || doc_id) AS uid, {_SQL_DATED} AS datetime, source, source AS sender,
 trim({_FIRST_LINE}) AS title, 'https://atom.example/' || doc_id AS url, {sql_clean('text')} AS body, 'rss' AS platform,
 text AS raw_source FROM documents"""),
    "subscription_feed": (subscription_feed, f"""
SELECT md5('https://sub.example/' || doc_id) AS uid, {_SQL_DATED} AS datetime, source, source AS sender,
 trim({_FIRST_LINE}) AS title, 'https://sub.example/' || doc_id AS url,
 {sql_clean('text', textclean.SUBSCRIPTION_ENTITY_REPLACEMENTS)} AS body, 'subscription' AS platform, text AS raw_source
FROM documents WHERE doc_id % 7 <> 0"""),
    "page_articles": (page_articles, f"""
SELECT md5(url) AS uid, CASE WHEN {_HEADING} = '' THEN 'Untitled Article' ELSE {sql_strip(_HEADING)} END AS title, url,
 {sql_squish(_sql_text(_ARTICLE))} AS body, html AS raw_source, 'subscription' AS platform FROM pages"""),
    "linked_texts": (linked_texts, f"""
SELECT * FROM (SELECT url, {sql_squish(_sql_text(_ARTICLE))} AS text FROM pages) WHERE text <> ''"""),
    "fediverse_articles": (fediverse_articles, f"""
WITH posts AS (SELECT d.*, p.url AS target, {sql_squish(_sql_text(_ARTICLE))} AS linked,
  '<p>' || {sql_escaped('text')} || '</p><a href="https://x.example/@me">me</a>'
   || coalesce('<a href="' || p.url || '">more</a>', '') AS markup
 FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id),
cleaned AS (SELECT *, {sql_clean('markup')} AS clean, coalesce(linked, '') <> '' AS found FROM posts)
SELECT md5('https://x.example/@me/' || doc_id) AS uid, 'Fediverse: @' || source || '@x.example' AS source, source AS sender,
 CASE WHEN t = '' THEN 'Fediverse post by @' || source WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS title,
 CASE WHEN found THEN target ELSE 'https://x.example/@me/' || doc_id END AS url,
 CASE WHEN found THEN '[Fediverse Update]: ' || clean || chr(10) || chr(10) || '[Scraped Article Content from ' || target || ']:' || chr(10) || linked
  ELSE clean END AS body, 'fediverse' AS platform
FROM (SELECT *, trim({_FIRST_LINE}) AS t FROM cleaned)"""),
    "linked_text_join": (linked_text_join, """
SELECT d.doc_id, CASE WHEN p.html IS NOT NULL THEN p.url ELSE 'https://x.example/' || source END AS url,
 CASE WHEN p.html IS NOT NULL THEN '[Fediverse Update]: ' || text || chr(10) || chr(10) || '[Scraped Article Content from ' || p.url || ']:' || chr(10) || html
  ELSE text END AS body FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id"""),
    "telegram_extract": (telegram_extract, f"""
WITH m AS (
 SELECT source, {sql_squish('text')} AS body, text AS raw_source, CAST(NULL AS VARCHAR) AS image_url,
  {_SQL_PUBLISHED} - INTERVAL 2 HOUR AS datetime,
  CASE WHEN doc_id % 2 = 0 THEN 'https://t.me/' || source || '/' || doc_id
   ELSE 'https://t.me/' || source || '/' || md5({sql_squish('text')}) END AS url FROM documents
 UNION ALL
 SELECT source, '', '[Photo-Only Update]', 'https://cdn.example/' || doc_id || '.jpg', NULL,
  'https://t.me/' || source || '/' || md5('https://cdn.example/' || doc_id || '.jpg') FROM documents)
SELECT md5(url) AS uid, datetime, 'Telegram: @' || source AS source, source AS sender, 'Telegram Post - @' || source AS title,
 url, body, 'telegram' AS platform, raw_source, image_url FROM m"""),
    "mail_extract": (mail_extract, _MAIL_SQL),
}
