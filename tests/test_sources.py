import datetime

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import dates, repetition, textclean
from broadsheet.schemas import RAW_ARTICLE
from broadsheet.sources import fediverse, feeds, landing, mail, markup, pages, telegram

MAIL = """From: =?utf-8?Q?Caf=C3=A9_News?= <desk@cafe.example>
Subject: =?utf-8?B?SMOpbGxv?=
 =?utf-8?Q?_w=C3=B6rld?=
Date: Thu, 21 May 2026 12:30:00 +0200 (SAST)
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="cut"

--cut
Content-Type: text/plain; charset=utf-8
Content-Transfer-Encoding: quoted-printable

first =C3=A9 plain
--cut
Content-Type: text/html; charset=utf-8
Content-Transfer-Encoding: 8bit

<html><head><meta charset="x"><title>no</title></head><body><p>Hi &amp; bye</p>
<a href="https://one.example">View online</a><a href="https://two.example">please View In Browser now</a></body></html>
--cut
Content-Type: text/plain; charset=utf-8

second plain
--cut
Content-Type: text/html
Content-Disposition: attachment; filename="x.html"

<p>attached</p>
--cut--
"""


def _mail(spark, content, **options):
    frame = spark.createDataFrame([("7", content)], "uid string, content string")
    return mail.mail_articles(frame, **options).first()


def test_mail_html_first_takes_last_part_and_link(spark):
    row = _mail(spark, MAIL)
    assert (row.title, row.source, row.sender) == ("Héllo wörld", "Café News", "desk@cafe.example")
    assert row.datetime == datetime.datetime(2026, 5, 21, 10, 30)
    assert row.body == "Hi & bye View online please View In Browser now" and row.url == "https://two.example"


def test_mail_plain_first_takes_first_part(spark):
    row = _mail(spark, MAIL, prefer="plain", pick="first")
    assert row.body == "first é plain" and row.url is None


def test_mail_without_structure(spark):
    row = _mail(spark, "Subject: s\n\nContent-Type: text/html\nbody text\n")
    assert (row.body, row.sender, row.source, row.datetime) == ("body text", "Unknown Sender", "Unknown Sender", None)


def test_mail_files_land_as_rows(spark, tmp_path):
    (tmp_path / "12.eml").write_text(MAIL)
    files = landing.read_payload_files(spark, str(tmp_path), "email", "inbox").withColumn("uid", landing.file_uid(F.col("path")))
    row = mail.mail_articles(files).first()
    assert row.uid == "12" and row.title == "Héllo wörld"
    assert mail.mail_articles(files).columns == RAW_ARTICLE.names


RSS = """<?xml version="1.0"?><rss><channel><title>C</title>
<item><title> One </title><link>https://f.example/@u/1</link><pubDate>Thu, 21 May 2026 12:30:00 +0200</pubDate>
<description>&lt;p&gt;Read &lt;a href="https://m.example/tags/x"&gt;#x&lt;/a&gt;
&lt;a href="https://paper.example/story"&gt;story&lt;/a&gt; &amp;amp; more&lt;/p&gt;</description></item>
<item><title></title><link>https://f.example/@u/2</link><description>only text</description></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title>
<link href="https://a.example/first"/><link rel="alternate" href="https://a.example/alt"/>
<summary>sum</summary><updated>2026-05-21T10:30:00Z</updated></entry></feed>"""


def _feeds(spark, *contents, name="source_name"):
    return spark.createDataFrame([("@u@f.example", c) for c in contents], f"{name} string, content string")


def test_rss_and_atom(spark):
    rows = {r.url: r for r in feeds.feed_articles(_feeds(spark, RSS, ATOM, "<html>nothing</html>")).collect()}
    assert set(rows) == {"https://f.example/@u/1", "https://f.example/@u/2", "https://a.example/alt"}
    one = rows["https://f.example/@u/1"]
    assert (one.title, one.body, one.datetime) == ("One", "Read #x story & more", datetime.datetime(2026, 5, 21, 10, 30))
    assert rows["https://a.example/alt"].body == "sum"
    assert rows["https://a.example/alt"].datetime == datetime.datetime(2026, 5, 21, 10, 30)


def test_mail_in_another_charset_and_broken_bytes(spark, tmp_path):
    head = b"Subject: s\r\nFrom: A <a@b.example>\r\nContent-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"
    (tmp_path / "1.eml").write_bytes(head + "caf\xe9".encode("latin-1"))
    (tmp_path / "2.eml").write_bytes(b"\xff\xfe no header")
    files = landing.read_payload_files(spark, str(tmp_path), "email", "inbox").withColumn("uid", landing.file_uid(F.col("path")))
    rows = {r.uid: r for r in mail.mail_articles(files).collect()}
    assert rows["1"].body == "caf\xe9" and len(rows) == 2


def test_feed_files_are_read_by_their_charset(spark, tmp_path):
    xml = '<?xml version="1.0" encoding="ISO-8859-1"?><rss><item><title>\xe9t\xe9</title><link>https://x.example/1</link></item></rss>'
    (tmp_path / "a.xml").write_bytes(xml.encode("latin-1"))
    (tmp_path / "b.xml").write_bytes(xml.replace("ISO-8859-1", "UTF-8").replace("/1<", "/2<").encode())
    landed = landing.read_payload_files(spark, str(tmp_path), "rss", "feed")
    assert [r.title for r in feeds.feed_articles(landed).collect()] == ["\xe9t\xe9"] * 2


def test_feed_items_without_link_or_with_html_entities(spark):
    xml = """<rss><item><title>A</title><guid>g-1</guid></item><item><title>B</title><pubDate>x</pubDate></item>
<item><title>C&nbsp;&eacute; R&D &amp; &unknown;</title><link>https://x.example/3</link><description><![CDATA[<p>&nbsp;a & b</p>]]></description></item>
<item><title>D</link></item></rss>"""
    landed = _feeds(spark, xml)
    rows = {(r.title or "")[0]: r for r in feeds.feed_articles(landed).collect()}
    assert set(rows) == {"A", "B", "C"} and len({r.uid for r in rows.values()} - {None}) == 3
    assert rows["C"].title == "C\xa0\xe9 R&D & &unknown;" and rows["C"].body == "a & b" and rows["C"].url == "https://x.example/3"
    assert [r.xml for r in feeds.unreadable_items(landed).collect()] == ["<item><title>D</link></item>"]


def test_links_are_those_of_anchors(spark):
    html = """<link href="https://l.example/x"><a class="c" href='https://a.example/1?a=1&amp;b=2'>x</a><A HREF="https://b.example">y</A><a data-href="z">"""
    assert _one(spark, html, textclean.links) == ["https://a.example/1?a=1&b=2", "https://b.example"]


def test_subscription_feed_prefers_full_content(spark):
    xml = RSS.replace("<description>only text", "<content:encoded><![CDATA[<b>full</b> &lt;x]]></content:encoded><description>only text")
    rows = {r.url: r.body for r in feeds.subscription_feed_articles(_feeds(spark, xml, "not xml <item>")).collect()}
    assert rows["https://f.example/@u/2"] == "full &lt;x" and len(rows) == 2


def test_fediverse_posts_take_linked_text(spark):
    landed = spark.createDataFrame(
        [("https://paper.example/story", "<div class='entry-content x'>Long <i>read</i></div><p>no</p>"), ("https://x.example", "<p>z</p>")],
        "url string, html string",
    )
    rows = {r.uid: r for r in fediverse.fediverse_articles(_feeds(spark, RSS, name="handle"), landed).collect()}
    linked, plain = sorted(rows.values(), key=lambda r: r.url, reverse=True)
    assert linked.url == "https://paper.example/story"
    assert linked.body == (
        "[Fediverse Update]: Read #x story & more\n\n[Scraped Article Content from https://paper.example/story]:\nLong read")
    assert (plain.title, plain.source, plain.sender) == ("Fediverse post by @u", "Fediverse: @u@f.example", "u")


def test_pages(spark):
    frame = spark.createDataFrame([
        ("u1", "<h1> Head </h1><time datetime='2026-05-21T10:30:00Z'></time><div class='a gh-content'>A<p>b<br>c</div><p>d</p>"),
        ("u2", "<p>one <b>two<p>three</p><div>x</div>"), ("u3", ""),
    ], "url string, html string")
    rows = {r.url: r for r in pages.subscription_articles(frame, F.lit("Pub")).collect()}
    assert (rows["u1"].title, rows["u1"].body) == ("Head", "Abc")
    assert rows["u1"].datetime == datetime.datetime(2026, 5, 21, 10, 30)
    assert (rows["u2"].title, rows["u2"].body) == ("Untitled Article", "one two three")
    assert rows["u3"].body == "" and pages.linked_texts(frame).count() == 2


def test_telegram(spark):
    wrap = "<div class='tgme_widget_message_wrap'>{}</div>"
    html = "".join(wrap.format(m) for m in (
        "<div class='tgme_widget_message_text'> Hello <br> there </div><a class='tgme_widget_message_date' href='https://t.me/c/1'>"
        "<time datetime='2026-05-21T12:30:00+02:00'></time></a>",
        "<a class='tgme_widget_message_photo_wrap' style=\"background-image:url('https://cdn/p.jpg')\"></a>",
        "<div>joined</div>",
    ))
    rows = telegram.channel_articles(spark.createDataFrame([("c", html)], "channel string, html string")).collect()
    text, photo = sorted(rows, key=lambda r: r.body, reverse=True)
    assert (text.body, text.url, text.datetime) == ("Hello  there".replace("  ", " "), "https://t.me/c/1", datetime.datetime(2026, 5, 21, 10, 30))
    assert (photo.body, photo.raw_source, photo.image_url) == ("", "[Photo-Only Update]", "https://cdn/p.jpg")
    assert photo.url.startswith("https://t.me/c/") and len(photo.url) == len("https://t.me/c/") + 32


def _one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, parsed", [
    ("Thu, 21 May 2026 12:30:00 +0200", datetime.datetime(2026, 5, 21, 10, 30)),
    ("Thu 21 May 2026 12:30:00 +0200", datetime.datetime(2026, 5, 21, 10, 30)),
    ("Thu, 21 May 2026 12:30:00", datetime.datetime(2026, 5, 21, 12, 30)),
    ("1 May 2026 12:30:00 -0500 (EST)", datetime.datetime(2026, 5, 1, 17, 30)),
    ("Thu, 21 May 2026 12:30:00 GMT", datetime.datetime(2026, 5, 21, 12, 30)),
    ("2026-05-21 12:30:00", datetime.datetime(2026, 5, 21, 12, 30)),
    ("2026-05-21T12:30:00Z", datetime.datetime(2026, 5, 21, 12, 30)),
    ("2026-05-21T12:30:00+05:30", datetime.datetime(2026, 5, 21, 7, 0)),
    ("2026-05-21T12:30:00.123+00:00", datetime.datetime(2026, 5, 21, 12, 30)),
    ("yesterday", None), ("", None), (None, None),
])
def test_dates(spark, raw, parsed):
    assert _one(spark, raw, dates.parse_date) == parsed


def test_html_clean_case(spark):
    html = "<p>Hello &amp; welcome to the site.&nbsp;This is a &quot;test&quot; &lt;post&gt;.</p>"
    assert _one(spark, html, textclean.clean_html) == 'Hello & welcome to the site. This is a "test" <post>.'
    assert _one(spark, None, textclean.clean_html) == ""


@pytest.mark.parametrize("url, allowed", [
    ("https://m.example/@user", False), ("https://m.example/@user/123", False), ("https://m.example/Tags/news", False),
    ("https://m.example/media/1.jpg", False), ("https://m.example/users/a", False), ("ftp://x.example/a", False),
    ("https://news.example/reports/energy-grid", True), ("https://example.com/some/article", True), (None, False),
])
def test_article_links(spark, url, allowed):
    assert _one(spark, url, textclean.is_article_link) is allowed


@pytest.mark.parametrize("handle, parts", [
    ("@u@d", ("u", "d")), ("u@d", ("u", "d")), (" @index@www.newsroom.co.za ", ("index", "www.newsroom.co.za")),
    ("invalid_handle", None), ("@a@b@c", None),
])
def test_handles(spark, handle, parts):
    got = _one(spark, handle, textclean.fediverse_handle)
    assert (tuple(got) if got else None) == parts


def test_word_cap(spark):
    long = " " + "w " * 12_001
    capped = _one(spark, long, textclean.capped_words)
    assert capped.truncated and capped.text == " ".join(["w"] * 12_000)
    kept = _one(spark, "a  b", textclean.capped_words)
    assert (kept.text, kept.truncated) == ("a  b", False)


def test_degenerate_output():
    assert repetition.is_degenerate("x" + "abc" * 9) and not repetition.is_degenerate("abc" * 8)
    assert repetition.is_degenerate("a" * 27) and not repetition.is_degenerate("a" * 26)
    assert not repetition.is_degenerate("abc\n" * 30) and repetition.is_degenerate("0123456789" * 9)


def test_markup_reader_handles_broken_pages():
    assert markup.tree("<p>a < b &amp; c<script>x<y</script").text() == "a < b & cx<y</script"
    assert markup.tree("<div class=a><p>x</div>y").find(markup.selector(".a")).text() == "x"


def test_mail_text_after_tags_without_an_end():
    assert mail.html_mail_text("<body><meta charset=utf-8><p>Hello</p>") == ("Hello", None)
    assert mail.html_mail_text("<head><title>T</title><body>Read <a href=/x>View in browser</a><style>p{}</style>.") == ("Read View in browser .", "/x")
