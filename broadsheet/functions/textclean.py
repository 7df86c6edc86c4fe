"""Text rules as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
ENTITY_REPLACEMENTS = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
)
SUBSCRIPTION_ENTITY_REPLACEMENTS = (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'))
INVISIBLE = r"[\x{200b}-\x{200f}\x{feff}]+"
SPACE_RUN = r"[\s\p{Z}]+"
WORD_CAP = 12_000
REJECTED_LINK_PARTS_ANY_CASE = "/tags/|/explore/|/media/|/files/|/assets/"
REJECTED_LINK_PARTS = ("/@", "/users/", "/statuses/")
TITLE_LIMIT, TITLE_KEPT, TITLE_ENDING = 80, 77, "..."


def squish(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def squish_ends(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE_RUN}|{SPACE_RUN}$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def clean_html(html: Column, replacements=ENTITY_REPLACEMENTS) -> Column:
    """Tags to spaces, the named entities decoded in order, whitespace squished."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, plain in replacements:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.coalesce(squish(text), F.lit(""))


def drop_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, " ")


def drop_mime_header_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?im)^\s*content-(type|transfer-encoding):.*$", "")


def sender_address(sender: Column) -> Column:
    bracketed = F.regexp_extract(sender, r"<([^>]+)>", 1)
    return F.when(bracketed != "", bracketed).otherwise(sender)


def sender_publisher(sender: Column) -> Column:
    """Display name, else the domain of the address, else a fixed label."""
    address = sender_address(sender)
    name = F.btrim(F.trim(F.regexp_replace(sender, r"<[^>]+>", "")), F.lit("'\""))
    domain = F.when(F.contains(address, F.lit("@")), F.split_part(address, F.lit("@"), F.lit(2)))
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(domain, F.lit("")), F.lit("Email Intake"))


def link_uid(link: Column) -> Column:
    return F.md5(link)


def translation_key(text: Column, language: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", text, language, model), 256)


def fediverse_handle(handle: Column) -> Column:
    """struct(username, domain); NULL unless there are exactly two parts."""
    parts = F.split(F.regexp_replace(F.trim(handle), "^@", ""), "@")
    ok = (F.size(parts) == 2) & (F.element_at(parts, 1) != "") & (F.element_at(parts, -1) != "")
    return F.when(
        ok,
        F.struct(F.element_at(parts, 1).alias("username"), F.element_at(parts, -1).alias("domain")),
    )


def ingest_target(platform: Column, url: Column) -> Column:
    """What an adapter fetches: the feed URL, the channel name or the handle."""
    domain = F.regexp_extract(url, r"https?://([^/]+)/.*", 1)
    handle = F.regexp_extract(url, r".*/(@.*)$", 1)
    return (
        F.when(platform == "rss", url)
        .when(platform == "telegram", F.regexp_replace(url, r"^.*/([^/]+)$", "$1"))
        .when(
            (platform == "fediverse") & url.startswith("http"),
            F.concat(F.when(handle != "", handle).otherwise(url), F.lit("@"),
                     F.when(domain != "", domain).otherwise(url)),
        )
        .when(platform == "fediverse", url)
    )


def is_article_link(url: Column) -> Column:
    """External article rather than a profile, status, tag or media address."""
    allowed = url.rlike("^https?://") & ~url.rlike(f"(?i){REJECTED_LINK_PARTS_ANY_CASE}")
    for part in REJECTED_LINK_PARTS:
        allowed = allowed & ~F.contains(url, F.lit(part))
    return F.coalesce(allowed, F.lit(False))


def links(html: Column) -> Column:
    """Addresses of the anchors in order, in either kind of quotes, with ``&amp;`` resolved."""
    quoted = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]+"|'[^']+')"""), F.lit(1))
    return F.transform(quoted, lambda q: F.replace(F.substring(q, F.lit(2), F.length(q) - 2), F.lit("&amp;"), F.lit("&")))


def first_article_link(html: Column) -> Column:
    return F.try_element_at(F.filter(links(html), is_article_link), F.lit(1))


def display_title(title: Column, fallback: Column) -> Column:
    cut = F.concat(F.substring(title, 1, TITLE_KEPT), F.lit(TITLE_ENDING))
    return (
        F.when(F.coalesce(title, F.lit("")) == "", fallback)
        .when(F.char_length(title) > TITLE_LIMIT, cut)
        .otherwise(title)
    )


def capped_words(text: Column, cap: int = WORD_CAP) -> Column:
    """struct(text, truncated): first ``cap`` words when longer, else unchanged."""
    # n words need at least 2 n - 1 characters, so most texts are never split.
    words = F.when(F.char_length(text) >= 2 * cap, F.split(squish(text), " "))
    longer = F.coalesce(F.size(words) > cap, F.lit(False))
    return F.struct(
        F.when(longer, F.array_join(F.slice(words, 1, cap), " ")).otherwise(text).alias("text"),
        longer.alias("truncated"),
    )


def embedding_text(summary: Column, topics: Column, themes: Column) -> Column:
    joined = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    return F.concat(summary, F.lit("\nTopics: "), joined(topics), F.lit("\nThemes: "), joined(themes))


def analysis_prompt(title: Column, sender: Column, content: Column) -> Column:
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit("TITLE: "), part(title), F.lit("\nSENDER/SOURCE: "), part(sender),
        F.lit("\nCONTENT:\n"), part(content),
    )


def strip_fence(response: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(response, r"^```json\s*", ""), r"\s*```$", "")


def join_list(items: Column) -> Column:
    return F.array_join(items, ", ")


def split_list(text: Column) -> Column:
    """Comma list to trimmed array; empty or NULL text gives an empty array."""
    parts = F.transform(F.split(text, ","), lambda part: squish_ends(part))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def similarity_percent(similarity: Column) -> Column:
    return F.floor(similarity * 100 + 0.5).cast("int")


def safe_filename(title: Column, is_mail: Column) -> Column:
    """Letters, digits, space, hyphen and underscore; 50 characters; extension by kind."""
    kept = F.trim(F.regexp_replace(F.coalesce(F.nullif(title, F.lit("")), F.lit("content")), r"[^\p{L}\p{N} _-]", ""))
    name = F.coalesce(F.nullif(F.substring(kept, 1, 50), F.lit("")), F.lit("download"))
    return F.concat(name, F.when(is_mail, F.lit(".eml")).otherwise(F.lit(".txt")))
