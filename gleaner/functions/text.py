"""Text expressions, Column to Column, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.plans import signatures as S

#: Entities that become characters; the ampersand comes last, so that no second round happens.
ENTITIES = {"&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&middot;": "·", "&bull;": "•", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&euro;": "€", "&pound;": "£", "&times;": "×", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
_DROPPED = ("title", "script", "style", "svg", "noscript", "template")
_BREAKS = "br|/p|/div|/li|/h[1-6]|/tr|/section|/article|/header|/footer|/td|/th|/dt|/dd"


def unescape(c: Column) -> Column:
    """The named entities above; others stay as they are."""
    for entity, character in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(character))
    return c


def html_to_text(html: Column) -> Column:
    """Readable lines of a page: hidden blocks dropped, block ends as line ends, tags as spaces, no empty lines."""
    c = F.regexp_replace(html, r"(?is)<(" + "|".join(_DROPPED) + r")\b.*?</\1>", " ")
    c = F.regexp_replace(c, rf"(?i)<({_BREAKS})\b[^>]*>", "\n")
    c = F.regexp_replace(unescape(F.regexp_replace(c, "<[^>]+>", " ")), r"[ \t\r\f\x0b]+", " ")
    return F.array_join(F.filter(F.transform(F.split(c, "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def html_title(html: Column) -> Column:
    """The first title, white space collapsed; null without one."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), F.trim(unescape(F.regexp_replace(found, r"\s+", " "))))


def looks_like_html(c: Column) -> Column:
    return F.lower(F.substring(F.ltrim(c), 1, 15)).rlike("^(<!doctype|<html)")


def lines(c: Column) -> Column:
    """All lines, also a last empty one."""
    return F.split(c, "\n", -1)


def text_lines(c: Column) -> Column:
    """Lines without their ends of any kind; no empty one after the last end."""
    return F.when(c == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.regexp_replace(c, r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r", -1))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal(c: Column) -> Column:
    """Key of a line for comparison: white space collapsed, lower case."""
    return F.lower(collapse(c))


def fold(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def snippet(c: Column, limit: int = 160) -> Column:
    c = F.trim(c)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 3), F.lit("...")))


def mask(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 4), F.lit("... ("), F.length(c).cast("string"), F.lit(" chars)"))


def slug(url: Column) -> Column:
    """A file name for a saved answer."""
    return F.concat(F.substring(F.regexp_replace(F.regexp_replace(url, r"^.*?://", ""), r"[^A-Za-z0-9._-]+", "_"), 1, 180), F.lit(".json"))


def page_slug(url: Column) -> Column:
    """A file name for a captured page."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z]+://", ""), r"/+$", "")
    name = F.substring(F.regexp_replace(bare, r"[^A-Za-z0-9._-]+", "_"), 1, 120)
    return F.when(name == "", F.lit("page")).otherwise(name)


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8000."""
    return F.locate("\0", F.decode(F.substring(content, 1, 8000), "ISO-8859-1")) > 0


def decoded(content: Column, limit: int | None = None) -> Column:
    """Bytes, cut at limit, as text."""
    return F.decode(F.substring(content, 1, limit) if limit else content, "UTF-8")


def line_count(c: Column) -> Column:
    """Line ends, and one for a last line without."""
    ends = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return (ends + F.when((c != "") & ~c.endswith("\n"), 1).otherwise(0)).cast("long")


def non_blank_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\r\n|\n|\r", -1), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")).cast("long")


def heading_key(title: Column) -> Column:
    """Heading without link targets, emphasis marks and a section number."""
    plain = F.regexp_replace(F.regexp_replace(title, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`]", "")
    return F.regexp_replace(normal(plain), r"^(?:§\s*)?\d+(?:\.\d+)*\.?\s+", "")


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"https?://([A-Za-z0-9.-]+\.[A-Za-z]{2,})(?::\d+)?", 1)), r"\.+$", "")


def hosts_in(c: Column) -> Column:
    """Hosts of all URLs in a text."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"https?://([A-Za-z0-9.-]+\.[A-Za-z]{2,})(?::\d+)?"), 1), lambda h: F.regexp_replace(F.lower(h), r"\.+$", ""))


def is_ignored_host(host: Column) -> Column:
    """Ends with an ignored host, without a dot in between being asked for."""
    return F.exists(F.array(*[F.lit(h) for h in S.IGNORE_HOSTS]), lambda h: host.endswith(h))
