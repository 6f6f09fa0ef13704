"""Pages: captures, hosts, prices and groups of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.numbers import to_number
from gleaner.functions.text import host_of, html_title, html_to_text, is_ignored_host, looks_like_html
from gleaner.plans import signatures as S

# How amounts and units are written.
NUMBER = r"(?:\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
PRICE = rf"(?:US\$|\$|€|£|\b(?:USD|EUR|GBP)\s?){NUMBER}|{NUMBER}\s?(?:€|£|\b(?:USD|EUR|GBP)\b)"
UNIT = r"(?i)(?:/\s?|\bper\s|\ba\s|\beach\s)(month|mo|year|yr|annum|seat|user|person|member|workspace|hour|minute|GB|TB|request|credit|agent|bot|computer|machine|day)s?\b"
LOW_TEXT = 300


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, body): pages as text; what is no HTML stays as it is."""
    c = F.col(html)
    return pages.select(key, html_title(c).alias("title"), F.when(looks_like_html(c), html_to_text(c)).otherwise(c).alias("body"), c.alias("html"))


def capture_facts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Title, characters and lines of the text, bytes and SHA-256 of the page, and whether the text is suspiciously short."""
    rows = page_text(pages, key)
    return rows.select(
        key,
        "title",
        F.length("body").cast("long").alias("text_chars"),
        F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n", -1))).cast("long").alias("lines"),
        F.octet_length("html").cast("long").alias("bytes"),
        F.sha2("html", 256).alias("sha256"),
        (F.length("body") < LOW_TEXT).alias("low_text"),
    )


def hosts(pages: DataFrame, url: str = "url", unit: str = "page_id") -> DataFrame:
    """(host, pages, example, telemetry): hosts of URLs without the ignored ones; the first page as an example.

    The owner of a telemetry host is found by an equi-join of the host's own suffixes.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), unit).where("host <> ''").where(~is_ignored_host(F.col("host")))
    per = rows.groupBy("host").agg(F.countDistinct(unit).alias("pages"), F.min(unit).alias("example"))
    return with_owner(per)


def with_owner(per: DataFrame) -> DataFrame:
    known = [(h, i, name) for i, (h, name) in enumerate((h, name) for name, _, _, hs, _ in S.TELEMETRY for h in hs)]
    table = per.sparkSession.createDataFrame(known, "suffix string, ord int, owner string")
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    # As many rows as the library knows hosts.
    owner = per.select("host", F.explode(ends).alias("suffix")).join(F.broadcast(table), "suffix").groupBy("host").agg(F.min_by("owner", "ord").alias("telemetry"))
    return per.join(owner, "host", "left")


def ordered_hosts(rows: DataFrame, cap: int = 60) -> DataFrame:
    """Telemetry hosts, and of the others the cap most frequent (0: all). A top-k report."""
    other = rows.where("telemetry IS NULL").orderBy(F.desc("pages"), "host")
    return rows.where("telemetry IS NOT NULL").unionByName(other.limit(cap) if cap else other)


def amounts(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep, currency, amount): every price in a line."""
    rows = lines.select(*keep, F.explode(F.regexp_extract_all("text", F.lit(PRICE), 0)).alias("m"))
    number = F.regexp_extract("m", NUMBER, 0)
    currency = F.when(F.col("m").rlike(r"^(US\$|\$|USD)|USD$"), "USD").when(F.col("m").rlike("^(€|EUR)|(€|EUR)$"), "EUR").otherwise("GBP")
    return rows.select(*keep, currency.alias("currency"), to_number(number).alias("amount"))


def price_range(lines: DataFrame, page: str) -> DataFrame:
    return amounts(lines, page).groupBy(page, "currency").agg(F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"), F.count("*").alias("amounts"))


def units(lines: DataFrame, *keep: str) -> DataFrame:
    """Distinct units of a price line, in order, in lower case."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(UNIT), 1), lambda x: F.lower(x))))
    return lines.where(F.col("text").rlike(PRICE)).select(*keep, F.array_join(found, ",").alias("units"))


def on_domains(host, domains: list[str]):
    """The host is one of the domains or below one."""
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
