"""Captures, hosts, prices: S13, S15, S17, S18, P46-P49, P31, P32, P50, P51, A23, A27, A28, D02, J10, T04, X01, X02."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import numbers as N
from gleaner.functions import text as T
from gleaner.operators import pages as P
from gleaner.operators.match import signals, summary
from gleaner.operators.traction import last_page
from gleaner.plans import signatures as S
from gleaner.plans.rules import rules
from gleaner.queries import fixtures as X
from gleaner.queries.base import query, quote, string_list, table

_DROP = "|".join(f"<{t}\\b.*?</{t}>" for t in ("title", "script", "style", "svg", "noscript", "template"))
_UNESCAPED = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)" + _DROP + "', ' ', 'g'), '(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/section|/article|/header|/footer|/td|/th|/dt|/dd)\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"


def unescape_sql(c: str) -> str:
    for a, b in T.ENTITIES.items():
        c = f"replace({c}, {quote(a)}, {quote(b)})"
    return c


BODY_SQL = "array_to_string(list_filter(list_transform(string_split(regexp_replace(" + unescape_sql(_UNESCAPED) + ", '[ \\t\\r\\f\\x0b]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"
TITLE_SQL = "CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN trim(" + unescape_sql("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')") + ") END"


@query(f"""WITH b AS (SELECT page_id, html, {TITLE_SQL} AS title, {BODY_SQL} AS body FROM pages)
SELECT page_id, title, length(body)::BIGINT AS text_chars, CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END::BIGINT AS lines, strlen(html)::BIGINT AS bytes, sha256(html) AS sha256, length(body) < 300 AS low_text FROM b""")
def page_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every captured page."""
    return P.capture_facts(table(spark, sf_dir, "pages"))


@query(f"""WITH l AS (SELECT page_id, generate_subscripts(string_split({BODY_SQL}, chr(10)), 1)::BIGINT AS line, unnest(string_split({BODY_SQL}, chr(10))) AS text FROM pages)
SELECT page_id, line, text FROM l WHERE text <> ''""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered lines of every page's text."""
    rows = P.page_text(table(spark, sf_dir, "pages")).select("page_id", F.posexplode(T.lines(F.col("body"))).alias("pos", "text")).where("text <> ''")
    return rows.select("page_id", (F.col("pos") + 1).cast("long").alias("line"), "text")


_HOST_SQL = "rtrim(lower(regexp_extract(url, 'https?://([A-Za-z0-9.-]+\\.[A-Za-z]{2,})(?::\\d+)?', 1)), '.')"
_KNOWN = ", ".join(f"({quote(h)}, {i}, {quote(n)})" for i, (h, n) in enumerate((h, n) for n, _, _, hs, _ in S.TELEMETRY for h in hs))


def _hosts_sql(source: str) -> str:
    return f"""WITH h AS (SELECT {_HOST_SQL} AS host, id FROM {source}), k AS (SELECT * FROM (VALUES {_KNOWN}) t(suffix, ord, owner)),
p AS (SELECT host, count(DISTINCT id)::BIGINT AS pages, min(id) AS example FROM h WHERE host <> '' AND NOT list_bool_or(list_transform({string_list(S.IGNORE_HOSTS)}, lambda i: ends_with(host, i))) GROUP BY host)
SELECT host, pages, example, (SELECT arg_min(owner, ord) FROM k WHERE p.host = k.suffix OR ends_with(p.host, '.' || k.suffix)) AS telemetry FROM p"""


@query(_hosts_sql("(SELECT url, page_id AS id FROM pages)"))
def hosts_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of all page URLs; example.* hosts are ignored by their ends."""
    return P.hosts(table(spark, sf_dir, "pages"))


@query("SELECT regexp_extract(url, '://([^/]+)', 1) AS host, count(*)::BIGINT AS pages FROM pages GROUP BY 1")
def pages_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P49 without the ignored list: pages of each host."""
    host = F.regexp_extract("url", "://([^/]+)", 1)
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"))




@query(_hosts_sql(X.PAGE_URLS.sql()))
def telemetry_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and the telemetry product that owns them, by suffix."""
    return P.hosts(X.PAGE_URLS.df(spark, sf_dir), "url", "id")


@query(f"WITH a AS ({_hosts_sql(X.PAGE_URLS.sql())}) SELECT * FROM a WHERE telemetry IS NOT NULL UNION ALL (SELECT * FROM a WHERE telemetry IS NULL ORDER BY pages DESC, host LIMIT 1)")
def hosts_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All telemetry hosts, of the others the first by pages. A top-k report."""
    return P.ordered_hosts(P.hosts(X.PAGE_URLS.df(spark, sf_dir), "url", "id"), cap=1)


_NUMBER = "(?:\\d{1,3}(?:[.,]\\d{3})+(?:[.,]\\d{1,2})?|\\d+(?:[.,]\\d{1,2})?)"
_TO_NUMBER = "CASE WHEN regexp_matches(m, '^\\d{1,3}(?:[.,]\\d{3})+$') THEN regexp_replace(m, '[.,]', '', 'g') WHEN regexp_matches(m, '^(\\d{1,3}(?:[.,]\\d{3})*|\\d+)[.,](\\d{1,2})$') THEN regexp_replace(regexp_extract(m, '^(\\d{1,3}(?:[.,]\\d{3})*|\\d+)[.,](\\d{1,2})$', 1), '[.,]', '', 'g') || '.' || regexp_extract(m, '^(\\d{1,3}(?:[.,]\\d{3})*|\\d+)[.,](\\d{1,2})$', 2) ELSE regexp_replace(m, '[.,]', '', 'g') END::DOUBLE"


@query(f"SELECT text, {_TO_NUMBER} AS amount FROM (SELECT text, text AS m FROM {X.PART_AMOUNTS.sql()})")
def money_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands and decimals of amounts."""
    return X.PART_AMOUNTS.df(spark, sf_dir).select("text", N.to_number(F.col("text")).alias("amount"))


def _amounts_sql(source: str) -> str:
    return f"""SELECT page, line, CASE WHEN regexp_matches(p, '^(US\\$|\\$|USD)|USD$') THEN 'USD' WHEN regexp_matches(p, '^(€|EUR)|(€|EUR)$') THEN 'EUR' ELSE 'GBP' END AS currency, regexp_extract(p, '{_NUMBER}') AS m
FROM (SELECT page, line, unnest(regexp_extract_all(text, '(?:US\\$|\\$|€|£|\\b(?:USD|EUR|GBP)\\s?){_NUMBER}|{_NUMBER}\\s?(?:€|£|\\b(?:USD|EUR|GBP)\\b)')) AS p FROM {source})"""


@query(f"SELECT page, currency, min({_TO_NUMBER}) AS min_amount, max({_TO_NUMBER}) AS max_amount, count(*)::BIGINT AS amounts FROM ({_amounts_sql(X.PRICE_LINES.sql())}) GROUP BY page, currency")
def price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, greatest and number of amounts per currency."""
    return P.price_range(X.PRICE_LINES.df(spark, sf_dir), "page")


@query(f"SELECT doc_id AS page, currency, min({_TO_NUMBER}) AS min_amount, max({_TO_NUMBER}) AS max_amount, count(*)::BIGINT AS amounts FROM (SELECT page AS doc_id, currency, m FROM ({_amounts_sql('(SELECT doc_id AS page, 0 AS line, text FROM documents)')})) GROUP BY doc_id, currency")
def document_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P46 over whole documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")
    return P.price_range(docs, "page")


@query(f"""SELECT page, line, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)(?:/\\s?|\\bper\\s|\\ba\\s|\\beach\\s)(month|mo|year|yr|annum|seat|user|person|member|workspace|hour|minute|GB|TB|request|credit|agent|bot|computer|machine|day)s?\\b', 1), lambda x: lower(x)))), ',') AS units
FROM {X.PRICE_LINES.sql()} WHERE regexp_matches(text, '(?:US\\$|\\$|€|£|\\b(?:USD|EUR|GBP)\\s?){_NUMBER}|{_NUMBER}\\s?(?:€|£|\\b(?:USD|EUR|GBP)\\b)')""")
def price_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of price lines."""
    return P.units(X.PRICE_LINES.df(spark, sf_dir), "page", "line")


def _groups_sql(source: str) -> str:
    parts = [f"SELECT '{r.rule_id}' AS rule_id, {quote(r.label)} AS label, count(*) FILTER (WHERE {f'length(text) <= {r.max_line} AND ' if r.max_line else ''}regexp_matches(text, {quote(r.pattern)}))::BIGINT AS lines FROM s" for r in rules("page")]
    return f"WITH s AS (SELECT text FROM {source}) " + " UNION ALL ".join(parts)


@query(_groups_sql(X.PRICE_LINES.sql()))
def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per group of a pricing page; a line may be in several."""
    table_ = rules("page")
    found = signals(X.PRICE_LINES.df(spark, sf_dir), table_, F.col("text"), ["page"])
    return summary(found, table_, "page").select("rule_id", "label", "lines")


@query(f"""WITH b AS (SELECT query, CAST(body AS JSON) AS j FROM {X.PAGE_CAPTURES.sql()}), n AS (SELECT query, j, unnest(range(1, json_array_length(j)::BIGINT)) AS i FROM b WHERE json_array_length(j) > 1)
SELECT query, (j->(i::INT))->>0 AS timestamp, (j->(i::INT))->>1 AS original, substr((j->(i::INT))->>0, 1, 4) || '-' || substr((j->(i::INT))->>0, 5, 2) || '-' || substr((j->(i::INT))->>0, 7, 2) AS date, 'https://web.archive.org/web/' || ((j->(i::INT))->>0) || '/' || ((j->(i::INT))->>1) AS archive_url FROM n""")
def capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index answers, the first row is the header."""
    rows = X.PAGE_CAPTURES.df(spark, sf_dir).select("query", F.from_json("body", "array<array<string>>").alias("a")).where("size(a) > 1")
    rows = rows.select("query", F.element_at("a", 1).alias("h"), F.explode(F.slice("a", 2, 1_000_000)).alias("r")).select("query", F.map_from_arrays("h", "r").alias("m"))
    t, u = F.col("m")["timestamp"], F.col("m")["original"]
    return rows.select("query", t.alias("timestamp"), u.alias("original"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)).alias("date"), F.concat(F.lit("https://web.archive.org/web/"), t, F.lit("/"), u).alias("archive_url"))


@query(f"""SELECT header, nullif(regexp_extract(list_filter(string_split(header, ','), lambda x: contains(x, 'rel="last"'))[1], '[?&]page=(\\d+)', 1), '')::BIGINT AS last FROM {X.PAGE_LINKS.sql()}""")
def link_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page of a Link header."""
    return X.PAGE_LINKS.df(spark, sf_dir).select("header", last_page(F.col("header")).alias("last"))


@query("""SELECT page_id, substr(regexp_replace(regexp_replace(url, '^.*?://', ''), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 180) || '.json' AS answer_file,
CASE WHEN regexp_replace(url, '^[A-Za-z]+://', '') IN ('', '/') THEN 'page' ELSE substr(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '/+$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 120) END AS page_file, contains(url, '://') OR starts_with(url, 'git@') AS is_url FROM pages""")
def saved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of saved answers and pages."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.slug(u).alias("answer_file"), T.page_slug(u).alias("page_file"), (u.contains("://") | u.startswith("git@")).alias("is_url"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) <= 160 THEN trim(text) ELSE substr(trim(text), 1, 157) || '...' END AS snippet FROM documents")
def document_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, cut to 160 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


_OFFER_HOST = "lower(regexp_extract(text, 'https?://([A-Za-z0-9.-]+\\.[A-Za-z]{2,})', 1))"


@query(f"SELECT file, {_OFFER_HOST} AS host FROM {X.PAGE_OFFERS.sql()} WHERE {_OFFER_HOST} = 'example.org' OR ends_with({_OFFER_HOST}, '.example.org')")
def own_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers that link to an own domain or a subdomain of one."""
    host = T.host_of(F.col("text"))
    return X.PAGE_OFFERS.df(spark, sf_dir).select("file", host.alias("host")).where(P.on_domains(F.col("host"), ["example.org"]))




@query(f"SELECT tag, json_extract_string(a, '$.name') AS name, json_extract_string(a, '$.download_count')::BIGINT AS downloads FROM (SELECT tag, unnest(CAST(body AS JSON[])) AS a FROM {X.ORDER_FILES.sql()})")
def release_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested assets of releases as rows."""
    rows = X.ORDER_FILES.df(spark, sf_dir).select("tag", F.explode(F.from_json("body", "array<struct<name: string, download_count: long>>")).alias("a"))
    return rows.select("tag", "a.name", F.col("a.download_count").alias("downloads"))
