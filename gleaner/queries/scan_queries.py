"""Scans and reports over whole tables: P09, P14, P20, P23, P38, A04, A22, A24, A26, A35, D02, D09, D12, F24, F25, J18, T03, T10, T11, W11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import classify as C
from gleaner.operators import pages as P
from gleaner.operators import reports as R
from gleaner.operators import scans as N
from gleaner.plans import signatures as S
from gleaner.plans.rules import Rule, rules
from gleaner.queries import fixtures as X
from gleaner.queries.base import query, quote, string_list, table
from gleaner.queries.files import _PATH_SQL, document_files
from gleaner.queries.page_queries import BODY_SQL
from gleaner.queries.rule_queries import _secret_lines

#: Lines of code that documents end with, one each by their number, so that scans have something to find.
_CODE = [t for _, _, t in X.SIGNAL_LINES.rows] + [t for *_, t in _secret_lines().rows] + ["posthog.init(key) " + "x" * 2000]
_FILES_SQL = f"(SELECT {_PATH_SQL} AS path, text || chr(10) || {string_list(_CODE)}[1 + doc_id % {len(_CODE)}] AS text FROM documents)"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file whose last line is a line of code."""
    line = F.get(F.array(*[F.lit(t) for t in _CODE]), F.pmod("doc_id", F.lit(len(_CODE))).cast("int"))
    return document_files(spark, sf_dir).select("path", F.concat("text", F.lit("\n"), line).alias("text"))


def _lines_sql(where: str, most: int = 0) -> str:
    limit = f" WHERE length(line_text) <= {most}" if most else ""
    return f"""f AS (SELECT path, string_split(text, chr(10)) AS t FROM {_FILES_SQL} WHERE {where}), u AS (SELECT path, unnest(t) AS line_text, generate_subscripts(t, 1)::BIGINT AS line FROM f), l AS (SELECT *, lower(line_text) AS low FROM u{limit})"""


def _any_sql(table_: list[Rule], extra: str = "NULL") -> str:
    """Rows (name, path, line, text, extra) for each rule that a line fires."""
    gate = lambda r: "(" + " OR ".join(f"contains(low, {quote(k)})" for k in r.keywords) + ") AND " if r.group == "telemetry" else ""
    one = ", ".join(f"CASE WHEN {gate(r)}regexp_matches(line_text, {quote(r.pattern)}) THEN struct_pack(name := {quote(r.label)}, s := {quote(r.strength)}) END" for r in table_)
    return f"SELECT path, line, line_text, low, h.name, h.s FROM (SELECT *, unnest(list_filter([{one}], lambda x: x IS NOT NULL)) AS h FROM l)"


_TEL_SQL = f"""WITH {_lines_sql("NOT ends_with(path, '.md') AND NOT contains(path, '/tests/')", 2000)}, h AS ({_any_sql(rules("telemetry"))}),
s AS (SELECT name, path, line, max(CASE WHEN s = 'usage' OR contains(low, '://') OR contains(low, '<script') OR contains(low, 'src=') THEN 1 ELSE 0 END) AS used, min(line_text) AS t FROM h GROUP BY name, path, line)"""
_CUT = "substr(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), 1, 160)"


@query(f"{_TEL_SQL} SELECT name, place, path, line, CASE WHEN used = 1 THEN 'usage' ELSE 'mention' END AS match, {_CUT} AS text FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, line)::INT AS place FROM s) WHERE place <= 8")
def sdk_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight lines of every product, in the order of files and lines. A top-k report."""
    return N.first_hits(N.sdk_lines(code_files(spark, sf_dir)), 8)


@query(f"{_TEL_SQL}, k AS (SELECT * FROM (VALUES {', '.join(f'({quote(n)}, {quote(k)})' for n, k, *_ in S.TELEMETRY)}) t(name, kind)) SELECT s.name, k.kind, count(DISTINCT path)::BIGINT AS files, CASE WHEN max(used) = 1 THEN 'usage' ELSE 'mention only' END AS strength, count(*)::BIGINT AS hits FROM s JOIN k ON k.name = s.name GROUP BY s.name, k.kind")
def sdk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with files, strength and lines."""
    return N.sdk_summary(N.sdk_lines(code_files(spark, sf_dir)))


_MODE = "CASE WHEN contains(path, '/tests/') THEN 'test' ELSE 'scan' END"
_CODE_SQL = _lines_sql("NOT ends_with(path, '.md') AND strlen(text) <= 1000000", 2000)
_BILL = f"""WITH {_CODE_SQL}, h AS ({_any_sql(rules("billing"))}), b AS (SELECT name, path, line, {_MODE} AS mode FROM h GROUP BY name, path, line)"""


@query(f"{_BILL} SELECT name, count(*)::BIGINT AS hits, count(DISTINCT path)::BIGINT AS files FROM b WHERE mode = 'scan' GROUP BY name")
def billing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing providers with lines and files, tests apart."""
    return N.billing_summary(N.billing_lines(code_files(spark, sf_dir)))


@query(f"{_BILL} SELECT DISTINCT name, path FROM b WHERE mode = 'scan'")
def billing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of every billing provider."""
    return N.billing_files(N.billing_lines(code_files(spark, sf_dir)))


@query(f"{_BILL} SELECT name, place, path, line FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, line)::INT AS place FROM b WHERE mode = 'scan') WHERE place <= 12")
def billing_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve lines of every provider. A top-k report."""
    return N.first_hits(N.billing_lines(code_files(spark, sf_dir)).where("mode = 'scan'"), 12).select("name", "place", "path", "line")


def _gates_sql() -> str:
    parts = []
    for g in N.GATES:
        arms = " ".join(f"WHEN regexp_matches(line_text, {quote(r.pattern)}) THEN {quote(r.strength)}" for r in rules(g))
        parts.append(f"SELECT {quote(g)} AS rule_group, {_MODE} AS mode, CASE {arms} END AS strength FROM l")
    return " UNION ALL ".join(parts)


@query(f"""{_BILL}, g AS (SELECT * FROM ({_gates_sql()}) WHERE strength IS NOT NULL UNION ALL SELECT 'billing', mode, NULL FROM b), k AS (SELECT * FROM (VALUES {', '.join(f'({quote(x)})' for x in (*N.GATES, 'billing'))}) t(rule_group))
SELECT k.rule_group, count(g.mode) FILTER (WHERE mode = 'scan')::BIGINT AS hits, count(g.mode) FILTER (WHERE mode = 'scan' AND strength = 'strong')::BIGINT AS strong, count(g.mode) FILTER (WHERE mode = 'test')::BIGINT AS in_tests FROM k LEFT JOIN g ON g.rule_group = k.rule_group GROUP BY k.rule_group""")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, strong hits and hits in tests of every group."""
    files = code_files(spark, sf_dir)
    return N.gate_counts(N.gate_lines(files), N.billing_lines(files))


def _safety_sql() -> str:
    parts = [f"SELECT path, line, {quote(r.label)} AS signal, regexp_extract(line_text, {quote(r.pattern)}) AS v FROM l WHERE regexp_matches(line_text, {quote(r.pattern)})" for r in rules("safety_secret")]
    return f"WITH {_lines_sql('true')} SELECT path, line, signal, substr(v, 1, 4) || '... (' || length(v) || ' chars)' AS masked FROM ({' UNION ALL '.join(parts)})"


@query(_safety_sql())
def safety_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets that must not be published, masked."""
    return N.safety_findings(code_files(spark, sf_dir))


_PAGE = rules("page")


@query(f"""WITH l AS (SELECT page_id, string_split({BODY_SQL}, chr(10)) AS b FROM pages), n AS (SELECT page_id, list_filter(b, lambda x: trim(x) <> '') AS l FROM l)
SELECT page_id, len(l)::BIGINT AS lines, len(list_filter(l, lambda x: regexp_matches(x, {quote(P.PRICE)})))::BIGINT AS price_lines, {', '.join(f"len(list_filter(l, lambda x: regexp_matches(x, {quote(r.pattern)}){f' AND length(x) <= {r.max_line}' if r.max_line else ''}))::BIGINT AS {r.label}" for r in _PAGE)} FROM n""")
def page_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, price lines and lines of each group on every page."""
    return R.page_report(table(spark, sf_dir, "pages"))


_KIND = f"CASE WHEN contains(path, '/tests/') THEN 'tests' WHEN ends_with(path, '.md') THEN 'docs' ELSE 'source_and_other' END"  # noqa: F541


def _without_copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = document_files(spark, sf_dir)
    first = docs.groupBy("text").agg(F.min_by("path", "doc_id").alias("path"))
    return docs.select("path"), first.select("path")


@query(f"""WITH o AS (SELECT doc_id, text, {_PATH_SQL} AS path FROM documents), g AS (SELECT DISTINCT path, {_KIND} AS kind FROM o WHERE path NOT IN (SELECT arg_min(path, doc_id) FROM o GROUP BY text)),
p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path)::INT AS place, count(*) OVER (PARTITION BY kind)::BIGINT AS total FROM g) SELECT kind, place, path, total FROM p WHERE place <= 50""")
def removal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing exact copies deletes, by kind, the first 50 paths of each beside their total. A top-k report."""
    old, new = _without_copies(spark, sf_dir)
    return R.deleted_lists(old, new).select("kind", "place", "path", "total")


@query(f"""WITH o AS (SELECT {_PATH_SQL} AS path FROM documents UNION ALL SELECT source || '/README.md' FROM documents), d AS (SELECT DISTINCT path, CASE WHEN ends_with(path, 'README.md') THEN 0 ELSE 2 END AS p FROM o WHERE ends_with(path, '.md') AND NOT contains(path, '/tests/'))
SELECT row_number() OVER (ORDER BY p, path)::INT AS place, path, greatest((SELECT count(*) FROM d) - 500, 0)::BIGINT AS not_checked FROM d ORDER BY p, path LIMIT 500""")
def docs_to_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files in their order of interest, 500 at most, and how many are left. A top-k report."""
    files = document_files(spark, sf_dir)
    return R.docs_to_check(files.select("path").unionByName(files.select(F.concat("source", F.lit("/README.md")).alias("path"))))


_UP = "SELECT 'orders' AS ecosystem, o_custkey::VARCHAR AS name, o_orderkey::VARCHAR || CASE o_orderstatus WHEN 'P' THEN '-pre' ELSE '' END AS version, o_orderdate AS published FROM orders"


@query(f"""WITH d AS ({_UP}), c AS (SELECT ecosystem, name, arg_min(version, (published, version)) AS resolved, arg_max(version, (published, version)) AS latest FROM d GROUP BY ecosystem, name),
j AS (SELECT c.*, a.published AS resolved_published, b.published AS latest_published FROM c JOIN d a ON a.name = c.name AND a.version = c.resolved JOIN d b ON b.name = c.name AND b.version = c.latest)
SELECT ecosystem, name, resolved, latest, resolved_published, latest_published, (epoch_us(latest_published) - epoch_us(resolved_published)) // 86400000000 AS days_between,
(SELECT count(DISTINCT version) FROM d WHERE d.name = j.name AND NOT regexp_matches(version, '[-+][A-Za-z]') AND published > resolved_published AND published <= latest_published)::BIGINT AS stable_releases_since FROM j""")
def upstream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12, A37 over whole tables: customers as components, their orders as releases, partly shipped ones as previews."""
    orders = table(spark, sf_dir, "orders")
    version = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", "-pre").otherwise(""))
    dates = orders.select(F.lit("orders").alias("ecosystem"), F.col("o_custkey").cast("string").alias("name"), version.alias("version"), F.col("o_orderdate").cast("timestamp").alias("published"))
    at = F.struct("published", "version")
    ends = dates.groupBy("ecosystem", "name").agg(F.min_by("version", at).alias("resolved"), F.max_by("version", at).alias("latest"))
    out = R.upstream(ends.select("ecosystem", "name", "resolved"), ends.select("ecosystem", "name", "latest"), dates)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("resolved_published", "latest_published")})


COUNTS = X.Fixture(
    "source string, name string, bodies array<string>",
    [
        ("npm", "@s/a", ['{"downloads": 10}', '{"downloads": 70}', '{"downloads": 300, "end": "2024-01-31"}', '{"repository": {"url": "git+https://x.test/a"}}']),
        ("npm", "bare", ['{"downloads": 1}', "{}", "{}", '{"repository": "x/y"}']),
        ("npm", "bad name", ["{}"]),
        ("pypi", "b", ['{"data": {"last_day": 1, "last_week": 7, "last_month": 30}}', '{"info": {"project_urls": {"Source": "https://x.test/b"}}}']),
        ("pypi", "a/b", ["{}"]),
        ("crate", "c", ['{"crate": {"downloads": 99, "recent_downloads": 9, "newest_version": "1.1"}}']),
        ("brew", "i", ['{"analytics": {"install": {"30d": {"i": 4, "i --head": 2}, "90d": {"other": 3, "more": 4}, "365d": {}}}}']),
        ("cask", "k", ["{}"]),
        ("docker", "d/e", ['{"pull_count": 5, "star_count": 2}']),
        ("docker", "plain", ['{"pull_count": 5}']),
        ("open_vsx", "f/g", ['{"downloadCount": 3, "averageRating": 4.5, "reviewCount": 1}']),
        ("discord", "h", ['{"guild": {"name": "H"}, "approximate_member_count": 50, "approximate_presence_count": 5}']),
        ("discord", "gone", ['{"_error": "HTTP 404"}']),
    ],
)


def _counts_sql() -> str:
    got = lambda i, paths: "coalesce(" + ", ".join(f"json_extract_string(bodies[{i + 1}], {quote(p)})" for p in paths) + ", NULL)"
    arms = [f"SELECT source, name, {quote(f)} AS field, {got(i, paths)} AS value FROM g WHERE source = {quote(s)}" for s, fields in R.COUNT_FIELDS.items() for f, i, paths in fields]
    for p in ("30d", "90d", "365d"):
        at = f"json_extract(bodies[1], '$.analytics.install.\"{p}\"')"
        arms.append(f"SELECT source, name, 'installs_{p}', coalesce(json_extract_string({at}, '$.\"' || name || '\"'), list_sum(json_extract_string({at}, '$.*')::BIGINT[])::VARCHAR) FROM g WHERE source IN ('brew', 'cask')")
    fine = "CASE source " + " ".join(f"WHEN {quote(s)} THEN regexp_matches(name, {quote(p)})" for s, p in R.NAME_FORMATS.items()) + " ELSE false END"
    return f"""WITH c AS (SELECT *, {fine} AS fine, list_filter(list_transform(bodies, lambda b: json_extract_string(b, '$._error')), lambda e: e IS NOT NULL)[1] AS e FROM {COUNTS.sql()}), g AS (SELECT * FROM c WHERE fine AND e IS NULL)
SELECT source, name, 'error' AS field, CASE WHEN fine THEN e ELSE 'bad name' END AS value FROM c WHERE NOT fine OR e IS NOT NULL UNION ALL {' UNION ALL '.join(arms)}"""


@query(_counts_sql())
def count_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of saved answers of eight sources; bad names and error answers give an error."""
    return R.public_counts(COUNTS.df(spark))


_FACTS = X.Fixture("url string, body string", [("/repos/o/r", '{"full_name": "o/r", "description": "d", "stargazers_count": 12, "subscribers_count": 3, "forks_count": 2, "open_issues_count": 5, "archived": false, "license": {"spdx_id": "MIT"}, "created_at": "2020-01-02T03:04:05Z", "pushed_at": "2024-01-01T00:00:00Z", "default_branch": "main", "topics": ["a", "b"], "homepage": "https://x.test"}'), ("/repos/o/s", '{"full_name": "o/s", "archived": true}'), ("/search?q=x", '{"total_count": 77}')])
_TEXT = {"full_name": "full_name", "description": "description", "default_branch": "default_branch", "license": "license.spdx_id", "created_at": "created_at", "pushed_at": "pushed_at", "homepage": "homepage"}
_NUMBERS = {"stars": "stargazers_count", "forks": "forks_count", "watchers": "subscribers_count", "open_issues_plus_prs": "open_issues_count"}


@query(f"""SELECT url, {', '.join(f"json_extract_string(body, '$.{p}') AS {n}" for n, p in _TEXT.items())}, {', '.join(f"json_extract_string(body, '$.{p}')::BIGINT AS {n}" for n, p in _NUMBERS.items())}, json_extract_string(body, '$.archived')::BOOLEAN AS archived, coalesce(array_to_string(json_extract_string(body, '$.topics[*]'), ','), '') AS topics
FROM {_FACTS.sql()} WHERE json_extract_string(body, '$.full_name') IS NOT NULL""")
def repository_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """thirteen facts of a repository."""
    return R.repository_facts(_FACTS.df(spark))


_LISTED = X.Fixture("full_name string, name string", [("o/notes", "notes"), ("o/notes-releases", "notes-releases"), ("o/Notes", "Notes"), ("o/note", "note"), ("o/blog", "blog"), ("o/release-tool", "release-tool"), ("p/abc-desktop", "abc-desktop"), ("p/my-releases", "my-releases")])
_OWN = X.Fixture("full_name string", [("o/notes",), ("p/abc",)])


@query(f"""WITH w AS (SELECT full_name AS repo, string_split(full_name, '/')[1] AS owner, regexp_replace(lower(string_split(full_name, '/')[2]), '[^a-z0-9]', '', 'g') AS stem FROM {_OWN.sql()}), l AS (SELECT full_name, string_split(full_name, '/')[1] AS owner, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS f FROM {_LISTED.sql()})
SELECT repo, full_name FROM l JOIN w USING (owner) WHERE full_name <> repo AND f <> stem AND (contains(f, 'release') OR (length(stem) >= 4 AND (contains(f, stem) OR contains(stem, f))))""")
def release_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other repositories of an owner that may hold the releases."""
    return R.sibling_repositories(_LISTED.df(spark), _OWN.df(spark))


@query("""WITH f AS (SELECT c_custkey::VARCHAR AS repo, min(o_orderdate) AS first FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT repo, strftime(first, '%Y-%m-%d') AS first_release, (epoch_us(first) - epoch_us(TIMESTAMP '1992-01-01')) // 86400000000 AS gap_days, (epoch_us(first) - epoch_us(TIMESTAMP '1992-01-01')) // 86400000000 > 14 AS warning FROM f""")
def late_first_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D09 over whole tables: customers as repositories made on one day, their orders as releases."""
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("repo"), F.to_timestamp(F.lit("1992-01-01")).alias("created"))
    releases = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderdate").cast("timestamp").alias("published"))
    return R.late_first_release(made, releases)


@query("SELECT event_type AS key, count(*)::BIGINT AS n FROM events GROUP BY event_type ORDER BY count(*) DESC, min(event_id) LIMIT 3")
def most_common_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent kinds, ties by the first seen. A top-k report."""
    return R.most_common(table(spark, sf_dir, "events"), F.col("event_type"), "event_id", 3)


@query("WITH p AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL) SELECT o_custkey, arg_min(o_orderpriority, (-n, f)) AS o_orderpriority, max(n)::BIGINT AS n FROM p GROUP BY o_custkey")
def modal_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent priority of each customer, ties by the first order."""
    return R.modal_names(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


_KEYS = X.Fixture("path string, text string", [("a", "Licensed under the MIT License\nPermission is hereby granted, free of charge. Source code needs a License  Key."), ("b", "source code and license key"), ("c", "MIT License\nsource code"), ("d", "Apache License, Version 2.0\nThe source\ncode asks for a license\nkey.")])


@query("SELECT * FROM (VALUES ('a', 'mentions a license key: likely source-available terms'), ('b', 'mentions a license key: likely source-available terms'), ('c', NULL), ('d', 'mentions a license key: likely source-available terms')) t(path, note)")
def license_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences whose texts speak of keys."""
    return _KEYS.df(spark).select("path", R.license_note(F.col("text")).alias("note"))


@query("""SELECT l_shipdate::DATE::VARCHAR AS repo, count(DISTINCT l_orderkey)::BIGINT AS commits, count(*) FILTER (WHERE l_returnflag = 'N')::BIGINT AS branches, count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS tags, round(sum(l_partkey) / 1000000.0, 1)::DOUBLE AS disk_mb FROM lineitem GROUP BY 1""")
def snapshot_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A35 over a whole table: shipping days as repositories, orders as commits, lines as branches, tags and files."""
    rows = table(spark, sf_dir, "lineitem").withColumn("repo", F.to_date("l_shipdate").cast("string"))
    refs = rows.select("repo", F.when(F.col("l_returnflag") == "N", "branch").when(F.col("l_returnflag") == "R", "tag").alias("kind"), F.col("l_orderkey").cast("string").alias("name"))
    return R.snapshot_counts(rows.select("repo", F.col("l_orderkey").alias("sha")), refs, rows.select("repo", F.col("l_partkey").alias("bytes")))
