"""Inputs for both engines: made of the given tables by one SELECT, or small literal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DUCK = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]"}


class Fixture:
    """Rows with a schema 'name type, ...'; timestamps are given as text."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.columns = [tuple(c.strip().split(" ", 1)) for c in schema.split(", ")]
        self.rows = rows

    def df(self, spark: SparkSession, sf_dir: str = "") -> DataFrame:
        given = ", ".join(f"{n} {'string' if t == 'timestamp' else t}" for n, t in self.columns)
        out = spark.createDataFrame(self.rows, given)
        return out.select(*[out[n].cast(t).alias(n) for n, t in self.columns])

    def sql(self) -> str:
        def lit(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, (int, float)):
                return repr(v)
            if isinstance(v, (list, tuple)):
                return "[" + ", ".join(map(lit, v)) + "]"
            return "'" + v.replace("'", "''") + "'"

        rows = ", ".join("(" + ", ".join(f"CAST({lit(v)} AS {_DUCK[t]})" for v, (_, t) in zip(r, self.columns, strict=True)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS t({', '.join(n for n, _ in self.columns)}))"


class Derived:
    """Rows that one SELECT, in what both engines' SQL have in common, makes of a table; its name stands in braces."""

    def __init__(self, table: str, select: str):
        self.table, self.select = table, select

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = spark.sql(self.select, **{self.table: spark.read.parquet(f"{sf_dir}/{self.table}.parquet")})
        return out.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in out.dtypes])

    def sql(self) -> str:
        return "(" + self.select.format(**{self.table: self.table}) + ")"


class Beside:
    """All documents as files, each with one row of a fixture by its number: its path below the document's own folder, its text before the document's.

    Ids count from 0. Fixtures without a text keep the document's.
    """

    def __init__(self, fixture: Fixture, path: str = "file", text: str = "text"):
        at = {n: i for i, (n, _) in enumerate(fixture.columns)}
        self.path, self.paths, self.texts = path, [r[at[path]] for r in fixture.rows], [r[at[text]] if text in at else "" for r in fixture.rows]

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.pmod("doc_id", F.lit(len(values))).cast("int"))
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return docs.select(F.concat("source", F.lit("/d"), "doc_id", F.lit("/"), of(self.paths)).alias(self.path), F.concat(of(self.texts), F.lit("\n"), "text").alias("text"))

    def sql(self) -> str:
        of = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][1 + doc_id % {len(values)}]"
        return f"(SELECT source || '/d' || doc_id || '/' || {of(self.paths)} AS {self.path}, {of(self.texts)} || chr(10) || text AS text FROM documents)"

    def lines_sql(self) -> str:
        return f"(SELECT {self.path}, unnest(t) AS text, generate_subscripts(t, 1)::BIGINT AS line FROM (SELECT {self.path}, string_split(text, chr(10)) AS t FROM {self.sql()}))"


_S = "CAST({} AS STRING)".format
_CUST, _ORDER = _S("o_custkey"), _S("o_orderkey")
#: Orders as a log of commits: customers are authors under two names and three addresses.
LOG = Derived(
    "orders",
    f"""SELECT {_ORDER} AS sha,
  CASE WHEN o_custkey % 40 = 0 THEN 'dependabot[bot]' WHEN o_orderkey % 3 = 0 THEN 'Dev ' || {_CUST} ELSE 'dev-' || {_CUST} END AS name,
  CASE WHEN o_custkey % 40 = 0 THEN 'bot@users.noreply.github.com' WHEN o_orderkey % 5 = 0 THEN {_CUST} || '+handle' || {_CUST} || '@users.noreply.github.com' WHEN o_orderkey % 5 = 1 THEN '' ELSE 'Dev' || {_CUST} || '@corp' || {_S('o_custkey % 12')} || '.test' END AS email,
  substr({_S('o_orderdate')}, 1, 10) || 'T' || lpad({_S('o_orderkey % 24')}, 2, '0') || ':00:00' || CASE o_custkey % 3 WHEN 0 THEN '+05:30' WHEN 1 THEN '-03:00' ELSE '+00:00' END AS date,
  o_orderkey % 9 = 0 AS merge,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Merge branch ' || CASE o_custkey % 4 WHEN 0 THEN 'codex/' WHEN 1 THEN 'claude/' WHEN 2 THEN 'cursor/' ELSE 'feature/' END || o_orderstatus WHEN o_orderkey % 7 = 0 THEN 'fix: crash of ' || o_orderpriority WHEN o_orderkey % 7 = 1 THEN 'Fixes prices' ELSE 'Add ' || o_orderpriority END AS subject,
  CASE WHEN o_orderkey % 6 = 0 THEN 'why' || chr(10) || 'Co-authored-by: Copilot <x@y.test>' WHEN o_orderkey % 6 = 1 THEN 'Co-Authored-By: Cursor Agent <c@d.test>' || chr(10) || 'co-authored-by : Gemini <g@h.test>' ELSE '' END AS body
FROM {{orders}} WHERE o_orderdate IS NOT NULL""",
)
#: Lines of orders as the paths that commits touch.
LOG_PATHS = Derived("lineitem", f"SELECT {_S('l_orderkey')} AS sha, 'src/p' || {_S('l_partkey % 300')} || CASE WHEN l_linenumber % 2 = 0 THEN '.py' ELSE '.md' END AS path FROM {{lineitem}}")
#: Orders as tags, some of which are no versions.
LOG_TAGS = Derived("orders", f"SELECT CASE WHEN o_custkey % 10 = 0 THEN 'nightly-' || {_ORDER} WHEN o_custkey % 10 = 1 THEN {_S('o_custkey % 5')} || '.' || {_ORDER} ELSE 'v' || {_S('o_custkey % 5')} || '.' || {_ORDER} || '.' || {_S('o_orderkey % 4')} END AS tag, o_orderdate AS date FROM {{orders}} WHERE o_orderdate IS NOT NULL")
_TAG = _S("CAST(floor(l_orderkey / 500) AS BIGINT)")
#: Lines of orders as files of releases, 500 orders each; quantities are downloads.
RELEASE_FILES = Derived(
    "lineitem",
    f"""SELECT 'v1.' || {_TAG} || '.0' AS tag, l_shipdate AS published_at, CAST(l_quantity AS BIGINT) AS downloads,
  CASE l_partkey % 12 WHEN 0 THEN 'latest.yml' WHEN 1 THEN 'latest-mac.yml' WHEN 2 THEN 'Tool-Setup.exe' WHEN 3 THEN 'Tool-1.' || {_TAG} || '.0.dmg' WHEN 4 THEN 'Tool.dmg.blockmap' WHEN 5 THEN 'tool_1.' || {_TAG} || '.0_amd64.deb' WHEN 6 THEN 'SHA256SUMS.txt' WHEN 7 THEN 'tool.apk' WHEN 8 THEN 'tool-mac.zip' WHEN 9 THEN 'tool-linux.tar.gz' WHEN 10 THEN 'tool-1.' || {_TAG} || '.0.whl' ELSE 'readme' || {_S('l_linenumber')} || '.html' END AS name
FROM {{lineitem}} WHERE l_shipdate IS NOT NULL""",
)
#: Every fiftieth event as a star that was given.
STAR_POINTS = Derived("events", "SELECT event_id AS star, ts AS starred_at FROM {events} WHERE event_id % 50 = 0 AND ts IS NOT NULL")
_AMOUNT = f"{_S('p_size')} || '.' || lpad({_S('p_partkey % 100')}, 2, '0')"
#: Parts as lines of their brand's price page.
PRICE_LINES = Derived(
    "part",
    f"""SELECT p_brand AS page, p_partkey AS line,
  CASE p_partkey % 11 WHEN 0 THEN 'Pro: $' || {_AMOUNT} || ' per month, up to ' || {_S('p_size')} || ' seats' WHEN 1 THEN 'Team US$ ' || {_S('p_partkey')} || ' a year, billed yearly' WHEN 2 THEN '€' || {_AMOUNT} || ' / month' WHEN 3 THEN {_S('p_size')} || ',99 € per user' WHEN 4 THEN '1,' || lpad({_S('p_partkey % 1000')}, 3, '0') || ' credits included' WHEN 5 THEN 'Contact sales about ' || p_name WHEN 6 THEN '+ $' || {_S('p_size')} || ' each extra workspace' WHEN 7 THEN 'USD 1,' || lpad({_S('p_partkey % 1000')}, 3, '0') || '.50 per seat' WHEN 8 THEN {_S('p_size')} || ' GBP per agent' WHEN 9 THEN 'Start free trial of ' || p_type ELSE p_name || ', cancel any time, plus tax' END AS text
FROM {{part}}""",
)

_KEY = _S("p_partkey")
_FOLDER = _S("CAST(floor(p_partkey / 4) AS BIGINT) % 25")
_VERSION = f"{_S('p_size')} || '.' || {_S('p_partkey % 10')}"
_MANIFEST = f"CASE p_partkey % 4 WHEN 0 THEN 'svc' || {_FOLDER} || '/go.mod' WHEN 1 THEN 'api' || {_FOLDER} || CASE WHEN p_size % 5 = 0 THEN '/requirements-dev.txt' ELSE '/requirements.txt' END WHEN 2 THEN 'crate' || {_FOLDER} || '/Cargo.toml' ELSE 'ios' || {_FOLDER} || '/Podfile.lock' END"
#: Parts as the entries of manifests of four kinds, with the lines that open them.
PART_MANIFESTS = Derived(
    "part",
    f"""SELECT {_MANIFEST} AS manifest, 10 + p_partkey AS line, CASE p_partkey % 4
    WHEN 0 THEN chr(9) || 'github.com/b' || {_S('p_size')} || '/p' || {_KEY} || ' v' || {_VERSION} || '.0' || CASE WHEN p_partkey % 3 = 0 THEN ' // indirect' ELSE '' END
    WHEN 1 THEN 'Pkg_' || {_KEY} || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '==' || {_VERSION} || ' # pinned' ELSE '>=' || {_VERSION} END
    WHEN 2 THEN 'crate-' || {_KEY} || ' = "' || {_VERSION} || '"' ELSE '  - Pod' || {_KEY} || ' (' || {_VERSION} || ')' END AS text FROM {{part}}
  UNION ALL SELECT DISTINCT {_MANIFEST}, CAST(1 AS BIGINT), CASE p_partkey % 4 WHEN 0 THEN 'require (' WHEN 1 THEN '# names' WHEN 2 THEN '[dependencies]' ELSE 'PODS:' END FROM {{part}}""",
)
#: Parts as package.json files of their own.
PART_PACKAGES = Derived("part", f"""SELECT 'web' || {_KEY} || '/package.json' AS manifest, '{{{{"dependencies": {{{{"n' || {_S('p_partkey % 30')} || '": "^' || {_VERSION} || '"}}}}, "devDependencies": {{{{"jest' || {_S('p_size')} || '": "29"}}}}}}}}' AS content FROM {{part}} WHERE p_partkey % 8 = 3""")
_LOCKFILE = f"CASE WHEN p_partkey % 2 = 0 THEN 'crate' || {_FOLDER} || '/Cargo.lock' ELSE 'py' || {_FOLDER} || '/poetry.lock' END"
_PACKAGE = f"'Pack_' || {_S('CAST(floor(p_partkey / 2) AS BIGINT) % 300')}"
#: Parts as blocks of lock files.
PART_LOCKS = Derived("part", " UNION ALL ".join(f"SELECT {_LOCKFILE} AS lockfile, 4 * p_partkey + {i} AS line, {t} AS text FROM {{part}}" for i, t in enumerate(["'[[package]]'", f"'name = \"' || {_PACKAGE} || '\"'", f"'version = \"' || {_VERSION} || '.0\"'"])))
#: Parts as components that manifests name, with gaps.
PART_COMPONENTS = Derived(
    "part",
    f"""SELECT CASE p_size % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'crates' WHEN 2 THEN 'go' ELSE 'pypi' END AS ecosystem, 'c' || {_S('p_partkey % 150')} AS name, CASE p_partkey % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'peer' ELSE 'prod' END AS kind, '^' || {_VERSION} AS declared,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE {_VERSION} || '.1' END AS resolved, CASE WHEN p_partkey % 6 = 0 THEN 'git' || {_S('p_partkey % 7')} END AS source, 'f' || lpad({_KEY}, 12, '0') || '/manifest' AS manifest FROM {{part}}""",
)
#: Parts as resolved and latest versions, as registry answers, and as folders with and without locks.
PART_VERSIONS = Derived("part", f"SELECT CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 51 = 0 THEN 'workspace' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'v' ELSE '' END || {_S('p_size % 3')} || '.' || {_S('p_partkey % 4')} || '.' || {_S('p_partkey % 7')} END AS resolved, {_S('p_size % 4')} || '.' || {_S('p_partkey % 5')} || CASE WHEN p_partkey % 9 = 0 THEN '.latest' WHEN p_partkey % 10 = 0 THEN '.+' ELSE '' END AS latest FROM {{part}}")
PART_NAMES = Derived("part", "SELECT p_name AS name FROM {part} UNION SELECT p_type FROM {part} UNION SELECT p_brand || '_.' || p_type FROM {part}")
PART_ANSWERS = Derived(
    "part",
    f"""SELECT CASE p_partkey % 6 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'crates' WHEN 3 THEN 'go' WHEN 4 THEN 'maven' ELSE 'swift' END AS ecosystem, 'p' || {_KEY} AS name,
  CASE p_partkey % 6 WHEN 0 THEN '{{{{"dist-tags": {{{{"latest": "' || {_VERSION} || '"}}}}}}}}' WHEN 1 THEN '{{{{"info": {{{{"version": "' || {_VERSION} || '"}}}}}}}}' WHEN 2 THEN '{{{{"crate": {{{{"max_stable_version": ' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '"' || {_VERSION} || '"' END || ', "newest_version": "' || {_VERSION} || '-rc"}}}}}}}}'
  WHEN 3 THEN '{{{{"Version": "v' || {_VERSION} || '"}}}}' WHEN 4 THEN '{{{{"response": {{{{"docs": [{{{{"latestVersion": "' || {_VERSION} || '"}}}}]}}}}}}}}' ELSE '{{{{"tag_name": "v' || {_VERSION} || '"}}}}' END AS body FROM {{part}}""",
)
_ECOSYSTEM = "CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'crates' ELSE 'pypi' END"
PART_LOCK_FOLDERS = Derived("part", f"SELECT DISTINCT CASE WHEN p_size % 10 = 0 THEN '' WHEN p_size % 3 = 0 THEN 'a' || {_S('p_size')} ELSE 'a' || {_S('p_size')} || '/b' || {_S('p_partkey % 5')} END AS lock_folder, {_ECOSYSTEM} AS ecosystem FROM {{part}} WHERE p_partkey % 7 = 0")
PART_NEEDS = Derived("part", f"SELECT CASE WHEN p_partkey % 40 = 0 THEN '' ELSE 'a' || {_S('p_size')} || CASE WHEN p_partkey % 2 = 0 THEN '/b' || {_S('p_partkey % 5')} || '/c' ELSE 'x' END END AS folder, {_ECOSYSTEM} AS ecosystem FROM {{part}}")
#: Orders as releases, some of them candidates.
ORDER_RELEASES = Derived("orders", f"SELECT '1.' || {_ORDER} || CASE WHEN o_custkey % 4 = 0 AND o_orderkey > 9 THEN '.0-rc.1' ELSE '.0' END AS version, o_orderdate AS published FROM {{orders}}")


_PAGE, _PLACE = _S("page_id"), _S("page_id % 90")
#: Pages' urls, every sixth of them at a telemetry product.
PAGE_URLS = Derived("pages", f"SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN CASE page_id % 5 WHEN 0 THEN 'https://app.posthog.com/x' WHEN 1 THEN 'https://o' || {_PAGE} || '.sentry.io./api' WHEN 2 THEN 'http://sentry.io:8080/' WHEN 3 THEN 'https://api.segment.com' ELSE 'no url' END ELSE url END AS url FROM {{pages}}")
#: Pages as answers of an archive's index, with the url as query.
PAGE_CAPTURES = Derived("pages", f"""SELECT url AS query, CASE WHEN page_id % 10 = 0 THEN '[]' ELSE '[["timestamp", "original", "statuscode"], ["2024' || lpad({_S('1 + page_id % 12')}, 2, '0') || lpad({_S('1 + page_id % 28')}, 2, '0') || '030405", "' || url || '", "200"]' || CASE WHEN page_id % 2 = 0 THEN ', ["20230101000000", "http://x.test/' || {_PAGE} || '", "301"]]' ELSE ']' END END AS body FROM {{pages}}""")
#: Pages as Link headers of a listing.
PAGE_LINKS = Derived("pages", f"""SELECT CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '<' || url || '&page=1>; rel="prev"' ELSE '<https://a.test/r?page=2>; rel="next", <https://a.test/r?per_page=1&page=' || {_PAGE} || '>; rel="last"' END AS header FROM {{pages}}""")
#: Pages as offers in files.
PAGE_OFFERS = Derived("pages", f"SELECT 'f' || {_PLACE} || '.ts' AS file, CASE WHEN page_id % 7 = 0 THEN 'no offer' ELSE 'see ' || url || ' now' END AS text FROM {{pages}}")
#: Parts as amounts in several spellings.
PART_AMOUNTS = Derived("part", f"SELECT CASE p_partkey % 5 WHEN 0 THEN {_S('p_size')} WHEN 1 THEN {_S('p_size')} || ',' || lpad({_S('p_partkey % 1000')}, 3, '0') WHEN 2 THEN {_S('p_size')} || '.' || lpad({_S('p_partkey % 100')}, 2, '0') WHEN 3 THEN {_S('p_size')} || '.' || lpad({_S('p_partkey % 1000')}, 3, '0') || ',' || {_S('p_partkey % 10')} ELSE {_S('p_size')} || ',' || lpad({_S('p_partkey % 1000')}, 3, '0') || '.' || lpad({_S('p_partkey % 100')}, 2, '0') END AS text FROM {{part}}")
#: Lines of orders as releases with their files in JSON.
ORDER_FILES = Derived("lineitem", f"""SELECT 'v' || {_S('l_orderkey')} || '.' || {_S('l_linenumber')} AS tag, CASE WHEN l_partkey % 20 = 0 THEN '[]' ELSE '[{{{{"name": "a' || {_S('l_partkey')} || '.dmg", "download_count": ' || {_S('CAST(l_quantity AS BIGINT)')} || '}}}}, {{{{"name": "b.exe", "download_count": 4}}}}]' END AS body FROM {{lineitem}}""")
#: Parts as install counts of a package manager.
PART_INSTALLS = Derived("part", f"""SELECT 'brew' AS source, 'i' || {_KEY} AS name, '{{{{"analytics": {{{{"install": {{{{"30d": {{{{"i' || {_S('p_partkey - p_partkey % 2')} || '": ' || {_S('p_size')} || ', "i --head": 2}}}}, "90d": {{{{"other": 3, "more": ' || {_KEY} || '}}}}, "365d": {{{{}}}}}}}}}}}}}}}}' AS body FROM {{part}}""")
_OLD_PATH = f"CASE WHEN p_size % 9 = 0 THEN 'tests/t' || {_S('p_size')} WHEN p_size % 4 = 0 THEN 'src/d' || {_S('p_size')} || '/e' || {_S('p_partkey % 3')} ELSE 'lib' || {_S('p_size')} END || '/f' || {_KEY} || CASE p_partkey % 3 WHEN 0 THEN '.md' ELSE '.py' END"
_NEW_PATH = f"'new/' || {_OLD_PATH}"
#: Parts as files at two revisions: those of some sizes are deleted, those of others moved, new ones come.
PATHS_OLD = Derived("part", f"SELECT {_OLD_PATH} AS path FROM {{part}}")
PATHS_NEW = Derived("part", f"SELECT CASE WHEN p_size % 7 = 2 THEN {_NEW_PATH} ELSE {_OLD_PATH} END AS path FROM {{part}} WHERE p_size % 6 <> 0 UNION ALL SELECT 'added/g' || {_KEY} FROM {{part}} WHERE p_partkey % 11 = 0")
PATH_CHANGES = Derived("part", f"SELECT CASE WHEN p_size % 6 = 0 THEN 'D' ELSE 'R' END AS status, {_OLD_PATH} AS old, CASE WHEN p_size % 6 = 0 THEN NULL ELSE {_NEW_PATH} END AS new FROM {{part}} WHERE p_size % 6 = 0 OR p_size % 7 = 2")

PATHS = Fixture(
    "path string, head string",
    [(p, "") for p in ("src/app/main.ts", "src/latest.ts", "tests/test_api.py", "src/app/button.test.tsx", "pkg/store/store_test.go", "ios/AppTests/LoginTests.swift", "spec/models/user_spec.rb", "e2e/login.ts", "src/fixtures/data.json", "docs/guide.md", "README.md", "CHANGELOG.md", "node_modules/x/index.js", "vendor/lib/a.c", "proto/api_pb2.py", "web/app.min.js", "build/out.js", ".env.local", "config/.env.example", "keys/id_rsa", "deploy/service-account.json", "package.json", "yarn.lock", "go.mod", "examples/demo.py", "android/AndroidManifest.xml", "Cargo.toml", "deep/a/b/c/file.rs", "third_party/zlib/LICENSE", "LICENSE", "LICENSE.md", "NOTICE.txt", "COPYING.LESSER", "licence.py", "LICENSING.md", "PATENTS")]
    + [("src/gen/model.ts", "// @generated by a tool\nexport const a = 1"), ("src/gen/client.go", "// Code generated by oapi. DO NOT EDIT.")],
)

ASSETS = Fixture(
    "tag string, published_at timestamp, name string, downloads long",
    [
        ("v1.0.0", "2024-01-01 00:00:00", "latest.yml", 100),
        ("v1.0.0", "2024-01-01 00:00:00", "latest-mac.yml", 400),
        ("v1.0.0", "2024-01-01 00:00:00", "Tool-Setup.exe", 30),
        ("v1.0.0", "2024-01-01 00:00:00", "Tool-1.0.0.dmg", 20),
        ("v1.0.0", "2024-01-01 00:00:00", "Tool-1.0.0.dmg.blockmap", 9),
        ("v1.1.0", "2024-01-15 12:00:00", "latest.yml", 300),
        ("v1.1.0", "2024-01-16 12:00:00", "latest-linux.yml", 50),
        ("v1.1.0", "2024-01-15 12:00:00", "tool_1.1.0_amd64.deb", 40),
        ("v1.1.0", "2024-01-15 12:00:00", "SHA256SUMS.txt", 3),
        ("v1.2.0-mobile", "2024-01-20 00:00:00", "tool.apk", 70),
        ("v1.2.0", "2024-02-01 00:00:00", "appcast.xml", 900),
        ("v1.2.0", "2024-02-01 00:00:00", "Tool.dmg", 60),
        ("v1.2.0", "2024-02-01 00:00:00", "tool-mac.zip", 8),
        ("v1.2.0", "2024-02-01 00:00:00", "tool-linux.tar.gz", 7),
        ("v1.2.0", "2024-02-01 00:00:00", "tool-1.2.0.whl", 5),
        ("v1.2.0", "2024-02-01 00:00:00", "readme.html", 1),
    ],
)

STARS = Fixture("star long, starred_at timestamp", [(1, "2024-01-01 00:00:00"), (101, "2024-01-11 00:00:00"), (201, "2024-01-21 12:00:00"), (201, "2024-01-22 00:00:00"), (250, "2024-01-26 00:00:00")])

VERSIONS = Fixture("resolved string, latest string", [("1.2.3", "2.0.0"), ("1.2.3", "1.3.0"), ("1.2.3", "1.2.9"), ("v1.2.3", "1.2.3"), ("3.0", "2.9.9"), ("workspace", "1.0.0"), (None, "1.0.0"), ("1.0.0-beta.2", "1.0")])

MONEY = Fixture("text string", [(t,) for t in ("0", "12", "1,234", "1.234", "1,234.50", "4,99", "169.00", "1.234,5", "12.5")])

PRICING = Fixture(
    "page string, line long, text string",
    [("a", i, t) for i, t in enumerate(["Simple pricing", "Free", "$0 forever", "Get started", "Pro: $12 per month, up to 5 seats", "Team US$ 169 a year, billed yearly", "€4.99 / month", "4,99 € per user", "1,200 credits included", "Custom", "Contact sales", "+ $5 each extra workspace", "Cancel any time, plus tax"], 1)]
    + [("b", i, t) for i, t in enumerate(["Open source", "USD 29 per seat", "29 GBP per agent", "No prices here, only 30 requests", "Start free trial and a very long line that is over sixty characters, so no call"], 1)],
)

COPY = Fixture(
    "doc string, line long, text string",
    [
        ("x", 1, "# Rival compared"),
        ("x", 2, "Unlike Rival we are the best choice."),
        ("x", 3, "```"),
        ("x", 4, "Rival has 500 users"),
        ("x", 5, "```"),
        ("x", 6, "Rival has 500 users."),
        ("x", 7, "Rival had 500 users on 2024-05-01."),
        ("x", 8, "> " + "word " * 41),
        ("x", 9, "> short answer"),
        ("x", 10, "<!-- claims-lint: off -->"),
        ("x", 11, "Rival is slow, always."),
        ("x", 12, "<!-- claims-lint: on -->"),
        ("x", 13, "A game changer, faster than Rival <!-- claims-lint: ignore -->"),
        ("x", 14, "A game changer, faster than Rival, 100% safe"),
        ("x", 15, "See Rival v1.2.3 and [Rival 2](http://a.b/2) `5`"),
        ("y", 1, "Never the cheapest, first-ever tool"),
        ("y", 2, "1. Rival"),
    ],
)
FORBIDDEN = Fixture("line string", [("# words we do not use",), ("",), ("game changer",), ("re:revolution\\w*",)])
DENIED = Fixture("line string", [("# private",), ("secretname @allow=docs/a.md,/README.md",), ("re:code ?word",)])

COMMITS = Fixture(
    "sha string, name string, email string, date string, merge boolean, subject string, body string",
    [
        ("a1", "Dana Roe", "dana@corp.test", "2024-01-01T09:00:00+05:30", False, "Add parser", ""),
        ("a2", "Dana Roe", "dana@corp.test", "2024-01-02T09:00:00+05:30", False, "fix: crash", "Co-authored-by: Copilot <x@y.test>"),
        ("a3", "dana-roe", "123+danaroe@users.noreply.github.com", "2024-01-07T23:30:00-03:00", False, "Fixes bug", ""),
        ("a4", "Lee", "lee@corp.test", "2024-01-08T01:00:00+00:00", True, "Merge branch 'codex/x'", ""),
        ("a5", "Lee", "lee@corp.test", "2024-01-09T10:00:00+00:00", False, "Docs", "Co-Authored-By: Cursor Agent <c@d.test>\nCo-authored-by: Gemini <g@h.test>"),
        ("a6", "dependabot[bot]", "bot@users.noreply.github.com", "2024-12-30T10:00:00+00:00", False, "Bump x", ""),
        ("a7", "Nomail", "", "2027-01-01T10:00:00+00:00", False, "hotfix release", ""),
    ],
)
COMMIT_PATHS = Fixture("sha string, path string", [("a1", "src/a.py"), ("a1", "src/a.py"), ("a2", "src/a.py"), ("a3", "src/a.py"), ("a3", "docs/x.md"), ("a5", "docs/x.md"), ("a6", "go.sum")])
TAGS = Fixture("tag string, date timestamp", [("v0.1.0", "2024-01-01 00:00:00"), ("v0.2.0", "2024-01-01 20:00:00"), ("nightly", "2024-01-02 00:00:00"), ("app-v1.0.0-rc.1", "2024-01-05 08:00:00"), ("1.0", "2024-02-01 00:00:00")])

TREE_OLD = Fixture("path string", [("src/a.py",), ("src/b.py",), ("old/one.py",), ("old/two.py",), ("old/deep/three.py",), ("gone/x.py",), ("gone/y.md",), ("docs/guide.md",), ("README.md",), ("tests/test_a.py",), ("top.txt",)])
TREE_NEW = Fixture("path string", [("src/a.py",), ("src/b.py",), ("new/one.py",), ("new/two.py",), ("docs/manual.md",), ("README.md",), ("src/c.py",)])
TREE_CHANGES = Fixture("status string, old string, new string", [("R", "old/one.py", "new/one.py"), ("R", "old/two.py", "new/two.py"), ("R", "docs/guide.md", "docs/manual.md"), ("D", "old/deep/three.py", None), ("D", "gone/x.py", None), ("D", "gone/y.md", None), ("D", "tests/test_a.py", None), ("D", "top.txt", None), ("M", "README.md", "README.md")])
DOC_VERSIONS = Fixture(
    "file string, side string, line long, text string",
    [("docs/manual.md", "old", i, t) for i, t in enumerate(["# Guide", "## 1. Install", "```", "## not a heading", "```", "## Old *part*", "### [Link](x) here ##", "## Use C#"], 1)]
    + [("docs/manual.md", "new", i, t) for i, t in enumerate(["# Guide", "## 2. Install", "## Use C#", "## Fresh"], 1)],
)

MANIFEST_LINES = Fixture(
    "manifest string, line long, text string",
    [("svc/go.mod", i, t) for i, t in enumerate(["module x", "require github.com/a/b v1.2.3", "require (", "\tgithub.com/c/d v0.1.0 // indirect", "\tgithub.com/e/f v2.0.0+incompatible", ")", "github.com/no/t v9"], 1)]
    + [("api/requirements.txt", i, t) for i, t in enumerate(["flask==2.0 ; python_version > '3'", "# comment", "-r other.txt", "requests[socks]>=2", "git+https://x/y", "Django # web"], 1)]
    + [("api/requirements-dev.txt", i, t) for i, t in enumerate(["pytest", "./local"], 1)]
    + [("crate/Cargo.toml", i, t) for i, t in enumerate(["[package]", 'name = "x"', "[dependencies]", 'serde = "1.0"', 'tokio = { version = "1.2", features = ["full"] }', "local = { path = \"../l\" }", "ws.workspace = true", "[dev-dependencies]", 'criterion = "0.5" # bench'], 1)]
    + [("ios/Podfile.lock", i, t) for i, t in enumerate(["PODS:", "  - Alamofire (5.6.1)", "    - Inner (1.0)", "  - Moya (15.0.0):"], 1)],
)
LOCK_LINES = Fixture("lockfile string, line long, text string", [("crate/Cargo.lock", i, t) for i, t in enumerate(["[[package]]", 'name = "serde"', 'version = "1.0.188"', "", "[[package]]", 'name = "serde"', 'version = "0.9.0"', "[[package]]", 'name = "criterion"', 'version = "0.5.1"'], 1)] + [("poetry.lock", i, t) for i, t in enumerate(["[[package]]", 'name = "flask"', 'version = "2.0.3"'], 1)])
YARN_LINES = Fixture("lockfile string, line long, text string", [("web/yarn.lock", i, t) for i, t in enumerate(["# yarn lockfile v1", '"@scope/a@^1.0.0", "@scope/a@^1.1.0":', '  version "1.1.4"', "left-pad@npm:^1.3.0:", "  version: 1.3.0"], 1)])
PACKAGE_JSON = Fixture("manifest string, content string", [("web/package.json", '{"dependencies": {"@scope/a": "^1.0.0", "left-pad": "^1.3.0", "odd": {"x": 1}}, "devDependencies": {"jest": "29"}, "license": "MIT"}'), ("package.json", '{"peerDependencies": {"react": ">=18"}, "optionalDependencies": {"fs": "1"}}'), ("bad/package.json", "{nope")])
PACKAGE_LOCK = Fixture("lockfile string, content string", [("package-lock.json", '{"packages": {"": {"version": "1"}, "node_modules/react": {"version": "18.2.0"}, "web/node_modules/jest": {"version": "29.7.0"}, "node_modules/x/node_modules/react": {"version": "16.0.0"}}}')])
NPM_NEEDS = Fixture("folder string, name string, declared string", [("web", "jest", "29"), ("web", "react", ">=18"), ("web/deep/er", "react", ">=18"), ("other", "jest", "29"), ("other", "none", "1")])
LOCK_FOLDERS = Fixture("lock_folder string, ecosystem string", [("", "npm"), ("web", "npm"), ("crate", "crates"), ("", "pypi")])
NEED_FOLDERS = Fixture("folder string, ecosystem string", [("web", "npm"), ("web/deep/er", "npm"), ("webby", "npm"), ("crate/sub", "crates"), ("other", "crates"), ("api", "pypi"), ("", "npm")])
COMPONENT_ROWS = Fixture(
    "ecosystem string, name string, kind string, declared string, resolved string, source string, manifest string",
    [("npm", "react", "peer", ">=18", "18.2.0", None, "package.json"), ("npm", "react", "prod", "^18", "18.2.0", "u", "web/package.json"), ("npm", "Axios", "dev", "1", None, None, "web/package.json"), ("crates", "serde", "prod", "1.0", "0.9.0, 1.0.188", None, "crate/Cargo.toml"), ("go", "a/b", "indirect", "v1", "v1", None, "go.mod")],
)
REGISTRY = Fixture(
    "ecosystem string, name string, body string",
    [
        ("npm", "react", '{"dist-tags": {"latest": "19.0.0"}}'),
        ("pypi", "flask", '{"info": {"version": "3.0.0"}}'),
        ("crates", "serde", '{"crate": {"max_stable_version": null, "newest_version": "1.0.200"}}'),
        ("go", "a/b", '{"Version": "v2.0.0", "Time": "2024-01-01T00:00:00Z"}'),
        ("maven", "g:a", '{"response": {"docs": [{"latestVersion": "2.1", "timestamp": 1700000000000}]}}'),
        ("swift", "pkg", '{"tag_name": "v5.0.1"}'),
    ],
)
RELEASE_DATES = Fixture("version string, published timestamp", [("1.0.0", "2024-01-01 00:00:00"), ("1.1.0-rc.1", "2024-01-05 00:00:00"), ("1.1.0", "2024-01-10 00:00:00"), ("1.2.0", "2024-01-18 06:00:00"), ("2.0.0", "2024-03-01 00:00:00")])
COUNTS = Fixture(
    "source string, name string, body string",
    [
        ("npm_day", "a", '{"downloads": 10}'),
        ("pypi", "b", '{"data": {"last_day": 1, "last_week": 7, "last_month": 30}}'),
        ("crate", "c", '{"crate": {"downloads": 99, "recent_downloads": 9, "max_stable_version": "1.0"}}'),
        ("docker", "d/e", '{"pull_count": 5, "star_count": 2}'),
        ("open_vsx", "f/g", '{"downloadCount": 3, "averageRating": 4.5, "reviewCount": 1}'),
        ("discord", "h", '{"guild": {"name": "H"}, "approximate_member_count": 50, "approximate_presence_count": 5}'),
        ("brew", "i", '{"analytics": {"install": {"30d": {"i": 4, "i --head": 2}, "90d": {"other": 3, "more": 4}, "365d": {}}}}'),
        ("crate", "bad name", "{}"),
        ("docker", "x/y", '{"_error": "HTTP 404"}'),
    ],
)
CAPTURES = Fixture("query string, body string", [("a", '[["timestamp", "original", "statuscode"], ["20240102030405", "http://x.test/", "200"], ["20240203040506", "http://x.test/p", "301"]]'), ("b", "[]")])
LINKS = Fixture("header string", [('<https://a.test/r?page=2>; rel="next", <https://a.test/r?per_page=1&page=34>; rel="last"',), ('<https://a.test/r?page=1>; rel="prev"',), ("",), (None,)])
SIGNAL_LINES = Fixture(
    "file string, line long, text string",
    [
        ("src/main.ts", 1, "import posthog from 'posthog-js'"),
        ("src/main.ts", 2, "posthog.init(key)"),
        ("src/list.ts", 1, "  'sentry.io',"),
        ("src/list.ts", 2, "fetch('https://o1.sentry.io/api')"),
        ("src/list.ts", 3, "const telemetry = optOut"),
        ("src/list.ts", 4, "@OptIn(Experimental::class)"),
        ("web/pay.ts", 1, 'import { loadStripe } from "@stripe/stripe-js"'),
        ("web/pay.ts", 2, 'if (plan === "pro") checkLicense(key)'),
        ("web/pay.ts", 3, 'const price = "$12.00" // Upgrade now'),
        (".github/workflows/ci.yml", 1, "STRIPE_LICENSE_KEY: x"),
        ("electron/main.js", 1, "webPreferences: { nodeIntegration: true, sandbox: false }"),
        ("electron-builder.yml", 1, "publisherName: X"),
        ("src/other.ts", 1, "publisherName: X"),
        ("server/app.py", 1, "app.run(host='0.0.0.0')"),
    ],
)
MARKDOWN = Fixture("doc string, text string", [("m", "# T\nintro\n## A\n" + "a" * 30 + "\n## B\n<table>\n## no cut\n</table>\n### C\n" + "c" * 25 + "\n```\n## no\n```\n## D\nend\n"), ("n", "short"), ("o", "## X\n" + "x" * 100)])
PAGE_PAIR = Fixture("pair string, side string, line long, text string", [("p", s, i, t) for s, ts in (("old", ["Welcome to the shop", "The plan costs 10 dollars a month", "SUPPORT by phone", "ok", "This sentence goes away entirely", "Welcome to the shop"]), ("new", ["Welcome  to the shop", "The plan costs 12 dollars a month", "support by phone", "A completely fresh line of text"])) for i, t in enumerate(ts, 1)])

#: Documents as source files with one line of code, and as files of all kinds of paths.
CODE = Beside(SIGNAL_LINES)
ANY_PATHS = Beside(PATHS, "path", "head")
