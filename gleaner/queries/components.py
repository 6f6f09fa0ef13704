"""Components: F01, F02, F05-F07, F13, F16, F18-F20, F22, J03-J09, J20, A18, A19, A37, P36, P37, T07, T15, U01, D11, D12, version functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.numbers import behind, is_exact, python_name
from gleaner.operators import dependencies as D
from gleaner.operators.running import running
from gleaner.queries import fixtures as X
from gleaner.queries.base import query, table

_V = "(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?"


def _triple(c: str) -> str:
    part = lambda i: f"coalesce(nullif(regexp_extract({c}, '{_V}', {i}), '')::BIGINT, 0)"
    return f"CASE WHEN regexp_matches({c}, '\\d') THEN [{part(1)}, {part(2)}, {part(3)}] END"


@query(f"""WITH v AS (SELECT resolved, latest, {_triple('resolved')} AS h, {_triple('latest')} AS w FROM {X.PART_VERSIONS.sql()})
SELECT resolved, latest, CASE WHEN h IS NULL OR w IS NULL THEN 'unknown' WHEN h > w THEN 'ahead' WHEN h[1] < w[1] THEN 'major' WHEN h[2] < w[2] THEN 'minor' WHEN h[3] < w[3] THEN 'patch' ELSE 'current' END AS gap,
regexp_matches(latest, '^[\\w.\\-]+$') AND NOT ends_with(latest, '+') AND NOT contains(lower(latest), 'latest') AS exact FROM v""")
def version_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far versions are behind."""
    return X.PART_VERSIONS.df(spark, sf_dir).select("resolved", "latest", behind(F.col("resolved"), F.col("latest")).alias("gap"), is_exact(F.col("latest")).alias("exact"))


_V2 = "p_size || '.' || p_partkey % 10"
_AT = "CAST(floor(p_partkey / 4) AS BIGINT) % 25"
_PARSED = f"""(SELECT 'svc' || {_AT} || '/go.mod' AS manifest, 'go' AS ecosystem, 'github.com/b' || p_size || '/p' || p_partkey AS name, 'v' || {_V2} || '.0' AS declared, CASE WHEN p_partkey % 3 = 0 THEN 'indirect' ELSE 'prod' END AS kind, 'v' || {_V2} || '.0' AS resolved FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT 'api' || {_AT} || CASE WHEN p_size % 5 = 0 THEN '/requirements-dev.txt' ELSE '/requirements.txt' END, 'pypi', 'Pkg_' || p_partkey, CASE p_partkey % 3 WHEN 0 THEN '*' WHEN 1 THEN '==' || {_V2} ELSE '>=' || {_V2} END, CASE WHEN p_size % 5 = 0 THEN 'dev' ELSE 'prod' END, NULL FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT 'crate' || {_AT} || '/Cargo.toml', 'crates', 'crate-' || p_partkey, {_V2}, 'prod', NULL FROM part WHERE p_partkey % 4 = 2
UNION ALL SELECT 'ios' || {_AT} || '/Podfile.lock', 'cocoapods', 'Pod' || p_partkey, {_V2}, 'prod', {_V2} FROM part WHERE p_partkey % 4 = 3
UNION ALL SELECT 'web' || p_partkey || '/package.json', 'npm', 'n' || p_partkey % 30, '^' || {_V2}, 'prod', NULL FROM part WHERE p_partkey % 8 = 3
UNION ALL SELECT 'web' || p_partkey || '/package.json', 'npm', 'jest' || p_size, '29', 'dev', NULL FROM part WHERE p_partkey % 8 = 3) t"""


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.PART_MANIFESTS.df(spark, sf_dir)
    parts = [D.go_rows(lines), D.requirement_rows(lines), D.cargo_rows(lines), D.pod_rows(lines), D.package_json_rows(X.PART_PACKAGES.df(spark, sf_dir))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"SELECT * FROM {_PARSED}")
def declared_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of five kinds of manifests, written from parts and read again; the SQL takes them from the parts."""
    return _declared(spark, sf_dir)


@query(f"SELECT manifest, name FROM {_PARSED} WHERE kind NOT IN ('dev', 'indirect') AND regexp_matches(name, '^[a-n].*$')")
def chosen_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production components whose names match the shell pattern [a-n]*."""
    return _declared(spark, sf_dir).where(~F.col("kind").isin("dev", "indirect") & F.col("name").rlike("^[a-n].*$")).select("manifest", "name")


_LOCKED = f"""(SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'crate' || {_AT} || '/Cargo.lock' ELSE 'py' || {_AT} || '/poetry.lock' END AS lockfile, 'Pack_' || (CAST(floor(p_partkey / 2) AS BIGINT) % 300) AS name, {_V2} || '.0' AS version FROM part)"""


@query(f"SELECT lockfile, name, version FROM {_LOCKED}")
def locked_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[[package]] blocks."""
    return D.lock_packages(X.PART_LOCKS.df(spark, sf_dir)).select("lockfile", "name", "version")


@query(f"SELECT name, string_agg(version, ', ' ORDER BY version) AS resolved FROM (SELECT DISTINCT name, version FROM {_LOCKED} WHERE ends_with(lockfile, 'Cargo.lock')) GROUP BY name")
def crate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All locked versions of a crate."""
    return D.crate_versions(D.lock_packages(X.PART_LOCKS.df(spark, sf_dir)).where("lockfile LIKE '%Cargo.lock'"))


_NAMES = X.PART_NAMES


@query(f"SELECT name, lower(regexp_replace(name, '[-_.]+', '-', 'g')) AS key FROM {_NAMES.sql()}")
def python_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normal form of package names."""
    return _NAMES.df(spark, sf_dir).select("name", python_name(F.col("name")).alias("key"))


@query(f"SELECT lower(replace(name, '_', '-')) AS name, first(version ORDER BY lockfile, p_partkey) AS resolved FROM {_LOCKED} WHERE ends_with(lockfile, 'poetry.lock') GROUP BY 1")
def python_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first locked version of a normal name."""
    return D.python_versions(D.lock_packages(X.PART_LOCKS.df(spark, sf_dir)).where("lockfile LIKE '%poetry.lock'"))


@query("SELECT * FROM (VALUES ('@scope/a', '^1.0.0', '1.1.4'), ('@scope/a', '^1.1.0', '1.1.4'), ('left-pad', '^1.3.0', '1.3.0')) t(name, declared, version)")
def yarn_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every spec of an entry, split at the last @."""
    return D.yarn_specs(X.YARN_LINES.df(spark)).select("name", "declared", "version")


@query("SELECT * FROM (VALUES ('', 'react', '18.2.0'), ('web', 'jest', '29.7.0')) t(importer, name, version)")
def npm_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: packages of workspaces; copies nested in other packages are none."""
    return D.package_lock_rows(X.PACKAGE_LOCK.df(spark)).select("importer", "name", "version")


@query("SELECT * FROM (VALUES ('web', 'jest', '29', '29.7.0'), ('web', 'react', '>=18', '18.2.0'), ('web/deep/er', 'react', '>=18', '18.2.0'), ('other', 'jest', '29', NULL), ('other', 'none', '1', NULL), ('other', 'left-pad', '*', '1.3.0'), ('other', '@scope/a', '^1.1.0', '1.1.4')) t(importer, name, declared, resolved)")
def npm_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importer, exact spec, root, only version."""
    needs = X.NPM_NEEDS.df(spark).withColumnRenamed("folder", "importer")
    needs = needs.unionByName(spark.createDataFrame([("other", "left-pad", "*"), ("other", "@scope/a", "^1.1.0")], "importer string, name string, declared string"))
    return D.npm_resolution(needs, D.package_lock_rows(X.PACKAGE_LOCK.df(spark)), D.yarn_specs(X.YARN_LINES.df(spark)))


@query(f"""SELECT n.folder, n.ecosystem, (SELECT arg_max(l.lock_folder, length(l.lock_folder)) FROM {X.PART_LOCK_FOLDERS.sql()} l WHERE l.ecosystem = n.ecosystem AND (l.lock_folder = '' OR n.folder = l.lock_folder OR starts_with(n.folder, l.lock_folder || '/'))) AS lock_folder FROM {X.PART_NEEDS.sql()} n""")
def nearest_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest folder above with a lock of the ecosystem."""
    return D.nearest_lock(X.PART_NEEDS.df(spark, sf_dir), X.PART_LOCK_FOLDERS.df(spark, sf_dir))


_R = X.PART_COMPONENTS.sql()


def _seen(c: str) -> str:
    return f"coalesce((SELECT string_agg(v, '|' ORDER BY a) FROM (SELECT {c} AS v, min((manifest, kind, declared)) AS a FROM {_R} r WHERE r.ecosystem = o.ecosystem AND r.name = o.name AND coalesce({c}, '') <> '' GROUP BY {c})), '')"


@query(f"SELECT ecosystem, name, count(*)::BIGINT AS manifests, min(manifest) AS example_manifest, first(source ORDER BY manifest) FILTER (WHERE source IS NOT NULL) AS source, {_seen('kind')} AS kinds, {_seen('declared')} AS declareds, {_seen('resolved')} AS resolveds FROM {_R} o GROUP BY ecosystem, name")
def component_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per component."""
    return D.roll_up(X.PART_COMPONENTS.df(spark, sf_dir))


@query(f"SELECT ecosystem, count(DISTINCT name)::BIGINT AS components FROM {_R} GROUP BY ecosystem")
def components_per_ecosystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each ecosystem."""
    return X.PART_COMPONENTS.df(spark, sf_dir).groupBy("ecosystem").agg(F.countDistinct("name").alias("components"))


@query("""SELECT p_brand AS ecosystem, p_type AS name, count(*)::BIGINT AS manifests, min(p_partkey) AS first_part, count(DISTINCT l_suppkey)::BIGINT AS suppliers, min(p_size)::INT AS least_size, max(p_size)::INT AS largest_size
FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand, p_type""")
def part_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18 over whole tables: parts as components, lines as manifests."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("ecosystem"), F.col("p_type").alias("name")).agg(F.count("*").alias("manifests"), F.min("p_partkey").alias("first_part"), F.countDistinct("l_suppkey").alias("suppliers"), F.min("p_size").alias("least_size"), F.max("p_size").alias("largest_size"))


@query("""WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS region, n_name AS nation, count(DISTINCT c_custkey)::BIGINT AS customers, count(o_orderkey)::BIGINT AS orders, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
FROM n JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name""")
def declared_vs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment by left joins, over whole tables."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("k"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.countDistinct("c_custkey").alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"), F.min("a").alias("first_order"), F.max("b").alias("last_order"))


_B = "CAST(body AS JSON)"


@query(f"""SELECT ecosystem, name, CASE ecosystem WHEN 'npm' THEN coalesce(json_extract_string({_B}, '$.latest'), json_extract_string({_B}, '$."dist-tags".latest')) WHEN 'pypi' THEN json_extract_string({_B}, '$.info.version') WHEN 'crates' THEN coalesce(json_extract_string({_B}, '$.crate.max_stable_version'), json_extract_string({_B}, '$.crate.newest_version'))
WHEN 'go' THEN json_extract_string({_B}, '$.Version') WHEN 'maven' THEN json_extract_string({_B}, '$.response.docs[0].latestVersion') WHEN 'swift' THEN ltrim(json_extract_string({_B}, '$.tag_name'), 'v') END AS latest FROM {X.PART_ANSWERS.sql()}""")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version in saved registry answers."""
    return D.latest_version(X.PART_ANSWERS.df(spark, sf_dir))


_DATES = X.ORDER_RELEASES.sql()


@query(f"""WITH e AS (SELECT (SELECT published FROM {_DATES} WHERE version = '1.2.0') AS a, (SELECT published FROM {_DATES} WHERE version = '1.5.0') AS b)
SELECT (epoch_us(b) - epoch_us(a)) // 86400000000 AS days_between, (SELECT count(*) FROM {_DATES} WHERE NOT regexp_matches(version, '[-+][A-Za-z]') AND published > a AND published <= b)::BIGINT AS stable_releases_since FROM e""")
def stable_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and stable releases from the shipped version to the latest."""
    return D.stable_since(X.ORDER_RELEASES.df(spark, sf_dir), "1.2.0", "1.5.0")


@query(f"SELECT ecosystem, name, CASE WHEN row_number() OVER (ORDER BY ecosystem, name) <= 2 THEN 'looked up' ELSE 'over the cap' END AS state FROM (SELECT DISTINCT ecosystem, name FROM {_R})")
def lookup_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two components are looked up, the others marked."""
    known = X.PART_COMPONENTS.df(spark, sf_dir).select("ecosystem", "name").distinct()
    rows = running(known, [], ["ecosystem", "name"], sums={"n": F.lit(1)}, name="lookups")
    return rows.select("ecosystem", "name", F.when(F.col("n") <= 2, "looked up").otherwise("over the cap").alias("state"))
