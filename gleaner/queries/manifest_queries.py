"""Further formats and adapters: F03, F04, F08-F12, F14, F15, F17, F21, F23, F25, F26, J05-J07, J16, A34, A35, P19, P39, P52, S04, S05, S10, S11, S14, S19, S23, S24, S26-S30, D07.

Where a format is nested text, the SQL states the rows that the fixture must give.
"""

from __future__ import annotations

import gzip
import plistlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.classify import LICENSE_NAME
from gleaner.operators import manifests as M
from gleaner.plans import signatures as S
from gleaner.queries import fixtures as X
from gleaner.queries.base import query, quote, table
from gleaner.sources import saved

FILES = X.Fixture(
    "manifest string, content string",
    [
        ("ios/Package.swift", 'let p = Package(dependencies: [.package(url: "https://x.test/a/Alpha.git", from: "1.2.0"), .package(url: "https://x.test/b/beta", .upToNextMinor(from: "2.0.1")), .package(path: "../local"), .package(url: "https://x.test/c/gamma", "1.0.0"..<"2.0.0")])'),
        ("ios/App.xcodeproj/project.pbxproj", 'repositoryURL = "https://x.test/d/Delta.git";\n requirement = {\n kind = upToNextMajorVersion;\n minimumVersion = 3.1.0;\n };\n repositoryURL = "https://x.test/e/eps"; requirement = { kind = branch; branch = main; };'),
        ("mac/project.yml", "name: App\npackages:\n  Zeta:\n    url: https://x.test/z/Zeta\n    exactVersion: 1.4.0\n  Eta:\n    url: https://x.test/h/eta\n    revision: 0123456789abcdef # pinned\n  Loc:\n    path: ../l\ntargets:\n  A:\n    type: app\n"),
        ("ios/Package.resolved", '{"pins": [{"identity": "Alpha", "location": "https://x.test/a/Alpha.git", "state": {"version": "1.2.9"}}, {"identity": "rev", "state": {"revision": "abcdef0123456789"}}], "version": 2}'),
        ("vendor/lib/sbom.json", '{"bomFormat": "CycloneDX", "metadata": {"component": {"name": "libz", "version": "1.3", "purl": "pkg:generic/libz@1.3"}}}'),
        ("vendor/two/sbom.json", '{"spdxVersion": "SPDX-2.3", "documentDescribes": ["A"], "packages": [{"SPDXID": "A", "name": "two", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:cargo/two@0.1"}]}, {"SPDXID": "B", "name": "no"}]}'),
        ("py/pyproject.toml", '[project]\nname = "x"\ndependencies = [\n  "flask>=2 ; python_version > \'3\'",\n  "rich",\n]\n[project.optional-dependencies]\ndev = ["pytest>=7"]\nweb = ["uvicorn[standard]==0.2"]\n[tool.poetry.dependencies]\npython = "^3.9"\nhttpx = { version = "0.27", extras = ["a"] }\n[tool.poetry.group.lint.dependencies]\nruff = "*"\n'),
    ],
)
_ROWS = """(VALUES ('ios/Package.swift', 'swift', 'alpha', 'from 1.2.0', 'prod', NULL, 'https://x.test/a/Alpha.git'), ('ios/Package.swift', 'swift', 'beta', 'upToNextMinor 2.0.1', 'prod', NULL, 'https://x.test/b/beta'), ('ios/Package.swift', 'swift', 'gamma', '1.0.0..<2.0.0', 'prod', NULL, 'https://x.test/c/gamma'),
('ios/App.xcodeproj/project.pbxproj', 'swift', 'delta', 'from 3.1.0', 'prod', NULL, 'https://x.test/d/Delta.git'), ('ios/App.xcodeproj/project.pbxproj', 'swift', 'eps', 'branch main', 'prod', NULL, 'https://x.test/e/eps'),
('mac/project.yml', 'swift', 'zeta', 'exact 1.4.0', 'prod', NULL, 'https://x.test/z/Zeta'), ('mac/project.yml', 'swift', 'eta', 'revision 0123456789ab', 'prod', NULL, 'https://x.test/h/eta'),
('ios/Package.resolved', 'swift', 'alpha', 'pinned', 'prod', '1.2.9', 'https://x.test/a/Alpha.git'), ('ios/Package.resolved', 'swift', 'rev', 'pinned', 'prod', 'abcdef012345', NULL),
('vendor/lib/sbom.json', 'vendored', 'libz', '1.3', 'vendored', '1.3', NULL), ('vendor/two/sbom.json', 'crates', 'two', 'unknown', 'vendored', NULL, NULL),
('py/pyproject.toml', 'pypi', 'flask', '>=2', 'prod', NULL, NULL), ('py/pyproject.toml', 'pypi', 'rich', '*', 'prod', NULL, NULL), ('py/pyproject.toml', 'pypi', 'pytest', '>=7', 'dev', NULL, NULL), ('py/pyproject.toml', 'pypi', 'uvicorn', '==0.2', 'optional', NULL, NULL), ('py/pyproject.toml', 'pypi', 'httpx', '0.27', 'prod', NULL, NULL), ('py/pyproject.toml', 'pypi', 'ruff', '*', 'dev', NULL, NULL)
) t(manifest, ecosystem, name, declared, kind, resolved, source)"""


@query(f"SELECT * FROM {_ROWS}")
def parsed_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested formats."""
    return M.parsed_files(FILES.df(spark))


@query(f"WITH r AS (SELECT * FROM {_ROWS} WHERE ecosystem = 'swift'), p AS (SELECT name, resolved FROM r WHERE resolved IS NOT NULL) SELECT r.manifest, r.name, coalesce(r.resolved, p.resolved, CASE WHEN starts_with(r.declared, 'exact ') THEN substr(r.declared, 7) END) AS resolved FROM r LEFT JOIN p ON p.name = r.name")
def swift_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned version by name, else a literal exact version."""
    rows = M.parsed_files(FILES.df(spark)).where("ecosystem = 'swift'")
    pins = rows.where("resolved IS NOT NULL").groupBy("name").agg(F.max("resolved").alias("pin"))
    exact = F.when(F.col("declared").startswith("exact "), F.expr("substring(declared, 7)"))
    return rows.join(pins, "name", "left").select("manifest", "name", F.coalesce("resolved", "pin", exact).alias("resolved"))


_PNPM = X.Fixture("manifest string, content string", [("pnpm-lock.yaml", "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      react:\n        specifier: ^18\n        version: 18.2.0(x@1)\n  web:\n    devDependencies:\n      '@s/a':\n        specifier: 1\n        version: 1.0.3\n      own:\n        specifier: workspace:*\n        version: link:../own\npackages:\n  x: y\n"), ("old/pnpm-lock.yaml", "dependencies:\n  lodash: 4.17.21\n")])


@query("SELECT * FROM (VALUES ('pnpm-lock.yaml', '', 'react', '18.2.0'), ('pnpm-lock.yaml', 'web', '@s/a', '1.0.3'), ('old/pnpm-lock.yaml', '', 'lodash', '4.17.21')) t(manifest, importer, name, version)")
def pnpm_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """importers of both versions of the format."""
    return M.pnpm_rows(_PNPM.df(spark))


_CATALOG = X.Fixture("lockfile string, line long, text string", [("gradle/libs.versions.toml", i, t) for i, t in enumerate(["[versions]", 'ktor = "2.3.0"', 'room = { strictly = "2.6.1" }', "[libraries]", 'ktor-core = { module = "io.ktor:ktor-core", version.ref = "ktor" }', 'room_rt = { group = "androidx.room", name = "room-runtime", version.ref = "room" }', 'junit = "junit:junit:4.13.2"', 'bom = { module = "a.b:bom" }'], 1)])
_GRADLE = X.Fixture("manifest string, line long, text string", [("app/build.gradle.kts", i, t) for i, t in enumerate(["dependencies {", '  implementation("com.x:y:1.0.+")', "  implementation(libs.ktor.core)", "  kapt(libs.room.rt)", "  testImplementation(libs.junit)", "  api(platform(libs.bom))", "  debugImplementation 'com.d:e:2.1@aar'", "}"], 1)])


@query("SELECT * FROM (VALUES ('ktor.core', 'io.ktor:ktor-core', '2.3.0'), ('room.rt', 'androidx.room:room-runtime', '2.6.1'), ('junit', 'junit:junit', '4.13.2'), ('bom', 'a.b:bom', NULL)) t(alias, coordinate, version)")
def gradle_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of a catalog."""
    return M.gradle_catalog(_CATALOG.df(spark))


@query("""SELECT * FROM (VALUES ('app/build.gradle.kts', 'prod', 'com.x:y', '1.0.+', NULL, NULL), ('app/build.gradle.kts', 'prod', 'io.ktor:ktor-core', '2.3.0', 'ktor.core', '2.3.0'), ('app/build.gradle.kts', 'build', 'androidx.room:room-runtime', '2.6.1', 'room.rt', '2.6.1'),
('app/build.gradle.kts', 'dev', 'junit:junit', '4.13.2', 'junit', '4.13.2'), ('app/build.gradle.kts', 'prod', 'a.b:bom', 'managed (BOM or platform)', 'bom', NULL)  ) t(manifest, kind, name, declared, alias, resolved)""")
def gradle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """components of build files."""
    return M.gradle_rows(_GRADLE.df(spark), M.gradle_catalog(_CATALOG.df(spark)))


_PLIST = plistlib.dumps({"com.apple.security.app-sandbox": True, "com.apple.security.cs.allow-jit": True, "com.apple.security.device.camera": True, "off": False}).decode()
_ENTITLEMENTS = X.Fixture("manifest string, content string", [("a.entitlements", _PLIST), ("b.entitlements", "not a list")])


@query(f"SELECT * FROM (VALUES ('a.entitlements', 'entitlements', 'com.apple.security.app-sandbox,com.apple.security.cs.allow-jit,com.apple.security.device.camera'), ('a.entitlements', 'app sandbox', 'true'), ('a.entitlements', 'risky entitlement com.apple.security.cs.allow-jit', {quote(S.RISKY_ENTITLEMENTS['com.apple.security.cs.allow-jit'])}), ('a.entitlements', 'privacy-sensitive entitlements', 'com.apple.security.device.camera'), ('b.entitlements', 'entitlements file could not be parsed', NULL)) t(manifest, signal, detail)")
def entitlement_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property lists."""
    return M.entitlement_rows(_ENTITLEMENTS.df(spark))


_LICENSED = X.Fixture("path string, content string", [("package.json", '{"license": "MIT"}'), ("x/composer.json", '{"licenses": ["A", "B"]}'), ("bad/package.json", "{"), ("Cargo.toml", '[package]\nlicense = "Apache-2.0"\n'), ("pyproject.toml", '[project]\nlicense = {text = "BSD"}\n'), ("setup.cfg", "[metadata]\nlicense = GPL\n"), ("g.gemspec", "s.license = 'Ruby'"), ("p.podspec", "s.license = { :type => 'ISC' }"), ("none/Cargo.toml", "[package]\n")])


@query("SELECT * FROM (VALUES ('package.json', 'MIT'), ('x/composer.json', '[\"A\",\"B\"]'), ('bad/package.json', NULL), ('Cargo.toml', 'Apache-2.0'), ('pyproject.toml', 'BSD'), ('setup.cfg', 'GPL'), ('g.gemspec', 'Ruby'), ('p.podspec', 'ISC'), ('none/Cargo.toml', NULL)) t(path, license)")
def manifest_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """licenses that manifests declare."""
    return _LICENSED.df(spark).select("path", M.manifest_license(F.col("path"), F.col("content")).alias("license"))


_LOCKS = X.Fixture("name string, content string", [("package-lock.json", '{"packages": {"": {}, "node_modules/a": {}, "node_modules/b": {}}}'), ("Cargo.lock", "[[package]]\nname = 1\n[[package]]\n"), ("go.sum", "a v1 h1:x\na v1/go.mod h1:y\nb v2 h1:z\n"), ("Podfile.lock", "PODS:\n  - A (1)\n  - B (2):\n    - A\n\nDEPENDENCIES:\n  - A\n"), ("yarn.lock", 'a@^1:\n  version "1"\n"@b/c@^2", "@b/c@^3":\n  version "2"\n'), ("other.lock", "x"), ("pnpm-lock.yaml", "lockfileVersion: 9\npackages:\n\n  '@a/b@1.0.0':\n    resolution: x\n  /c@2.0.0:\n    dev: true\nsnapshots:\n  d@1: {}\n"), ("Package.resolved", '{"identity": "a", "package": "b"}'), ("composer.lock", '{"packages": [{"name": "a/b"}, {"name":  "c/d"}]}'), ("gradle.lockfile", "# head\na:b:1=x\n"), ("Gemfile.lock", "GEM\n  specs:\n    rake (13)\n    rack (3)\n      x (1)\n")])


@query("SELECT name, entries::BIGINT AS entries FROM (VALUES ('package-lock.json', 2), ('Cargo.lock', 2), ('go.sum', 2), ('Podfile.lock', 2), ('yarn.lock', 2), ('other.lock', 0), ('pnpm-lock.yaml', 2), ('Package.resolved', 1), ('composer.lock', 2), ('gradle.lockfile', 2), ('Gemfile.lock', 2)) t(name, entries)")
def lock_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages in lock files."""
    return _LOCKS.df(spark).select("name", M.lock_entries(F.col("name"), F.col("content")).alias("entries"))


_URLS = X.Fixture("ecosystem string, name string, source string", [("npm", "@scope/a", None), ("pypi", "flask", None), ("crates", "serde", None), ("go", "github.com/Azure/Go", None), ("maven", "g.h:art", None), ("swift", "x", "git@github.com:own/repo.git"), ("swift", "y", "https://gitlab.test/a/b")])


@query("""SELECT * FROM (VALUES ('@scope/a', 'https://registry.npmjs.org/-/package/@scope%2Fa/dist-tags', NULL), ('flask', 'https://pypi.org/pypi/flask/json', NULL), ('serde', 'https://crates.io/api/v1/crates/serde', NULL), ('github.com/Azure/Go', 'https://proxy.golang.org/github.com/!azure/!go/@latest', NULL),
('g.h:art', 'https://search.maven.org/solrsearch/select?q=g%3A%22g.h%22%20AND%20a%3A%22art%22&rows=1&wt=json', NULL), ('x', NULL, 'own/repo'), ('y', NULL, NULL)) t(name, url, repository)""")
def registry_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addresses of registry answers, and repositories of sources."""
    return _URLS.df(spark).select("name", M.registry_url(F.col("ecosystem"), F.col("name")).alias("url"), M.repository_of(F.col("source")).alias("repository"))


_XML = X.Fixture("xml string", [("<metadata><latest>2.0-beta</latest><release>1.9</release></metadata>",), ("<latest>3</latest>",), ("<x/>",)])


@query(f"SELECT xml, coalesce(nullif(regexp_extract(xml, '<release>([^<]+)</release>', 1), ''), nullif(regexp_extract(xml, '<latest>([^<]+)</latest>', 1), '')) AS latest FROM {_XML.sql()}")
def maven_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in repository metadata."""
    return _XML.df(spark).select("xml", M.maven_latest(F.col("xml")).alias("latest"))


_FOUND = X.Fixture("url string, body string", [("/search/issues?q=x", '{"total_count": 77}'), ("/repos/o/r", '{"full_name": "o/r"}')])


@query(f"SELECT url, json_extract_string(body, '$.total_count')::BIGINT AS found FROM {_FOUND.sql()} WHERE json_extract_string(body, '$.total_count') IS NOT NULL")
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of saved searches."""
    found = F.get_json_object("body", "$.total_count").cast("long")
    return _FOUND.df(spark).select("url", found.alias("found")).where("found IS NOT NULL")


_SIGNALS = X.Fixture("file string, signal string, text string", [("package.json", "Electron dependency", ""), ("app/main.js", "renderer sandbox disabled", ""), ("App.xcodeproj/project.pbxproj", "hardened runtime in Xcode project", "ENABLE_HARDENED_RUNTIME = NO"), ("App.xcodeproj/project.pbxproj", "entitlements file in Xcode project", "")])
_FIRES = f"""WITH s AS (SELECT * FROM {_SIGNALS.sql()}) SELECT 'Electron app without fuses' AS signal FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM s WHERE signal = 'Electron dependency') AND NOT EXISTS (SELECT 1 FROM s WHERE signal = 'fuses configured')
UNION ALL SELECT 'Xcode project without the hardened runtime' FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM s WHERE ends_with(file, '.pbxproj')) AND NOT EXISTS (SELECT 1 FROM s WHERE signal = 'hardened runtime in Xcode project' AND contains(text, 'YES'))
UNION ALL SELECT 'Xcode project without an entitlements file' FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM s WHERE ends_with(file, '.pbxproj')) AND NOT EXISTS (SELECT 1 FROM s WHERE signal = 'entitlements file in Xcode project')"""


@query(_FIRES)
def absent_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings from what is missing, by one conditional aggregate."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    sig, xcode = F.col("signal"), F.col("file").endswith(".pbxproj")
    row = _SIGNALS.df(spark).agg(has(sig == "Electron dependency").alias("e"), has(sig == "fuses configured").alias("f"), has(xcode).alias("x"), has((sig == "hardened runtime in Xcode project") & F.col("text").contains("YES")).alias("h"), has(sig == "entitlements file in Xcode project").alias("t"))
    found = F.array_compact(F.array(F.when(F.col("e") & ~F.col("f"), "Electron app without fuses"), F.when(F.col("x") & ~F.col("h"), "Xcode project without the hardened runtime"), F.when(F.col("x") & ~F.col("t"), "Xcode project without an entitlements file")))
    return row.select(F.explode(found).alias("signal"))


_TERMS = X.Fixture("path string, text string", [("CONTRIBUTING.md", "Sign the CLA first\nclass\nAdd Signed-off-by lines\nour trademark"), ("DCO", "Developer Certificate of Origin")])


@query(f"WITH l AS (SELECT path, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)contributor license agreement|\\bcla\\b|developer certificate of origin|signed-off-by|\\bdco\\b|trademark'))[1:6]) AS mention FROM {_TERMS.sql()}) SELECT path, substr(trim(mention), 1, 160) AS mention FROM l")
def contribution_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six lines on contribution terms."""
    found = F.slice(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"(?i)contributor license agreement|\bcla\b|developer certificate of origin|signed-off-by|\bdco\b|trademark")), 1, 6)
    return _TERMS.df(spark).select("path", F.explode(found).alias("x")).select("path", F.substring(F.trim("x"), 1, 160).alias("mention"))


_CLONES = X.Fixture("repo string, shallow boolean, partial boolean, lfs boolean", [("a", True, False, True), ("b", False, False, False), ("c", False, True, False)])


@query(f"SELECT repo, array_to_string(list_filter([CASE WHEN shallow THEN 'shallow' END, CASE WHEN partial THEN 'partial' END, CASE WHEN lfs THEN 'lfs' END], lambda x: x IS NOT NULL), ',') AS warnings FROM {_CLONES.sql()}")
def clone_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a copy of a repository lacks."""
    parts = [F.when(F.col(c), c) for c in ("shallow", "partial", "lfs")]
    return _CLONES.df(spark).select("repo", F.array_join(F.array_compact(F.array(*parts)), ",").alias("warnings"))


_BLOBS = X.Fixture("ord long, sha string, path string, text string", [(1, "s1", "a.txt", "mail me@corp.test"), (2, "s1", "b.txt", "mail me@corp.test"), (3, "s2", "a.txt", "clean"), (4, "s3", "c.txt", "x@example.com y@dev.test")])


@query(f"WITH b AS (SELECT sha, arg_min(path, ord) AS path, arg_min(text, ord) AS text FROM {_BLOBS.sql()} GROUP BY sha), e AS (SELECT sha, path, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS a FROM b) SELECT sha, path, substr(a, 1, 4) || '... (' || length(a) || ' chars)' AS masked FROM e WHERE NOT regexp_matches(a, '(?i)@example\\.(?:com|org|net)$')")
def history_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every blob once, under its first path."""
    blobs = _BLOBS.df(spark).groupBy("sha").agg(F.min_by("path", "ord").alias("path"), F.min_by("text", "ord").alias("text"))
    rows = blobs.select("sha", "path", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0)).alias("a")).where(~F.col("a").rlike(r"(?i)@example\.(?:com|org|net)$"))
    return rows.select("sha", "path", T.mask(F.col("a")).alias("masked"))


_TREE = X.Fixture("path string, text string", [("enterprise/a.ts", "x"), ("ee/LICENSE", "\nCommercial terms\nmore"), ("packages/premium/b.ts", "y"), ("packages/core/c.ts", "z"), ("src/sub/LICENSE.md", "MIT"), ("a/b/c/d/paid/x", "deep"), ("node_modules/ee/x", "skip")])


@query("""SELECT * FROM (VALUES ('enterprise', 'name', NULL), ('ee', 'name and own license', 'Commercial terms'), ('packages/premium', 'name', NULL), ('src/sub', 'own license', 'MIT')) t(folder, reason, first_line)""")
def paid_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders down to three levels that are named like a paid layer or have a license file; the SQL states the rows."""
    p = F.col("path")
    parts = F.split(p, "/")
    rows = _TREE.df(spark).where(p.contains("/")).withColumn("n", F.size(parts) - 1)
    rows = rows.where(~F.arrays_overlap(F.slice(parts, 1, F.least("n", F.lit(3))), F.array(*[F.lit(x) for x in S.SKIP_DIRS])))
    up = rows.select("path", "text", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.least("n", F.lit(3))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("i", "folder"))
    own = (F.col("i") + 1 == F.col("n")) & F.substring_index(p, "/", -1).rlike(LICENSE_NAME) & ~F.lower(p).rlike(r"\.(py|js|ts)$")
    first = F.get(F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), 0)
    per = up.groupBy("folder").agg(F.bool_or(own).alias("own"), F.min(F.when(own, F.substring(first, 1, 100))).alias("first_line"))
    named = F.lower(F.substring_index("folder", "/", -1)).isin(*S.PAID_FOLDERS)
    return per.where(named | F.col("own")).select("folder", F.when(named & F.col("own"), "name and own license").when(named, "name").otherwise("own license").alias("reason"), "first_line")


@query("SELECT * FROM (VALUES ('gz', 'page one'), ('plain', 'page two'), ('broken', NULL)) t(name, body)")
def decoded_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed bodies inflated, others unchanged (the broken one is told by a null here); the SQL states the rows."""
    rows = spark.createDataFrame([("gz", bytearray(gzip.compress(b"page one"))), ("plain", bytearray(b"page two")), ("broken", bytearray(b"\x1f\x8bxx"))], "name string, content binary")
    body = M.inflated(F.col("content"))
    return rows.select("name", body.alias("b")).select("name", F.when(F.hex("b").startswith("1F8B"), None).otherwise(F.decode("b", "UTF-8")).alias("body"))


@query("SELECT * FROM (VALUES ('text', false, 'ab'), ('zero', true, NULL), ('late zero', false, 'xx')) t(name, is_bin, head)")
def byte_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zero byte among the first 8000 makes a file binary; limits are in bytes; the SQL states the rows."""
    rows = spark.createDataFrame([("text", bytearray(b"abc")), ("zero", bytearray(b"a\0b")), ("late zero", bytearray(b"x" * 9000 + b"\0"))], "name string, content binary")
    binary = T.is_binary(F.col("content"))
    return rows.select("name", binary.alias("is_bin"), F.when(~binary, T.decoded(F.col("content"), 2)).alias("head"))


_LOG = X.Fixture("record string", [("s1\x1fAnn\x1fa@x.test\x1f2024-01-01T00:00:00+00:00\x1fp1\x1fFirst\x1fbody one",), ("s2\x1fBob\x1fb@x.test\x1f2024-02-01T00:00:00+00:00\x1fp1 p2\x1fMerge\x1f",), ("broken\x1frow",)])


@query("SELECT * FROM (VALUES ('s1', 'Ann', false, 'First', 'body one'), ('s2', 'Bob', true, 'Merge', '')) t(sha, name, merge, subject, body)")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a saved log; more than one parent is a merge, short records are dropped; the SQL states the rows."""
    return saved.commit_records(_LOG.df(spark)).select("sha", "name", "merge", "subject", "body")


@query(f"SELECT sha FROM {X.LOG.sql()} WHERE date::TIMESTAMPTZ >= TIMESTAMPTZ '1995-01-02 00:00:00+00' AND date::TIMESTAMPTZ < TIMESTAMPTZ '1995-03-09 00:00:00+00'")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits since and until two instants."""
    at = F.to_timestamp("date")
    return X.LOG.df(spark, sf_dir).where((at >= F.lit("1995-01-02T00:00:00Z").cast("timestamp")) & (at < F.lit("1995-03-09T00:00:00Z").cast("timestamp"))).select("sha")


_REVISIONS = X.Fixture("rev string, path string, content string", [("v1", "a.md", "one"), ("v2", "a.md", "two"), ("v1", "gone.md", "x")])


@query(f"SELECT a.path, a.content AS old, coalesce(b.content, '') AS new FROM {_REVISIONS.sql()} a LEFT JOIN {_REVISIONS.sql()} b ON b.rev = 'v2' AND b.path = a.path WHERE a.rev = 'v1'")
def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at two revisions; a missing file is empty."""
    rows = _REVISIONS.df(spark)
    new = rows.where("rev = 'v2'").select("path", F.col("content").alias("new"))
    return rows.where("rev = 'v1'").join(new, "path", "left").select("path", F.col("content").alias("old"), F.coalesce("new", F.lit("")).alias("new"))


@query("SELECT event_type, '{\"event_type\":\"' || event_type || '\",\"n\":' || count(*) || '}' AS json FROM events GROUP BY event_type")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON text."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return rows.select("event_type", F.to_json(F.struct("event_type", "n")).alias("json"))


_HISTORY = X.Fixture("path string, commit string, date timestamp, subject string", [("LICENSE", "c1", "2020-01-01 00:00:00", "add"), ("LICENSE", "c2", "2023-01-01 00:00:00", "relicense"), ("sub/LICENSE", "c3", "2021-01-01 00:00:00", "x")])


@query(f"SELECT path, commit, row_number() OVER (PARTITION BY path ORDER BY date DESC)::INT AS place FROM {_HISTORY.sql()} WHERE NOT contains(path, '/')")
def license_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of root license files, the newest first."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy(F.desc("date"))
    return _HISTORY.df(spark).where(~F.col("path").contains("/")).select("path", "commit", F.row_number().over(w).alias("place"))


