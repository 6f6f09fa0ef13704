"""Files of a tree: S01-S04, P01-P18, P24, A01, A02, A20, A21, T01, T02; documents stand for files where a whole table is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import classify as C
from gleaner.functions import text as T
from gleaner.operators import licenses as L
from gleaner.plans import signatures as S
from gleaner.queries import fixtures as X
from gleaner.queries.base import query, quote, string_list, table

#: Documents as files: the source as top folder, every tenth below tests, the language as suffix.
_PATH_SQL = "source || '/' || CASE WHEN doc_id % 10 = 3 THEN 'tests' ELSE 'src' END || '/doc_' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.ts' WHEN 'de' THEN '.go' ELSE '.md' END"


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 10 == 3, "tests").otherwise("src")
    ending = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".ts").when(F.col("lang") == "de", ".go").otherwise(".md")
    return docs.select("doc_id", "source", "lang", "text", F.concat("source", F.lit("/"), folder, F.lit("/doc_"), "doc_id", ending).alias("path"))


_LINES = "(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)"
_NONBLANK = "len(list_filter(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '\\s', '', 'g') <> ''))"
_KIND_SQL = f"CASE WHEN regexp_matches(string_split(path, '/')[-1], {quote(C.GENERATED_NAME)}) OR regexp_matches(substr(text, 1, 800), {quote(C.GENERATED_MARK)}) THEN 'generated' WHEN regexp_matches(path, {quote(C.TEST_FOLDER)}) OR regexp_matches(string_split(path, '/')[-1], {quote(C.TEST_NAME)}) THEN 'test' ELSE 'source' END"
_FILES_SQL = f"WITH f AS (SELECT *, {_KIND_SQL} AS kind, {_LINES} AS lines, {_NONBLANK} AS non_blank FROM (SELECT doc_id, source, lang, text, {_PATH_SQL} AS path FROM documents))"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return document_files(spark, sf_dir).withColumns({"kind": C.source_kind(F.col("path"), t), "lines": T.line_count(t), "non_blank": T.non_blank_count(t)})


@query(_FILES_SQL + " SELECT k.kind, count(f.kind)::BIGINT AS files, coalesce(sum(lines), 0)::BIGINT AS lines, coalesce(sum(non_blank), 0)::BIGINT AS non_blank FROM (VALUES ('source'), ('test'), ('generated')) k(kind) LEFT JOIN f ON f.kind = k.kind GROUP BY k.kind")
def line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, lines and non-blank lines of each kind; kinds without files have 0."""
    kinds = spark.createDataFrame([("source",), ("test",), ("generated",)], "kind string")
    sums = _counted(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("non_blank").alias("non_blank"))
    return F.broadcast(kinds).join(sums, "kind", "left").na.fill(0)  # three kinds


_PIVOT = "count(*)::BIGINT AS files, sum(CASE WHEN kind = 'source' THEN lines ELSE 0 END)::BIGINT AS source, sum(CASE WHEN kind = 'test' THEN lines ELSE 0 END)::BIGINT AS test, sum(CASE WHEN kind = 'generated' THEN lines ELSE 0 END)::BIGINT AS generated"


def _pivot(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("files"), *[F.sum(F.when(F.col("kind") == k, F.col("lines")).otherwise(0)).alias(k) for k in ("source", "test", "generated")])


@query(_FILES_SQL + f" SELECT string_split(path, '/')[1] AS area, {_PIVOT} FROM f GROUP BY 1")
def lines_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by area, one column per kind."""
    return _pivot(_counted(spark, sf_dir).withColumn("area", C.area(F.col("path"))), "area")


@query(_FILES_SQL + f" SELECT CASE WHEN ends_with(path, '.py') THEN 'Python' WHEN ends_with(path, '.ts') THEN 'TypeScript' ELSE 'Go' END AS language, {_PIVOT} FROM f WHERE NOT ends_with(path, '.md') GROUP BY 1")
def lines_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by language; files of an unknown suffix are left out."""
    return _pivot(_counted(spark, sf_dir).withColumn("language", C.language(F.col("path"))).where("language IS NOT NULL"), "language")


@query(_FILES_SQL + " SELECT path, lines::BIGINT AS lines FROM f WHERE kind = 'source' ORDER BY lines DESC, path DESC LIMIT 15")
def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 largest source files, paths descending on ties. A top-k report."""
    return _counted(spark, sf_dir).where("kind = 'source'").orderBy(F.desc("lines"), F.desc("path")).limit(15).select("path", "lines")


def _has(parts: str, names) -> str:
    return f"len(list_intersect({parts}, {string_list(names)})) > 0"


_PARTS, _NAME = "string_split(path, '/')[:-2]", "string_split(path, '/')[-1]"
_SUFFIX = f"lower(regexp_extract({_NAME}, '^.+(\\.[^.]*[^.])$', 1))"
_TEST = f"(regexp_matches(path, {quote(C.TEST_FOLDER)}) OR regexp_matches({_NAME}, {quote(C.TEST_NAME)}))"


@query(f"""SELECT path, {_TEST} AS is_test, {_has(_PARTS, S.SKIP_DIRS)} AS skipped, {_has(_PARTS, S.VENDORED_DIRS)} AND NOT {_has(_PARTS, [n for n in S.SKIP_DIRS if n not in S.VENDORED_DIRS])} AS vendored,
CASE WHEN {_has(_PARTS, S.SKIP_DIRS)} THEN 'dependencies_or_build' WHEN {_TEST} THEN 'tests' WHEN {_has(_PARTS, C.DOC_FOLDERS)} OR list_contains({string_list(C.DOC_SUFFIXES)}, {_SUFFIX}) THEN 'docs' ELSE 'source_and_other' END AS removed_kind,
CASE WHEN regexp_matches(upper({_NAME}), '^(README|CHANGELOG|CHANGES|HISTORY|RELEASES)') THEN 0 WHEN {_has(_PARTS, C.DOC_FOLDERS)} THEN 1 ELSE 2 END AS doc_priority,
CASE WHEN len(string_split(path, '/')) > 2 THEN array_to_string(string_split(path, '/')[1:2], '/') ELSE '(root)' END AS area2
FROM {X.ANY_PATHS.sql()}""")
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths are."""
    p = F.col("path")
    return X.ANY_PATHS.df(spark, sf_dir).select("path", C.is_test_path(p).alias("is_test"), C.is_skipped(p).alias("skipped"), C.is_vendored(p).alias("vendored"), C.removed_kind(p).alias("removed_kind"), C.doc_priority(p).alias("doc_priority"), C.area(p, 2).alias("area2"))


_CODE = f"(list_contains({string_list(C.CODE_SUFFIXES)}, {_SUFFIX}) OR list_contains({string_list(C.MANIFESTS)}, {_NAME}) OR starts_with({_NAME}, '.env'))"
_DOC = f"list_contains({string_list(C.SCAN_DOC_SUFFIXES)}, {_SUFFIX})"


@query(f"""SELECT path, CASE WHEN list_contains({string_list(C.SCAN_LOCKFILES)}, {_NAME}) OR regexp_matches({_NAME}, '(\\.min\\.js|\\.map)$') THEN '' WHEN {_DOC} THEN '' WHEN NOT {_CODE} THEN '' WHEN {_TEST} THEN 'test' ELSE 'scan' END AS code_scan,
(list_contains({string_list(C.TELEMETRY_SUFFIXES)}, {_SUFFIX}) OR lower({_NAME}) IN ('package.json', 'podfile', 'gemfile', 'cargo.toml', 'go.mod')) AND NOT regexp_matches(lower({_NAME}), '(\\.min\\.js|\\.map)$') AND lower({_NAME}) NOT IN ('package-lock.json', 'pnpm-lock.yaml', 'yarn.lock') AND NOT {_TEST} AS telemetry_scan,
NOT {_has(_PARTS, [n for n in S.SKIP_DIRS if n not in ("build", "release", "releases")])} AND NOT list_contains({string_list(C.SECURITY_LOCKFILES)}, {_NAME}) AND (list_contains({string_list(C.SECURITY_SUFFIXES)}, {_SUFFIX}) OR {_NAME} IN ('AndroidManifest.xml', 'Info.plist')) AND NOT {_TEST} AND NOT regexp_matches(path, '(?i)(^|/)(examples?|samples?|demos?)(/|$)') AS security_scan,
regexp_matches(path, '(?i)(^|/)([^/]*\\.(pem|key|p12|pfx|keystore|jks)|id_(rsa|ecdsa|ed25519)[^/]*|[^/]*service[-_]?account[^/]*\\.json)$') OR (regexp_matches({_NAME}, '(?i)^\\.env') AND NOT regexp_matches({_NAME}, '(?i)^\\.env(\\.example|\\.sample|\\.template)$')) AS forbidden
FROM {X.ANY_PATHS.sql()}""")
def scan_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files each scan reads, and files that must not be there."""
    p = F.col("path")
    return X.ANY_PATHS.df(spark, sf_dir).select("path", C.code_eligible(p).alias("code_scan"), C.telemetry_eligible(p).alias("telemetry_scan"), C.security_eligible(p).alias("security_scan"), p.rlike(C.FORBIDDEN_FILE).alias("forbidden"))


def _family_sql(text: str) -> str:
    low = f"regexp_replace(lower({text}), '\\s+', ' ', 'g')"
    first = f"coalesce(list_filter(regexp_split_to_array({text}, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '\\s', '', 'g') <> '')[1], '')"
    title = f"regexp_replace(lower(trim(regexp_replace(trim({first}), '^#+', ''))), '^the ', '')"
    one = [f"WHEN starts_with({title}, {quote(ps[0])}) THEN {quote(f)}" for f, _, ps in S.LICENSES if f not in ("Proprietary or custom", "BSD-2-Clause", "BSD-3-Clause")]
    two = ["WHEN " + " AND ".join(f"contains({low}, {quote(p)})" for p in ps) + f" THEN {quote(f)}" for f, _, ps in S.LICENSES]
    return f"CASE {' '.join(one + two)} WHEN contains({low}, 'source-available') OR contains({low}, 'source available') OR contains({low}, 'license key') THEN 'Proprietary or custom' ELSE 'Unrecognized' END"


@query(f"SELECT family, count(*)::BIGINT AS documents FROM (SELECT {_family_sql('text')} AS family FROM documents) GROUP BY family")
def license_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the license that their text names."""
    return L.families(table(spark, sf_dir, "documents").select("text")).groupBy("family").agg(F.count("*").alias("documents"))


LICENSE_TEXTS = X.Fixture(
    "path string, text string",
    [
        ("LICENSE", "MIT License\n\nCopyright (c) 2024 Someone <a@b.test>\n\nPermission is hereby granted, free of charge, to any person"),
        ("ee/LICENSE", "Licensed to holders of a license key. Source code is shown. All rights reserved."),
        ("server/COPYING", "# The GNU General Public License\n\nVersion 3, 29 June 2007"),
        ("lib/LICENSE.txt", "Mozilla Public License Version 2.0\nsee GNU Affero General Public License"),
        ("NOTICE", "Apache License, Version 2.0"),
        ("LICENSING.md", "We use AGPL: gnu affero general public license"),
        ("old/LICENSE", "nothing known"),
        ("LICENSE.py", "code"),
        ("bsd/LICENSE", "Redistribution and use in source and binary forms; Neither the name of X"),
    ],
)
LICENSE_DOCUMENTS = X.Beside(LICENSE_TEXTS, "path")
_LIC = f"(SELECT path, text, {_NAME} AS name, {_family_sql('text')} AS family FROM {LICENSE_DOCUMENTS.sql()} WHERE regexp_matches({_NAME}, {quote(C.LICENSE_NAME)}) AND NOT list_contains({string_list(S.NOT_LICENSE_SUFFIXES)}, {_SUFFIX}))"
_TYPE = "CASE WHEN starts_with(lower(name), 'licensing') THEN 'licensing note' WHEN starts_with(lower(name), 'notice') THEN 'notice' WHEN starts_with(lower(name), 'patents') THEN 'patents' ELSE 'license' END"
_COPYRIGHT = "substr(regexp_replace(trim(list_filter(regexp_split_to_array(text, '\\r\\n|\\n|\\r')[1:60], lambda x: regexp_matches(x, '(?i)copyright\\s*(\\(c\\)|©|\\d{4})'))[1]), '<[^>]*@[^>]*>', '<email>', 'g'), 1, 160)"
_GPL = "CASE WHEN family = 'GPL' THEN CASE WHEN contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), 'version 3') THEN '3' WHEN contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), 'version 2') THEN '2' END END"
_KIND = "CASE family " + " ".join(f"WHEN {quote(f)} THEN {quote(k)}" for f, k, _ in S.LICENSES) + " ELSE 'read in full' END"


@query(f"SELECT path, {_TYPE} AS file_type, family, {_KIND} AS kind, {_GPL} AS version, {_COPYRIGHT} AS copyright FROM {_LIC}")
def license_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License files with type, family, version and copyright line."""
    rows = L.families(LICENSE_DOCUMENTS.df(spark, sf_dir).where(C.is_license_file(F.col("path"))))
    return rows.select("path", C.license_file_type(C.file_name(F.col("path"))).alias("file_type"), "family", "kind", C.gpl_version(F.col("text"), F.col("family")).alias("version"), C.copyright_line(F.col("text")).alias("copyright"))


@query(f"""WITH l AS (SELECT * FROM {_LIC} WHERE {_TYPE} = 'license'), f AS (SELECT list_distinct(list(family) FILTER (WHERE family <> 'Unrecognized')) AS f, coalesce(bool_or(NOT contains(path, '/')), false) AS root FROM l)
SELECT array_to_string(list_sort(list_intersect(f, {string_list(S.COPYLEFT)})), ',') AS copyleft, array_to_string(list_sort(list_intersect(f, {string_list(S.SOURCE_AVAILABLE)})), ',') AS source_available, len(f) > 1 AS more_than_one_family, NOT root AS missing_root_license FROM f""")
def license_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags over license files."""
    return L.flags(L.families(LICENSE_DOCUMENTS.df(spark, sf_dir).where(C.is_license_file(F.col("path")))))


_SPDX = X.Fixture("path string, text string", [("src/a.c", "/* SPDX-License-Identifier: MIT */\nint x;"), ("src/b.py", "# SPDX-License-Identifier: Apache-2.0 OR MIT\n"), ("lib/c.js", "// SPDX-License-Identifier: MIT"), ("top.sh", "#!/bin/sh\n# none"), ("x.html", "<!-- SPDX-License-Identifier: GPL-3.0-only -->")])
_SPDX_FILES = X.Beside(_SPDX, "path")


@query(f"""WITH s AS (SELECT trim(regexp_extract(substr(text, 1, 4000), '(?m)SPDX-License-Identifier:[ \\t]*([A-Za-z0-9.+\\-() ]+?)[ \\t]*(?:\\*/|-->|#|$)', 1)) AS identifier, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '(root)' END AS area FROM {_SPDX_FILES.sql()})
SELECT 'all' AS scope, '' AS name, identifier, count(*)::BIGINT AS files FROM s WHERE identifier <> '' GROUP BY identifier UNION ALL SELECT 'area', area, identifier, count(*) FROM s WHERE identifier <> '' GROUP BY area, identifier""")
def spdx_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in headers, by identifier and by top folder."""
    return L.spdx_headers(_SPDX_FILES.df(spark, sf_dir))
