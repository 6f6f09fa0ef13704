"""Removals: X05, X08, J12-J14, J19, U02-U05, U08, W09, W10, A29-A32, T10, T11, S09."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import classify as C
from gleaner.functions.text import normal
from gleaner.operators import removals as R
from gleaner.plans import signatures as S
from gleaner.queries import fixtures as X
from gleaner.queries.base import query, quote, string_list, table

_OLD, _NEW, _CH = X.PATHS_OLD.sql(), X.PATHS_NEW.sql(), X.PATH_CHANGES.sql()


def _folders(t: str) -> str:
    return f"SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS folder FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM {t})"


_GONE = f"g AS ({_folders(_OLD)} EXCEPT {_folders(_NEW)}), o AS (SELECT folder FROM g WHERE CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') ELSE '' END NOT IN (SELECT folder FROM g))"


@query(f"WITH {_GONE} SELECT folder FROM o")
def outermost_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vanished folders whose parent is still there."""
    return R.outermost_gone(X.PATHS_OLD.df(spark, sf_dir), X.PATHS_NEW.df(spark, sf_dir))


_KINDS = f"CASE WHEN len(list_intersect(string_split(folder, '/'), {string_list(S.SKIP_DIRS)})) > 0 THEN 'dependencies_or_build' WHEN regexp_matches(folder || '/x', {quote(C.TEST_FOLDER)}) THEN 'tests' WHEN len(list_intersect(string_split(folder, '/'), {string_list(C.DOC_FOLDERS)})) > 0 THEN 'docs' ELSE 'source_and_other' END"


@query(f"""WITH {_GONE}, f AS (SELECT folder, count(*) AS files FROM o JOIN {_OLD} p ON starts_with(p.path, o.folder || '/') GROUP BY folder),
m AS (SELECT folder, CASE WHEN ends_with(new, substr(old, length(folder) + 1)) THEN left(new, length(new) - length(old) + length(folder)) ELSE regexp_replace(new, '/?[^/]*$', '') END AS target FROM o JOIN {_CH} c ON c.status = 'R' AND starts_with(c.old, o.folder || '/')),
t AS (SELECT folder, first(target ORDER BY n DESC, target) AS target, sum(n) AS renamed FROM (SELECT folder, target, count(*) AS n FROM m GROUP BY ALL) GROUP BY folder)
SELECT folder, files::BIGINT AS files, coalesce(renamed, 0)::BIGINT AS renamed, CASE WHEN 2 * coalesce(renamed, 0) >= files THEN 'moved' ELSE 'removed' END AS fate, CASE WHEN 2 * coalesce(renamed, 0) >= files THEN target END AS destination, CASE WHEN 2 * coalesce(renamed, 0) < files THEN {_KINDS} END AS kind FROM f LEFT JOIN t USING (folder)""")
def vanished_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moved or removed."""
    return R.vanished_folders(X.PATHS_OLD.df(spark, sf_dir), X.PATHS_NEW.df(spark, sf_dir), X.PATH_CHANGES.df(spark, sf_dir))


@query(f"""SELECT (SELECT count(*) FROM {_OLD})::BIGINT AS at_old, (SELECT count(*) FROM {_NEW})::BIGINT AS at_new, (SELECT count(*) FROM {_CH} WHERE status = 'D')::BIGINT AS deleted, (SELECT count(*) FROM {_CH} WHERE status = 'R')::BIGINT AS renamed,
(SELECT count(*) FROM (SELECT path FROM {_NEW} EXCEPT SELECT path FROM {_OLD} EXCEPT SELECT new FROM {_CH} WHERE status = 'R'))::BIGINT AS added""")
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at both revisions."""
    return R.file_totals(X.PATHS_OLD.df(spark, sf_dir), X.PATHS_NEW.df(spark, sf_dir), X.PATH_CHANGES.df(spark, sf_dir))


_PARTS = "string_split(old, '/')[:-2]"


@query(f"""SELECT CASE WHEN len(list_intersect({_PARTS}, {string_list(S.SKIP_DIRS)})) > 0 THEN 'dependencies_or_build' WHEN regexp_matches(old, {quote(C.TEST_FOLDER)}) OR regexp_matches(string_split(old, '/')[-1], {quote(C.TEST_NAME)}) THEN 'tests'
WHEN len(list_intersect({_PARTS}, {string_list(C.DOC_FOLDERS)})) > 0 OR regexp_matches(lower(old), '\\.(md|mdx|markdown|rst|adoc)$') THEN 'docs' ELSE 'source_and_other' END AS kind, CASE WHEN contains(old, '/') THEN string_split(old, '/')[1] ELSE '(root)' END AS top, count(*)::BIGINT AS files FROM {_CH} WHERE status = 'D' GROUP BY 1, 2""")
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted files by kind and top folder."""
    rows = X.PATH_CHANGES.df(spark, sf_dir).where("status = 'D'")
    return rows.groupBy(C.removed_kind(F.col("old")).alias("kind"), C.top_folder(F.col("old")).alias("top")).agg(F.count("*").alias("files"))


@query("SELECT file, line::BIGINT AS line, level, title FROM (VALUES ('docs/manual.md', 6, 2, 'Old *part*'), ('docs/manual.md', 7, 3, '[Link](x) here')) t(file, line, level, title)")
def removed_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings the new version lacks; renumbered ones are none. The SQL states the rows."""
    return R.removed_headings(X.DOC_VERSIONS.df(spark))


_SIDE = "SELECT DISTINCT conv_id, key FROM (SELECT conv_id, role, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g'))) AS key FROM conversations) WHERE length(key) >= 12 AND role"


@query(f"""WITH o AS ({_SIDE} = 'user'), n AS ({_SIDE} <> 'user'), b AS (SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, o.key AS ok, n.key AS nk FROM o FULL JOIN n ON o.conv_id = n.conv_id AND o.key = n.key)
SELECT conv_id, count(*) FILTER (WHERE ok IS NOT NULL AND nk IS NOT NULL)::BIGINT AS kept, count(*) FILTER (WHERE nk IS NULL)::BIGINT AS removed, count(*) FILTER (WHERE ok IS NULL)::BIGINT AS added FROM b GROUP BY conv_id""")
def conversation_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a conversation's user turns against its other turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.split("text", "\n", -1)).alias("x")).withColumn("key", normal(F.col("x")))
    return R.line_diff(rows.where("role = 'user'"), rows.where("role <> 'user'"), "conv_id", "key", 12)


@query("""WITH b AS (SELECT DISTINCT lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g'))) AS key FROM benchmark), d AS (SELECT source, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g'))) AS key FROM documents)
SELECT source, count(DISTINCT key)::BIGINT AS keys, count(DISTINCT key) FILTER (WHERE key IN (SELECT key FROM b))::BIGINT AS in_benchmark FROM d WHERE length(key) >= 12 GROUP BY source""")
def benchmark_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U04 over documents: distinct lines of each source, and those that benchmark items hold too."""
    keys = lambda df, *c: df.select(*c, F.explode(F.split("text", "\n", -1)).alias("x")).select(*c, normal(F.col("x")).alias("key")).where("length(key) >= 12").distinct()
    own = keys(table(spark, sf_dir, "documents"), "source")
    known = keys(table(spark, sf_dir, "benchmark")).withColumn("hit", F.lit(1))
    return own.join(known, "key", "left").groupBy("source").agg(F.count("*").alias("keys"), F.count("hit").alias("in_benchmark"))


@query("SELECT pair, line::BIGINT AS line, fate, before, after, ratio::DOUBLE AS ratio FROM (VALUES ('p', 2, 'reworded', 'The plan costs 10 dollars a month', 'The plan costs 12 dollars a month', 0.97), ('p', 5, 'removed', 'This sentence goes away entirely', NULL, NULL)) t(pair, line, fate, before, after, ratio)")
def reworded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old lines that are gone or reworded; the SQL states the rows."""
    return R.reworded(X.PAGE_PAIR.df(spark))


@query()
def reworded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14 over all conversations: first turns as old text, the others as new. Not expressible in SQL."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair"), F.when(F.col("turn") == 0, "old").otherwise("new").alias("side"), "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return R.reworded(rows.select(F.col("pair").cast("string").alias("pair"), "side", (F.col("turn") * 1_000_000 + F.col("pos")).alias("line"), "text"))


_KEYED = "regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(title, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`]', '', 'g'), '\\s+', ' ', 'g'))), '^(?:§\\s*)?\\d+(?:\\.\\d+)*\\.?\\s+', '')"
_HEADING = "'^ {0,3}(#{1,6})[ \\t]+(.+?)(?:[ \\t]+#+)?[ \\t]*$'"


@query(f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), l AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1)::BIGINT AS line FROM d),
b AS (SELECT doc_id, 'old' AS side, line, CASE WHEN line % 3 = 1 THEN '## ' || line || '. ' || x ELSE x END AS x FROM l UNION ALL SELECT doc_id, 'new', line, CASE WHEN line % 3 = 1 THEN '## ' || (line + 1) || '. ' || x ELSE x END FROM l WHERE (line + doc_id) % 4 <> 0),
w AS (SELECT *, regexp_matches(x, '^ {{0,3}}(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(x, '^ {{0,3}}(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, side ORDER BY line) % 2 AS code FROM b),
h AS (SELECT doc_id, side, line, length(regexp_extract(x, {_HEADING}, 1))::INT AS level, trim(regexp_extract(x, {_HEADING}, 2)) AS title FROM w WHERE NOT fence AND code = 0 AND regexp_matches(x, {_HEADING})), k AS (SELECT *, {_KEYED} AS key FROM h)
SELECT doc_id, line, level, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY line) AS n FROM k WHERE side = 'old' AND key <> '' AND NOT EXISTS (SELECT 1 FROM k o WHERE o.side = 'new' AND o.doc_id = k.doc_id AND o.key = k.key)) WHERE n = 1""")
def lost_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X08, J13, U08, W09 over all documents, every third line a numbered heading, against versions that lack every fourth line and count on."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).withColumn("line", (F.col("pos") + 1).cast("long"))
    numbered = lambda n: F.when(F.col("line") % 3 == 1, F.concat(F.lit("## "), F.col("line") + n, F.lit(". "), "text")).otherwise(F.col("text"))
    old = lines.select("file", F.lit("old").alias("side"), "line", numbered(0).alias("text"))
    both = old.unionByName(lines.where("(line + file) % 4 <> 0").select("file", F.lit("new").alias("side"), "line", numbered(1).alias("text")))
    return R.removed_headings(both).withColumnRenamed("file", "doc_id")
