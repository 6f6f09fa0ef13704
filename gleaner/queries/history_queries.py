"""Histories: A03-A15, J11, J17, W01-W03, W08, P33-P35, X04. events stand for a log: user_id is the author, event_type the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import classify as C
from gleaner.functions.numbers import tenths
from gleaner.operators import history as H
from gleaner.plans import signatures as S
from gleaner.queries import fixtures as X
from gleaner.queries.base import query, quote, string_list, table


def _per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("user_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("n"))


_USERS = "WITH c AS (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"


@query(_USERS + " SELECT user_id, n::BIGINT AS n, ((2000 * n + sum(n) OVER ()) // (2 * sum(n) OVER ()))::DOUBLE / 10 AS share_pct FROM c ORDER BY n DESC, user_id LIMIT 10")
def author_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most active and their shares; exact halves go up. A top-k report."""
    return H.author_shares(_per_user(spark, sf_dir), "user_id", "n")


@query(_USERS + """, t AS (SELECT sum(n) AS t FROM c), b AS (SELECT n FROM c ORDER BY n DESC LIMIT 5)
SELECT (SELECT count(*) FROM c)::BIGINT AS distinct_authors, (SELECT count(*) FROM c WHERE n >= 10)::BIGINT AS with_10_plus, (SELECT count(*) FROM c WHERE n = 1)::BIGINT AS with_one,
((2000 * (SELECT max(n) FROM c) + t) // (2 * t))::DOUBLE / 10 AS top1_share_pct, ((2000 * (SELECT sum(n) FROM b) + t) // (2 * t))::DOUBLE / 10 AS top5_share_pct FROM t""")
def author_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of authors and the shares of the first and first five."""
    return H.author_totals(_per_user(spark, sf_dir), "user_id", "n")


@query(_USERS + ", r AS (SELECT row_number() OVER (ORDER BY n DESC, user_id) AS r, sum(n) OVER (ORDER BY n DESC, user_id ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER () AS t FROM c) SELECT coalesce(min(r), 0)::BIGINT AS bus_factor FROM r WHERE 2 * run >= t")
def bus_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest authors with half of all."""
    return H.bus_factor(_per_user(spark, sf_dir), "user_id", "n")


@query("SELECT strftime(ts, '%G') || '-W' || strftime(ts, '%V') AS week, count(*)::BIGINT AS commits, count(*) FILTER (WHERE event_type <> 'refund')::BIGINT AS non_merge FROM events GROUP BY 1")
def weekly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per ISO week; 'refund' stands for merges."""
    return H.weekly(table(spark, sf_dir, "events"), F.col("ts"), F.col("event_type") == "refund")


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS commits FROM events WHERE user_id IS NOT NULL GROUP BY event_type ORDER BY 2 DESC, 1 LIMIT 20")
def event_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users per type. A top-k report."""
    return H.hotspots(table(spark, sf_dir, "events").where("user_id IS NOT NULL"), "user_id", "event_type")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, min(ts) AS first FROM events GROUP BY 1), g AS (SELECT first, epoch_us(first) - epoch_us(lag(first) OVER (ORDER BY first)) AS gap FROM d)
SELECT count(*)::BIGINT AS days, sum(gap)::DOUBLE / (count(gap) * 3600000000)::DOUBLE AS mean_gap_hours, median(gap) / 3600000000::DOUBLE AS median_gap_hours, count(*) FILTER (WHERE gap < 86400000000)::BIGINT AS gaps_under_24h FROM g""")
def first_event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the first events of days."""
    firsts = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").cast("timestamp").alias("date")).select(F.concat(F.lit("v1."), F.date_format("day", "yyyyMMdd")).alias("tag"), "date")
    return H.release_gaps(firsts).select(F.col("version_tags").alias("days"), "mean_gap_hours", "median_gap_hours", "gaps_under_24h")


_KEY = "CASE WHEN regexp_matches(lower(trim(email)), '^(?:\\d+\\+)?([^@]+)@users\\.noreply\\.github\\.com$') THEN 'github:' || regexp_extract(lower(trim(email)), '^(?:\\d+\\+)?([^@]+)@users\\.noreply\\.github\\.com$', 1) WHEN trim(email) <> '' THEN lower(trim(email)) ELSE lower(trim(name)) END"
_BOT = "(" + " OR ".join(f"regexp_matches(name, {quote('(?i)' + p)})" for p in S.BOT_AUTHORS) + ")"
_C = X.LOG.sql()


@query(f"WITH n AS (SELECT {_KEY} AS author_key, name, count(*) AS n FROM {_C} WHERE NOT merge GROUP BY ALL) SELECT author_key, first(name ORDER BY n DESC, name) AS author, sum(n)::BIGINT AS commits FROM n GROUP BY author_key")
def commits_per_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits by author key, with the most frequent name."""
    return H.commits_per_author(X.LOG.df(spark, sf_dir))


_MERGED = f"""WITH o AS (SELECT {_KEY} AS k, name FROM {_C} WHERE NOT merge), v AS (SELECT k, name AS v FROM o UNION SELECT k, substr(k, 8) FROM o WHERE starts_with(k, 'github:')),
f AS (SELECT DISTINCT k, regexp_replace(lower(v), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS f FROM v), s AS (SELECT f FROM f WHERE length(f) >= 4 GROUP BY f HAVING count(*) > 1), w AS (SELECT k, min(f) AS g FROM f JOIN s USING (f) GROUP BY k)"""
_OWNED = "SELECT o.k AS author_key, coalesce('group:' || max(w.g), o.k) AS owner, count(*)::BIGINT AS commits FROM o LEFT JOIN w ON w.k = o.k GROUP BY o.k"
_OWNERS = _MERGED + ", m AS (" + _OWNED + "), c AS (SELECT owner, sum(commits) AS n FROM m GROUP BY owner)"


@query(_MERGED + " " + _OWNED)
def merged_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that share a folded name or handle, each with the first group that claims it."""
    return H.merged_identities(X.LOG.df(spark, sf_dir))


@query(_OWNERS + ", r AS (SELECT row_number() OVER (ORDER BY n DESC, owner) AS r, sum(n) OVER (ORDER BY n DESC, owner ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER () AS t FROM c) SELECT coalesce(min(r), 0)::BIGINT AS bus_factor FROM r WHERE 2 * run >= t")
def merged_bus_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bus factor of merged identities."""
    owners = H.merged_identities(X.LOG.df(spark, sf_dir)).groupBy("owner").agg(F.sum("commits").alias("n"))
    return H.bus_factor(owners, "owner", "n")


@query(f"SELECT CASE WHEN NOT contains(email, '@') THEN '(none)' WHEN ends_with(lower(string_split(email, '@')[-1]), 'users.noreply.github.com') THEN 'users.noreply.github.com' ELSE lower(string_split(email, '@')[-1]) END AS domain, count(*)::BIGINT AS commits FROM {_C} WHERE NOT merge AND NOT {_BOT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def email_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of people. A top-k report."""
    return H.email_domains(X.LOG.df(spark, sf_dir))


@query(f"SELECT name, count(*)::BIGINT AS commits FROM {_C} WHERE NOT merge AND {_BOT} GROUP BY name ORDER BY 2 DESC, 1 LIMIT 10")
def automated_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bots by name. A top-k report."""
    return H.automated_authors(X.LOG.df(spark, sf_dir))


@query(f"SELECT strftime(substr(date, 1, 19)::TIMESTAMP, '%G') || '-W' || strftime(substr(date, 1, 19)::TIMESTAMP, '%V') AS week, count(*)::BIGINT AS commits, count(*) FILTER (WHERE NOT merge)::BIGINT AS non_merge FROM {_C} GROUP BY 1")
def weekly_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: weeks of the authors' own clocks."""
    return H.weekly(X.LOG.df(spark, sf_dir), F.to_timestamp_ntz(F.substring("date", 1, 19)), F.col("merge"))


@query(f"WITH f AS (SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(subject, {quote(C.FIX_SUBJECT)})) AS k FROM {_C} WHERE NOT merge) SELECT n::BIGINT AS non_merge, k::BIGINT AS fixes, ((2000 * k + n) // (2 * n))::DOUBLE / 10 AS share_pct FROM f")
def fix_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of fixes."""
    return H.fix_share(X.LOG.df(spark, sf_dir))


_TAGS = f"(SELECT * FROM {X.LOG_TAGS.sql()} WHERE regexp_matches(tag, {quote(C.VERSION_TAG)}))"


@query(f"""WITH g AS (SELECT tag, date, epoch_us(date) - epoch_us(lag(date) OVER (ORDER BY date, tag)) AS gap FROM {_TAGS})
SELECT count(*)::BIGINT AS version_tags, first(tag ORDER BY date, tag) AS first_tag, last(tag ORDER BY date, tag) AS last_tag, sum(gap)::DOUBLE / (count(gap) * 3600000000)::DOUBLE AS mean_gap_hours, median(gap) / 3600000000::DOUBLE AS median_gap_hours, count(*) FILTER (WHERE gap < 86400000000)::BIGINT AS gaps_under_24h FROM g""")
def release_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version tags and the gaps between them."""
    return H.release_gaps(X.LOG_TAGS.df(spark, sf_dir))


@query(f"SELECT tag, date FROM {_TAGS} ORDER BY date DESC, tag DESC LIMIT 10")
def recent_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten tags. A top-k report."""
    return H.recent_tags(X.LOG_TAGS.df(spark, sf_dir)).select("tag", F.col("date").cast("timestamp_ntz").alias("date"))


@query(f"SELECT path, count(DISTINCT sha)::BIGINT AS commits FROM {X.LOG_PATHS.sql()} GROUP BY path ORDER BY 2 DESC, 1 LIMIT 20")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits per path, once each. A top-k report."""
    return H.hotspots(X.LOG_PATHS.df(spark, sf_dir), "sha", "path")


_LABELS = " UNION ALL ".join(f"SELECT sha, {quote(n)} AS label FROM v WHERE " + " OR ".join(f"regexp_matches(v, {quote('(?i)' + p)})" for p in ps) for n, ps in S.ASSISTANTS)
_TRAILERS = f"WITH v AS (SELECT sha, unnest(regexp_extract_all(body, '(?im)^\\s*(?:Co-authored-by)\\s*:\\s*(.+)$', 1)) AS v FROM {_C} WHERE NOT merge), l AS (SELECT DISTINCT sha, label FROM ({_LABELS}))"


@query(_TRAILERS + " SELECT label, count(*)::BIGINT AS commits FROM l GROUP BY label")
def assistant_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits per assistant named in a trailer, each label once per commit."""
    return H.assistants(X.LOG.df(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("commits"))


@query(_TRAILERS + f", n AS (SELECT count(*) AS n FROM {_C} WHERE NOT merge) SELECT (SELECT count(DISTINCT sha) FROM l)::BIGINT AS with_trailer, ((2000 * (SELECT count(DISTINCT sha) FROM l) + n) // (2 * n))::DOUBLE / 10 AS share_pct FROM n")
def assistant_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of commits with a trailer."""
    some = H.assistants(X.LOG.df(spark, sf_dir)).agg(F.countDistinct("sha").alias("with_trailer"))
    every = X.LOG.df(spark, sf_dir).where("NOT merge").agg(F.count("*").alias("n"))
    return some.join(F.broadcast(every)).select("with_trailer", tenths(F.col("with_trailer"), F.col("n")).alias("share_pct"))


@query(f"SELECT p AS prefix, count(*)::BIGINT AS merges FROM (SELECT subject, unnest({string_list(S.BRANCH_PREFIXES)}) AS p FROM {_C} WHERE merge) WHERE contains(subject, p) GROUP BY p")
def branch_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of assistants' branches."""
    return H.branch_merges(X.LOG.df(spark, sf_dir))


_TREE = X.Beside(X.Fixture("path string", [("AGENTS.md",), ("pkg/CLAUDE.md",), ("pkg/.claude/settings.json",), (".cursor/rules",), ("MYAGENTS.md",), (".kirox/a",)]), "path")


@query(f"SELECT DISTINCT i AS item FROM (SELECT path, unnest({string_list(S.INSTRUCTION_FILES)}) AS i FROM {_TREE.sql()}) WHERE CASE WHEN ends_with(i, '/') THEN starts_with(path, i) OR contains(path, '/' || i) ELSE path = i OR ends_with(path, '/' || i) END")
def instruction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction files in a tree."""
    return H.instruction_files(_TREE.df(spark, sf_dir))


@query(f"SELECT first(date ORDER BY date::TIMESTAMPTZ, sha) AS first, last(date ORDER BY date::TIMESTAMPTZ, sha) AS last FROM {_C}")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last date as written, by instant."""
    return H.first_and_last(X.LOG.df(spark, sf_dir))


@query("SELECT event_type, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS least, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in JSON."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min(k).alias("least"), F.max(k).alias("most"), F.sum(k).alias("total"))
