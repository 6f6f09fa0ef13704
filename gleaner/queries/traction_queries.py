"""Traction: P12, P13, J15, A16, A17, A36, W04-W07, F24, A38, P38, S29."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import classify as C
from gleaner.functions.numbers import tenths
from gleaner.operators import traction as R
from gleaner.operators.running import running
from gleaner.plans import signatures as S
from gleaner.queries import fixtures as X
from gleaner.queries.base import query, quote, table

_A = X.RELEASE_FILES.sql()
_PLATFORM = "CASE " + " ".join(f"WHEN ends_with(lower(name), {quote(e)}) THEN {quote(p)}" for e, p in S.INSTALLERS.items()) + " " + " ".join(f"WHEN regexp_matches(name, {quote(r)}) THEN {quote(p)}" for p, r in S.PLATFORM_HINTS) + " ELSE 'any' END"
_CATEGORY = f"CASE WHEN regexp_matches(name, {quote(C.UPDATE_CHECK)}) THEN 'update-check' WHEN regexp_matches(name, {quote(C.UPDATE_DELTA)}) THEN 'update-delta' WHEN regexp_matches(name, {quote(C.CHECKSUM)}) THEN 'checksum-or-signature' WHEN " + " OR ".join(f"ends_with(lower(name), {quote(e)})" for e in S.INSTALLERS) + f" THEN 'installer' WHEN regexp_matches(name, {quote(C.PACKAGE)}) THEN 'package' WHEN regexp_matches(name, {quote(C.ARCHIVE)}) THEN CASE WHEN ({_PLATFORM}) = 'macos' THEN 'update-payload-or-archive' ELSE 'archive' END ELSE 'other' END"
_VERSIONED = f"(regexp_matches(name, {quote(C.VERSION_IN_NAME)}) OR (tag <> '' AND contains(name, ltrim(tag, 'v'))))"
_CLASSED = f"(SELECT *, {_CATEGORY} AS category, CASE WHEN lower(name) = 'latest.yml' THEN 'windows' ELSE {_PLATFORM} END AS platform, {_VERSIONED} AS versioned FROM {_A})"
_SPLIT = f"(SELECT *, CASE WHEN category <> 'installer' THEN category WHEN versioned THEN 'installer-versioned-name' ELSE 'installer-stable-name' END AS kind FROM {_CLASSED})"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.classified(X.RELEASE_FILES.df(spark, sf_dir))


@query(f"SELECT name, category, platform, versioned FROM {_CLASSED}")
def asset_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, platform and version of release files."""
    return _rows(spark, sf_dir).select("name", "category", "platform", "versioned")


@query(f"SELECT kind, sum(downloads)::BIGINT AS downloads FROM {_SPLIT} GROUP BY kind")
def downloads_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads by category."""
    return R.downloads(_rows(spark, sf_dir), "kind")


@query(f"SELECT platform, kind, sum(downloads)::BIGINT AS downloads FROM {_SPLIT} GROUP BY platform, kind")
def downloads_by_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads by platform and category."""
    return R.downloads(_rows(spark, sf_dir), "platform", "kind")


@query(f"WITH t AS (SELECT sum(downloads) AS t, sum(downloads) FILTER (WHERE category = 'installer') AS i, sum(downloads) FILTER (WHERE category = 'update-check') AS u FROM {_CLASSED}) SELECT t::BIGINT AS total, ((2000 * i + t) // (2 * t))::DOUBLE / 10 AS installers_share_pct, ((2000 * u + t) // (2 * t))::DOUBLE / 10 AS update_checks_share_pct FROM t")
def download_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of installers and update checks."""
    s = lambda c: F.sum(F.when(F.col("category") == c, F.col("downloads")).otherwise(0))
    row = _rows(spark, sf_dir).agg(F.sum("downloads").alias("total"), s("installer").alias("i"), s("update-check").alias("u"))
    return row.select("total", tenths(F.col("i"), F.col("total")).alias("installers_share_pct"), tenths(F.col("u"), F.col("total")).alias("update_checks_share_pct"))


_NOW = "2024-02-11 00:00:00"
_WINDOWS = f"""p AS (SELECT tag, min(published_at) AS published_at, sum(CASE WHEN category = 'installer' THEN downloads ELSE 0 END)::BIGINT AS installers, sum(CASE WHEN category = 'installer' AND NOT versioned THEN downloads ELSE 0 END)::BIGINT AS installers_stable_name, sum(CASE WHEN category = 'update-check' THEN downloads ELSE 0 END)::BIGINT AS update_checks FROM {_CLASSED} GROUP BY tag HAVING count(*) FILTER (WHERE category = 'update-check') > 0),
w AS (SELECT *, greatest((epoch_us(coalesce(lead(published_at) OVER (ORDER BY published_at, tag), TIMESTAMP '{_NOW}')) - epoch_us(published_at)) / 86400000000.0, 1.0 / 24) AS days, row_number() OVER (ORDER BY published_at DESC, tag DESC) AS back FROM p)"""


@query(f"WITH {_WINDOWS} SELECT tag, days, installers, installers_stable_name, update_checks, installers / days AS installers_per_day, update_checks / days AS update_checks_per_day FROM w")
def release_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time each release was the latest, and downloads per day in it."""
    return R.release_windows(_rows(spark, sf_dir), F.lit(_NOW).cast("timestamp")).drop("published_at", "back")


@query(f"WITH {_WINDOWS}, d AS (SELECT *, floor(days * 100 + 0.5)::BIGINT AS d FROM w), c AS (SELECT * FROM d WHERE back > 1 AND d >= 50 ORDER BY back LIMIT 5), s AS (SELECT sum(d) / 100 AS d, sum(update_checks) AS c FROM c) SELECT c / d AS checks_per_day, floor(c / d * 4 / 24 + 0.5)::BIGINT AS copies FROM s")
def running_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies running at once at a check every four hours."""
    return R.running_copies(R.release_windows(_rows(spark, sf_dir), F.lit(_NOW).cast("timestamp")), 4.0)


@query(f"""WITH l AS (SELECT *, lag(star) OVER (ORDER BY star, starred_at) AS b, lag(starred_at) OVER (ORDER BY star, starred_at) AS s FROM {X.STAR_POINTS.sql()})
SELECT star - b AS stars, (epoch_us(starred_at) - epoch_us(s)) / 86400000000.0 AS days, (star - b) / ((epoch_us(starred_at) - epoch_us(s)) / 86400000000.0) AS stars_per_day FROM l WHERE star > b AND starred_at > s""")
def star_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars a day between milestones."""
    return R.star_pace(X.STAR_POINTS.df(spark, sf_dir)).select("stars", "days", "stars_per_day")


@query("SELECT * FROM (VALUES (41, 5, 1), (41, 5, 11), (41, 5, 21), (41, 5, 31), (41, 5, 41), (3, 9, 1), (3, 9, 2), (3, 9, 3), (1, 4, 1)) t(total, samples, page)")
def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced pages."""
    return spark.createDataFrame([(t, n, p) for t, n in ((41, 5), (3, 9), (1, 4)) for p in R.sample_pages(t, n)], "total int, samples int, page int")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), w AS (SELECT day, n, lead(day) OVER (ORDER BY day) AS next FROM d)
SELECT day, n::BIGINT AS events, coalesce(next - day, 1)::BIGINT AS days, n / coalesce(next - day, 1) AS per_day FROM w""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W04 over events: purchases of a day and the days until the next day that has some."""
    days = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    days = running(days, [], [F.desc("day")], before={"next": F.col("day")}, name="days")
    gap = F.coalesce(F.datediff("next", "day"), F.lit(1)).cast("long")
    return days.withColumn("days", gap).drop("next").withColumn("per_day", F.col("events") / F.col("days"))


_J = "CAST(body AS JSON)"


@query(f"""WITH p AS (SELECT name, unnest(['30d', '90d', '365d']) AS period, {_J} AS j FROM {X.PART_INSTALLS.sql()} WHERE source = 'brew'), v AS (SELECT name, period, json_extract(j, '$.analytics.install."' || period || '"') AS m FROM p)
SELECT name, period, coalesce(json_extract_string(m, '$."' || name || '"')::BIGINT, (SELECT sum(x::BIGINT) FROM (SELECT unnest(json_extract_string(m, '$.*')) AS x)))::BIGINT AS installs FROM v""")
def installs_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named entry, else the sum of all, else null."""
    rows = X.PART_INSTALLS.df(spark, sf_dir).where("source = 'brew'").select("name", F.explode(F.from_json("body", "analytics struct<install: map<string, map<string, long>>>")["analytics"]["install"]).alias("period", "m"))
    total = F.when(F.size("m") > 0, F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.select("name", "period", F.coalesce(F.try_element_at("m", F.col("name")), total).alias("installs"))
