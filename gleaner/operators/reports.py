"""Reports over saved inputs: pages, removals, registries, public counts, repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import classify as C
from gleaner.operators import pages as P
from gleaner.operators.dependencies import latest_version
from gleaner.plans.rules import rules


def page_report(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, lines, price_lines and one count for each group of page rules) of each page's non-blank lines; a line can belong to several groups.

    One pass over a page's own lines, without a shuffle. A null page has no lines.
    """
    body = P.page_text(pages, key, html).select(key, F.filter(F.split("body", "\n", -1), lambda x: F.trim(x) != "").alias("l"))
    counted = lambda p, most=0: F.size(F.filter("l", lambda x: x.rlike(p) & (F.length(x) <= most) if most else x.rlike(p)))
    none = lambda c: F.greatest(c, F.lit(0)).cast("long")  # noqa: E731  size of null is -1
    groups = [none(counted(r.pattern, r.max_line)).alias(r.label) for r in rules("page")]
    return body.select(key, none(F.size("l")).alias("lines"), none(counted(P.PRICE)).alias("price_lines"), *groups)


def capped(rows: DataFrame, by: str, order: list[Column | str], top: int = 50) -> DataFrame:
    """Rows with their place in the order and the total of their group; the first top of each, all for 0. A top-k report."""
    w = Window.partitionBy(by)
    totals = rows.groupBy(by).agg(F.count("*").alias("total"))
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(*order)))
    return (rows.where(F.col("place") <= top) if top else rows).join(totals, by)


def deleted_lists(old: DataFrame, new: DataFrame, top: int = 50) -> DataFrame:
    """(kind, place, path, total) of paths of old that new lacks, by kind, in the order of paths."""
    gone = old.select("path").distinct().join(new.select("path").distinct(), "path", "left_anti")
    return capped(gone.withColumn("kind", C.removed_kind(F.col("path"))), "kind", ["path"], top)


def docs_to_check(paths: DataFrame, most: int = 500) -> DataFrame:
    """(place, path, not_checked): Markdown outside of tests and dependencies, README and the like first, then documentation folders; not_checked counts those beyond most. A top-k report."""
    wanted = paths.where(C.suffix(F.col("path")).isin(".md", ".mdx", ".markdown")).where(~C.removed_kind(F.col("path")).isin("tests", "dependencies_or_build")).select("path").distinct()
    some = wanted.withColumn("p", C.doc_priority(F.col("path"))).orderBy("p", "path").limit(most)
    placed = some.withColumn("place", F.row_number().over(Window.orderBy("p", "path")))  # at most that many rows
    total = wanted.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("not_checked"))
    return placed.join(F.broadcast(total)).select("place", "path", "not_checked")  # one row


def upstream(components: DataFrame, latest: DataFrame, dates: DataFrame) -> DataFrame:
    """Components (ecosystem, name, resolved) with latest, both publish times, days between and stable releases since.

    latest: (ecosystem, name, latest); dates: (ecosystem, name, version, published). What is unknown is null. Joins are
    by component; its releases are counted beside it, none is gathered.
    """
    key = ["ecosystem", "name"]
    when = lambda c, to: dates.groupBy(*key, F.col("version").alias(c)).agg(F.max("published").alias(to))
    rows = components.distinct().join(latest.groupBy(*key).agg(F.max("latest").alias("latest")), key, "left")
    rows = rows.join(when("latest", "latest_published"), [*key, "latest"], "left").join(when("resolved", "resolved_published"), [*key, "resolved"], "left")
    span = rows.where("latest_published IS NOT NULL AND resolved_published IS NOT NULL").select(*key, "resolved", "resolved_published", "latest_published")
    stable = dates.where(~F.col("version").rlike("[-+][A-Za-z]")).join(span, key).where("published > resolved_published AND published <= latest_published")
    since = stable.groupBy(*key, "resolved").agg(F.countDistinct("version").alias("n"))
    days = F.floor((F.unix_micros("latest_published") - F.unix_micros("resolved_published")) / F.lit(86_400_000_000)).cast("long")
    known = days.isNotNull()
    return rows.join(since, [*key, "resolved"], "left").select(*key, "resolved", "latest", "resolved_published", "latest_published", days.alias("days_between"), F.when(known, F.coalesce("n", F.lit(0))).alias("stable_releases_since"))


def upstream_of_answers(components: DataFrame, answers: DataFrame, dates: DataFrame) -> DataFrame:
    """D12 from saved registry answers (ecosystem, name, body)."""
    return upstream(components, latest_version(answers), dates)


# How names are written, by source.
NAME_FORMATS = {
    "npm": r"^(@[\w.-]+/)?[\w.-]+$", "pypi": r"^[\w.-]+$", "crate": r"^[\w-]+$", "brew": r"^[\w.+@-]+$",
    "cask": r"^[\w.+@-]+$", "docker": r"^[\w.-]+/[\w.-]+$", "open_vsx": r"^[\w.-]+/[\w.-]+$", "discord": r"^[\w-]+$",
}

#: Fields of each source: name, place in the list of answers, JSON paths in the order they are tried.
COUNT_FIELDS = {
    "npm": [("downloads_last_day", 0, ["$.downloads"]), ("downloads_last_week", 1, ["$.downloads"]), ("downloads_last_month", 2, ["$.downloads"]), ("period_end", 2, ["$.end"]), ("repository", 3, ["$.repository.url", "$.repository"])],
    "pypi": [("downloads_last_day", 0, ["$.data.last_day"]), ("downloads_last_week", 0, ["$.data.last_week"]), ("downloads_last_month", 0, ["$.data.last_month"]), ("repository", 1, ["$.info.project_urls.Source", "$.info.project_urls.Repository", "$.info.project_urls.Code", "$.info.project_urls.GitHub", "$.info.home_page"])],
    "crate": [("downloads_all_time", 0, ["$.crate.downloads"]), ("downloads_last_90_days", 0, ["$.crate.recent_downloads"]), ("latest_version", 0, ["$.crate.max_stable_version", "$.crate.newest_version"]), ("updated_at", 0, ["$.crate.updated_at"]), ("repository", 0, ["$.crate.repository"])],
    "docker": [("pulls_all_time", 0, ["$.pull_count"]), ("stars", 0, ["$.star_count"]), ("last_updated", 0, ["$.last_updated"])],
    "open_vsx": [("downloads_all_time", 0, ["$.downloadCount"]), ("average_rating", 0, ["$.averageRating"]), ("reviews", 0, ["$.reviewCount"]), ("version", 0, ["$.version"])],
    "discord": [("server", 0, ["$.guild.name"]), ("members_approximate", 0, ["$.approximate_member_count"]), ("online_approximate", 0, ["$.approximate_presence_count"])],
}
_INSTALLS = "analytics struct<install: map<string, map<string, bigint>>>"


def public_counts(answers: DataFrame) -> DataFrame:
    """Answers (source, name, bodies: array of JSON texts) to rows (source, name, field, value).

    A name in the wrong form, or else the first answer with an error, gives the one field error. Installs of brew and
    cask: the named entry, else the sum of all, else null. Fields without a value are null.
    """
    name, bodies = F.col("name"), F.col("bodies")
    fine = F.lit(False)
    for source, pattern in NAME_FORMATS.items():
        fine = fine | ((F.col("source") == source) & name.rlike(pattern))
    error = F.get(F.filter(F.transform(bodies, lambda b: F.get_json_object(b, "$._error")), lambda e: e.isNotNull()), 0)
    entry = lambda field, value: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"))
    got = lambda place, paths: F.coalesce(*[F.get_json_object(F.get(bodies, place), p) for p in paths])
    periods = F.from_json(F.get(bodies, 0), _INSTALLS)["analytics"]["install"]

    def installs(period: str) -> Column:
        m = F.try_element_at(periods, F.lit(period))
        total = F.when(F.size(m) > 0, F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))))
        return F.coalesce(F.try_element_at(m, name), total)

    fields = F.when(F.col("source").isin("brew", "cask"), F.array(*[entry(f"installs_{p}", installs(p)) for p in ("30d", "90d", "365d")]))
    for source, table in COUNT_FIELDS.items():
        fields = fields.when(F.col("source") == source, F.array(*[entry(f, got(i, paths)) for f, i, paths in table]))
    found = F.when(~fine, F.array(entry("error", F.lit("bad name")))).when(error.isNotNull(), F.array(entry("error", error))).otherwise(fields)
    return answers.select("source", "name", F.explode(found).alias("e")).select("source", "name", "e.field", "e.value")


def repository_facts(answers: DataFrame) -> DataFrame:
    """(url and 13 facts) of saved answers (url, body) about repositories; watchers are the subscribers, topics a list."""
    g = lambda p: F.get_json_object("body", p)
    number = lambda p: g(p).cast("long")
    return answers.where(g("$.full_name").isNotNull()).select(
        "url",
        g("$.full_name").alias("full_name"),
        g("$.description").alias("description"),
        number("$.stargazers_count").alias("stars"),
        number("$.forks_count").alias("forks"),
        number("$.subscribers_count").alias("watchers"),
        number("$.open_issues_count").alias("open_issues_plus_prs"),
        g("$.default_branch").alias("default_branch"),
        g("$.license.spdx_id").alias("license"),
        g("$.created_at").alias("created_at"),
        g("$.pushed_at").alias("pushed_at"),
        g("$.archived").cast("boolean").alias("archived"),
        F.array_join(F.coalesce(F.from_json(g("$.topics"), "array<string>"), F.expr("cast(array() as array<string>)")), ",").alias("topics"),
        g("$.homepage").alias("homepage"),
    )


def sibling_repositories(listed: DataFrame, repositories: DataFrame) -> DataFrame:
    """Repositories (full_name) with those of their owner (listed: full_name, name) that may hold their releases.

    Names are folded to small letters and digits. A clue is 'release' in the name, or for a stem of four characters or
    more that one name holds the other; a name that folds to the stem is none. The join is by owner.
    """
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    owner = lambda c: F.substring_index(c, "/", 1)
    own = repositories.select(F.col("full_name").alias("repo"), owner("full_name").alias("owner"), fold(F.expr("substring(full_name, instr(full_name, '/') + 1)")).alias("stem"))
    rows = listed.select("full_name", owner("full_name").alias("owner"), fold(F.col("name")).alias("f")).join(own, "owner").where("full_name <> repo AND f <> stem")
    near = (F.length("stem") >= 4) & (F.col("f").contains(F.col("stem")) | F.col("stem").contains(F.col("f")))
    return rows.where(F.col("f").contains("release") | near).select("repo", "full_name")


def late_first_release(repositories: DataFrame, releases: DataFrame, days: int = 14) -> DataFrame:
    """(repo, first_release, gap_days, warning): repositories (repo, created) whose first release (repo, published) came over that many days after their creation."""
    first = releases.groupBy("repo").agg(F.min("published").alias("first"))
    gap = F.floor((F.unix_micros("first") - F.unix_micros("created")) / F.lit(86_400_000_000)).cast("long")
    rows = repositories.join(first, "repo").withColumn("gap_days", gap)
    return rows.select("repo", F.date_format("first", "yyyy-MM-dd").alias("first_release"), "gap_days", (F.col("gap_days") > days).alias("warning"))


def most_common(rows: DataFrame, key: Column, order: str, k: int) -> DataFrame:
    """(key, n): the k most frequent, ties by their first row in the order. A top-k report."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(order).alias("_f")).orderBy(F.desc("n"), "_f").limit(k).select("key", "n")


def modal_names(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """(key, name, n): the most frequent name of each key, ties by the first seen."""
    per = rows.groupBy(key, name).agg(F.count("*").alias("n"), F.min(order).alias("f"))
    return per.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "f", F.col(name).alias("name"))).alias("b")).select(key, F.col("b.name").alias(name), (-F.col("b.m")).alias("n"))


def license_note(text: Column) -> Column:
    """What a text with a recognised licence says of license keys; null for none."""
    low = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.when((C.license_family(text) != "Unrecognized") & low.contains("source code") & low.contains("license key"), "mentions a license key: likely source-available terms")


def snapshot_counts(commits: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, commits, branches, tags, disk_mb) from commits (repo, sha), refs (repo, kind 'branch' or 'tag', name) and files (repo, bytes)."""
    a = commits.groupBy("repo").agg(F.countDistinct("sha").alias("commits"))
    b = refs.groupBy("repo").agg(F.count_if(F.col("kind") == "branch").alias("branches"), F.count_if(F.col("kind") == "tag").alias("tags"))
    c = files.groupBy("repo").agg(F.round(F.sum("bytes") / 1_000_000, 1).alias("disk_mb"))
    return a.join(b, "repo", "full").join(c, "repo", "full").na.fill(0)
