"""Commit histories: authors, cadence, releases, hotspots, assistants.

Ranked and running figures are taken from one row per author or path, never from commits; ties have an explicit order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.classify import FIX_SUBJECT, VERSION_TAG, author_key, is_bot
from gleaner.functions.numbers import tenths
from gleaner.functions.text import fold
from gleaner.operators.running import running
from gleaner.plans import signatures as S


def commits_per_author(commits: DataFrame) -> DataFrame:
    """(author_key, author, commits) of non-merge commits; author is the most frequent name, the first of equals."""
    own = commits.where("NOT merge").withColumn("author_key", author_key(F.col("name"), F.col("email")))
    names = own.groupBy("author_key", "name").agg(F.count("*").alias("n"))
    return names.groupBy("author_key").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("author"), F.sum("n").alias("commits"))


def bus_factor(counts: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the fewest keys, largest first, that hold half of all; 0 for none.

    Keys are first counted by value, so that the ordered pass is over distinct counts: with a total of n there are
    fewer than the square root of 2 n.
    """
    steps = counts.groupBy(value).agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc(value))
    steps = steps.withColumns({"before": F.coalesce(F.sum(F.col(value) * F.col("k")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "above": F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum(F.col(value) * F.col("k")).over(Window.partitionBy())})
    need = F.expr(f"above + greatest(1, (total - 2 * before + 2 * {value} - 1) div (2 * {value}))")
    reached = F.expr(f"2 * (before + {value} * k) >= total")
    return steps.agg(F.coalesce(F.min(F.when(reached, need)), F.lit(0)).cast("long").alias("bus_factor"))


def author_shares(counts: DataFrame, key: str, value: str, top: int = 10) -> DataFrame:
    """The top keys with their share, to one digit. A top-k report."""
    total = counts.agg(F.sum(value).alias("total"))
    best = counts.orderBy(F.desc(value), key).limit(top)
    return best.join(F.broadcast(total)).select(key, value, tenths(F.col(value), F.col("total")).alias("share_pct"))


def author_totals(counts: DataFrame, key: str, value: str) -> DataFrame:
    """distinct authors, with ten or more, with one, and the shares of the first and the first five."""
    top = counts.orderBy(F.desc(value), key).limit(5).agg(F.sum(value).alias("five"), F.max(value).alias("one"))
    every = counts.agg(F.count("*").alias("distinct_authors"), F.count_if(F.col(value) >= 10).alias("with_10_plus"), F.count_if(F.col(value) == 1).alias("with_one"), F.sum(value).alias("total"))
    out = every.join(F.broadcast(top))
    return out.select("distinct_authors", "with_10_plus", "with_one", tenths(F.coalesce("one", F.lit(0)), F.coalesce("total", F.lit(0))).alias("top1_share_pct"), tenths(F.coalesce("five", F.lit(0)), F.coalesce("total", F.lit(0))).alias("top5_share_pct"))


def merged_identities(commits: DataFrame) -> DataFrame:
    """(author_key, owner, commits): keys that share a folded name or handle belong to the first group that claims them.

    Groups go by their folded name. One pass, no transitive closure: a key in two groups goes to the first.
    """
    own = commits.where("NOT merge").withColumn("author_key", author_key(F.col("name"), F.col("email")))
    handle = F.when(F.col("author_key").startswith("github:"), F.substring("author_key", 8, 1000))
    folds = own.select("author_key", F.explode(F.array_compact(F.array(handle, F.col("name")))).alias("v")).select("author_key", fold(F.col("v")).alias("fold")).where("length(fold) >= 4").distinct()
    shared = folds.groupBy("fold").agg(F.count("*").alias("n")).where("n > 1").select("fold")
    owner = folds.join(shared, "fold").groupBy("author_key").agg(F.min("fold").alias("group"))
    counts = own.groupBy("author_key").agg(F.count("*").alias("commits"))
    return counts.join(owner, "author_key", "left").select("author_key", F.coalesce(F.concat(F.lit("group:"), "group"), "author_key").alias("owner"), "commits")


def email_domains(commits: DataFrame, top: int = 10) -> DataFrame:
    """Domains of people, not bots; no-reply subdomains as one; (none) without an address. A top-k report."""
    low = F.lower(F.substring_index("email", "@", -1))
    domain = F.when(~F.col("email").contains("@"), "(none)").when(low.endswith("users.noreply.github.com"), "users.noreply.github.com").otherwise(low)
    rows = commits.where("NOT merge").where(~is_bot(F.col("name"))).groupBy(domain.alias("domain")).agg(F.count("*").alias("commits"))
    return rows.orderBy(F.desc("commits"), "domain").limit(top)


def automated_authors(commits: DataFrame, top: int = 10) -> DataFrame:
    rows = commits.where("NOT merge").where(is_bot(F.col("name"))).groupBy("name").agg(F.count("*").alias("commits"))
    return rows.orderBy(F.desc("commits"), "name").limit(top)


def weekly(df: DataFrame, local_time, merge=None) -> DataFrame:
    """Rows per ISO week of a local time, all and without merges."""
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), local_time), F.weekofyear(local_time))
    return df.groupBy(week.alias("week")).agg(F.count("*").alias("commits"), F.count_if(~merge if merge is not None else F.lit(True)).alias("non_merge"))


def fix_share(commits: DataFrame, pattern: str = FIX_SUBJECT) -> DataFrame:
    row = commits.where("NOT merge").agg(F.count("*").alias("non_merge"), F.count_if(F.col("subject").rlike(pattern)).alias("fixes"))
    return row.select("non_merge", "fixes", tenths(F.col("fixes"), F.col("non_merge")).alias("share_pct"))


def release_gaps(tags: DataFrame) -> DataFrame:
    """One row over version tags in the order of time: count, first, last, mean and median gap in hours, gaps under a day.

    The gaps' median is exact.
    """
    rows = running(tags.where(F.col("tag").rlike(VERSION_TAG)), [], ["date", "tag"], before={"earlier": F.col("date")}, name="tags")
    rows = rows.withColumn("gap", F.unix_micros("date") - F.unix_micros("earlier"))
    at, hour = F.struct("date", "tag"), 3_600_000_000
    # Whole microseconds are summed, so that the mean does not depend on the order of rows.
    mean = F.sum("gap").cast("double") / (F.count("gap") * hour).cast("double")
    return rows.agg(F.count("*").alias("version_tags"), F.min_by("tag", at).alias("first_tag"), F.max_by("tag", at).alias("last_tag"), F.when(F.count("gap") > 0, mean).alias("mean_gap_hours"), (F.median("gap") / F.lit(float(hour))).alias("median_gap_hours"), F.count_if(F.col("gap") < 24 * hour).alias("gaps_under_24h"))


def recent_tags(tags: DataFrame, top: int = 10) -> DataFrame:
    return tags.where(F.col("tag").rlike(VERSION_TAG)).orderBy(F.desc("date"), F.desc("tag")).limit(top)


def hotspots(paths: DataFrame, unit: str, path: str, top: int = 20) -> DataFrame:
    """Distinct units (commits) per path. A top-k report."""
    rows = paths.select(unit, path).distinct().groupBy(path).agg(F.count("*").alias("commits"))
    return rows.orderBy(F.desc("commits"), path).limit(top)


def assistants(commits: DataFrame) -> DataFrame:
    """(sha, label) of assistants in the trailers of non-merge commits, each label once per commit."""
    keys = "|".join(S.TRAILER_KEYS)
    values = commits.where("NOT merge").select("sha", F.explode(F.regexp_extract_all("body", F.lit(rf"(?im)^\s*(?:{keys})\s*:\s*(.+)$"), 1)).alias("v"))
    found = []
    for label, patterns in S.ASSISTANTS:
        cond = F.lit(False)
        for p in patterns:
            cond = cond | F.col("v").rlike("(?i)" + p)
        found.append(F.when(cond, label))
    return values.select("sha", F.explode(F.array_compact(F.array(*found))).alias("label")).distinct()


def branch_merges(commits: DataFrame) -> DataFrame:
    found = F.filter(F.array(*[F.lit(p) for p in S.BRANCH_PREFIXES]), lambda p: F.col("subject").contains(p))
    return commits.where("merge").select(F.explode(found).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("merges"))


def instruction_files(tree: DataFrame) -> DataFrame:
    """Items that are in a tree: a path, a name in any folder, or a folder for items that end in a slash."""
    path = F.col("path")
    found = [F.when((path.startswith(i) | path.contains("/" + i)) if i.endswith("/") else ((path == i) | path.endswith("/" + i)), i) for i in S.INSTRUCTION_FILES]
    return tree.select(F.explode(F.array_compact(F.array(*found))).alias("item")).distinct()


def first_and_last(commits: DataFrame) -> DataFrame:
    """Dates as written, in the order of their instants."""
    at = F.struct(F.to_timestamp("date"), "sha")
    return commits.agg(F.min_by("date", at).alias("first"), F.max_by("date", at).alias("last"))
