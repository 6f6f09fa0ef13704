"""Joins that Spark has no operator for: by counted keys, as of an instant, of instants and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.running import running


def join_counted(rows: DataFrame, table: DataFrame, key: str | list[str], limit: int, most: int = 100_000) -> DataFrame:
    """rows with the one row of table of the same key; table's column m says how many of rows have it. Rows without one go.

    Keys of more than limit rows are sent to the rows instead of gathering them in a task. Where these are more than
    ``most``, limit is raised to a most-th of all counted rows: fewer than ``most`` keys can exceed that, so the heaviest
    are always sent and what is sent stays bounded. table is read several times.
    """
    keys = [key] if isinstance(key, str) else list(key)
    seen = table.agg(F.sum("m").alias("rows"), F.count_if(F.col("m") > limit).alias("large")).head()
    if not seen["large"]:
        return rows.join(table, keys)
    if seen["large"] > most:
        limit = seen["rows"] // most
    large = table.where(F.col("m") > limit)
    few = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(table.where(F.col("m") <= limit), keys)
    many = rows.join(F.broadcast(large), keys)
    return few.unionByName(many.select(*few.columns))


def latest_before(points: DataFrame, changes: DataFrame, keys: list[str], at: str, values: list[str], tie: str, name: str = "as-of") -> DataFrame:
    """Each row of points with the values and the instant (since) of the last change of its key at or before its own instant.

    Changes at one instant are told apart by tie, the largest counts; null where there is none. Rows of points without
    an instant or with a null key are kept and meet changes of the null key only; changes without an instant are left
    out. Both sides are put in one order by key and instant, and the last change is carried on over the ranges of that
    order: a key of very many rows lies in many ranges, and no row meets more than one change.
    """
    held = F.struct(*[F.col(c) for c in values], F.col(at).alias("since"))
    own = points.withColumns({"_kind": F.lit(1), "_tie": F.lit(None).cast(dict(changes.dtypes)[tie])})
    theirs = changes.where(F.col(at).isNotNull()).select(*keys, at, F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), held.alias("_change"))
    both = own.unionByName(theirs, allowMissingColumns=True)
    out = running(both, keys, [F.col(at).asc_nulls_first(), "_kind", F.col("_tie").asc_nulls_first()], last={"_last": F.col("_change")}, name=name)
    seen = out.where("_kind = 1").select(*points.columns, *[F.col(f"_last.{c}").alias(c) for c in values], F.col("_last.since").alias("since"))
    seen.__dict__["_stage_path"] = out.__dict__["_stage_path"]
    return seen


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: tuple[str, ...] = (), width: int = 3_600_000_000, hot: int = 10_000) -> DataFrame:
    """Pairs of a row of points and a row of intervals of equal keys with start <= at < end. Instants are timestamps.

    Time is cut into buckets of ``width`` microseconds. An interval goes to every bucket that it touches, a point to
    its own, so each pair meets in one bucket only and a long interval is several short ones. Points of one bucket
    beyond ``hot`` are not gathered: the intervals of such a bucket are sent to them. Null instants, and intervals
    that end before they begin, meet nothing.
    """
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(width))
    own = points.withColumn("_bucket", bucket(F.col(at)))
    cut = intervals.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.expr(f"{end} - interval 1 microsecond")))))
    by = [*keys, "_bucket"]
    held = [c for c in intervals.columns if c not in keys]
    groups = cut.groupBy(*by).agg(F.collect_list(F.struct(*held)).alias("_held"))  # the intervals that touch one bucket
    counts = own.groupBy(*by).agg(F.count("*").alias("m"))
    pairs = join_counted(own, groups.join(counts, by), by, hot).withColumn("_one", F.explode("_held"))
    inside = (F.col(f"_one.{start}") <= F.col(at)) & (F.col(at) < F.col(f"_one.{end}"))
    return pairs.where(inside).select(*points.columns, *[F.col(f"_one.{c}").alias(c) for c in held])
