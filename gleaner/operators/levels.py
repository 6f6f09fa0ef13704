"""Totals at several levels in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals_at_levels(rows: DataFrame, dims: list[str], levels: list[list[str]], *aggregates: Column) -> DataFrame:
    """(dims, level, aggregates): one row per group of each level. dims that a level leaves out are null there.

    level is the grouping id over all dims: a bit for each that is left out, the first dim's highest. It tells a null
    that is left out from a null in the data. All levels come from one scan and one shuffle of partial results; a
    distinct count is exact at each level, not a sum of the finer ones.
    """
    sets = [[F.col(c) for c in level] for level in levels]
    return rows.groupingSets(sets, *[F.col(c) for c in dims]).agg(F.grouping_id().cast("int").alias("level"), *aggregates)
