"""The first hits of a whole table in a given order, without finding all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from gleaner.operators.running import in_order
from gleaner.sources.shared import discard, materialize


def first_in_order(rows: DataFrame, order: list[str], find: Callable[[DataFrame], DataFrame], most: int, by: list[str]) -> DataFrame:
    """The first ``most`` rows of find(rows) in the order by; by begins with order, whose columns find keeps.

    rows are put in order by range. Then find runs over the first parts of that order, over four times as many, and so
    on, until there are enough hits: all hits of a part come before those of the next. What lies behind is never
    searched. The result reads stage tables. A top-k report.
    """
    laid = in_order(rows, order, "first")
    parts = [r["_part"] for r in laid.groupBy("_part").count().orderBy("_part").collect()]  # one row a part
    found, known, at, step = None, 0, 0, 1
    while at < len(parts) and known < most:
        own = laid.where(laid["_part"].between(parts[at], parts[min(at + step, len(parts)) - 1])).drop("_part", "_seq")
        hits = materialize(find(own).orderBy(*by).limit(most), "first-hits")
        known += hits.count()
        found = hits if found is None else found.unionByName(hits)
        at, step = at + step, step * 4
    discard(laid)
    return (find(rows.limit(0)) if found is None else found).orderBy(*by).limit(most)
