"""What a table of changes says of its keys at given instants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def states_at(changes: DataFrame, keys: list[str], at: str, values: list[str], tie: str, instants: dict[str, str]) -> DataFrame:
    """One row per key with, for each named instant, the values of its last change at or before it; null where there is none yet.

    Changes at one instant are told apart by tie, the largest counts. The instants are a short list of the caller's, so
    all states come from one aggregation with partial results and no key is gathered anywhere.
    """
    order, held = F.struct(at, tie), F.struct(*values)
    return changes.groupBy(*keys).agg(*[F.max_by(held, F.when(F.col(at) <= F.lit(t).cast("timestamp"), order)).alias(n) for n, t in instants.items()])


def totals_between(states: DataFrame, old: str, new: str, gone) -> DataFrame:
    """One row: keys present at both instants' states, and how they became so. gone(state) tells a deletion."""
    there = lambda s: F.col(s).isNotNull() & ~gone(F.col(s))
    count = lambda c, n: F.count_if(c).alias(n)
    return states.agg(
        count(there(old), "at_old"), count(there(new), "at_new"), count(~there(old) & there(new), "added"),
        count(there(old) & ~there(new), "deleted"), count(there(old) & there(new) & (F.col(old) != F.col(new)), "changed"),
    )
