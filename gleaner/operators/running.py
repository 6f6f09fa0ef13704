"""Running figures over all rows in one order, without a window over all rows.

The rows are put in order by range, so that a key with very many rows lies in as many parts as these need, and written
down. Within a part, running figures are those of a window over the part's own rows. What a part takes over from those
before it follows from one row of totals a part: as the order begins with the keys, at most one key of each part has
rows in an earlier one, so the table of what is taken over has no more rows than there are parts and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.sources.shared import materialize


def _as_columns(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def in_order(df: DataFrame, order, name: str = "in-order") -> DataFrame:
    """df as a stage table with _part and _seq: parts follow each other in the order, _seq rises within each.

    Rows that agree in the whole order are told apart by where they were read, so that they need not share a part.
    """
    by = [*_as_columns(order), F.col("_read")]
    laid = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_read")
    return materialize(laid.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), name)


def running(df: DataFrame, keys: list[str], order, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, before: dict[str, Column] | None = None, name: str = "running") -> DataFrame:
    """df with further columns, taken over the rows of the same keys in the given order.

    sums: the sum of a whole number over this row and those before it. last: the last value that is not null, of this
    row and those before it. before: the value of the row before this one, null for the first. Null keys are a key of
    their own. Ties are broken by all columns that the order names and then by where rows were read. No rows, no rows.
    The result reads a stage table, which discard() deletes.
    """
    sums, last, before = sums or {}, last or {}, before or {}
    held = df.withColumns({f"_s_{c}": v for c, v in sums.items()} | {f"_l_{c}": v for c, v in last.items()} | {f"_b_{c}": v for c, v in before.items()})
    rows = in_order(held, [*[F.col(k).asc_nulls_first() for k in keys], *_as_columns(order)], name)

    totals = rows.groupBy("_part", *keys).agg(
        F.min("_seq").alias("_first"),
        *[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in sums],
        *[F.max(F.when(F.col(f"_l_{c}").isNotNull(), F.struct("_seq", f"_l_{c}"))).alias(f"_l_{c}") for c in last],
        *[F.max_by(F.struct(F.col(f"_b_{c}").alias("v")), "_seq").alias(f"_b_{c}") for c in before],
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    taken = totals.select(
        "_part", *keys, "_first", F.count("*").over(earlier).alias("_parts"),
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_ts_{c}") for c in sums],
        *[F.last(F.col(f"_l_{c}")[f"_l_{c}"], ignorenulls=True).over(earlier).alias(f"_tl_{c}") for c in last],
        *[F.last(f"_b_{c}").over(earlier)["v"].alias(f"_tb_{c}") for c in before],
    ).where("_parts > 0").drop("_parts")
    taken = taken.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in taken.columns if c != "_part" and c not in keys])

    own = Window.partitionBy("_part", *keys).orderBy("_seq")
    here = own.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns(
        {f"_s_{c}": F.sum(f"_s_{c}").over(here) for c in sums}
        | {f"_l_{c}": F.last(f"_l_{c}", ignorenulls=True).over(here) for c in last}
        | {f"_b_{c}": F.lag(f"_b_{c}").over(own) for c in before}
    )
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(F.broadcast(taken), same, "left")
    out = out.select(
        *df.columns,
        *[(F.coalesce(f"_s_{c}", F.lit(0)) + F.coalesce(f"_ts_{c}", F.lit(0))).alias(c) for c in sums],
        *[F.coalesce(f"_l_{c}", f"_tl_{c}").alias(c) for c in last],
        *[F.when(F.col("_seq") == F.col("_first"), F.col(f"_tb_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in before],
    )
    out.__dict__["_stage_path"] = rows.__dict__["_stage_path"]
    return out
