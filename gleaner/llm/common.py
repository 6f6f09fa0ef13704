"""Shared helpers: stage tables in the shared folder, text access in Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.sources.shared import discard, materialize, only_result, shared_dir

__all__ = ["CHUNK_BYTES", "chunks", "connected_components", "discard", "join_counted", "materialize", "only_result", "row_key", "shared_dir", "spans", "texts_of"]

#: Text handled at once by the vectorised kernels; a longer text is handled alone.
CHUNK_BYTES = 2_000_000


def texts_of(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def spans(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of items of about limit together; a larger one is alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together."""
    return spans([len(t) for t in texts], limit)


def row_key(text, *seed) -> F.col:
    """64-bit key of a text, computed in the JVM."""
    return F.xxhash64(F.coalesce(text, F.lit("")), *[F.lit(s) for s in seed])


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


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node that links reach, for every node of edges (x, y) of long ids.

    Alternates large-star and small-star steps; each is one aggregation and one join, so that a node with very many
    neighbours never has them in one task's memory. Self links and repeated links are harmless; no edges, no rows. The
    result reads a stage table, which discard() deletes.
    """
    now = materialize(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), name)

    def summary(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).head()
        return row["n"], row["s"]

    seen = summary(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        then = materialize(small, name)
        before, seen = seen, summary(then)
        discard(now)
        now = then
        if before == seen:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    out.__dict__["_stage_path"] = now.__dict__["_stage_path"]
    return out
