"""Where long documents may be cut, and their best split into parts, from window sums over lines.

Lines become rows (length and kind only; texts stay where they are), and what is open at a line is a window figure over
the lines of its document: fences are counted, and of tables and callouts the last tag above decides. The split is a
dynamic programme over the few cut points of a document, as an aggregate over their array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.sources.shared import materialize

# What opens and closes blocks, what a part may begin with.
FENCE, HEADING = "```", r"^(## |### )"
TAGS = {"table": (r"^<table[\s>]", "</table>"), "callout": (r"^<callout", "</callout>")}
#: Ends of lines, which stay part of them.
LINE_END = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0B\x0C\x1C-\x1E\x85\u2028\u2029])"


def cut_points(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, chars, cuts, balanced): offsets of second and third level headings outside tables, callouts and code.

    balanced is false where one of these is still open at the end. keys name a row; a null text is empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(*keys, F.posexplode(F.filter(F.split(t, LINE_END, -1), lambda x: x != "")).alias("_pos", "_x"))
    bare = F.regexp_replace("_x", r"^[\s\p{Z}\x1C-\x1F\x85]+|[\s\p{Z}\x1C-\x1F\x85]+$", "")
    shape = lines.select(
        *keys, "_pos", F.length("_x").alias("_n"), bare.startswith(FENCE).alias("_fence"), F.col("_x").rlike(HEADING).alias("_head"),
        *[F.when(bare.startswith(shut), False).when(bare.rlike(opens), True).alias(f"_{k}") for k, (opens, shut) in TAGS.items()],
    )
    here = Window.partitionBy(*keys).orderBy("_pos")
    above = here.rowsBetween(Window.unboundedPreceding, -1)
    fences = F.coalesce(F.sum(F.col("_fence").cast("int")).over(above), F.lit(0))
    # A line of code is neither tag nor heading; so is the fence that begins it.
    rows = shape.withColumn("_code", (fences % 2 == 1) | F.col("_fence"))
    live = lambda c: F.when(~F.col("_code"), F.col(c))
    rows = rows.withColumns({"_at": F.coalesce(F.sum("_n").over(above), F.lit(0))} | {f"_in_{k}": F.coalesce(F.last(live(f"_{k}"), ignorenulls=True).over(above), F.lit(False)) for k in TAGS})
    free = ~F.col("_code") & ~F.col("_in_table") & ~F.col("_in_callout")
    cuts = F.sort_array(F.collect_list(F.when(F.col("_head") & (F.col("_at") > 0) & free, F.col("_at"))))
    left = [F.coalesce(F.max_by(live(f"_{k}"), F.when(live(f"_{k}").isNotNull(), F.col("_pos"))), F.lit(False)) for k in TAGS]
    balanced = (F.count_if("_fence") % 2 == 0) & ~left[0] & ~left[1]
    known = rows.groupBy(*keys).agg(F.sum("_n").alias("chars"), cuts.alias("cuts"), balanced.alias("balanced"))
    empty = docs.where(t == "").select(*keys, F.lit(0).cast("long").alias("chars"), F.array().cast("array<bigint>").alias("cuts"), F.lit(True).alias("balanced"))
    return known.unionByName(empty)


#: Parts of a point without a way on.
NO_WAY = 1 << 30


def best_ends(points: str, limit: int) -> tuple[str, str]:
    """Two expressions over an ascending array from 0 to the length: the best way on from each point, and the ends on the way from the first.

    The best way has the fewest parts of at most limit, then the smallest largest part, then the earliest cuts. From the
    back, each point gets (parts, largest, next point) over the later points that lie within limit and have a way on.
    """
    size = f"{points}[i + 1 + k] - {points}[i]"
    none = f"struct({NO_WAY} as parts, 0L as largest, -1 as next)"
    steps = f"transform(best, (b, k) -> if(b.parts >= {NO_WAY} or {size} > {limit}, {none}, struct(b.parts + 1 as parts, greatest(b.largest, {size}) as largest, i + 1 + k as next)))"
    from_each = f"aggregate(sequence(size({points}) - 2, 0, -1), array(struct(0 as parts, 0L as largest, -1 as next)), (best, i) -> concat(array(array_min({steps})), best))"
    done = f"w.at >= size({points}) - 1"
    walk = f"aggregate(sequence(1, size({points}) - 1), struct(0 as at, cast(array() as array<bigint>) as ends), (w, _) -> if({done}, w, struct(_best[w.at].next as at, concat(w.ends, array({points}[_best[w.at].next])) as ends))).ends"
    return from_each, walk


def split_documents(docs: DataFrame, key: str, text: str, limit: int = 18_000) -> DataFrame:
    """(key, part, start, chars, error): parts of each document; error instead where it can't be cut.

    Rows that agree in key and text are split once each. The result reads a stage table.
    """
    own = docs.select(F.col(key), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    times = own.groupBy(F.col(key).alias("_k2"), F.col("_t").alias("_t2")).agg(F.count("*").alias("_times"))
    known = materialize(cut_points(own.dropDuplicates([key, "_t"]), [key, "_t"], "_text"), "cut-points")
    points = known.withColumn("_p", F.expr("if(chars = 0, array(0L), concat(array(0L), filter(cuts, c -> c < chars), array(chars)))"))
    best, walk = best_ends("_p", int(limit))
    none = "cast(array() as array<struct<parts: int, largest: bigint, next: int>>)"
    points = points.withColumn("_best", F.expr(f"if(balanced and size(_p) > 1, {best}, {none})"))
    ends = F.expr(f"case when not balanced then null when size(_p) = 1 then array(0L) when _best[0].parts >= {NO_WAY} then null else {walk} end")
    points = points.withColumn("_ends", ends).join(times, F.col(key).eqNullSafe(F.col("_k2")) & (F.col("_t") == F.col("_t2"))).select(key, "chars", "balanced", "_ends", "_times")
    error = F.when(~F.col("balanced"), "unbalanced table, callout or code block").when(F.col("_ends").isNull(), f"a section is longer than {limit} characters")
    parts = F.expr("if(_ends is null, array(struct(0L as part, 0L as start, chars as chars)), transform(_ends, (e, i) -> struct(cast(i as bigint) as part, if(i = 0, 0L, _ends[i - 1]) as start, e - if(i = 0, 0L, _ends[i - 1]) as chars)))")
    out = points.select(key, error.alias("error"), F.explode(parts).alias("p"), "_times").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return out.select(key, "p.part", "p.start", "p.chars", "error")
