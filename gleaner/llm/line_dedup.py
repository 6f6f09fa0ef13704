"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of its host if more than ``max_ratio`` of the host's pages hold it, and at least ``min_pages``.
Lines are compared trimmed, by two 64-bit hashes. Pages are counted with partial sums. The lines that go are written
down; those of very many pages are sent to the positions of lines instead of gathering these by line. So a host with a
third of all pages or a line in all of them is no single task's work. Only line hashes are shuffled by line; texts move
once, to meet the positions that go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import join_counted, materialize, row_key

MAX_RATIO, MIN_PAGES = 0.1, 5
#: Pages of one line that are joined by the line.
HOT = 10_000


def drop_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, carry: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, carried columns, n_lines, n_dropped, text.

    Every row is a page. Blank lines are never dropped, nor counted. A null host is a host of its own; a null text has
    no lines and stays null; an empty text has one blank line. Where all lines go the text is empty. Repeated rows
    count as often as they occur. Other columns of docs play no part. An empty table gives no rows. The result reads a
    stage table of the lines that go, which stays behind.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("")).alias("_h"), row_key(F.col(text)).alias("_k"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text).alias("text"))
    line = lambda x: (F.xxhash64(F.lit(1), x).alias("h1"), F.xxhash64(F.lit(2), x).alias("h2"))
    lines = own.select("doc_id", "_h", "_k", F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)).alias("lines"))
    pages = own.groupBy("_h").agg(F.count("*").alias("pages"))
    held = lines.select("_h", F.explode(F.array_distinct("lines")).alias("x")).where("x <> ''").select("_h", *line(F.col("x")))
    held = held.groupBy("_h", "h1", "h2").agg(F.count("*").alias("df")).where(F.col("df") >= min_pages)
    common = held.join(pages, "_h").where(F.col("df") > F.lit(float(max_ratio)) * F.col("pages"))
    common = materialize(common.select("_h", "h1", "h2", F.col("df").alias("m")), "common-lines")
    spots = lines.select("doc_id", "_h", "_k", F.posexplode("lines").alias("pos", "x")).where("x <> ''").select("doc_id", "_h", "_k", "pos", *line(F.col("x")))
    gone = join_counted(spots, common, ["_h", "h1", "h2"], HOT).groupBy("doc_id", "_h", "_k").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_d2"), F.col("_h").alias("_h2"), F.col("_k").alias("_k2"), "gone")
    out = own.join(gone, own["doc_id"].eqNullSafe(gone["_d2"]) & (own["_k"] == gone["_k2"]) & (own["_h"] == gone["_h2"]), "left")
    cut = F.split("text", "\n", -1)
    out = out.withColumn("_lines", cut)
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "gone"), lambda i: F.get(F.col("_lines"), i))
    return out.select(
        "doc_id",
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their source as host, without the lines that over a tenth of the source's documents hold."""
    return drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, '') AS h, text FROM documents),
l AS (SELECT r, h, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
p AS (SELECT h, count(*) AS pages FROM d GROUP BY h),
b AS (SELECT l.h, trim(x) AS k FROM l JOIN p ON p.h = l.h WHERE trim(x) <> '' GROUP BY l.h, trim(x), p.pages
      HAVING count(DISTINCT r) >= {MIN_PAGES} AND count(DISTINCT r) > {MAX_RATIO}::DOUBLE * p.pages),
m AS (SELECT l.r, l.pos, l.x, b.k IS NOT NULL AS gone FROM l LEFT JOIN b ON b.h = l.h AND b.k = trim(l.x)),
t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE t.kept END AS text
FROM d LEFT JOIN t ON t.r = d.r
"""
