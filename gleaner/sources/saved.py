"""Readers and writers of saved inputs: trees, logs, answers, pages. Nothing here talks to a network or a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.classify import is_skipped
from gleaner.functions.text import decoded, is_binary

FIELD, RECORD = "\x1f", "\x1e"
TREE_SCHEMA = "path string, length long, content binary"


def tree(spark: SparkSession, root: str, names: str | None = None, most_bytes: int | None = None, with_skipped: bool = False) -> DataFrame:
    """(rel_path, length, content) of files below root; names is a glob of file names.

    The size limit is a filter on the source's own column, so larger files are not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", names) if names else reader).load(root)
    if most_bytes is not None:
        rows = rows.where(F.col("length") <= most_bytes)
    base = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    rows = rows.withColumn("rel_path", F.regexp_replace(F.substring_index(base, root.split(":")[-1].rstrip("/") + "/", -1), "^/+", ""))
    rows = rows if with_skipped else rows.where(~is_skipped(F.col("rel_path")))
    return rows.select("rel_path", "length", "content")


def texts(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(rel_path, text) of files that are no binaries, of their first limit bytes."""
    return files.where(~is_binary(F.col("content"))).select("rel_path", decoded(F.col("content"), limit).alias("text"))


def commit_records(records: DataFrame, column: str = "record") -> DataFrame:
    """(sha, name, email, date, merge, subject, body) of records with seven fields."""
    f = F.split(F.regexp_replace(column, r"^\n+", ""), FIELD, -1)
    rows = records.select(f.alias("f")).where("size(f) >= 7")
    return rows.select(F.col("f")[0].alias("sha"), F.col("f")[1].alias("name"), F.col("f")[2].alias("email"), F.col("f")[3].alias("date"), (F.size(F.split(F.trim(F.col("f")[4]), " +")) > 1).alias("merge"), F.col("f")[5].alias("subject"), F.rtrim(F.col("f")[6]).alias("body"))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """A saved log whose records end with 0x1E."""
    return commit_records(spark.read.option("lineSep", RECORD).text(path).withColumnRenamed("value", "record"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """A saved listing of paths, separated by zero bytes."""
    return spark.read.option("lineSep", "\0").text(path).where("value <> ''").withColumnRenamed("value", "path")


def tree_changes(spark: SparkSession, path: str) -> DataFrame:
    """(status, old, new) of a saved comparison: a status, then one path, or two for renames, separated by tabs.

    The status is its first letter; new is null for deleted files and old for modified ones. Copies and additions are left out.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> ''").select(F.substring(f[0], 1, 1).alias("status"), f[1].alias("old"), F.get(f, 2).alias("to"))
    return rows.where("status IN ('D', 'R', 'M')").select("status", "old", F.when(F.col("status") == "M", F.col("old")).otherwise(F.col("to")).alias("new"))


def paged(saved: DataFrame, size: int = 100) -> DataFrame:
    """(list, page, item) of saved answers (url, body) whose bodies are lists, up to each list's first short page.

    A list is its URL without the number of the page; a page that was saved twice counts once.
    """
    number = r"([?&]page=)(\d+)"
    pages = saved.select(F.regexp_replace("url", number, "$1").alias("list"), F.coalesce(F.nullif(F.regexp_extract("url", number, 2), F.lit("")), F.lit("1")).cast("int").alias("page"), F.from_json("body", "array<string>").alias("items")).where("items IS NOT NULL").dropDuplicates(["list", "page"])
    last = pages.where(F.size("items") < size).groupBy("list").agg(F.min("page").alias("last"))
    rows = pages.join(last, "list", "left").where("last IS NULL OR page <= last")
    return rows.select("list", "page", F.explode("items").alias("item"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Saved answers, one JSON document per file, with url, fetched_at and the body as text."""
    rows = spark.read.option("wholetext", "true").text(folder)
    g = lambda p: F.get_json_object("value", p)
    return rows.select(g("$.url").alias("url"), g("$.fetched_at").alias("fetched_at"), g("$.body").alias("body"))


def phrases(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list of phrases or denied terms."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.json(path)


def save_by_key(rows: DataFrame, key: str, path: str) -> None:
    """Write rows below path, one folder a key; keys that rows hold are replaced, others stay. Doing it again changes nothing.

    Rows of one key are written by as many tasks as they lie in, so that no key is gathered. A null key has a folder too.
    """
    rows.withColumn("_key", F.col(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_key").parquet(path)


def replay(spark: SparkSession, path: str, keys: list) -> DataFrame:
    """The saved rows of some keys; only their folders are listed and read."""
    saved = spark.read.parquet(path)
    return saved.where(F.col("_key").isin(*keys)).drop("_key")
