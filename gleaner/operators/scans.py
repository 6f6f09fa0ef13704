"""Scans of source files (path, text): telemetry products, billing providers, gates, secrets; first hits and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import classify as C
from gleaner.functions import text as T
from gleaner.operators.match import signals
from gleaner.plans import signatures as S
from gleaner.plans.rules import Rule, rules

#: Files of more bytes are no source code to scan; a telemetry scan reads files of any length, whole.
MOST_BYTES = 1_000_000
GATES = ("license_gate", "plan_gate", "offer", "lead_capture")


def _named(table: list[Rule], field: str = "label") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for r in table for x in (r.rule_id, getattr(r, field))]), F.col("rule_id"))


def _trimmed(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"^\s+|\s+$", ""), 1, 160)


def sdk_lines(files: DataFrame, include_tests: bool = False, include_docs: bool = False) -> DataFrame:
    """P20: (name, path, line, match, text), one row per product and line: 'usage', or 'mention' of a bare domain that the line doesn't load.

    Lines over 2000 characters are passed over, null texts have no lines.
    """
    table = rules("telemetry")
    own = files.where(C.telemetry_eligible(F.col("path"), include_tests, include_docs))
    found = signals(own.select("path", "text"), table, F.col("text"), ["path"])
    low = F.lower("text")
    used = (F.col("strength") == "usage") | low.contains("://") | low.contains("<script") | low.contains("src=")
    per = found.withColumn("name", _named(table)).groupBy("name", "path", "line").agg(F.bool_or(used).alias("used"), F.min("text").alias("text"))
    return per.select("name", "path", "line", F.when(F.col("used"), "usage").otherwise("mention").alias("match"), _trimmed(F.col("text")).alias("text"))


def sdk_summary(lines: DataFrame) -> DataFrame:
    """(name, kind, files, strength, hits) of sdk_lines."""
    kinds = F.create_map(*[F.lit(x) for name, kind, *_ in S.TELEMETRY for x in (name, kind)])
    out = lines.groupBy("name").agg(F.countDistinct("path").alias("files"), F.when(F.bool_or(F.col("match") == "usage"), "usage").otherwise("mention only").alias("strength"), F.count("*").alias("hits"))
    return out.select("name", F.element_at(kinds, F.col("name")).alias("kind"), "files", "strength", "hits")


def first_hits(lines: DataFrame, most: int, by: str = "name") -> DataFrame:
    """The first most lines of each name in the order of paths and lines, with their place; all of them for 0. A top-k report."""
    rows = lines.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("path", "line")))
    return rows.where(F.col("place") <= most) if most else rows


def _code(files: DataFrame, include_tests: bool, include_docs: bool) -> DataFrame:
    """Files that a scan of code reads, with mode 'scan' or 'test'; larger ones are passed over."""
    return files.where(F.octet_length("text") <= MOST_BYTES).withColumn("mode", C.code_eligible(F.col("path"), include_tests, include_docs)).where("mode <> ''")


def billing_lines(files: DataFrame, include_tests: bool = False, include_docs: bool = False) -> DataFrame:
    """(name, path, line, mode, text): one row per provider and line; mode 'test' for files that are tests."""
    table = rules("billing")
    found = signals(_code(files, include_tests, include_docs), table, F.col("text"), ["path", "mode"])
    per = found.withColumn("name", _named(table)).groupBy("name", "path", "line", "mode").agg(F.min("text").alias("text"))
    return per.select("name", "path", "line", "mode", T.snippet(F.col("text")).alias("text"))


def billing_summary(lines: DataFrame) -> DataFrame:
    """(name, hits, files) of billing_lines outside of tests; billing_files lists the files, first_hits examples."""
    return lines.where("mode = 'scan'").groupBy("name").agg(F.count("*").alias("hits"), F.countDistinct("path").alias("files"))


def billing_files(lines: DataFrame) -> DataFrame:
    """(name, path) of billing_lines outside of tests, each once."""
    return lines.where("mode = 'scan'").select("name", "path").distinct()


def gate_lines(files: DataFrame, include_tests: bool = False, include_docs: bool = False) -> DataFrame:
    """(rule_group, path, line, mode, strength, text): of the rules of a group the first that fires counts on a line."""
    found = signals(_code(files, include_tests, include_docs), rules(*GATES), F.col("text"), ["path", "mode"], first_of_group=True)
    return found.select(F.substring_index("rule_id", ".", 1).alias("rule_group"), "path", "line", "mode", "strength", T.snippet(F.col("text")).alias("text"))


def gate_counts(gates: DataFrame, billing: DataFrame) -> DataFrame:
    """(rule_group, hits, strong, in_tests) of gate_lines and billing_lines; groups without a hit have 0."""
    both = gates.select("rule_group", "mode", "strength").unionByName(billing.select(F.lit("billing").alias("rule_group"), "mode", F.lit(None).cast("string").alias("strength")))
    scan = F.col("mode") == "scan"
    counts = both.groupBy("rule_group").agg(F.count_if(scan).alias("hits"), F.count_if(scan & (F.col("strength") == "strong")).alias("strong"), F.count_if(~scan).alias("in_tests"))
    groups = gates.sparkSession.createDataFrame([(g,) for g in (*GATES, "billing")], "rule_group string")
    return F.broadcast(groups).join(counts, "rule_group", "left").na.fill(0)  # five groups


def safety_findings(files: DataFrame) -> DataFrame:
    """(path, line, signal, masked) of the rules for publishing, the first match of each on a line."""
    table = rules("safety_secret")
    found = signals(files, table, F.col("text"), ["path"])
    return found.select("path", "line", _named(table).alias("signal"), T.mask(F.regexp_substr(F.col("text"), _named(table, "pattern"))).alias("masked"))
