"""Wording problems in drafts: forbidden phrases, long quotes, superlatives, comparisons, undated numbers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.plans.rules import SUPERLATIVES, gate

# Markers, dates, numbers and what is no claim.
OFF, ON, IGNORE = "<!-- claims-lint: off -->", "<!-- claims-lint: on -->", "<!-- claims-lint: ignore -->"
DATE = r"(?i)\b(\d{4}-\d{2}-\d{2}|\d{1,2} (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{4}|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2},? \d{4}|(as of|on) \w+ \d{4}|q[1-4] \d{4})\b"
NUMBER = r"(?i)\b\d[\d,.]*\s?(%|k\b|m\b|x\b|stars|users|downloads|customers)?"
NO_CLAIM = r"`[^`]*`|\bv?\d+\.\d+(?:\.\d+)+\b|[\w./-]+\.\w+:\d+(?:-\d+)?|\[[^\]]*\]\([^)]*\)|^\s*(?:#+\s*)?\d+[.)]\s"
COMPARATIVE = r"(?:unlike|better than|faster than|cheaper than|safer than|more \w+ than|worse than|slower than|instead of|vs\.?|versus)"


def phrase_rules(lines: list[str]) -> list[tuple[str, str]]:
    """(label, pattern): blank lines and # are skipped; re: is a pattern; others are whole words."""
    out = []
    for line in (x.strip() for x in lines):
        if line and not line.startswith("#"):
            out.append((line, "(?i)" + (line[3:] if line.startswith("re:") else r"(?:^|[^\p{L}\p{N}_])" + re.sub(r"([^\w\s])", r"\\\1", line) + r"(?:[^\p{L}\p{N}_]|$)")))
    return out


def denied_terms(lines: DataFrame, column: str = "line") -> DataFrame:
    """(term, is_pattern, allow) of a deny list with '@allow=a,b' endings."""
    c = F.trim(F.col(column))
    rows = lines.where((c != "") & ~c.startswith("#"))
    tail = r"^(.*?)\s+@allow=(\S+)$"
    term = F.trim(F.when(c.rlike(tail), F.regexp_extract(c, tail, 1)).otherwise(c))
    return rows.select(F.regexp_replace(term, "^re:", "").alias("term"), term.startswith("re:").alias("is_pattern"), F.when(c.rlike(tail), F.regexp_extract(c, tail, 2)).otherwise("").alias("allow"))


def is_allowed(allow, file):
    """'/x' is that path from the root; others are the path or its end."""
    return F.exists(F.filter(F.split(allow, ","), lambda a: a != ""), lambda a: F.when(a.startswith("/"), file == F.substring(a, 2, 10_000)).otherwise((file == a) | file.endswith(F.concat(F.lit("/"), a))))


def live_lines(lines: DataFrame, unit: str) -> DataFrame:
    """Lines outside fenced code and muted parts: fences count up, the last marker above decides."""
    w = Window.partitionBy(unit).orderBy("line")
    fence = F.trim("text").startswith("```")
    on, off = F.col("text").contains(ON), F.col("text").contains(OFF)
    rows = lines.withColumns({"fence": fence, "code": F.sum(fence.cast("int")).over(w) % 2})
    # Markers inside code count as well, but a fence line itself is passed over.
    rows = rows.withColumn("muted", F.coalesce(F.last(F.when(fence, None).when(on, False).when(off, True), ignorenulls=True).over(w), F.lit(False)))
    return rows.where(~F.col("fence") & (F.col("code") == 0) & ~F.col("muted") & ~on & ~F.col("text").contains(IGNORE)).drop("fence", "code", "muted")


def live_lines_of(texts: DataFrame, unit: str, text: str = "text") -> DataFrame:
    """(unit, line, text): live lines of whole texts; only those that hold a fence or a marker have their lines put in order."""
    c = F.col(text)
    marked = c.contains("```") | c.contains(OFF)
    cut = lambda df: df.select(unit, F.posexplode(F.split(c, "\n", -1)).alias("pos", "text")).select(unit, (F.col("pos") + 1).cast("long").alias("line"), "text")
    plain = cut(texts.where(~marked)).where(~F.col("text").contains(ON) & ~F.col("text").contains(IGNORE))
    return plain.unionByName(live_lines(cut(texts.where(marked)), unit))


def _held(low: Column, pattern: str) -> Column:
    """Whether a lowered line holds a word that every match of the pattern holds."""
    try:
        words = gate(pattern)
    except re.error:
        words = ()  # a pattern of Java's own
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words]) if words else F.lit(True)


def findings(lines: DataFrame, unit: str, forbidden: list[str], competitors: list[str], max_words: int = 40, superlatives: bool = True) -> DataFrame:
    """(unit, line, rule, detail)."""
    return live_findings(live_lines(lines, unit), unit, forbidden, competitors, max_words, superlatives)


def live_findings(lines: DataFrame, unit: str, forbidden: list[str], competitors: list[str], max_words: int = 40, superlatives: bool = True) -> DataFrame:
    """findings of lines that are live. Details are made for lines that break a rule only; words are looked for before patterns."""
    t, low = F.col("text"), F.col("_low")
    out, broken = [], []
    for label, pattern in phrase_rules(forbidden):
        hit = _held(low, label[3:] if label.startswith("re:") else re.escape(label)) & t.rlike(pattern)
        broken.append(hit)
        out.append(F.array(F.when(hit, F.struct(F.lit("forbidden").alias("rule"), F.lit(label).alias("detail")))))
    words = F.size(F.regexp_extract_all(F.regexp_replace(t, "^[> ]+", ""), F.lit(r"(\S+)"), 1))
    broken.append(t.startswith(">") & (words > max_words))
    out.append(F.array(F.when(t.startswith(">") & (words > max_words), F.struct(F.lit("too_long").alias("rule"), F.concat(words.cast("string"), F.lit(f" words (limit {max_words})")).alias("detail")))))
    if superlatives:
        pattern = rf"(?i)(?<![\p{{L}}\p{{N}}_])({SUPERLATIVES})(?![\p{{L}}\p{{N}}_])"
        broken.append(_held(low, SUPERLATIVES) & t.rlike(pattern))
        out.append(F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), lambda x: F.struct(F.lit("superlative").alias("rule"), x.alias("detail"))))
    for c in competitors:
        pattern = rf"(?i)\b{COMPARATIVE}\s+{re.escape(c)}\b"
        broken.append(_held(low, re.escape(c)) & t.rlike(pattern))
        hit = F.regexp_extract(t, pattern, 0)
        out.append(F.array(F.when(hit != "", F.struct(F.lit("comparative").alias("rule"), hit.alias("detail")))))
    if competitors:
        named = reduce(lambda a, b: a | b, [low.contains(c.lower()) for c in competitors])
        claim = F.regexp_replace(t, NO_CLAIM, " ").rlike(NUMBER) & ~t.rlike(DATE)
        broken.append(named & t.rlike(r"\d") & claim)
        out.append(F.array(F.when(named & claim, F.struct(F.lit("undated_number").alias("rule"), F.substring(F.trim(t), 1, 120).alias("detail")))))
    # A column of a generator, so that the filter does not lower each line for every word.
    rows = lines.select(unit, "line", "text", F.explode_outer(F.array(F.lower("text"))).alias("_low")).where(reduce(lambda a, b: a | b, broken))
    # outer: no filter is made of it that would ask every pattern once more.
    rows = rows.select(unit, "line", F.explode_outer(F.array_compact(F.concat(*out))).alias("f")).where("f IS NOT NULL")
    return rows.select(unit, "line", "f.rule", "f.detail")


def totals(found: DataFrame) -> DataFrame:
    """findings, failing (forbidden and too long) and warnings: one row."""
    failing = F.col("rule").isin("forbidden", "too_long")
    return found.agg(F.count("*").alias("findings"), F.count_if(failing).alias("failing"), F.count_if(~failing).alias("warnings"))
