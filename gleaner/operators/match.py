"""Rule engine: texts to lines to signals.

Gates are asked of whole texts first. One pattern finds whether a text holds any rule's word between such characters as
the rule lets stand around it; prose holds many words of rules, but few of them so. Of the texts that pass, a tree of all
words as plain substrings tells which rules may fire. Only these are cut into lines; each line then meets one gate and
one pattern of each such rule. No rule table is joined, and everything is one stage of the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.plans.rules import Rule, near_pattern, words_pattern


def fires(rule: Rule, line: Column, low: Column, gated: bool = True, path: Column | None = None) -> Column:
    cond = line.rlike(rule.scan or rule.pattern)
    if gated and rule.keywords:
        cond = reduce(lambda a, b: a | b, [low.contains(k) for k in rule.keywords]) & cond
    if rule.max_line:
        cond = (F.length(line) <= rule.max_line) & cond
    if rule.path_pattern and path is not None:
        cond = path.rlike(rule.path_pattern) & cond
    return cond


def candidates(rules: list[Rule], text: Column) -> Column:
    """Numbers of the rules that may fire somewhere in the text, ascending: those without a gate, and those with a word in it."""
    of_word: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for k in r.keywords:
            of_word.setdefault(k, []).append(i)
    always = [i for i, r in enumerate(rules) if not r.keywords]
    fixed = F.array(*[F.lit(i) for i in always]) if always else F.expr("cast(array() as array<int>)")
    if not of_word:
        return fixed
    # The longest word at a place tells of the words that it begins with; those inside it are found at their own places.
    table = F.create_map(*[x for w in of_word for x in (F.lit(w), F.array(*[F.lit(i) for k in of_word if w.startswith(k) for i in of_word[k]]))])
    held = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(words_pattern(of_word)), 1))
    return F.array_sort(F.array_union(fixed, F.flatten(F.transform(held, lambda w: F.element_at(table, w)))))


def _of_number(i: Column, values: list[Column], first: int = 0) -> Column:
    """The value of number i, found by halving, so that each pattern stays a literal that is compiled once."""
    if len(values) == 1:
        return values[0]
    half = len(values) // 2
    return F.when(i < first + half, _of_number(i, values[:half], first)).otherwise(_of_number(i, values[half:], first + half))


def signals(df: DataFrame, rules: list[Rule], text: Column, keep: list[str], max_line: int = 0, gated: bool = True, path: Column | None = None, first_of_group: bool = False) -> DataFrame:
    """One row per line and rule that fires: keep columns, line (from 1), rule_id, strength, text (the line).

    max_line: longer lines are passed over (0: only where a rule says so). first_of_group: of the rules of one group
    only the first that fires counts on a line. gated=False asks no gate, not even one that is part of a rule. A null
    text has no lines.
    """
    rows = df.select(*keep, text.alias("_t"), *([path.alias("_path")] if path is not None else []))
    lines = F.posexplode_outer(F.split("_t", "\n", -1)).alias("_pos", "_line")  # outer: no filter is made of it that would split twice
    limit = F.length("_line") <= max_line if max_line else F.lit(True)
    if first_of_group:
        # Few lines fire at all; which rule it is, is asked of these only. A line is lowered by a generator, as the filter would do it for every word.
        rows = rows.where("_t IS NOT NULL").select("*", lines).drop("_t").where(limit).select("*", F.explode_outer(F.array(F.lower("_line"))).alias("_low"))
        at, found = F.col("_path") if path is not None else None, []
        rows = rows.where(reduce(lambda a, b: a | b, [fires(r, F.col("_line"), F.col("_low"), gated, at) for r in rules]))
        for g in dict.fromkeys(r.group for r in rules):
            chain = None
            for i, r in ((i, r) for i, r in enumerate(rules) if r.group == g):
                hit = fires(r, F.col("_line"), F.col("_low"), gated, at)
                chain = F.when(hit, F.lit(i)) if chain is None else chain.when(hit, F.lit(i))
            found.append(chain)
        rows = rows.select("*", F.explode_outer(F.array_compact(F.array(*found))).alias("_i")).where("_i IS NOT NULL")
    else:
        # Lines are cut and lowered once a text; beside each stand the text's candidates, of which few are left by then.
        # A filter on texts or candidates would make these a second time; null texts and those without any have no lines instead.
        may = candidates(rules, F.col("_t")) if gated else F.array(*[F.lit(i) for i in range(len(rules))])
        if gated and (near := near_pattern(rules)):
            may = F.when(F.lower("_t").rlike(near), may)
        cut = F.posexplode_outer(F.when(F.size("_may") > 0, F.split("_t", "\n", -1))).alias("_pos", "_line")
        rows = rows.select("*", may.alias("_may")).select("*", cut).drop("_t").where("_line IS NOT NULL").where(limit).withColumn("_low", F.lower("_line"))
        at = F.col("_path") if path is not None else None
        hit = F.filter("_may", lambda i: _of_number(i, [fires(r, F.col("_line"), F.col("_low"), gated, at) for r in rules]))
        rows = rows.select("*", F.explode_outer(hit).alias("_i")).where("_i IS NOT NULL")
    rule = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_i") + 1)
    return rows.select(*keep, (F.col("_pos") + 1).cast("long").alias("line"), rule(r.rule_id for r in rules).alias("rule_id"), rule(r.strength for r in rules).alias("strength"), F.col("_line").alias("text"))


def summary(found: DataFrame, rules: list[Rule], unit: str) -> DataFrame:
    """Every rule with its lines and distinct units, zero included."""
    spark = found.sparkSession
    table = spark.createDataFrame([(r.rule_id, r.group, r.label, r.strength) for r in rules], "rule_id string, rule_group string, label string, strength string")
    counts = found.groupBy("rule_id").agg(F.count("*").alias("lines"), F.countDistinct(unit).alias("units"))
    # The rule table has as many rows as the library has rules.
    return F.broadcast(table).join(counts, "rule_id", "left").na.fill(0, ["lines", "units"])
