"""URL filter by path-template trees with smoothed labelled purity, in DataFrame functions only.

Urls are counted by host and shape (the path with every run of digits as #), so that all that follows works on distinct
shapes. Per host a tree of templates is grown from the top, one level of segments at a time. A child stays a branch of
its own if it is frequent (SHARE of its node's pages and PAGES of them at least) and differs from the node as a whole:
by Hoeffding's bound, in the share of good labels or in the share of pages that go on below it. All other children,
variable segments and statistically similar branches alike, are merged into the wildcard *, and grow on as one branch.
Segments beyond DEPTH levels count as one, **.

Each node has the labelled pages below it. Its purity is their good share, smoothed by WEIGHT pages of its parent's
purity; a host's parent is the whole table, whose purity is (good + 1) / (labelled + 2). A template is rejected if its
purity is below a half. Here labels come from rules (host and path prefix, allow or block).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import discard, join_counted, materialize

#: (verdict, host, path prefix) of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Levels of a template; a branch's least share of its node's pages (1 / SHARE) and least pages; pages that a parent counts for.
DEPTH, SHARE, PAGES, WEIGHT = 6, 20, 5, 4
#: Of Hoeffding's bound at a level of 0.05.
SPREAD = math.sqrt(0.5 * math.log(2 / 0.05))
#: Rows of one key that are not gathered in one task.
HOT = 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to /, ? or #, A-Z in lower case, and from there up to ? or #; empty without ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, of equally long ones a block, null without one."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _differ(x: str, of: str, all_x: str, all_of: str) -> str:
    """Whether two shares are further apart than Hoeffding's bound allows; a share of nothing differs from none."""
    return f"({of} > 0 and {all_of} > 0 and abs({x} / {of} - {all_x} / {all_of}) > {SPREAD!r}D * (1D / sqrt({of}) + 1D / sqrt({all_of})))"


def _apart() -> str:
    """When a child is a branch of its own: the only child, or a frequent one that differs from its node."""
    return f"(m = 1 or (n >= {PAGES} and n * {SHARE} >= all_n and ({_differ('good', 'labelled', 'all_good', 'all_labelled')} or {_differ('below', 'n', 'all_below', 'all_n')})))"


def _smoothed(good, labelled, parent):
    return (good + WEIGHT * parent) / (labelled + WEIGHT)


def path_templates(shapes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, shape, m, template, purity) of (host, shape, n, good, labelled), m being n; a stage table."""
    segments = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(shape, 2)"), "/", -1))
    cut = F.when(F.size("s") > depth, F.concat(F.slice("s", 1, depth), F.array(F.lit("**")))).otherwise(F.col("s"))
    now = materialize(shapes.withColumn("s", segments).withColumn("s", cut).withColumn("template", F.lit("")), "url-shapes")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "labelled")]
    levels = now.agg(F.max(F.size("s"))).head()[0] or 0
    ended, done = now.where("size(s) = 0"), [now]
    every = now.agg(*sums).select(((F.coalesce("good", F.lit(0)) + 1) / (F.coalesce("labelled", F.lit(0)) + 2)).alias("parent"))
    root = now.groupBy("host").agg(*sums).join(F.broadcast(every)).select("host", F.lit("").alias("template"), _smoothed(F.col("good"), F.col("labelled"), F.col("parent")).alias("purity"))
    purity = [materialize(root, "url-purity")]
    for level in range(1, levels + 1):
        active = now.where(F.size("s") >= level).withColumn("seg", F.get("s", F.lit(level - 1)))
        below = F.sum(F.when(F.size("s") > level, F.col("n")).otherwise(0)).alias("below")
        child = materialize(active.groupBy("host", "template", "seg").agg(F.count("*").alias("rows"), *sums, below), "url-children")
        node = materialize(child.groupBy("host", "template").agg(F.count("*").alias("m"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "good", "labelled", "below")]), "url-nodes")
        named = join_counted(child, node, ["host", "template"], HOT).withColumn("name", F.when(F.expr(_apart()), F.col("seg")).otherwise("*"))
        named = materialize(named.select("host", "template", "seg", F.col("rows").alias("m"), "name", "good", "labelled"), "url-names")
        full = F.concat("template", F.lit("/"), "name")
        # A node has at most SHARE branches beside the wildcard, so its children are few.
        tree = named.groupBy("host", F.col("template").alias("above"), full.alias("template")).agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
        above = purity[-1].select("host", F.col("template").alias("above"), F.col("purity").alias("parent"))
        purity.append(materialize(tree.join(above, ["host", "above"]).select("host", "template", _smoothed(F.col("good"), F.col("labelled"), F.col("parent")).alias("purity")), "url-purity"))
        grown = join_counted(active, named.drop("good", "labelled"), ["host", "template", "seg"], HOT).withColumn("template", full)
        now = materialize(grown.select(*now.columns), "url-shapes")
        ended = ended.unionByName(now.where(F.size("s") == level))
        done += [now, child, node, named]
    known = purity[0]
    for more in purity[1:]:
        known = known.unionByName(more)
    known = materialize(ended.groupBy("host", "template").agg(F.count("*").alias("m")).join(known, ["host", "template"]), "url-templates")
    out = join_counted(ended, known, ["host", "template"], HOT).select("host", "shape", F.col("n").alias("m"), "template", "purity")
    out = materialize(out, "url-known")
    discard(known, *purity, *done)
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of pages: page_id, carried columns, host, path, rule, verdict, template and purity.

    verdict is the rule's, else block where the template's purity is below a half, else allow. A null url, and one
    without ://, has an empty host and path; those share one host. Repeated rows count as often as they occur. Other
    columns of pages, whatever their names, play no part; carried ones may have any name but those of the result. An
    empty table gives no rows. The result reads a stage table of one row per host and shape, which stays behind.
    """
    host, path = host_and_path(F.col(url))
    held = [f"_c{i}" for i in range(len(carry))]
    own = pages.select(F.col(page_id).alias("page_id"), *[F.col(c).alias(h) for c, h in zip(carry, held, strict=True)], host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = own.select("*", F.regexp_replace("path", "[0-9]+", "#").alias("shape"), rule.alias("rule"), verdict.alias("said"))
    shapes = own.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("good"), F.count("said").alias("labelled"))
    out = join_counted(own, path_templates(shapes), ["host", "shape"], HOT)
    judged = F.coalesce("said", F.when(F.col("purity") < 0.5, "block").otherwise("allow"))
    return out.select("page_id", *[F.col(h).alias(c) for c, h in zip(carry, held, strict=True)], "host", "path", "rule", judged.alias("verdict"), "template", "purity")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with the five rules as labels."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    by = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[0] == "block"), reverse=True)
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[1], r[2])} THEN '{r[1] + r[2] if i else r[0]}'" for r in by) + " END"
    apart = _apart().replace("1D", "1.0::DOUBLE").replace(f"{SPREAD!r}D", f"{SPREAD!r}::DOUBLE")
    parts = [
        "u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"p AS (SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS shape, {case(1)} AS rule, {case(0)} AS said FROM hp)",
        "s AS (SELECT host, shape, count(*) AS n, count(*) FILTER (WHERE said = 'allow') AS good, count(said) AS labelled FROM p GROUP BY host, shape)",
        f"g AS (SELECT *, CASE WHEN shape = '' THEN []::VARCHAR[] ELSE string_split(substr(shape, 2), '/') END AS f FROM s), r0 AS (SELECT host, shape, n, good, labelled, CASE WHEN len(f) > {DEPTH} THEN list_concat(f[1:{DEPTH}], ['**']) ELSE f END AS s, '' AS template FROM g)",
        f"p0 AS (SELECT host, '' AS template, (sum(good) + {WEIGHT} * (SELECT (sum(good) + 1) / (sum(labelled) + 2) FROM r0)) / (sum(labelled) + {WEIGHT}) AS purity FROM r0 GROUP BY host)",
    ]
    for d in range(1, DEPTH + 2):
        q = d - 1
        parts += [
            f"c{d} AS (SELECT host, template, s[{d}] AS seg, sum(n) AS n, sum(good) AS good, sum(labelled) AS labelled, coalesce(sum(n) FILTER (WHERE len(s) > {d}), 0) AS below FROM r{q} WHERE len(s) >= {d} GROUP BY ALL)",
            f"n{d} AS (SELECT host, template, count(*) AS m, sum(n) AS all_n, sum(good) AS all_good, sum(labelled) AS all_labelled, sum(below) AS all_below FROM c{d} GROUP BY ALL)",
            f"k{d} AS (SELECT host, template, seg, good, labelled, CASE WHEN {apart} THEN seg ELSE '*' END AS name FROM c{d} JOIN n{d} USING (host, template))",
            f"r{d} AS (SELECT r.host, r.shape, r.n, r.good, r.labelled, r.s, r.template || '/' || k.name AS template FROM r{q} r JOIN k{d} k ON r.host = k.host AND r.template = k.template AND r.s[{d}] = k.seg WHERE len(r.s) >= {d})",
            f"p{d} AS (SELECT k.host, k.template || '/' || k.name AS template, (sum(good) + {WEIGHT} * purity) / (sum(labelled) + {WEIGHT}) AS purity FROM k{d} k JOIN p{q} USING (host, template) GROUP BY k.host, k.template, k.name, purity)",
        ]
    levels = range(DEPTH + 2)
    parts.append("e AS (" + " UNION ALL ".join(f"SELECT host, shape, template FROM r{d} WHERE len(s) = {d}" for d in levels) + "), pu AS (" + " UNION ALL ".join(f"SELECT * FROM p{d}" for d in levels) + ")")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, purity::DOUBLE AS purity FROM p JOIN e USING (host, shape) JOIN pu USING (host, template)"


OP12_SQL = _sql()
