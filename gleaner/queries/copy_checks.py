"""Drafts and documents: D01, D04-D06, P26, P41-P45, S21, S22, W09, A33."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import documents as DOC
from gleaner.operators import lint as L
from gleaner.operators import markdown as MD
from gleaner.plans.rules import SUPERLATIVE_LINE
from gleaner.queries import fixtures as X
from gleaner.queries.base import query, quote, table

_FINDINGS = """(VALUES ('x', 2, 'superlative', 'best'), ('x', 2, 'comparative', 'Unlike Rival'), ('x', 6, 'undated_number', 'Rival has 500 users.'), ('x', 8, 'too_long', '41 words (limit 40)'), ('x', 14, 'forbidden', 'game changer'), ('x', 14, 'comparative', 'faster than Rival'),
('x', 14, 'superlative', '100%'), ('x', 14, 'undated_number', 'A game changer, faster than Rival, 100% safe'), ('y', 1, 'superlative', 'Never'), ('y', 1, 'superlative', 'cheapest'), ('y', 1, 'superlative', 'first-ever')) t(doc, line, rule, detail)"""


def _found(spark: SparkSession) -> DataFrame:
    return L.findings(X.COPY.df(spark), "doc", [r[0] for r in X.FORBIDDEN.rows], ["Rival"])


@query(f"SELECT doc, line::BIGINT AS line, rule, detail FROM {_FINDINGS}")
def claims_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules outside code and muted parts; the SQL states the rows."""
    return _found(spark)


@query(f"SELECT count(*)::BIGINT AS findings, count(*) FILTER (WHERE rule IN ('forbidden', 'too_long'))::BIGINT AS failing, count(*) FILTER (WHERE rule NOT IN ('forbidden', 'too_long'))::BIGINT AS warnings FROM {_FINDINGS}")
def lint_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing findings and warnings."""
    return L.totals(_found(spark))


@query("""WITH l AS (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line, unnest(string_split(text, chr(10))) AS x FROM conversations)
SELECT conv_id, turn, line, len(regexp_extract_all(x, '\\S+'))::INT AS words FROM l WHERE len(regexp_extract_all(x, '\\S+')) > 40""")
def long_turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P42 over all conversations: lines of more than 40 words."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "x"))
    return rows.withColumn("words", F.size(F.regexp_extract_all("x", F.lit(r"(\S+)"), 1))).where("words > 40").select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("line"), "words")


@query("SELECT * FROM (VALUES ('secretname', false, 'docs/a.md,/README.md'), ('code ?word', true, '')) t(term, is_pattern, allow)")
def denied_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deny list; the SQL states the rows."""
    return L.denied_terms(X.DENIED.df(spark))


_TREE = X.Fixture("file string, text string", [("docs/a.md", "the SecretName"), ("x/docs/a.md", "secretname"), ("README.md", "secretname"), ("sub/README.md", "secretname codeword"), ("b.md", "a code word")])


@query("SELECT * FROM (VALUES ('sub/README.md', 'secretname'), ('sub/README.md', 'code ?word'), ('b.md', 'code ?word')) t(file, term)")
def denied_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denied terms in files that are not allowed to hold them; the SQL states the rows."""
    terms = L.denied_terms(X.DENIED.df(spark))
    # The deny list is the user's own short list; each file meets each of its terms.
    rows = _TREE.df(spark).join(F.broadcast(terms), ~L.is_allowed(F.col("allow"), F.col("file")), "inner")
    hit = F.when(F.col("is_pattern"), F.expr("lower(text) rlike lower(term)")).otherwise(F.lower("text").contains(F.lower("term")))
    return rows.where(hit).select("file", "term")


@query("SELECT doc, part::BIGINT AS part, start::BIGINT AS start, chars::BIGINT AS chars, error FROM (VALUES ('m', 0, 0, 78, NULL), ('m', 1, 78, 55, NULL), ('n', 0, 0, 5, NULL), ('o', 0, 0, 105, 'a section is longer than 80 characters')) t(doc, part, start, chars, error)")
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest parts of at most 80 characters, evenly; the SQL states the rows."""
    return DOC.split_documents(X.MARKDOWN.df(spark), "doc", "text", 80)


_LIMIT = 18_000
# Lines end at line feeds in this table; the dynamic programme and the walk are recursive over the points of each document.
_CHUNKS = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT r, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS pos, len(string_split(t, chr(10))) AS c FROM d),
l AS (SELECT r, pos, x, length(x) + CASE WHEN pos < c THEN 1 ELSE 0 END AS n, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS b FROM u WHERE x <> '' OR pos < c),
f AS (SELECT *, starts_with(b, '```') AS fence, coalesce(sum(CASE WHEN starts_with(b, '```') THEN 1 ELSE 0 END) OVER w, 0) AS fences, coalesce(sum(n) OVER w, 0) AS off FROM l WINDOW w AS (PARTITION BY r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, fence OR fences % 2 = 1 AS code FROM f),
h AS (SELECT *, CASE WHEN code THEN NULL WHEN starts_with(b, '</table>') THEN 0 WHEN regexp_matches(b, '^<table[\\s>]') THEN 1 END AS tb, CASE WHEN code THEN NULL WHEN starts_with(b, '</callout>') THEN 0 WHEN starts_with(b, '<callout') THEN 1 END AS cb FROM g),
k AS (SELECT *, coalesce(last_value(tb IGNORE NULLS) OVER w, 0) AS in_t, coalesce(last_value(cb IGNORE NULLS) OVER w, 0) AS in_c, coalesce(last_value(tb IGNORE NULLS) OVER v, 0) + coalesce(last_value(cb IGNORE NULLS) OVER v, 0) AS open FROM h
      WINDOW w AS (PARTITION BY r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT r, sum(n)::BIGINT AS chars, list(off ORDER BY off) FILTER (WHERE off > 0 AND NOT code AND in_t = 0 AND in_c = 0 AND (starts_with(x, '## ') OR starts_with(x, '### '))) AS cuts, sum(fence::INT) % 2 = 0 AND arg_max(open, pos) = 0 AS balanced FROM k GROUP BY r),
p AS (SELECT r, chars, balanced, list_concat(list_concat([0], coalesce(list_filter(cuts, lambda c: c < chars), [])), [chars])::BIGINT[] AS p FROM m),
dp AS (SELECT r, p, len(p) - 1 AS i, [{{'parts': 0, 'largest': 0::BIGINT, 'next': -1::BIGINT}}] AS best FROM p WHERE balanced
  UNION ALL SELECT r, p, i - 1, list_concat([list_sort(list_filter(list_transform(range(len(best)), lambda j: CASE WHEN best[j + 1] IS NULL OR p[i + j + 1] - p[i] > {_LIMIT} THEN NULL ELSE {{'parts': best[j + 1].parts + 1, 'largest': greatest(best[j + 1].largest, p[i + j + 1] - p[i]), 'next': i + j}} END), lambda y: y IS NOT NULL))[1]], best) FROM dp WHERE i > 0),
w AS (SELECT r, p, best, 0::BIGINT AS i0, 0::BIGINT AS part FROM dp WHERE i = 0 AND best[1] IS NOT NULL UNION ALL SELECT r, p, best, best[i0 + 1].next, part + 1 FROM w WHERE i0 < len(p) - 1),
o AS (SELECT r, part AS part, p[i0 + 1] AS start, p[best[i0 + 1].next + 1] - p[i0 + 1] AS chars FROM w WHERE i0 < len(p) - 1)
SELECT d.doc_id, coalesce(o.part, 0)::BIGINT AS part, coalesce(o.start, 0)::BIGINT AS start, coalesce(o.chars, p.chars, 0)::BIGINT AS chars,
  CASE WHEN p.r IS NULL THEN NULL WHEN NOT p.balanced THEN 'unbalanced table, callout or code block' WHEN o.r IS NULL THEN 'a section is longer than {_LIMIT} characters' END AS error FROM d LEFT JOIN p USING (r) LEFT JOIN o USING (r)"""


@query(_CHUNKS)
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D04, D05 over all documents."""
    return DOC.split_documents(table(spark, sf_dir, "documents"), "doc_id", "text", _LIMIT)


@query()
def converted_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Markdown for a block editor. Not expressible in SQL; tests state conversions of every kind of block."""
    return MD.convert_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


_PHRASES, _RIVALS = ["# words we do not use", "game changer", "re:revolution\\w*", "is of", "de la"], ["Than", "Nicht"]
_SUPERLATIVE = quote(SUPERLATIVE_LINE)
_MUTED = f"coalesce(last_value(CASE WHEN starts_with(trim(x), '```') THEN NULL WHEN contains(x, {quote(L.ON)}) THEN false WHEN contains(x, {quote(L.OFF)}) THEN true END IGNORE NULLS) OVER (PARTITION BY r ORDER BY line), false)"
_LIVE = f"""d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS t FROM documents), l AS (SELECT r, doc_id, unnest(t) AS x, generate_subscripts(t, 1)::BIGINT AS line FROM d),
w AS (SELECT *, starts_with(trim(x), '```') AS fence, sum(CASE WHEN starts_with(trim(x), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY line) % 2 = 1 AS code, {_MUTED} AS muted FROM l),
v AS (SELECT doc_id, line, x FROM w WHERE NOT fence AND NOT code AND NOT muted AND NOT contains(x, {quote(L.ON)}) AND NOT contains(x, {quote(L.OFF)}) AND NOT contains(x, {quote(L.IGNORE)}))"""
_NAMED = "(" + " OR ".join(f"contains(lower(x), {quote(c.lower())})" for c in _RIVALS) + ")"
_LINES = f"""WITH {_LIVE}, f AS (SELECT doc_id, line, 'forbidden' AS rule FROM v WHERE {" OR ".join(f"regexp_matches(x, {quote(p)})" for _, p in L.phrase_rules(_PHRASES))}
UNION SELECT doc_id, line, 'too_long' FROM v WHERE starts_with(x, '>') AND len(regexp_extract_all(regexp_replace(x, '^[> ]+', ''), '\\S+')) > 40
UNION SELECT doc_id, line, 'superlative' FROM v WHERE regexp_matches(x, {_SUPERLATIVE})
UNION SELECT doc_id, line, 'comparative' FROM v WHERE {" OR ".join(f"regexp_matches(x, {quote('(?i)' + chr(92) + 'b' + L.COMPARATIVE + chr(92) + 's+' + c + chr(92) + 'b')})" for c in _RIVALS)}
UNION SELECT doc_id, line, 'undated_number' FROM v WHERE {_NAMED} AND regexp_matches(regexp_replace(x, {quote(L.NO_CLAIM)}, ' ', 'g'), {quote(L.NUMBER)}) AND NOT regexp_matches(x, {quote(L.DATE)}))"""


def _lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.live_lines_of(table(spark, sf_dir, "documents"), "doc_id")
    return L.live_findings(lines, "doc_id", _PHRASES, _RIVALS).select("doc_id", "line", "rule").distinct()


@query(_LINES + " SELECT doc_id, line, rule FROM f")
def lint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01, P41-P45, S21, W09 over all documents: lines and the rules that they break."""
    return _lint(spark, sf_dir)


@query(_LINES + " SELECT count(*)::BIGINT AS findings, count(*) FILTER (WHERE rule IN ('forbidden', 'too_long'))::BIGINT AS failing, count(*) FILTER (WHERE rule NOT IN ('forbidden', 'too_long'))::BIGINT AS warnings FROM f")
def lint_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A33 over all documents: failing lines and warnings."""
    return L.totals(_lint(spark, sf_dir))
