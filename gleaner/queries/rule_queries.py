"""Rule engine over whole tables: J01, J02, P20-P22, P25, P27, P30, P40, P43, A25, T05, T12, W12 and the rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import classify as C
from gleaner.functions import text as T
from gleaner.operators.early import first_in_order
from gleaner.operators.match import signals, summary
from gleaner.operators.pages import page_text
from gleaner.operators.running import running
from gleaner.plans import signatures as S
from gleaner.plans.rules import SUPERLATIVE_LINE, Rule, rules
from gleaner.queries import fixtures as X
from gleaner.queries.base import query, quote, table
from gleaner.queries.page_queries import BODY_SQL
from gleaner.sources.shared import materialize

_TEXTS_SQL = f"(SELECT 'd' || doc_id AS unit, text FROM documents UNION ALL SELECT 'p' || page_id, {BODY_SQL} FROM pages)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("unit"), "text")
    pages = page_text(table(spark, sf_dir, "pages")).select(F.concat(F.lit("p"), "page_id").alias("unit"), F.col("body").alias("text"))
    return docs.unionByName(pages)


def _cond(r: Rule) -> str:
    gate = " OR ".join(f"contains(low, {quote(k)})" for k in r.keywords) if r.group in ("telemetry", "control") else ""
    return (f"({gate}) AND " if gate else "") + (f"length(line) <= {r.max_line} AND " if r.max_line else "") + f"regexp_matches(line, {quote(r.pattern)})"


def _summary_sql(source: str, table_: list[Rule], unit: str = "unit") -> str:
    """Each rule's lines and units, with the gates left out where they are no part of the rule."""
    one = ", ".join(f"struct_pack(rule_id := {quote(r.rule_id)}, rule_group := {quote(r.group)}, label := {quote(r.label)}, strength := {quote(r.strength)}, lines := count(*) FILTER (WHERE {_cond(r)}), units := count(DISTINCT {unit}) FILTER (WHERE {_cond(r)}))" for r in table_)
    return f"""WITH l AS (SELECT {unit}, unnest(string_split(text, chr(10))) AS line FROM {source}), w AS (SELECT *, lower(line) AS low FROM l),
a AS (SELECT unnest([{one}]) AS r FROM w) SELECT r.rule_id, r.rule_group, r.label, r.strength, r.lines::BIGINT AS lines, r.units::BIGINT AS units FROM a"""


_ALL = [r for r in rules() if r.group not in ("superlative", "email")]


@query(_summary_sql(_TEXTS_SQL, _ALL))
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and units of every rule over documents and pages; rules without a hit have 0."""
    return summary(signals(_texts(spark, sf_dir), _ALL, F.col("text"), ["unit"]), _ALL, "unit")


_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line, unnest(string_split(text, chr(10))) AS x FROM documents),
e AS (SELECT doc_id, line, unnest(regexp_extract_all(x, '{_EMAIL}')) AS a FROM l)
SELECT doc_id, line, substr(a, 1, 4) || '... (' || length(a) || ' chars)' AS masked FROM e WHERE NOT regexp_matches(a, '(?i)(?:@example\\.(?:com|org|net)|@users\\.noreply\\.github\\.com|^noreply@github\\.com)$')""")
def email_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in documents, masked; documentation and no-reply addresses are none."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "x")).where(F.col("x").contains("@"))
    rows = rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("x", F.lit(_EMAIL), 0)).alias("a")).where(~C.allowed_email(F.col("a")))
    return rows.select("doc_id", "line", T.mask(F.col("a")).alias("masked"))




def _secret_lines() -> X.Fixture:
    # Put together here, so that no file holds anything shaped like a secret.
    gh, aws, pk = "ghp_" + "aB3dE5gH7jK9" * 3, "AK" + "IA" + "QWERTYUIOP123456", "-----BEGIN RSA PRIVATE" + " KEY-----"
    rows = [("a", 1, f"token = {gh}"), ("a", 2, f"example {gh}"), ("a", 3, f"id {aws} end"), ("a", 4, "AK" + "IA" + "AAAAAAAAAAAAAAAA"), ("b", 1, pk), ("b", 2, "test " + pk), ("b", 3, "hf_" + "Zx9" * 12), ("b", 4, "nothing here")]
    return X.Fixture("file string, line long, text string", rows)


def _placeholder_sql(v: str, line: str) -> str:
    core = f"regexp_replace({v}, '^(gh[pousr]_|github_pat_|AKIA|AIza|xox[abprs]-|(sk|rk)_live_|sk-(proj-)?)', '')"
    return f"CASE WHEN contains({v}, 'PRIVATE KEY') THEN regexp_matches({line}, '(?i)example|dummy|fake|test') ELSE len(list_distinct(string_split({core}, ''))) <= 6 OR regexp_matches({v} || ' ' || {line}, '(?i)example|redact|dummy|fake|placeholder|xxxx|0000|your[_-]?key') END"


def _secrets_sql(source: str) -> str:
    parts = [f"SELECT file, line, {quote(n)} AS signal, regexp_extract(text, {quote(p)}) AS v, text FROM {source} WHERE regexp_matches(text, {quote(p)})" for n, p in S.SCAN_SECRETS]
    return f"SELECT file, line, signal, substr(v, 1, 4) || '... (' || length(v) || ' chars)' AS masked FROM ({' UNION ALL '.join(parts)}) WHERE NOT {_placeholder_sql('v', 'text')}"


def _secret_findings(lines: DataFrame) -> DataFrame:
    """lines (file, line, text): one row per rule that fires and is no placeholder."""
    pick = [F.struct(F.lit(n).alias("signal"), F.regexp_extract("text", p, 0).alias("v")) for n, p in S.SCAN_SECRETS]
    rows = lines.select("file", "line", "text", F.explode(F.filter(F.array(*pick), lambda s: s["v"] != "")).alias("s")).select("file", "line", "text", "s.signal", "s.v")
    return rows.where(~C.is_placeholder(F.col("v"), F.col("text"))).select("file", "line", "signal", T.mask(F.col("v")).alias("masked"))


_SECRET_FILES = X.Beside(_secret_lines())


@query(_secrets_sql(_SECRET_FILES.lines_sql()))
def secret_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in lines, without placeholders, masked."""
    lines = _SECRET_FILES.df(spark, sf_dir).select("file", F.posexplode(T.lines(F.col("text"))).alias("pos", "text"))
    return _secret_findings(lines.select("file", (F.col("pos") + 1).cast("long").alias("line"), "text"))


@query(_secrets_sql("(SELECT 'd' || doc_id AS file, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"))
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P21, P22 over all documents; a text without any rule's words is not cut into lines."""
    docs = table(spark, sf_dir, "documents").where(F.lower("text").rlike("gh[pousr]_|github_pat_|akia|aiza|xox|_live_|sk-|private key"))
    rows = docs.select(F.concat(F.lit("d"), "doc_id").alias("file"), F.posexplode(T.lines(F.col("text"))).alias("pos", "text"))
    return _secret_findings(rows.select("file", (F.col("pos") + 1).cast("long").alias("line"), "text"))


@query(f"WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, line FROM l WHERE regexp_matches(x, {quote(SUPERLATIVE_LINE)})")
def superlative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines with a superlative; its words are too common for a gate to spare anything."""
    return signals(table(spark, sf_dir, "documents"), rules("superlative"), F.col("text"), ["doc_id"], gated=False).select("doc_id", "line")


@query(_summary_sql("(SELECT file AS unit, text FROM " + X.CODE.sql() + ")", [r for r in _ALL if not r.path_pattern]))
def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22, A24-A26 on lines of code."""
    table_ = [r for r in _ALL if not r.path_pattern]
    return summary(signals(X.CODE.df(spark, sf_dir).withColumnRenamed("file", "unit"), table_, F.col("text"), ["unit"]), table_, "unit")


_TEL = rules("telemetry", limited=False)


@query(f"""WITH l AS (SELECT *, lower(text) AS low FROM {X.CODE.lines_sql()}),
h AS ({' UNION ALL '.join(f"SELECT file, line, {quote(r.label)} AS name, {quote(r.strength)} AS s, low FROM l WHERE ({' OR '.join(f'contains(low, {quote(k)})' for k in r.keywords)}) AND regexp_matches(text, {quote(r.pattern)})" for r in _TEL)}),
u AS (SELECT name, file, line, max(CASE WHEN s = 'usage' OR contains(low, '://') OR contains(low, '<script') OR contains(low, 'src=') THEN 1 ELSE 0 END) AS used FROM h GROUP BY ALL)
SELECT name, count(DISTINCT file)::BIGINT AS files, CASE WHEN max(used) = 1 THEN 'usage' ELSE 'mention only' END AS strength, count(*)::BIGINT AS hits FROM u GROUP BY name""")
def telemetry_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with files and strength; a bare domain is a mention unless the line loads it."""
    found = signals(X.CODE.df(spark, sf_dir), _TEL, F.col("text"), ["file"]).withColumnRenamed("line", "n")
    names = F.create_map(*[F.lit(x) for r in _TEL for x in (r.rule_id, r.label)])
    low = F.lower("text")
    used = (F.col("strength") == "usage") | low.contains("://") | low.contains("<script") | low.contains("src=")
    per = found.withColumn("name", names[F.col("rule_id")]).groupBy("name", "file", "n").agg(F.bool_or(used).alias("used"))
    return per.groupBy("name").agg(F.countDistinct("file").alias("files"), F.when(F.bool_or("used"), "usage").otherwise("mention only").alias("strength"), F.count("*").alias("hits"))


@query(f"""WITH l AS (SELECT *, lower(text) AS low FROM {X.CODE.lines_sql()}) SELECT file, line, text FROM l
WHERE ({' OR '.join(f'contains(low, {quote(k.lower())})' for k in S.CONTROL_KEYWORDS)}) AND ({' OR '.join(f"regexp_matches(text, {quote('(?i)' + p)})" for p in S.CONTROLS)}) AND NOT regexp_matches(text, {quote(S.IGNORE_CONTROLS[0])}) ORDER BY file, line LIMIT 6""")
def control_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consent and telemetry switches, the first 6 x max_hits (1 here) in the order of files and lines. A top-k report."""

    def find(files: DataFrame) -> DataFrame:
        found = signals(files, rules("control", limited=False), F.col("text"), ["file"]).where(~F.col("text").rlike(S.IGNORE_CONTROLS[0]))
        return found.select("file", "line", "text").distinct()

    return first_in_order(X.CODE.df(spark, sf_dir), ["file"], find, 6, ["file", "line"])


def _hardening_sql() -> str:
    parts = [f"SELECT {quote(r.area)} AS area, {quote(r.label)} AS signal, file, line FROM {X.CODE.lines_sql()} WHERE regexp_matches(text, {quote(r.pattern)})" + (f" AND regexp_matches(file, {quote(r.path_pattern)})" if r.path_pattern else "") for r in rules("hardening")]
    return f"SELECT area, signal, file, line FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY file, line, signal) AS n FROM ({' UNION ALL '.join(parts)})) WHERE n <= 200"


@query(_hardening_sql())
def hardening_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hardening signals, at most 200 per area; one rule counts in builder configuration only."""
    table_ = rules("hardening", limited=False)
    found = signals(X.CODE.df(spark, sf_dir), table_, F.col("text"), ["file"], path=F.col("file")).withColumnRenamed("line", "n")
    area, label = (F.create_map(*[F.lit(x) for r in table_ for x in (r.rule_id, getattr(r, k))]) for k in ("area", "label"))
    rows = found.select(area[F.col("rule_id")].alias("area"), label[F.col("rule_id")].alias("signal"), "file", F.col("n").alias("line"))
    w = Window.partitionBy("area").orderBy("file", "line", "signal")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 200").drop("r")


_GATES = rules("license_gate", "plan_gate", "offer", "lead_capture", limited=False)


def _ranked_sql() -> str:
    groups = dict.fromkeys(r.group for r in _GATES)
    parts = []
    for g in groups:
        own = [r for r in _GATES if r.group == g]
        cases = lambda f: "CASE " + " ".join(f"WHEN regexp_matches(text, {quote(r.pattern)}) THEN {quote(f(r))}" for r in own) + " END"  # noqa: E731, B023
        parts.append(f"SELECT {quote(g)} AS rule_group, file, line, {cases(lambda r: r.rule_id)} AS rule_id, {cases(lambda r: r.strength)} AS strength FROM {X.CODE.lines_sql()}")
    ci = "regexp_matches(file, '(^|/)\\.github/|\\.(ya?ml|sh)$')"
    return f"SELECT rule_group, file, line, rule_id, strength, row_number() OVER (PARTITION BY rule_group ORDER BY strength <> 'strong', {ci}, file, line)::INT AS place FROM ({' UNION ALL '.join(parts)}) WHERE rule_id IS NOT NULL"


@query(_ranked_sql())
def ranked_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of each group on a line of any length; strong before weak, workflow and shell files last, files without a path behind these."""
    found = signals(X.CODE.df(spark, sf_dir), _GATES, F.col("text"), ["file"], first_of_group=True).withColumnRenamed("line", "n")
    # Written down first: to be put in order, rows are read twice.
    rows = materialize(found.select(F.substring_index("rule_id", ".", 1).alias("rule_group"), "file", F.col("n").alias("line"), "rule_id", "strength"), "gate-hits")
    ci = F.col("file").rlike(r"(^|/)\.github/|\.(ya?ml|sh)$")
    order = [F.col("strength") != "strong", ci.asc_nulls_last(), F.asc_nulls_last("file"), "line"]
    return running(rows, ["rule_group"], order, sums={"place": F.lit(1)}, name="gates").withColumn("place", F.col("place").cast("int"))


_SEAM = "\\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_(?:URL|URI|TOKEN|KEY|ENDPOINT|HOST|BASE_URL)\\b"
_SEAM_LINES = X.Fixture("file string, line long, text string", [("a.ts", 1, "const a = env.CLOUD_API_URL || RELAY_TOKEN"), ("a.ts", 2, "CLOUDY_URL and MY_MANAGED_BASE_URL"), ("b.ts", 1, "CLOUD_API_URL"), ("b.ts", 2, "PROXY_SERVICE_HOST, X_CONTROL_PLANE_KEY")])
_SEAMS = X.Beside(_SEAM_LINES)


@query(f"""WITH m AS (SELECT file, line, unnest(regexp_extract_all(text, '{_SEAM}')) AS name FROM {_SEAMS.lines_sql()})
SELECT name, count(DISTINCT file)::BIGINT AS files, min(file || ':' || line) AS first FROM m WHERE list_bool_or(list_transform(['{"', '".join(S.SEAM_WORDS)}'], lambda w: contains('_' || name || '_', '_' || w || '_'))) GROUP BY name""")
def hosted_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that name a hosted service, with files and first place."""
    lines = _SEAMS.df(spark, sf_dir).select("file", F.posexplode(T.lines(F.col("text"))).alias("pos", "text")).withColumn("line", F.col("pos") + 1)
    rows = lines.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(_SEAM), 0)).alias("name"))
    held = F.exists(F.array(*[F.lit(w) for w in S.SEAM_WORDS]), lambda w: F.concat(F.lit("_"), F.col("name"), F.lit("_")).contains(F.concat(F.lit("_"), w, F.lit("_"))))
    return rows.where(held).groupBy("name").agg(F.countDistinct("file").alias("files"), F.min(F.concat_ws(":", "file", "line")).alias("first"))
