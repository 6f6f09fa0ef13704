"""Running order, states at instants, phrases and intervals over whole tables: W03-W05, W07, A12, A31, A36, J15, S10, S11, S21, S22, S30, P26."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.numbers import days_between
from gleaner.operators import traction as R
from gleaner.operators.joins import interval_join, latest_before
from gleaner.operators.phrases import find_phrases
from gleaner.operators.running import running
from gleaner.operators.states import states_at, totals_between
from gleaner.queries.base import query, table

_DAY = "86400000000.0"


def _milestones_sql(key: str, every: int) -> str:
    by = f"PARTITION BY {key} " if key else ""
    cols = f"{key}, " if key else ""
    return f"""WITH r AS (SELECT {cols}ts, row_number() OVER ({by}ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL),
m AS (SELECT *, lag(ts) OVER ({by}ORDER BY n) AS since, lag(n) OVER ({by}ORDER BY n) AS m FROM r WHERE n = 1 OR n % {every} = 0),
d AS (SELECT *, CASE WHEN since IS NULL THEN 0.0::DOUBLE ELSE (epoch_us(ts) - epoch_us(since)) / {_DAY}::DOUBLE END AS days FROM m WHERE n % {every} = 0)
SELECT {cols}n::BIGINT AS n, ts, coalesce(since, ts) AS since, days, CASE WHEN days > 0 THEN (n - m) / days END AS per_day FROM d"""


@query(_milestones_sql("", 1000))
def event_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thousandth of all events, with the pace since the one before."""
    return R.milestones(table(spark, sf_dir, "events"), [], "ts", "event_id", 1000)


@query(_milestones_sql("event_type", 250))
def type_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 250th event of each type."""
    return R.milestones(table(spark, sf_dir, "events"), ["event_type"], "ts", "event_id", 250)


@query("""WITH g AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) AS gap FROM events WHERE ts IS NOT NULL)
SELECT count(*)::BIGINT AS events, sum(gap)::DOUBLE / (count(gap) * 1000000)::DOUBLE AS mean_gap_seconds, median(gap) / 1000000::DOUBLE AS median_gap_seconds, max(gap) / 1000000::DOUBLE AS largest_gap_seconds, count(*) FILTER (WHERE gap < 60000000)::BIGINT AS gaps_under_a_minute FROM g""")
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between all events in their order."""
    rows = running(table(spark, sf_dir, "events").where("ts IS NOT NULL").select("ts", "event_id"), [], ["ts", "event_id"], before={"earlier": F.col("ts")}, name="events")
    rows = rows.select((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("earlier").cast("timestamp"))).alias("gap"))
    second = F.lit(1_000_000.0)
    mean = F.sum("gap").cast("double") / (F.count("gap") * 1_000_000).cast("double")
    return rows.agg(F.count("*").alias("events"), mean.alias("mean_gap_seconds"), (F.median("gap") / second).alias("median_gap_seconds"), (F.max("gap") / second).alias("largest_gap_seconds"), F.count_if(F.col("gap") < 60_000_000).alias("gaps_under_a_minute"))


@query("""WITH c AS (SELECT o_orderkey, o_orderdate, floor(o_totalprice * 100 + 0.5)::BIGINT AS cents FROM orders WHERE o_orderdate IS NOT NULL),
r AS (SELECT *, sum(cents) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run, sum(cents) OVER () AS total FROM c)
SELECT (10 * run // total)::BIGINT AS tenths, o_orderkey, o_orderdate, run::BIGINT AS cents FROM r WHERE 10 * run // total > 10 * (run - cents) // total""")
def revenue_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with which each tenth of all revenue was reached."""
    rows = table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL").select("o_orderkey", "o_orderdate", F.floor(F.col("o_totalprice") * 100 + 0.5).alias("own"))
    total = rows.agg(F.sum("own").alias("total"))
    rows = running(rows, [], ["o_orderdate", "o_orderkey"], sums={"cents": F.col("own")}, name="orders").join(F.broadcast(total))
    return rows.where("10 * cents div total > 10 * (cents - own) div total").select(F.expr("10 * cents div total").alias("tenths"), "o_orderkey", "o_orderdate", "cents")


_INSTANTS = {"a": "2024-01-08 00:00:00", "b": "2024-01-15 12:00:00", "c": "2024-01-23 06:30:00"}


@query("WITH k AS (SELECT DISTINCT user_id FROM events) SELECT k.user_id, " + ", ".join(f"{n}.event_type AS type_{n}, {n}.value AS value_{n}" for n in _INSTANTS) + " FROM k" + "".join(f" LEFT JOIN (SELECT user_id, event_type, value FROM events WHERE ts <= TIMESTAMP '{t}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) {n} ON {n}.user_id IS NOT DISTINCT FROM k.user_id" for n, t in _INSTANTS.items()))
def states_at_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event at three instants."""
    rows = states_at(table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_type", "value"], "event_id", _INSTANTS)
    return rows.select("user_id", *[F.col(f"{n}.{c}").alias(f"{o}_{n}") for n in _INSTANTS for c, o in (("event_type", "type"), ("value", "value"))])


_OLD, _NEW = "1994-06-30 00:00:00", "1996-12-31 00:00:00"


@query(f"""WITH s AS (SELECT l_partkey, l_suppkey, l_returnflag, l_shipdate, l_orderkey, l_linenumber FROM lineitem),
o AS (SELECT l_partkey, l_suppkey, l_returnflag = 'R' AS gone FROM s WHERE l_shipdate <= TIMESTAMP '{_OLD}' QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1),
n AS (SELECT l_partkey, l_suppkey, l_returnflag = 'R' AS gone FROM s WHERE l_shipdate <= TIMESTAMP '{_NEW}' QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1),
b AS (SELECT coalesce(NOT o.gone, false) AS at_old, coalesce(NOT n.gone, false) AS at_new, o.l_suppkey <> n.l_suppkey AS other FROM o FULL JOIN n USING (l_partkey))
SELECT count(*) FILTER (WHERE at_old)::BIGINT AS at_old, count(*) FILTER (WHERE at_new)::BIGINT AS at_new, count(*) FILTER (WHERE NOT at_old AND at_new)::BIGINT AS added, count(*) FILTER (WHERE at_old AND NOT at_new)::BIGINT AS deleted, count(*) FILTER (WHERE at_old AND at_new AND other)::BIGINT AS changed FROM b""")
def part_totals_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files, shipments as their changes (a returned one deletes), counted at two instants."""
    rows = table(spark, sf_dir, "lineitem").withColumns({"tie": F.struct("l_orderkey", "l_linenumber"), "gone": F.col("l_returnflag") == "R"})
    states = states_at(rows, ["l_partkey"], "l_shipdate", ["l_suppkey", "gone"], "tie", {"old": _OLD, "new": _NEW})
    return totals_between(states, "old", "new", lambda s: s["gone"])


@query("""WITH v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'),
m AS (SELECT p.event_id, p.user_id, max(struct_pack(ts := v.ts, id := v.event_id, value := v.value)) AS s, any_value(p.ts) AS ts FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts GROUP BY p.event_id, p.user_id)
SELECT event_id, user_id, s.value AS viewed, s.ts AS since, (epoch_us(ts) - epoch_us(s.ts)) / 1000000::DOUBLE AS seconds FROM m""")
def purchases_after_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase with its user's last view before it, as of its instant."""
    rows = table(spark, sf_dir, "events")
    points = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = rows.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("viewed"), "event_id")
    out = latest_before(points, views, ["user_id"], "ts", ["viewed"], "event_id")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / F.lit(1_000_000.0)
    return out.select("event_id", "user_id", "viewed", "since", seconds.alias("seconds"))


_W = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_PHRASES = f"""p AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, {_W.format('x')} AS w FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS x FROM benchmark)) WHERE len(w) >= 5),
d AS (SELECT DISTINCT doc_id, lang, {_W.format('text')} AS w FROM documents), j AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d), q AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS t FROM p),
f AS (SELECT j.doc_id, q.item_id, len(list_filter(range(1, len(j.w) - len(q.w) + 2), lambda i: j.w[i] = q.w[1] AND j.w[i:i + len(q.w) - 1] = q.w))::BIGINT AS times FROM j JOIN q ON contains(j.t, q.t) AND NOT (q.item_id % 4 = 0 AND j.lang = 'en'))"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n", -1)).alias("phrase")).where(r"regexp_count(phrase, '[\\p{L}\\p{N}]+') >= 5")
    docs = table(spark, sf_dir, "documents")
    found = find_phrases(docs, lines, "doc_id", "text", "item_id", "phrase")
    # Phrases of every fourth item are allowed in English texts.
    return found.join(docs.select("doc_id", "lang").distinct(), "doc_id").where("NOT (item_id % 4 = 0 AND lang <=> 'en')")


@query(f"WITH {_PHRASES} SELECT doc_id, item_id, sum(times)::BIGINT AS times FROM f GROUP BY doc_id, item_id")
def phrase_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of benchmark items in all documents that are not allowed to hold them."""
    return _findings(spark, sf_dir).groupBy("doc_id", "item_id").agg(F.sum("times").alias("times"))


@query(f"WITH {_PHRASES} SELECT item_id, count(DISTINCT doc_id)::BIGINT AS documents, sum(times)::BIGINT AS times FROM f GROUP BY item_id")
def phrase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and occurrences by benchmark item."""
    return _findings(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.sum("times").alias("times"))


_RATES = f"""r AS (SELECT min(ts) AS start FROM events WHERE event_type = 'signup' GROUP BY CAST(ts AS DATE)), w AS (SELECT start, coalesce(lead(start) OVER (ORDER BY start), (SELECT max(ts) FROM events)) AS stop FROM r),
c AS (SELECT w.start, w.stop, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS purchases, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS views FROM w LEFT JOIN events e ON e.ts >= w.start AND e.ts < w.stop GROUP BY w.start, w.stop),
t AS (SELECT start, epoch_us(stop) - epoch_us(start) AS us, greatest((epoch_us(stop) - epoch_us(start)) / {_DAY}::DOUBLE, 1.0::DOUBLE / 24) AS days, purchases, views FROM c)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    # A day's signups are mirrors of one release; the earliest counts.
    starts = events.where("event_type = 'signup'").groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("start")).select("start")
    end = events.agg(F.max("ts").alias("end"))
    windows = running(starts, [], [F.desc("start")], before={"next": F.col("start")}, name="windows").join(F.broadcast(end)).select("start", F.coalesce("next", "end").alias("stop"))
    met = interval_join(events.where("event_type IN ('purchase', 'view')").select("ts", "event_type"), windows, "ts", "start", "stop")
    counts = met.groupBy("start").agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "view").alias("views"))
    out = windows.join(counts, "start", "left").fillna(0, ["purchases", "views"])
    as_instant = lambda c: F.col(c).cast("timestamp")
    days = F.greatest(days_between(as_instant("start"), as_instant("stop")), F.lit(1.0) / 24)
    return out.select("start", (F.unix_micros(as_instant("stop")) - F.unix_micros(as_instant("start"))).alias("us"), days.alias("days"), "purchases", "views")


@query(f"WITH {_RATES} SELECT start, days, purchases, views, purchases / days AS purchases_per_day, views / days AS views_per_day FROM t")
def release_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows between first signups of days, with purchases and views in each, by interval join."""
    rows = _windows(spark, sf_dir)
    return rows.select("start", "days", "purchases", "views", (F.col("purchases") / F.col("days")).alias("purchases_per_day"), (F.col("views") / F.col("days")).alias("views_per_day"))


@query(f"WITH {_RATES}, o AS (SELECT views / days AS rate, sum(us) OVER (ORDER BY views / days, start ROWS UNBOUNDED PRECEDING) AS run, sum(us) OVER () AS total FROM t), m AS (SELECT min(rate) AS rate FROM o WHERE 2 * run >= total) SELECT rate AS views_per_day, floor(rate * 4.0::DOUBLE / 24 + 0.5)::BIGINT AS copies FROM m")
def usual_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows' median rate, weighted by their length, and copies at once at a check every four hours."""
    rows = _windows(spark, sf_dir).withColumn("rate", F.col("views") / F.col("days"))
    row = R.weighted_median(rows, "rate", "us", "start")
    return row.select(F.col("median").alias("views_per_day"), F.floor(F.col("median") * F.lit(4.0) / 24 + 0.5).alias("copies"))
