"""Totals at several levels, nested JSON as variants, saved partitions: A02, A05, A16, A20, F22, F25, S13, S19, X07."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import classify as C
from gleaner.functions import text as T
from gleaner.operators import traction as R
from gleaner.operators.levels import totals_at_levels
from gleaner.queries import fixtures as X
from gleaner.queries.base import query, table
from gleaner.queries.files import _FILES_SQL, document_files
from gleaner.queries.traction_queries import _SPLIT
from gleaner.sources.saved import replay, save_by_key
from gleaner.sources.shared import shared_dir

_SIZE_SETS = [["area", "language", "kind"], ["area", "language"], ["area", "kind"], ["language"], ["kind"], []]


def _sets_sql(sets: list[list[str]]) -> str:
    return "GROUP BY GROUPING SETS (" + ", ".join("(" + ", ".join(s) + ")" for s in sets) + ")"


@query(_FILES_SQL + f", g AS (SELECT string_split(path, '/')[1] AS area, lang AS language, kind, lines, non_blank FROM f) SELECT area, language, kind, grouping_id(area, language, kind)::INT AS level, count(*)::BIGINT AS files, sum(lines)::BIGINT AS lines, sum(non_blank)::BIGINT AS non_blank FROM g {_sets_sql(_SIZE_SETS)}")
def size_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and lines by area, language and kind at six levels."""
    t = F.col("text")
    rows = document_files(spark, sf_dir).select(C.area(F.col("path"), 1).alias("area"), F.col("lang").alias("language"), C.source_kind(F.col("path"), t).alias("kind"), T.line_count(t).alias("lines"), T.non_blank_count(t).alias("non_blank"))
    return totals_at_levels(rows, ["area", "language", "kind"], _SIZE_SETS, F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines"), F.sum("non_blank").cast("long").alias("non_blank"))


_DOWNLOAD_SETS = [["platform", "kind"], ["platform"], ["kind"], []]


@query(f"SELECT platform, kind, grouping_id(platform, kind)::INT AS level, sum(downloads)::BIGINT AS downloads, count(DISTINCT tag)::BIGINT AS releases FROM {_SPLIT} {_sets_sql(_DOWNLOAD_SETS)}")
def download_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads and releases by platform and category, and their totals."""
    rows = R.split_installers(R.classified(X.RELEASE_FILES.df(spark, sf_dir)))
    return totals_at_levels(rows, ["platform", "kind"], _DOWNLOAD_SETS, F.sum("downloads").alias("downloads"), F.count_distinct("tag").alias("releases"))


_USER_SETS = [["event_type", "day"], ["event_type"], ["day"], []]


@query(f"SELECT event_type, day, grouping_id(event_type, day)::INT AS level, count(DISTINCT user_id)::BIGINT AS users, count(*)::BIGINT AS events FROM (SELECT event_type, CAST(ts AS DATE) AS day, user_id FROM events) {_sets_sql(_USER_SETS)}")
def user_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users by type and day, exact at each level."""
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    return totals_at_levels(rows, ["event_type", "day"], _USER_SETS, F.count_distinct("user_id").alias("users"), F.count("*").alias("events"))


#: Events with their properties nested in an answer; every 97th answer is broken off.
_ANSWERS = "SELECT event_id, event_type, CASE WHEN event_id % 97 = 0 THEN substr(props, 1, 4) ELSE '{{\"props\": ' || props || ', \"user\": {{\"id\": ' || coalesce(CAST(user_id AS STRING), 'null') || ', \"tags\": [\"' || event_type || '\", \"t' || CAST(event_id % 3 AS STRING) || '\"]}}}}' END AS body FROM {events}"


@query(f"""WITH a AS (SELECT event_id, event_type, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM ({_ANSWERS.format(events='events')})),
v AS (SELECT event_type, json_extract_string(j, '$.user.tags[1]') AS tag, CAST(json_extract_string(j, '$.props.k') AS BIGINT) AS k, CAST(json_extract_string(j, '$.user.id') AS BIGINT) AS id, j FROM a)
SELECT event_type, tag, count(*)::BIGINT AS answers, count(*) FILTER (WHERE j IS NULL)::BIGINT AS broken, sum(k)::BIGINT AS k, count(DISTINCT id)::BIGINT AS users FROM v GROUP BY event_type, tag""")
def nested_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of nested JSON, parsed once into a variant; broken answers are null."""
    rows = spark.sql(_ANSWERS, events=table(spark, sf_dir, "events")).select("event_type", F.try_parse_json("body").alias("v"))
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    rows = rows.select("event_type", at("$.user.tags[1]", "string").alias("tag"), at("$.props.k", "long").alias("k"), at("$.user.id", "long").alias("id"), F.col("v").isNull().alias("bad"))
    return rows.groupBy("event_type", "tag").agg(F.count("*").alias("answers"), F.count_if("bad").alias("broken"), F.sum("k").alias("k"), F.count_distinct("id").alias("users"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('view', 'signup')")
def replayed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events saved by type, one type saved a second time, two types replayed."""
    import uuid

    path = f"{shared_dir(spark)}/saved/events-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    save_by_key(rows, "event_type", path)
    save_by_key(rows.where("event_type = 'view'"), "event_type", path)
    return replay(spark, path, ["view", "signup"])
