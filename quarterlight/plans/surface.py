"""Queries by other doors: as SQL with the library's own functions, and as streams that end."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import sql as functions
from ..functions.clock import floor_quarter
from ..operators import normalize
from ..operators.calendar import holiday_days
from ..operators.membership import mask
from ..streaming.quarters import Ingest, counts_once, read_events
from . import oracles
from .queries import EVENT_YEARS, INTERSECTION, ORDER_YEARS, STAMP, UNION, _t, _windows


def _sql(spark, d, text: str, **tables: str):
    functions.register(spark)
    for name, file in tables.items():
        _t(spark, d, file).createOrReplaceTempView(name)
    return spark.sql(text)


def sql_quarter_hours(spark, d):
    """Quarter-hours of each local day of the events' years, with the events in them: 92 and 100 on the days of the switches."""
    return _sql(
        spark, d,
        """WITH e AS (SELECT quarter_of(CAST(ts AS TIMESTAMP_NTZ)) AS quarter, count(*) AS n FROM ql_events GROUP BY 1),
y AS (SELECT DISTINCT year(convert_timezone('UTC', 'Europe/Berlin', quarter)) AS year FROM e),
q AS (SELECT q.* FROM y, LATERAL quarter_hours(y.year) q)
SELECT date_format(q.start_local, 'yyyy-MM-dd') AS day, season_of(CAST(min(q.start_local) AS DATE)) AS season, count(*) AS quarters, count(n) AS busy, CAST(coalesce(sum(n), 0) AS BIGINT) AS events, hhmm(max(CASE WHEN n > 0 THEN minute END)) AS last_busy
FROM q LEFT JOIN e ON e.quarter = q.start_utc GROUP BY 1""",
        ql_events="events",
    )


def sql_match_key(spark, d):
    return _sql(spark, d, "SELECT doc_id, md5(match_key(text)) AS key_md5 FROM ql_documents", ql_documents="documents")


def masked_events(spark, d):
    """Events by the flag that the year's mask has for their quarter-hour."""
    e = _t(spark, d, "events").select(floor_quarter(F.col("ts")).alias("start_utc"), "event_type").groupBy("start_utc", "event_type").agg(F.count(F.lit(1)).alias("n"))
    flags = None
    for year in range(EVENT_YEARS[0], EVENT_YEARS[1] + 1):
        one = mask(spark, _windows(spark), INTERSECTION, year, "interval_end_ambiguous").select("start_utc", "flag", "day_type")
        flags = one if flags is None else flags.unionByName(one)
    return e.join(flags, "start_utc").groupBy("event_type", "flag", "day_type").agg(F.sum("n").alias("n"))


def holiday_orders(spark, d):
    """Orders on each holiday of their years."""
    days = holiday_days(spark, UNION, *ORDER_YEARS).select("date", "name", "certain")
    o = _t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return o.join(F.broadcast(days), "date").select(F.date_format("date", "yyyy-MM-dd").alias("date"), "name", "certain", "n")


def _folder(spark) -> str:
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints").rstrip("/")
    return f"{shared}/stream-{uuid4().hex}"


def stream_counts(spark, d):
    """Events by quarter-hour and type, counted by a stream."""
    at = _folder(spark)
    counts_once(read_events(spark, f"{d}/events.parquet"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select(F.date_format("quarter", STAMP).alias("quarter"), "event_type", "n")


def stream_ingest(spark, d):
    """Events taken twice, by two runs over the same files: each counts once."""
    at = _folder(spark)
    ingest = Ingest(spark, f"{at}/events", spark.read.parquet(f"{d}/events.parquet").schema, late="3650 days")
    for run in ("first", "again"):
        ingest.run(read_events(spark, f"{d}/events.parquet"), run, f"{at}/{run}")
    return ingest.rows().groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


#: Kinds of rules, and values of every JSON type, whole and broken; a part's key and size choose.
KINDS = ("de_minimis_eur", "holiday_handling", "christmas_period", "workdays_only", "bridge_days", "something_else")
VALUES = ("12.5", '"7,5 %"', "true", "false", "null", '{"states": ["by", "BW"], "mode": "union"}', '{"states": ["by"]}', '{"from": "12-24", "to": "01-01"}', "[1, 2]", "[]", '{"states": [', "oops", '"working_day"', "0")


def rule_payloads(spark, d):
    p = _t(spark, d, "part")
    pick = lambda of, n: F.element_at(F.array(*map(F.lit, of)), (n % len(of) + 1).cast("int"))
    rules = p.select(F.col("p_partkey").alias("document_id"), pick(KINDS, F.col("p_partkey")).alias("kind"), pick(VALUES, F.col("p_size") + F.col("p_partkey").cast("int") % 7).alias("payload"))
    told = rules.withColumn("_t", normalize.rule_value(F.col("kind"), F.col("payload")))
    return told.groupBy("kind", "payload").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("_t.value")).alias("value"), F.bool_and("_t.resolved").alias("resolved"), F.bool_or(F.col("_t.problem").isNotNull()).alias("has_problem"))


QUERIES = [sql_quarter_hours, sql_match_key, masked_events, holiday_orders, stream_counts, stream_ingest, rule_payloads]


def sql() -> dict[str, str]:
    out = {}
    switch = "CAST(last_day(make_date(y, {0}, 1)) - CAST(dayofweek(last_day(make_date(y, {0}, 1))) AS INTEGER) AS TIMESTAMP) + INTERVAL 1 HOUR"
    summer = f"s >= {switch.format(3)} AND s < {switch.format(10)}"
    years = "(SELECT DISTINCT year(ts + INTERVAL 1 HOUR) AS y FROM events)"
    out["sql_quarter_hours"] = f"""WITH e AS (SELECT {oracles.QUARTER} AS quarter, count(*) AS n FROM events GROUP BY 1),
q AS (SELECT y, unnest(generate_series(CAST(make_date(y, 1, 1) AS TIMESTAMP) - INTERVAL 1 HOUR, CAST(make_date(y + 1, 1, 1) AS TIMESTAMP) - INTERVAL 75 MINUTE, INTERVAL 15 MINUTE)) AS s FROM {years}),
l AS (SELECT s, s + CASE WHEN {summer} THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS t FROM q)
SELECT strftime(t, '%Y-%m-%d') AS day, min(CASE WHEN month(t) IN (12, 1, 2) THEN 'winter' WHEN month(t) <= 5 THEN 'spring' WHEN month(t) <= 8 THEN 'summer' ELSE 'autumn' END) AS season, count(*) AS quarters, count(n) AS busy,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS events, strftime(max(CASE WHEN n > 0 THEN t END), '%H:%M') AS last_busy FROM l LEFT JOIN e ON e.quarter = l.s GROUP BY 1"""
    out["sql_match_key"] = oracles.sql()["match_key_full"]
    src = f"(SELECT {oracles.QUARTER} AS start_utc, event_type FROM events)"
    flag = f"CASE {oracles.ANSWER} WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE 'uncertain' END"
    out["masked_events"] = f"WITH {oracles._membership('interval_end_ambiguous', True, src)} SELECT event_type, {flag} AS flag, day_type, count(*) AS n FROM answers GROUP BY 1, 2, 3"
    out["holiday_orders"] = f"""SELECT strftime(d, '%Y-%m-%d') AS date, n AS name, s AS certain, count(*) AS n FROM (VALUES {oracles._holidays(*ORDER_YEARS, False)}) v(d, n, s) JOIN orders ON CAST(o_orderdate AS DATE) = d GROUP BY ALL"""
    out["stream_counts"] = f"SELECT strftime({oracles.QUARTER}, '{oracles.STAMP}') AS quarter, event_type, count(*) AS n FROM events GROUP BY 1, 2"
    out["stream_ingest"] = "SELECT user_id, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2"
    values = ", ".join("'" + v.replace("'", "''") + "'" for v in VALUES)
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    out["rule_payloads"] = f"""WITH r AS (SELECT p_partkey AS k, [{kinds}][p_partkey % {len(KINDS)} + 1] AS kind, [{values}][(p_size + p_partkey % 7) % {len(VALUES)} + 1] AS v FROM part),
t AS (SELECT *, json_valid(v) AS fine, CASE WHEN json_valid(v) THEN json_type(v) ELSE 'BROKEN' END AS type, CASE WHEN json_valid(v) THEN json_extract_string(v, '$') END AS said, v IN ('null', 'false', '0', '[]') AS empty FROM r),
n AS (SELECT *, CASE WHEN type = 'VARCHAR' THEN TRY_CAST(trim(replace(regexp_replace(said, '[%€]', '', 'g'), ',', '.')) AS DOUBLE) WHEN type IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(v AS DOUBLE) END AS number,
  CASE WHEN type = 'VARCHAR' THEN said ELSE v END AS bare, coalesce(list_transform(CASE WHEN type = 'OBJECT' THEN CAST(v::JSON->'$.states' AS VARCHAR[]) END, lambda x: upper(x)), []) AS states, CASE WHEN type = 'OBJECT' THEN coalesce(v::JSON->>'$.mode', 'unspecified') ELSE 'unspecified' END AS mode,
  CASE WHEN type = 'OBJECT' THEN v::JSON->>'$.from' END AS f, CASE WHEN type = 'OBJECT' THEN v::JSON->>'$.to' END AS u FROM t),
o AS (SELECT *, CASE kind WHEN 'workdays_only' THEN CASE WHEN empty AND v <> 'null' THEN 'false' ELSE 'true' END WHEN 'bridge_days' THEN bare
    WHEN 'holiday_handling' THEN CASE WHEN empty OR type = 'OBJECT' THEN '{{"states":[' || array_to_string(list_transform(states, lambda x: '"' || x || '"'), ',') || '],"mode":"' || mode || '","exclude":[]}}' ELSE v END
    WHEN 'christmas_period' THEN CASE WHEN empty OR type = 'OBJECT' THEN '{{"from":' || coalesce('"' || f || '"', 'null') || ',"to":' || coalesce('"' || u || '"', 'null') || '}}' ELSE v END
    WHEN 'de_minimis_eur' THEN CASE WHEN number IS NOT NULL THEN CAST(number AS VARCHAR) ELSE v END ELSE v END AS value,
  CASE kind WHEN 'workdays_only' THEN true WHEN 'bridge_days' THEN bare IN ('working_day', 'off_peak') WHEN 'holiday_handling' THEN len(states) = 1 OR (len(states) > 0 AND mode IN ('union', 'intersection'))
    WHEN 'christmas_period' THEN coalesce(f, '') <> '' AND coalesce(u, '') <> '' WHEN 'de_minimis_eur' THEN number IS NOT NULL ELSE true END AS resolved,
  CASE kind WHEN 'bridge_days' THEN bare NOT IN ('working_day', 'off_peak', 'off_peak_max_one', 'off_peak_max_one_per_week') WHEN 'holiday_handling' THEN NOT (empty OR type = 'OBJECT') WHEN 'christmas_period' THEN NOT (empty OR type = 'OBJECT') WHEN 'de_minimis_eur' THEN number IS NULL ELSE false END AS has_problem FROM n)
SELECT kind, v AS payload, count(*) AS n, min(value) AS value, bool_and(resolved) AS resolved, bool_or(has_problem) AS has_problem FROM o GROUP BY 1, 2"""
    return out
