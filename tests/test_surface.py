"""The functions as SQL, streams that are replayed, and rule payloads of every JSON type."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarterlight.functions import sql
from quarterlight.functions.text import match_key
from quarterlight.operators import normalize
from quarterlight.streaming.quarters import Ingest, read_events

SCHEMA = "event_id long, ts timestamp_ntz, v string"


@pytest.fixture
def at(tmp_path):
    return tmp_path


def row(k, hour, v="x"):
    return k, None if hour is None else dt.datetime(2025, 1, 10) + dt.timedelta(hours=hour), v


def put(spark, at, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")


def taken(ingest, kind="rows"):
    return sorted((r.event_id, r.v) for r in ingest.rows(kind).collect())


def test_replays_and_late_files_change_nothing(spark, at):
    put(spark, at, [row(1, 0), row(2, 5), row(2, 4, "earlier"), row(None, 1), row(3, None)])
    new = lambda: Ingest(spark, f"{at}/out", spark.read.parquet(f"{at}/in").schema, late="12 hours")
    ingest = new()
    ingest.run(read_events(spark, f"{at}/in"), "a", f"{at}/state-a")
    assert taken(ingest) == [(1, "x"), (2, "earlier")] and taken(ingest, "late") == []
    put(spark, at, [row(4, 30), row(2, 5, "copy"), row(5, -6)])
    ingest.run(read_events(spark, f"{at}/in"), "a", f"{at}/state-a")
    assert taken(ingest) == [(1, "x"), (2, "earlier"), (4, "x"), (5, "x")]  # 10 hours before the newest of the batch before: in time
    put(spark, at, [row(6, 2), row(1, 0), row(7, 29)])
    ingest.run(read_events(spark, f"{at}/in"), "a", f"{at}/state-a")
    now = taken(ingest), taken(ingest, "late")
    assert now == ([(1, "x"), (2, "earlier"), (4, "x"), (5, "x"), (7, "x")], [(6, "x")])
    again = new()  # another driver, another run, all files anew
    again.run(read_events(spark, f"{at}/in"), "b", f"{at}/state-b")
    assert (taken(again), taken(again, "late")) == now
    # A batch that is run again after a lost driver writes the same.
    batch = spark.createDataFrame([row(8, 30), row(9, 1)], SCHEMA)
    for _ in range(2):
        again.take(batch, "c", 0)
        assert taken(again) == [*now[0], (8, "x")] and taken(again, "late") == [*now[1], (9, "x")]


def test_functions_in_sql(spark):
    sql.register(spark)
    texts = ["Ab – 7.30  Uhr ─", "1 : 5", "ﬁ ①  7:05 - 9.15uhr", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("texts_")
    got = [r[0] for r in spark.sql("SELECT match_key(t) FROM texts_").collect()]
    assert got == [r[0] for r in df.select(match_key(F.col("t"))).collect()]
    assert spark.sql("SELECT indel_ratio('abcd', 'abce') AS r").first().r == 75.0
    days = spark.sql("SELECT CAST(start_local AS DATE) AS day, count(*) AS n FROM (VALUES (2025)) y(y), LATERAL quarter_hours(y.y, 'Europe/Berlin') GROUP BY 1 HAVING count(*) <> 96").collect()
    assert {(str(r.day), r.n) for r in days} == {("2025-03-30", 92), ("2025-10-26", 100)}
    assert spark.sql("SELECT count(*) AS n FROM (VALUES (2024)) y(y), LATERAL quarter_hours(y.y, 'UTC')").first().n == 366 * 96
    assert [r.s for r in spark.sql("SELECT season_of(make_date(2025, m, 1)) AS s FROM (SELECT explode(sequence(1, 12)) AS m) ORDER BY m").collect()] == ["winter"] * 2 + ["spring"] * 3 + ["summer"] * 3 + ["autumn"] * 3 + ["winter"]


@pytest.mark.parametrize(
    ("kind", "payload", "value", "resolved", "problem"),
    [
        ("de_minimis_eur", "1e2", "100.0", True, False),
        ("de_minimis_eur", '" 7,5 % "', "7.5", True, False),
        ("de_minimis_eur", "true", "true", False, True),
        ("de_minimis_eur", '{"a": 1}', '{"a": 1}', False, True),
        ("de_minimis_eur", '{"a": ', '{"a":', False, True),
        ("workdays_only", "0.0", "false", True, False),
        ("workdays_only", '"yes"', "true", True, False),
        ("workdays_only", None, "true", True, False),
        ("workdays_only", "{ }", "false", True, False),
        ("holiday_handling", '{"states": ["by"], "exclude": ["x"]}', '{"states":["BY"],"mode":"unspecified","exclude":["x"]}', True, False),
        ("holiday_handling", '{"states": "by"}', '{"states":[],"mode":"unspecified","exclude":[]}', False, False),
        ("holiday_handling", "[1]", "[1]", False, True),
        ("christmas_period", '{"from": "12-24", "to": {"x": 1}}', None, None, False),
        ("christmas_period", "", "", False, True),
        ("bridge_days", "12", "12", False, True),
        ("bridge_days", '"off_peak"', "off_peak", True, False),
        ("other", "nonsense", "nonsense", True, False),
    ],
)
def test_rule_payloads(spark, kind, payload, value, resolved, problem):
    r = spark.createDataFrame([(kind, payload)], "k string, v string").select(normalize.rule_value(F.col("k"), F.col("v")).alias("t")).first().t
    assert (r.problem is not None) == problem
    if value is not None:
        assert (r.value, r.resolved) == (value, resolved)
