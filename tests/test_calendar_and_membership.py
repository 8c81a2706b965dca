import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarterlight.functions.clock import hhmm
from quarterlight.operators.calendar import DayRules, classify_days, easter
from quarterlight.operators.membership import evaluate, interval_start, mask, quarter_hours

NE5 = [("w1", "winter", 465, 540), ("w2", "winter", 990, 1185), ("w3", "spring", 1005, 1125)]
BOTH = DayRules(states=("BY", "BW"), mode="intersection", exclude=("Mariä Himmelfahrt",), bridge="working_day")


def days(spark, rules, *dates):
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in dates], "date date")
    return [(r.day_type, r.off_peak) for r in classify_days(df, rules, 2023, 2028).orderBy("date").collect()]


def windows(spark):
    return spark.createDataFrame(NE5, "window_id string, season string, start_min int, end_min int")


def test_easter(spark):
    got = spark.range(2023, 2029).select(easter(F.col("id").cast("int")).alias("d")).orderBy("id").collect()
    assert [str(r.d) for r in got] == ["2023-04-09", "2024-03-31", "2025-04-20", "2026-04-05", "2027-03-28", "2028-04-16"]


def test_epiphany_by_state(spark):
    assert days(spark, DayRules(states=("BY",)), "2026-01-06") == [("holiday", True)]
    assert days(spark, DayRules(states=("NW",)), "2026-01-06") == [("workday", False)]
    assert days(spark, DayRules(), "2026-01-06") == [("workday", False)]


def test_local_holiday_is_open_until_settled(spark):
    assert days(spark, DayRules(states=("BY",)), "2025-08-15") == [("holiday", None)]
    assert days(spark, BOTH, "2025-08-15") == [("workday", False)]
    assert days(spark, DayRules(states=("BY",), exclude=("mariä himmelfahrt",)), "2025-08-15") == [("workday", False)]


@pytest.mark.parametrize(("rule", "off"), [("working_day", False), ("off_peak", True), ("off_peak_max_one", None), ("unstated", None)])
def test_bridge_days(spark, rule, off):
    rules = DayRules(states=("BY",), bridge=rule, christmas=("12-24", "01-01"))
    assert days(spark, rules, "2026-01-05", "2026-06-05") == [("bridge", off), ("bridge", off)]


def test_vague_christmas(spark):
    got = days(spark, DayRules(states=("BY",), christmas=None), "2026-12-23", "2026-12-24", "2026-12-28", "2026-12-31")
    assert got == [("workday", False), ("christmas", None), ("christmas", True), ("christmas", None)]


def test_year_mask(spark):
    m = mask(spark, windows(spark), BOTH, 2026).cache()
    assert m.count() == 35040
    per_day = {str(r[0]): r[1] for r in m.groupBy(F.to_date("start_local")).count().collect()}
    assert (per_day["2026-03-29"], per_day["2026-10-25"], per_day["2026-06-01"]) == (92, 100, 96)
    at = lambda t: m.where(F.col("start_utc") == F.lit(t).cast("timestamp_ntz")).first().flag
    assert at("2026-03-30 14:45:00") == "1" and at("2026-03-27 14:45:00") == "0"
    assert at("2026-01-06 07:00:00") == "0"  # a holiday in both states
    assert mask(spark, windows(spark), BOTH, 2026, covered=False).where("flag <> '0' OR covered").count() == 0


def test_open_first_quarter_hour(spark):
    q = spark.createDataFrame([("2026-01-12 06:30:00",), ("2026-01-12 06:45:00",), ("2026-01-12 06:15:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("start_utc"))
    got = evaluate(q, windows(spark), BOTH, (2026, 2026), "interval_end_ambiguous").orderBy("start_utc").collect()
    assert [r.in_window for r in got] == [False, None, True]
    assert [r.window_id for r in got] == [None, "w1", "w1"]


def test_time_stamps_name_intervals(spark):
    row = spark.sql("SELECT timestamp_ntz'2026-01-12 08:37:12' AS t, timestamp_ntz'2026-03-29 03:00:00' AS s")
    got = row.select(
        interval_start(F.col("t"), F.lit("start"), F.lit("assumed")).alias("a"),
        interval_start(F.col("t"), F.lit("end"), F.lit("assumed")).alias("b"),
        interval_start(F.col("t"), F.lit("dso"), F.lit("interval_end_physical")).alias("c"),
        interval_start(F.col("s"), F.lit("end"), F.lit("assumed"), local=True).alias("d"),
    ).first()
    assert [str(x)[11:16] for x in got] == ["08:30", "08:15", "08:15", "00:45"]
    assert quarter_hours(spark, 2028).count() == 366 * 96
    assert spark.range(1).select(hhmm(F.lit(1440))).first()[0] == "24:00"


def test_no_class_without_date(spark):
    df = spark.createDataFrame([(None,)], "date date")
    r = classify_days(df, BOTH, 2026, 2026).first()
    assert r.day_type is None and r.off_peak is None
