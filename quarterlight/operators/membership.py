"""Is a quarter-hour inside a window? Three-valued, right across daylight saving switches.

The answer is `inside AND NOT off_peak` in SQL's own three-valued logic: null means uncertain. Whether the level
is covered at all stays a column of its own. Windows are joined on their keys with the range as residual; the
window side is broadcast up to BROADCAST_ROWS, counted, and shuffled by key beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import QUARTER, floor_quarter, minute_of_day, plus_minutes, season_of, to_local, to_utc
from .calendar import DayRules, classify_days

BROADCAST_ROWS = 100_000
#: Conventions by which a document's times are meter time stamps of the interval's end.
END_CONVENTIONS = ("interval_end_physical", "interval_end_ambiguous", "interval_end_labels")


def physical_span(windows: DataFrame, convention: Column) -> DataFrame:
    """Adds certain_from, upto and open_from, in minutes: [open_from, certain_from) can't be decided.

    A window from 00:00 whose start moves becomes -15; it doesn't wrap to the day before.
    """
    earlier = F.col("start_min") - QUARTER
    return windows.withColumns({
        "certain_from": F.when(convention == "interval_end_labels", earlier).otherwise(F.col("start_min")),
        "upto": F.col("end_min"),
        "open_from": F.when(convention.isin("interval_end_labels", "interval_end_ambiguous"), earlier).otherwise(F.col("start_min")),
    })


def interval_start(ts: Column, label: Column, convention: Column, local: bool = False) -> Column:
    """UTC start of the quarter-hour that a time stamp names: ends move back by one, then all go down to the grid."""
    utc = to_utc(ts) if local else ts
    is_end = (label == "end") | (label == "dso") & convention.isin(*END_CONVENTIONS)
    return floor_quarter(F.when(is_end, plus_minutes(utc, -QUARTER)).otherwise(utc))


def quarter_hours(spark: SparkSession, year: int) -> DataFrame:
    """start_utc of every quarter-hour of a local year: 92 or 100 on the days of the switches."""
    new_year = lambda y: to_utc(F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz"))
    steps = F.sequence(new_year(year), plus_minutes(new_year(year + 1), -QUARTER), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(QUARTER)))
    return spark.range(1).select(F.explode(steps).alias("start_utc"))


def answer(flag: Column) -> Column:
    return F.when(flag, "true").when(~flag, "false").otherwise("uncertain")


def evaluate(quarters: DataFrame, windows: DataFrame, rules: DayRules, years: tuple[int, int], convention: str = "assumed", keys: tuple[str, ...] = (), covered: Column | None = None) -> DataFrame:
    """quarters (start_utc and keys) with local time, season, day class, matching window and in_window.

    years: first and last local year that can occur; days of other years have no class and leave hits uncertain.
    windows: window_id, season, start_min, end_min and keys, one row each. The first covering window counts, else
    the last whose open part holds the quarter-hour. in_window is null where undecided; `covered` false makes it
    null too and the column covered says so. Windows' count decides whether they are broadcast.
    """
    at = to_local(F.col("start_utc"))
    q = quarters.withColumns({"start_local": at, "season": season_of(F.month(at)), "_minute": minute_of_day(at), "_date": F.to_date(at)})
    spark = quarters.sparkSession
    first, last = (F.make_date(F.lit(y), F.lit(m), F.lit(d)) for y, m, d in ((years[0], 1, 1), (years[1], 12, 31)))
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("_date"))  # a row a day: bounded by the years
    days = classify_days(days, rules, *years, on="_date")
    w = physical_span(windows, F.lit(convention)).select("season", *keys, F.struct(F.col("start_min").alias("start"), "end_min", "window_id").alias("_w"), "certain_from", "upto", "open_from")
    # One row a key: its windows in an array, so that no quarter-hour is multiplied and none has to be grouped again.
    w = w.groupBy("season", *keys).agg(F.sort_array(F.collect_list(F.struct("_w", "certain_from", "upto", "open_from"))).alias("_ws"))
    if w.count() <= BROADCAST_ROWS:
        w = F.broadcast(w)
    out = q.join(F.broadcast(days), "_date", "left").join(w, ["season", *keys], "left")
    minute = F.col("_minute")
    ws = F.coalesce("_ws", F.array())
    hit = F.get(F.filter(ws, lambda x: (x["certain_from"] <= minute) & (minute + QUARTER <= x["upto"])), F.lit(0))
    edge = F.try_element_at(F.filter(ws, lambda x: (x["open_from"] <= minute) & (minute < x["certain_from"])), F.lit(-1))
    out = out.withColumns({"_hit": hit["_w"], "_edge": edge["_w"]})
    inside = F.when(F.col("_hit").isNotNull(), True).when(F.col("_edge").isNotNull(), F.lit(None).cast("boolean")).otherwise(False)
    found = F.coalesce("_hit", "_edge")
    out = out.withColumns({"covered": F.lit(True) if covered is None else covered, "window_id": found["window_id"]})
    out = out.withColumn("in_window", F.when(F.col("covered"), inside & ~F.col("off_peak")))
    return out.drop("_date", "_minute", "_ws", "_hit", "_edge")


def mask(spark: SparkSession, windows: DataFrame, rules: DayRules, year: int, convention: str = "assumed", covered: bool = True) -> DataFrame:
    """A year's quarter-hours with flag 1, 0 or uncertain; an uncovered level prints 0 and says covered false."""
    out = evaluate(quarter_hours(spark, year), windows, rules, (year - 1, year + 1), convention, covered=F.lit(covered))
    flag = F.when(~F.col("covered"), "0").otherwise(F.replace(F.replace(answer(F.col("in_window")), F.lit("true"), F.lit("1")), F.lit("false"), F.lit("0")))
    return out.select("start_utc", "start_local", flag.alias("flag"), "season", "day_type", "window_id", "covered")
