"""Clock arithmetic on columns: minutes of a day, quarter-hours, seasons, local time.

Instants are TIMESTAMP_NTZ in UTC and local times TIMESTAMP_NTZ in the zone, so nothing here depends on the
session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"
QUARTER = 15
SEASONS = ("winter", "spring", "summer", "autumn")


def hhmm(minutes: Column) -> Column:
    """465 -> 07:45; 1440 -> 24:00."""
    return F.concat_ws(":", F.lpad((minutes / 60).cast("int").cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def day_percent(minutes: Column) -> Column:
    return F.round(100 * minutes / 1440, 4)


def season_of(month: Column) -> Column:
    """Meteorological seasons; December belongs to winter."""
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), (F.floor((month % 12) / 3) + 1).cast("int"))


def to_local(utc: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def to_utc(local: Column, zone: str = ZONE) -> Column:
    """A repeated local time is its first occurrence, a skipped one moves on by the gap."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def plus_minutes(ts: Column, n) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), n if isinstance(n, Column) else F.lit(n))


def floor_quarter(ts: Column) -> Column:
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts) % QUARTER, F.extract(F.lit("SECOND"), ts).cast("decimal(18,6)"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)
