"""Day classes: weekend, holiday, christmas, bridge or workday, with days that a document leaves open.

Holidays are a small generated dimension (a few dozen rows a year and rule set) that is part of the plan, so days of any number meet it
in one broadcast join.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of public law: name, day (month-day, or days after Easter, or bettag), states (* for all), from, to.
HOLIDAYS = [
    ("Neujahr", "01-01", "*", 1900, 9999),
    ("Heilige Drei Könige", "01-06", "BW BY ST", 1900, 9999),
    ("Internationaler Frauentag", "03-08", "BE", 2019, 9999),
    ("Internationaler Frauentag", "03-08", "MV", 2023, 9999),
    ("Karfreitag", "-2", "*", 1900, 9999),
    ("Ostersonntag", "0", "BB", 1900, 9999),
    ("Ostermontag", "1", "*", 1900, 9999),
    ("Erster Mai", "05-01", "*", 1900, 9999),
    ("Christi Himmelfahrt", "39", "*", 1900, 9999),
    ("Pfingstsonntag", "49", "BB", 1900, 9999),
    ("Pfingstmontag", "50", "*", 1900, 9999),
    ("Fronleichnam", "60", "BW BY HE NW RP SL", 1900, 9999),
    ("Mariä Himmelfahrt", "08-15", "SL", 1900, 9999),
    ("Weltkindertag", "09-20", "TH", 2019, 9999),
    ("Tag der Deutschen Einheit", "10-03", "*", 1990, 9999),
    ("Reformationstag", "10-31", "BB MV SN ST TH", 1990, 9999),
    ("Reformationstag", "10-31", "BE BW BY HB HE HH NI NW RP SH SL", 2017, 2017),
    ("Reformationstag", "10-31", "HB HH NI SH", 2018, 9999),
    ("Allerheiligen", "11-01", "BW BY NW RP SL", 1900, 9999),
    ("Buß- und Bettag", "bettag", "SN", 1995, 9999),
    ("Erster Weihnachtstag", "12-25", "*", 1900, 9999),
    ("Zweiter Weihnachtstag", "12-26", "*", 1900, 9999),
]
#: Holidays of only some municipalities of Bavaria.
LOCAL = [("Mariä Himmelfahrt", "08-15", "BY", 1900, 9999)]
STATES = "BB BE BW BY HB HE HH MV NI NW RP SH SL SN ST TH".split()
DEFAULT_CHRISTMAS = ("12-24", "01-01")


@dataclass(frozen=True)
class DayRules:
    """What a document says of its days. christmas None: the period is named without dates."""

    states: tuple[str, ...] = ()
    mode: str = "union"
    exclude: tuple[str, ...] = ()
    bridge: str = "unstated"
    christmas: tuple[str, str] | None = DEFAULT_CHRISTMAS
    workdays_only: bool = True  # kept, though weekends are off-peak either way


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by Gauss's rule in the form of Butcher."""
    whole = lambda c: F.floor(c).cast("int")
    a, b, c = year % 19, whole(year / 100), year % 100
    h = (19 * a + b - whole(b / 4) - whole((b - whole((b + 8) / 25) + 1) / 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * whole(c / 4) - h - c % 4) % 7
    m = whole((a + 11 * h + 22 * k) / 451)
    n = h + k - 7 * m + 114
    return F.make_date(year, whole(n / 31), n % 31 + 1)


def _easter(year: int) -> date:
    """The same for one year."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    n = h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114
    return date(year, n // 31, n % 31 + 1)


def _day(rule: str, year: int) -> date:
    if rule == "bettag":  # the Wednesday before 23 November
        last = date(year, 11, 22)
        return last - timedelta((last.weekday() - 2) % 7)
    if rule.lstrip("-").isdigit():
        return _easter(year) + timedelta(int(rule))
    return date(year, int(rule[:2]), int(rule[3:]))


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def _holidays(rules: DayRules, first: int, last: int) -> dict[date, tuple[str, bool]]:
    """Name and certainty of each holiday: a few dozen a year."""
    states = list(rules.states or ("DE",))
    by_day: dict[date, dict[str, str]] = {}
    for year in range(first, last + 1):
        for name, rule, where, since, until in HOLIDAYS:
            if since <= year <= until:
                for state in states:
                    if where == "*" and state in (*STATES, "DE") or state in where.split():
                        by_day.setdefault(_day(rule, year), {}).setdefault(state, name)
    need = len(set(states)) if rules.mode == "intersection" else 1
    found = {day: (next(own[s] for s in states if s in own), True) for day, own in by_day.items() if len(own) >= need}
    if "BY" in rules.states and rules.mode != "intersection":
        for year in range(first, last + 1):
            for name, rule, _, since, until in LOCAL:
                if since <= year <= until:
                    found.setdefault(_day(rule, year), (name, False))
    left_out = [x for x in map(_folded, rules.exclude) if x]
    return {day: (name, sure) for day, (name, sure) in found.items() if not any(x in _folded(name) or _folded(name) in x for x in left_out)}


def _local(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A few rows as part of the plan: no job makes them, and no worker reads them."""
    literal = lambda v: f"DATE '{v}'" if isinstance(v, date) else str(v).lower() if isinstance(v, bool) else "NULL" if v is None else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    names = ", ".join(columns.split())
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in zip(columns.split(), ("DATE", "STRING", "BOOLEAN", "BOOLEAN", "BOOLEAN"), strict=False)) + " WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)} AS t({names})")


def holiday_days(spark: SparkSession, rules: DayRules, first: int, last: int) -> DataFrame:
    """date, name, certain: holidays of all (intersection) or any (union) of the rules' states, none twice."""
    return _local(spark, "date name certain", [(d, n, c) for d, (n, c) in sorted(_holidays(rules, first, last).items())])


def classify_days(days: DataFrame, rules: DayRules, first: int, last: int, on: str = "date") -> DataFrame:
    """days with day_type, off_peak (null: not to be decided) and holiday (its name).

    The first that holds counts: weekend, certain holiday, christmas period, local holiday, bridge day, working
    day. A bridge day lies between a weekend and a certain holiday of the same year. Null days have no class.
    """
    spark = days.sparkSession
    found = _holidays(rules, first, last)
    sure = {day for day, (_, certain) in found.items() if certain}
    told = {*found, *(day + timedelta(n) for day in sure for n in (-1, 1) if (day + timedelta(n)).year == day.year)}
    near = lambda day, n: day + timedelta(n) in sure and (day + timedelta(n)).year == day.year or None
    rows = [(day, *found.get(day, (None, None)), near(day, 1), near(day, -1)) for day in sorted(told)]
    h = _local(spark, "_h holiday _certain _next _before", rows)
    h = h.select("_h", F.col("holiday").cast("string"), *[F.col(c).cast("boolean").alias(c) for c in ("_certain", "_next", "_before")])
    d = F.col(on)
    out = days.join(F.broadcast(h), d == F.col("_h"), "left")
    week = F.weekday(d)
    bridge = (week == 0) & F.col("_next").isNotNull() | (week == 4) & F.col("_before").isNotNull()
    md = F.date_format(d, "MM-dd")
    if rules.christmas:
        a, b = rules.christmas
        open_, sure = F.lit(False), md.between(a, b) if a <= b else (md >= a) | (md <= b)
    else:
        open_, sure = md.isin("12-24", "12-31"), md.between("12-27", "12-30")
    certain = F.coalesce("_certain", F.lit(False))
    kind = F.when(d.isNull(), F.lit(None)).when(week >= 5, "weekend").when(certain, "holiday").when(sure | open_, "christmas").when(F.col("_certain").isNotNull(), "holiday").when(bridge, "bridge").otherwise("workday")
    bridged = {"working_day": False, "off_peak": True}.get(rules.bridge)
    off = (
        F.when((week >= 5) | certain | sure, True)
        .when(open_ | F.col("_certain").isNotNull(), F.lit(None).cast("boolean"))
        .when(bridge, F.lit(bridged).cast("boolean"))
        .when(d.isNotNull(), False)
    )
    return out.withColumns({"day_type": kind, "off_peak": off}).drop("_h", "_certain", "_next", "_before")
