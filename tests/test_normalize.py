import json

import pytest
from pyspark.sql import functions as F

from quarterlight.operators import normalize as N

DEFINED = "Jeder Zeitstempel 09:15 Uhr bezeichnet die Viertelstunde von 09:00 Uhr bis 09:15 Uhr."
STAMPS = "Alle genannten Uhrzeiten sind Zeitstempel des Zählers. \n"
MAPPED = "Ein Fenster, das \nvon 08:00 bis 11:30 reicht, hat die Zeitstempel von 08:15 bis \n11:30."
READINGS = "document_id int, meter_label string, listed_start string, first_timestamp string, page int, quote string"


@pytest.fixture(scope="module")
def resolved(spark):
    end = lambda k, a=None, b=None: (k, "end", a, b, 1, "x")
    readings = [end(1, "09:00", "09:15"), end(2, "09:00", "09:15"), end(3, "08:00", "08:15"), end(4, "08:00", "08:15"), end(5), (6, None, None, None, None, None), (7, "start", None, None, 1, "x"), end(8, "9:00", "9:00"), end(9, "09:00", "09:00"), end(9, "09:00", "09:00"), end(10)]
    wrong = DEFINED.replace("09:00 Uhr bis", "08:00 Uhr bis")
    pages = [(1, 1, STAMPS + DEFINED), (2, 1, DEFINED), (3, 1, MAPPED), (4, 1, None), (4, 2, ""), (5, 1, "nichts"), (5, 3, "Erstens. " + STAMPS + DEFINED + " Ende."), (5, 2, DEFINED.replace("Uhr", "")), (6, 4, STAMPS + DEFINED), (7, 1, STAMPS + DEFINED), (8, 1, STAMPS + DEFINED), (9, 1, wrong + STAMPS), (11, 1, STAMPS + DEFINED)]
    got = N.resolve_conventions(spark.createDataFrame(readings, READINGS), spark.createDataFrame(pages, "document_id int, page int, text string")).collect()
    assert len(got) == 10
    return {r.document_id: r for r in got}


def test_conventions(resolved):
    labels, open_ = "interval_end_labels", "interval_end_ambiguous"
    want = {1: (labels, "warning"), 2: (open_, "warning"), 3: ("interval_end_physical", None), 4: (open_, "warning"), 5: (open_, None), 6: (labels, "info"), 7: ("interval_start", None), 8: (labels, None), 9: (open_, "warning"), 10: (open_, None)}
    assert {k: (r.convention, r.severity) for k, r in resolved.items()} == want
    # 5: the first page that defines a time stamp decides, although a later one would say more.
    assert resolved[1].quote == " ".join((STAMPS + DEFINED).split()) and (resolved[6].page, resolved[2].quote) == (4, "x")


def test_rule_values(spark):
    rows = [
        ("workdays_only", None, "true", True), ("workdays_only", "false", "false", True), ("workdays_only", "\"no\"", "true", True),
        ("bridge_days", '"off_peak"', "off_peak", True), ("bridge_days", '"off_peak_max_one"', "off_peak_max_one", False), ("bridge_days", '"odd"', "odd", "p"), ("bridge_days", None, "null", "p"),
        ("holiday_handling", '{"states": ["by"]}', {"states": ["BY"], "mode": "unspecified", "exclude": []}, True), ("holiday_handling", '{"states": ["by", "bw"]}', {"states": ["BY", "BW"], "mode": "unspecified", "exclude": []}, False),
        ("holiday_handling", '{"states": ["BY", "BW"], "mode": "union", "exclude": ["x"]}', {"states": ["BY", "BW"], "mode": "union", "exclude": ["x"]}, True), ("holiday_handling", None, {"states": [], "mode": "unspecified", "exclude": []}, False), ("holiday_handling", "7", "7", "p"),
        ("christmas_period", '{"from": "12-24", "to": "01-01"}', {"from": "12-24", "to": "01-01"}, True), ("christmas_period", '{"from": "12-24"}', {"from": "12-24", "to": None}, False),
        ("min_kw_diff", '"100 kW"', '"100 kW"', "p"), ("significance_threshold", '" 30,5 % "', "30.5", True), ("de_minimis_eur", "500", "500.0", True), ("de_minimis_eur", None, "null", "p"), ("other", '"any"', '"any"', True),
    ]
    got = spark.createDataFrame([(i, k, v) for i, (k, v, *_) in enumerate(rows)], "i int, kind string, value string").select("i", N.rule_value(F.col("kind"), F.col("value")).alias("t")).orderBy("i").collect()
    for (kind, value, want, state), r in zip(rows, got, strict=True):
        assert (json.loads(r.t.value) if isinstance(want, dict) else r.t.value) == want, (kind, value)
        assert (r.t.resolved, r.t.problem is not None) == (state is True, state == "p"), (kind, value)


def test_normalize_keeps_what_has_a_meaning(spark):
    windows = spark.createDataFrame([(1, "Mittelspannung", "Winter", "7:45", "9:00 Uhr", 5), (1, "odd", "Winter", "1:00", "2:00", 5), (1, "HS", None, "1:00", "2:00", 5), (1, "HS", "Sommer", "früh", "2:00", 5)], "document_id int, level_label string, season_label string, start string, end string, page int")
    empties = spark.createDataFrame([(1, "HS", "Herbst"), (1, None, "Herbst")], "document_id int, level_label string, season_label string")
    rules = spark.createDataFrame([(1, "bridge_days", '"odd"', True), (1, "bridge_days", '"off_peak_max_one"', False)], "document_id int, kind string, value string, grounded boolean")
    readings = spark.createDataFrame([(1, "end", "09:00", "09:15", 1, "x")], READINGS)
    pages = spark.createDataFrame([(1, 1, DEFINED)], "document_id int, page int, text string")
    got = N.normalize(readings, windows, empties, rules, pages)
    assert [(r.level, r.season, r.start_min, r.end_min, r.page) for r in got.windows.collect()] == [("NE5", "winter", 465, 540, 5)]
    assert got.empties.count() == 1 and got.rules.count() == 2
    want = ["CONVENTION_CORRECTED", "EMPTY_CELL_UNMAPPED", "LEVEL_UNMAPPED", "RULE_AMBIGUOUS", "RULE_UNGROUNDED", "RULE_VALUE_INVALID", "SEASON_UNMAPPED", "TIME_UNPARSEABLE"]
    assert sorted(r.code for r in got.findings.collect()) == want
    nothing = N.normalize(*[d.limit(0) for d in (readings, windows, empties, rules, pages)])
    assert [d.count() for d in nothing] == [0] * 5
