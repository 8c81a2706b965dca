"""Histories, tracks, proposals, notes and sentences on small facts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarterlight.operators import report

W = "document_id int, entity string, level string, season string, start_min int, end_min int, status string, origin string, revision int"


@pytest.fixture(scope="module")
def windows(spark):
    rows = [
        (1, "w/a", "NE5", "winter", 420, 540, "auto-ok", "extract", 1),
        (1, "w/a@r2", "NE5", "winter", 420, 600, "rejected", "auto", 2),
        (1, "w/ab", "NE5", "winter", 990, 1185, "needs-review", "extract", 1),
        (1, "w/c", "NE7", "summer", 600, 540, "auto-ok", "extract", 1),
    ]
    return spark.createDataFrame(rows, W)


def test_history_is_that_of_one_window(spark, windows):
    got = report.window_history(windows, spark.createDataFrame([("w/a@r2",), ("w/none",)], "entity string")).orderBy("revision").collect()
    assert [(r.entity, r.label, r.status_label) for r in got] == [("w/a", "07:00–09:00", "auto-ok"), ("w/a@r2", "07:00–10:00", "Removed (consensus)")]


def test_tracks_of_a_day(spark, windows):
    docs = spark.createDataFrame([(1, "interval_end_labels", ["NE6", "NE5", "odd"]), (2, "assumed", [])], "document_id int, convention string, levels array<string>")
    empties = spark.createDataFrame([(1, "NE6", "winter")], "document_id int, level string, season string")
    issues = spark.createDataFrame([(1, "NE5/winter", "warning", 0), (1, "w/c", "error", 0), (1, "NE6/summer", "error", 1), (1, None, "error", 0)], "document_id int, target string, severity string, resolved int")
    got = {(r.level, r.season): r for r in report.ribbons(docs, windows.where("revision = 1"), empties, issues).collect()}
    assert len(got) == 12 and {k[0] for k in got} == {"NE5", "NE6", "NE7"}
    five = got["NE5", "winter"]
    assert [(b.label, b.left, b.width, b.boundary, b.flagged) for b in five.bars] == [("07:00–09:00", 29.1667, 8.3333, 1.0417, True), ("16:30–19:45", 68.75, 13.5417, 1.0417, True)]
    assert (five.hours, five.empty, five.missing, five.flagged) == (5.25, False, False, True)
    odd = got["NE7", "summer"]
    assert [(b.invalid, b.left, b.width, b.boundary, b.flagged) for b in odd.bars] == [(True, 37.5, 4.1667, 0.0, True)] and not odd.flagged
    assert (got["NE6", "winter"].empty, got["NE6", "winter"].missing, got["NE6", "summer"].missing, got["NE6", "summer"].flagged) == (True, False, True, False)


def test_proposals_replace_one_value(spark, windows):
    cell = "array<struct<start_min:int,end_min:int>>"
    rows = [(1, 2, "NE5", "winter", "parse", [(420, 555), (990, 1185)], 0), (1, 1, "NE5", "winter", "extract", [(400, 500), (420, 560)], 0), (1, 0, "NE5", "winter", "extract", [(420, 570)], 1), (1, 3, "NE7", "summer", "extract", [(0, 60)], 0)]
    v = spark.createDataFrame(rows, f"document_id int, iid int, level string, season string, stage string, suggested {cell}, resolved int")
    got = report.edit_proposals(windows.where("revision = 1"), v).collect()
    assert [(r.entity, r.start_min, r.end_min, r.source) for r in got] == [("w/a", 420, 555, "OCR reading")]  # the other reading has two that fit


def test_notes_resolve_issues(spark):
    issues = spark.createDataFrame([(1, 7, "A", 0), (2, 7, "B", 0), (3, 8, "C", 2)], "iid int, document_id int, code string, resolved int")
    notes = spark.createDataFrame([(1, "me", " seen ", "t1"), (2, "me", "  ", "t2"), (3, "me", "ok", "t3"), (9, "me", "ok", "t4")], "iid int, reviewer string, comment string, at string")
    after, done = report.acknowledge(issues, notes)
    assert {(r.iid, r.resolved) for r in after.collect()} == {(1, 1), (2, 0), (3, 2)}
    assert {(r.activity, r.comment) for r in done.collect()} == {("ack/7/1-t1", "seen"), ("ack/8/3-t3", "ok")}


@pytest.mark.parametrize(
    ("kind", "value", "said"),
    [
        ("workdays_only", "true", "Monday to Friday only"),
        ("workdays_only", "false", "every day"),
        ("bridge_days", "off_peak_max_one", "at most one is off-peak; the document does not say which"),
        ("bridge_days", "odd", "odd"),
        ("holiday_handling", '{"states": ["BY", "BW"], "mode": "intersection", "exclude": ["x", "y"]}', "holidays valid in all of BY and BW, except x, y"),
        ("holiday_handling", '{"states": ["BY"], "mode": "intersection"}', "public holidays in BY"),
        ("holiday_handling", "{}", "public holidays in unspecified states"),
        ("christmas_period", '{"from": "12-24", "to": "01-01"}', "24.12. to 01.01. off-peak"),
        ("christmas_period", '{"from": "12-24"}', "between Christmas and New Year, dates not stated"),
        ("min_kw_diff", "100.0", "100 kW"),
        ("significance_threshold", "7.5", "7.5 %"),
        ("de_minimis_eur", '"some"', "some €"),
        ("other", '"text"', "text"),
    ],
)
def test_sentences(spark, kind, value, said):
    assert spark.createDataFrame([(kind, value)], "k string, v string").select(report.rule_sentence(F.col("k"), F.col("v"))).first()[0] == said


def test_costs_and_runs(spark, windows):
    at = lambda h: dt.datetime(2025, 1, 1, h)
    calls = spark.createDataFrame([(1, 1.5, "live", at(1)), (1, 2.0, "live", at(9)), (1, 9.0, "cache", at(9)), (2, 1.0, "live", at(9)), (3, 50.0, "live", at(9))], "document_id int, cost_usd double, source string, at timestamp_ntz")
    docs = spark.createDataFrame([(1, False, at(5)), (2, False, at(5)), (3, True, at(5))], "document_id int, synthetic boolean, since timestamp_ntz")
    assert report.cost_estimate(calls, docs).first().cost == 2.25 and report.cost_estimate(calls.limit(0), docs).first().cost is None
    issues = spark.createDataFrame([(1, "error", 0), (1, "warning", 1)], "document_id int, severity string, resolved int")
    got = {r.document_id: (r.windows, r.review, r.auto, r.errors, r.warnings, r.calls, r.live_calls, r.cost) for r in report.run_summary(docs, windows, issues, calls).collect()}
    assert got == {1: (3, 1, 0, 1, 0, 2, 1, 2.0), 2: (0, 0, 0, 0, 0, 1, 1, 1.0), 3: (0, 0, 0, 0, 0, 1, 1, 50.0)}
    cells = spark.createDataFrame([("NE7", "winter"), ("NE5", "autumn"), ("zz", "winter"), ("NE5", "winter")], "l string, s string")
    assert [tuple(r) for r in cells.orderBy(*report.cell_order(F.col("l"), F.col("s"))).collect()] == [("NE5", "winter"), ("NE5", "autumn"), ("NE7", "winter"), ("zz", "winter")]


def test_names_and_missing_channels(spark):
    rows = [(1, " A Netz ", "A Netz", None), (2, "A N…", "A Netz GmbH", ""), (3, "B", None, "no key"), (4, None, None, None)]
    got = report.name_findings(spark.createDataFrame(rows, "document_id int, name string, printed string, vision_note string")).collect()
    assert sorted((r.document_id, r.code, r.severity) for r in got) == [(2, "DSO_NAME_FROM_PAGE", "info"), (3, "CROSS_CHECK_UNAVAILABLE", "info"), (3, "DSO_NAME_UNGROUNDED", "warning")]
