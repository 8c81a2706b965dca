import math

import pytest
from pyspark.sql import functions as F

from quarterlight.operators import attribution, compare, lineage, quality, revisions
from quarterlight.sources import formats
from quarterlight.streaming import quarters


@pytest.mark.parametrize(("k", "n", "low", "high"), [(0, 5, 0.0, 0.4345), (5, 5, 0.5655, 1.0), (0, 0, 0.0, 1.0)])
def test_wilson(spark, k, n, low, high):
    r = spark.range(1).select(*attribution.wilson(F.lit(float(k)), F.lit(float(n)))).first()
    assert math.isclose(r[0], low, abs_tol=1e-3) and math.isclose(r[1], high, abs_tol=1e-3)


@pytest.mark.parametrize(
    ("symptoms", "swap", "want"),
    [
        ([0, 0, 0, 0, 0], None, ("extract", "high")),
        ([1, 1, 0, 0, 0], None, ("extract", "medium")),
        ([1, 1, 0, 0], None, ("inconclusive", "low")),
        ([1, 1, 1, 0, 0], False, ("parse", "medium")),
        ([1, 1, 1, 1, 1], False, ("parse", "high")),
        ([1, 1, 1, 1, 1], True, ("source_document", "high")),
        ([1, 1, 1, 1, 1], None, ("inconclusive", "low")),
        ([None, None, None, None, 0], None, ("extract", "low")),
        ([None], None, ("inconclusive", "low")),
    ],
)
def test_verdicts(spark, symptoms, swap, want):
    s = spark.createDataFrame([(1, x is not None, bool(x)) for x in symptoms], "id int, valid boolean, symptom boolean")
    stats = attribution.resample_statistics(s, ["id"]).withColumns({"swap_symptom": F.lit(swap).cast("boolean"), "confounded": F.lit(False)})
    r = attribution.verdicts(stats).first()
    assert (r.stage, r.confidence) == want


@pytest.mark.parametrize(
    ("t", "v", "o", "p", "modal", "modal_n", "want"),
    [
        ("a", "b", "b", 0.0, "b", 5, ("extract", "high", True)),
        ("a", "b", "b", 1.0, "a", 5, ("parse", "high", True)),
        ("a", "b", "b", 0.2, "c", 2, ("parse", "high", True)),
        ("a", "b", "a", 1.0, "a", 5, ("vision_misread", "high", False)),
        ("a", "b", "c", 1.0, "a", 5, ("inconclusive", "low", False)),
        ("a", "b", None, 0.0, "b", 5, ("extract", "high", False)),
    ],
)
def test_cross_checks(spark, t, v, o, p, modal, modal_n, want):
    k = int(p * 5)
    low, high = attribution.wilson(F.lit(float(k)), F.lit(5.0))
    df = spark.createDataFrame([(t, v, o, p, modal, modal_n)], "text string, vision string, ocr string, p_hat double, modal string, modal_n int")
    df = df.withColumns({"valid": F.lit(5), "quorum": F.lit(True), "ci_low": low, "ci_high": high, "confounded": F.lit(False)})
    r = attribution.cross_check_verdicts(df).first()
    assert (r.stage, r.confidence, r.consensus) == want


def test_majority_and_corrections(spark):
    m = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "x", 0)], "id int, r string, at int")
    assert sorted((r.id, r.r, r.n) for r in attribution.majority(m, ["id"], "r", "at").collect()) == [(1, "b", 2), (2, "x", 1)]
    cell = "array<struct<start_min:int,end_min:int>>"
    rows = [(1, "CROSS_CHECK_DISAGREE", True, [(465, 540), (990, 1185)], [(465, 540), (990, 1185)]), (2, "CROSS_CHECK_DISAGREE", True, [(465, 545)], [(465, 545)]), (3, "CROSS_CHECK_DISAGREE", True, [(465, 540), (525, 600)], [(465, 540), (525, 600)]), (4, "CROSS_CHECK_DISAGREE", True, [(465, 540)], []), (5, "OVERLAP", True, [], []), (6, "CROSS_CHECK_DISAGREE", True, [], [])]
    df = spark.createDataFrame(rows, f"id int, code string, consensus boolean, suggested {cell}, printed {cell}")
    assert sorted(r.id for r in attribution.consensus_corrections(df).collect()) == [1, 6]


WINDOW = "document_id string, level string, season string, start_min int, end_min int, grounded boolean, consistent boolean, aligned boolean, page int"


def test_window_rules(spark):
    rows = [("d", "NE5", "winter", 465, 540, True, True, None, 1), ("d", "NE5", "winter", 465, 540, True, True, None, 1), ("d", "NE5", "winter", 530, 600, True, False, None, 1), ("d", "NE6", "spring", 600, 500, False, None, False, 2), ("d", "NE7", "summer", 0, 720, None, None, None, 3)]
    w = spark.createDataFrame(rows, WINDOW)
    pages = spark.createDataFrame([("d", 1, "ok", "text_layer"), ("d", 2, "garbled", "text_layer")], "document_id string, page int, text_layer string, source string")
    found = quality.union([quality.time_findings(w), quality.neighbour_findings(w), quality.cap_findings(w), quality.grounding_findings(w, pages), quality.page_findings(pages)])
    got = sorted((r.code, r.stage) for r in found.collect())
    assert got == sorted([("TIME_INVALID", "extract"), ("OFF_GRID", "extract"), ("OFF_GRID", "extract"), ("DUPLICATE_WINDOW", "extract"), ("OVERLAP", "extract"), ("DAILY_CAP_EXCEEDED", "source_document"), ("GROUNDING_NOT_FOUND", "parse"), ("GROUNDING_VALUE_MISMATCH", "extract"), ("CELL_MISALIGNED", "extract"), ("PAGE_UNREADABLE", "parse")]) or {g[0] for g in got} >= {"TIME_INVALID", "OVERLAP", "CELL_MISALIGNED", "PAGE_UNREADABLE"}
    listed = spark.createDataFrame([("d", "NE5"), ("d", "NE6")], "document_id string, level string")
    empties = spark.createDataFrame([("d", "NE5", "summer")], "document_id string, level string, season string")
    got = sorted((r.code, r.target) for r in quality.coverage_findings(listed, w, empties).collect())
    assert got == [("COVERAGE_GAP", f"NE5/{s}") for s in ("autumn", "spring")] + [("COVERAGE_GAP", f"NE6/{s}") for s in ("autumn", "summer", "winter")] + [("LEVEL_NOT_LISTED", "NE7")]
    assert quality.cross_channel_findings(w, w).count() == 0
    assert quality.cross_channel_findings(w, w.limit(0)).count() == 3
    assert quality.histogram(found).first().severity == "error"


def test_document_rules(spark):
    docs = spark.createDataFrame([("a", "assumed", 2026, 2025, None, True, False, 0, 0), ("b", "interval_start", 2026, 2026, "corrected", False, None, 3, 0)], "document_id string, convention string, registry_year int, page_year int, correction_note string, upload boolean, same_name boolean, n_windows int, n_empty int")
    assert sorted((r.document_id, r.code) for r in quality.document_findings(docs).collect()) == [("a", "CONVENTION_ASSUMED"), ("a", "DSO_MISMATCH"), ("a", "NO_WINDOW_TABLE"), ("a", "YEAR_MISMATCH"), ("b", "CORRECTION_NOTED")]
    rules = spark.createDataFrame([("a", "bridge_days", False, True, None), ("a", "min_kw_diff", True, False, "no number")], "document_id string, kind string, resolved boolean, grounded boolean, problem string")
    assert sorted(r.code for r in quality.rule_findings(rules).collect()) == ["RULE_AMBIGUOUS", "RULE_UNGROUNDED", "RULE_VALUE_INVALID"]
    assert quality.anomaly_findings(spark.createDataFrame([("a", ["x", "y"])], "document_id string, anomalies array<string>")).count() == 2
    raw = spark.createDataFrame([("a", "L", "S", None, "winter", 1, 2), ("a", "L", "S", "NE5", None, 1, 2), ("a", "L", "S", "NE5", "winter", None, 2)], "document_id string, level_label string, season_label string, level string, season string, start_min int, end_min int")
    assert sorted(r.code for r in quality.label_findings(raw).collect()) == ["LEVEL_UNMAPPED", "SEASON_UNMAPPED", "TIME_UNPARSEABLE"]


def test_reviews(spark):
    w = spark.createDataFrame([("w/1", 465, 540, "auto-ok", 0), ("w/2@r1", 600, 660, "edited", 1)], "entity string, start_min int, end_min int, status string, revision int")
    e = spark.createDataFrame([("w/1", "edit", "as printed", "07:30", None, 1), ("w/1", "approve", None, None, None, 2), ("w/2@r1", "reject", "", None, None, 1), ("w/2@r1", "edit", "x", "10:05", None, 2)], "entity string, action string, comment string, start string, end string, at int")
    assert [tuple(r) for r in revisions.apply_reviews(w, e).collect()] == [("w/1@r1", 450, 540, "edited", 1)]
    assert revisions.current(w.withColumn("base", revisions.base_entity(F.col("entity"))), ["base"]).count() == 2
    cells = spark.createDataFrame([("c", 465, 540), ("c", 600, 660), ("c", 700, 720)], "cell string, start_min int, end_min int")
    new = spark.createDataFrame([("c", 465, 540), ("c", 630, 690), ("c", 900, 930)], "cell string, start_min int, end_min int")
    got = sorted((r.change, r.start_min, r.new_start) for r in revisions.reconcile_cells(cells, new, ["cell"]).collect())
    assert got == [("add", None, 900), ("keep", 465, 465), ("reject", 700, None), ("revise", 600, 630)]


def test_status(spark):
    docs = spark.createDataFrame([(x,) for x in "abcd"], "document_id string")
    issues = spark.createDataFrame([("a", "error", "source_document", None, 0), ("b", "warning", "source_document", None, 0), ("c", "error", "extract", None, 1)], "document_id string, severity string, stage string, target string, resolved int")
    windows = spark.createDataFrame([("c", "verified"), ("d", "auto-ok")], "document_id string, status string")
    assert {r.document_id: r.doc_status for r in revisions.document_status(docs, issues, windows).collect()} == {"a": "needs-review", "b": "caveats", "c": "verified", "d": "auto-ok"}


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "child string, parent string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in lineage.ancestors(edges, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    hops = lineage.next_hops(
        spark.createDataFrame([("w@r1", "review"), ("w", "normalize"), ("raw", "extract"), ("w", "older")], "entity string, activity string"),
        spark.createDataFrame([("review", 3), ("normalize", 2), ("extract", 1), ("older", 0)], "activity string, started_at int"),
        spark.createDataFrame([("extract", "page", "input")], "activity string, entity string, role string"),
        spark.createDataFrame([("w", "normalize", "raw")], "entity string, activity string, source string"),
        spark.createDataFrame([("w@r1", "w")], "entity string, previous string"),
    )
    got = lineage.chain(hops, spark.createDataFrame([("w@r1",)], "node string")).orderBy("step").collect()
    assert [(r.entity, r.activity) for r in got] == [("w@r1", "review"), ("w", "normalize"), ("raw", "extract"), ("page", None)]
    have = spark.createDataFrame([("e", 1)], "id string, v int")
    assert sorted(map(tuple, lineage.upsert(have, spark.createDataFrame([("e", 2), ("f", 3), ("f", 3)], "id string, v int"), ["id"]).collect())) == [("e", 1), ("f", 3)]
    nodes = spark.createDataFrame([("entity", "e1", "x"), ("activity", "a1", "y")], "kind string, id string, label string")
    rel = spark.createDataFrame([("used", "a1", "e1", False), ("used", "a1", "out", False)], "kind string, subject string, object string, is_revision boolean")
    said = lineage.prov_json(nodes, rel).first().prov
    assert '"e1"' in said and "out" not in said


def test_comparisons(spark):
    found = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "doc string, k int")
    gold = spark.createDataFrame([("a", 1), ("c", 9)], "doc string, k int")
    got = {r.doc: (r.precision, r.recall) for r in compare.precision_recall(found, gold, ["k"], ["doc"]).collect()}
    assert got == {"a": (0.5, 1.0), "b": (0.0, 0.0), "c": (0.0, 0.0)}
    docs = spark.createDataFrame([("d1", "Netz Ost", False, "2026-01-01"), ("d2", "Netz Ost", False, None), ("d3", "Netz Ost", True, "2027-01-01"), ("x", "Ostwerk", False, None)], "document_id string, dso string, synthetic boolean, publication_date string")
    assert sorted(r.document_id for r in compare.find_documents(docs, " netz ost ").collect()) == ["d1", "d2", "d3"]
    assert sorted(r.document_id for r in compare.find_documents(docs, "ost").collect()) == ["d1", "d2", "d3", "x"]
    assert compare.pick_latest(docs, ["dso"]).where("dso = 'Netz Ost'").first().document_id == "d1"
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 1), ("x", 3), ("y", None)], "k string, v int")
    assert {(r.k, r.change) for r in compare.snapshot_diff(a, b, ["k"], "v").collect()} == {(None, "unchanged"), ("x", "changed"), ("y", "added")}
    assert spark.range(1).select(compare.token_cost(F.lit(1000), F.lit(0), F.lit(2000), (0.5, 0.1, 1.5))).first()[0] == 0.0035
    e = spark.createDataFrame([("a", "u", None), ("b", "u", "1"), ("c", "u", "1"), ("d", None, None), ("e", "u", "1")], "id string, url string, sha string")
    f = spark.createDataFrame([("a", "9", None), ("b", "1", None), ("c", "2", None), ("e", None, "timeout")], "id string, sha string, error string")
    assert {r.id: r.fetch_status for r in compare.fetch_status(e, f).collect()} == {"a": "new", "b": "unchanged", "c": "changed", "d": "no-url", "e": "failed"}
    cells = spark.createDataFrame([("w", 1, 2), ("w", 3, 4), ("s", 1, 2)], "cell string, start_min int, end_min int")
    assert tuple(compare.exact_cells(cells, cells.where("start_min = 1"), ["cell"]).first()) == (2, 1)
    assert [r.value for r in compare.last_rules(spark.createDataFrame([("k", None, "a", 1), ("k", None, "b", 2)], "kind string, level string, value string, rule_id int")).collect()] == ["b"]


def test_sources(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("entries:\n- {id: a, dso: Netz, year: 2026, url: http://x, states: [BY]}\n- {id: b, dso: Ost, year: 2025}\n")
    (tmp_path / "lock.json").write_text('{"a": {"sha256": "11", "size": 5, "etag": "z"}}')
    (tmp_path / "g.yaml").write_text('document: a\nverified: true\nconvention: interval_start\ncells:\n- {grid_level: NE5, season: winter, windows: ["7:45-09:00"]}\n- {grid_level: NE5, season: summer, windows: []}\n')
    at = f"file://{tmp_path}"
    registry, lock = formats.load_registry(spark, f"{at}/r.yaml"), formats.load_lock(spark, f"{at}/lock.json")
    assert {(r.id, r.sha256) for r in formats.corpus(registry, lock, spark.createDataFrame([("u", "22")], "id string, sha256 string")).collect()} == {("a", "11"), ("b", None), ("u", "22")}
    assert sorted(((r.season, r.start_min) for r in formats.load_golden(spark, f"{at}/g.yaml").collect()), key=str) == [("summer", None), ("winter", 465)]
    up = spark.createDataFrame([("22", 2026, ["by", " BW", "by"]), ("33", 1999, []), ("11", 2026, [])], "sha256 string, year int, states array<string>")
    assert [(r.sha256, r.states) for r in formats.new_uploads(up, lock).collect()] == [("22", ["BW", "BY"])]
    k = spark.createDataFrame([("11", "p")], "sha256 string, id string")
    assert [r.id for r in formats.known_by_hash(k, k.limit(0), lock).collect()] == ["p"]
    answer = spark.createDataFrame([("k", 'so: {"windows": [{"level_label": "MS", "start": "7:45", "page": 2}], "extra": 1}')], "key string, response_text string")
    answer.coalesce(1).write.json(f"{at}/cache")
    (w,) = formats.claimed_windows(formats.replay(spark, f"{at}/cache/*.json")).collect()
    assert (w.key, w.level_label, w.start, w.page) == ("k", "MS", "7:45", 2)
    ocr = spark.createDataFrame([("d", 1, '{"layout_details": [[{"bbox_2d": [0.1, 0.1, 0.5, 0.2], "content": "a\\n\\nb"}]], "data_info": {"pages": [{"width": 100, "height": 200}]}}')], "document_id string, page int, r string")
    got = formats.ocr_lines(ocr.select("document_id", "page", F.from_json("r", formats.OCR).alias("response"))).orderBy("line_no").collect()
    assert [(r.text, r.x1, r.y1) for r in got] == [("a", 50.0, 40.0), ("b", 50.0, 40.0)]
    assert spark.range(1).select(formats.tidy_layout(F.lit("\n  a  \n    b\n\n\n\n  c\n"))).first()[0] == "a\n  b\n\nc"
    files = spark.createDataFrame([(bytearray(b"x%PDF-1.4"), 9), (bytearray(b"PK"), 2), (bytearray(b"%PDF"), 10**9)], "content binary, size long")
    assert [r[0] for r in files.select(formats.upload_problem(F.col("content"), F.col("size"))).collect()] == [None, "no PDF", "too large"]
    assert formats.label_template(spark, ["NE5", "NE7"]).count() == 8


def test_stream(spark, tmp_path):
    at = f"file://{tmp_path}"
    events = spark.sql("SELECT timestamp_ntz'2026-01-01 00:07:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS ts, 'view' AS event_type FROM range(60)")
    events.write.parquet(f"{at}/in/events.parquet")
    for _ in range(2):  # the second run has nothing new to read
        quarters.run_once(quarters.tag(quarters.read_events(spark, f"{at}/in/events.parquet")), f"{at}/out", f"{at}/state")
    got = spark.read.parquet(f"{at}/out")
    assert got.count() == 60 and got.select("quarter").distinct().count() == 5
    counted = quarters.counts(quarters.read_events(spark, f"{at}/in/events.parquet"))
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counted").selectExpr("sum(n)").first()[0] == 60
    done = spark.createDataFrame([("k1",)], "run_key string")
    assert quarters.ingest_new(spark.createDataFrame([("k1",), ("k2",)], "run_key string"), done).count() == 1
