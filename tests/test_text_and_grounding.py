import pytest
from pyspark.sql import functions as F

from quarterlight.functions import fuzzy, text
from quarterlight.operators import grounding


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("printed", "key"),
    [
        ("07.45 – 9:00 Uhr", "07:45-09:00"),
        ("  Winter \n 7:45 ", "winter 07:45"),
        ("HS ─ MS", "hs ms"),
        ("uhrzeit 12 . 30", "uhrzeit 12:30"),
        ("ﬁx − Ⅳ", "fix-iv"),
        ("Gebühr 1.234", "gebühr 1.234"),
    ],
)
def test_match_key(spark, printed, key):
    assert one(spark, text.match_key(F.col("t")), t=printed) == key


@pytest.mark.parametrize(("t", "minutes"), [("07:45", 465), ("7:45", 465), ("07.45 Uhr", 465), ("24:00", 1440), ("24:15", None), ("25:00", None), ("7:45-9", None), ("", None)])
def test_parse_time(spark, t, minutes):
    assert one(spark, text.parse_time(F.col("t")), t=t) == minutes


def test_times_and_ranges(spark):
    t = "von 07:45 bis 9.00 Uhr und 16:30 Uhr – 19:45, 24:30"
    assert one(spark, text.times_in(F.col("t")), t=t) == [465, 540, 990, 1185]
    assert [tuple(r) for r in one(spark, text.time_ranges_in(F.col("t")), t=t)] == [(465, 540), (990, 1185)]


@pytest.mark.parametrize(
    ("label", "level"),
    [("Netzebene 5", "NE5"), ("NE 3", "NE3"), ("Umspannung HS/MS", "NE4"), ("Umspannung in die Mittelspannung", "NE4"), ("Höchstspannung", "NE1"), ("Hochspannung", "NE3"), ("Mittel-/Niederspannung", "NE6"), ("Niederspannung", "NE7"), ("MS", "NE5"), ("Straße", None)],
)
def test_levels(spark, label, level):
    assert one(spark, text.map_level(F.col("t")), t=label) == level


@pytest.mark.parametrize(("label", "season"), [("Winter (Dez-Feb)", "winter"), ("Frühjahr", "spring"), ("MÄRZ", "spring"), ("Juni", "summer"), ("Herbst", "autumn"), ("Jahr", None)])
def test_seasons(spark, label, season):
    assert one(spark, text.map_season(F.col("t")), t=label) == season


def test_small_text_functions(spark):
    assert one(spark, text.normal_level(F.col("t")), t="ne 5") == one(spark, text.normal_level(F.col("t")), t="5") == "NE5"
    assert one(spark, text.person_id(F.col("t")), t=" Ana-M. Ö ") == "ana-m--ö"
    assert one(spark, text.fold(F.col("t")), t="Mariä") == "maria"
    assert one(spark, text.json_object(F.col("t"), "a int"), t='Here:\n```json\n{"a": 3, "b": 1}\n```').a == 3
    assert one(spark, text.json_object(F.col("t"), "a int"), t="x {\"a\": 4} y").a == 4
    assert [one(spark, text.text_health(F.col("t"), F.lit(i)), t=t) for t, i in (("", False), ("short", False), ("short", True), ("a text that can be read", False), ("���� bad glyphs", False))] == ["empty", "ok", "empty", "ok", "garbled"]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_scores():
    import random

    rnd = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        assert fuzzy._lcs(a, b) == brute_lcs(a, b)
        s, lo, hi = fuzzy.partial_of(a, b)
        short, long = sorted((a, b), key=len)
        if short:
            windows = [long[max(0, e - len(short)) : min(e, len(long))] for e in range(1, len(long) + len(short))]
            best = max([200 * brute_lcs(short, w) / (len(short) + len(w)) for w in windows if w], default=0)
            assert abs(s - best) < 1e-9
            assert abs(fuzzy.partial_of(a, b, 70.0)[0] - (best if best >= 70 else 0)) < 1e-9
    assert fuzzy.token_set_of("netz ostheim gmbh", "ostheim netz") == 100.0
    assert fuzzy.ratio_of("07:45-09:00", "07:45-19:00") > 90


def test_grounding(spark):
    quotes = spark.createDataFrame([(1, 1, "HS/MS 30%"), (1, 2, "Hochlastzeitfenster im Winter 2026"), (1, 3, "Hochlastzeitfenster im Winter 2027"), (1, 4, "07:45–09:00")], "page int, quote_id int, quote string")
    lines = spark.createDataFrame([(1, 0, "HS/MS 20%"), (1, 1, "Hochlastzeitfenster im Wintr 2026 sind"), (1, 2, "7.45 - 9:00 Uhr")], "page int, line_no int, text string")
    got = {(r.quote_id, r.line_no): r.score for r in grounding.ground_fuzzy(quotes, lines, ["page"]).collect()}
    assert set(got) == {(2, 1), (4, 2)} and got[4, 2] == 100.0 and got[2, 1] > 90
    exact = grounding.ground_exact(spark.createDataFrame([(1, "a B"), (2, ""), (3, "zz")], "quote_id int, quote string"), spark.createDataFrame([(9, "x a  b y")], "page_id int, text string"))
    assert [tuple(r) for r in exact.collect()] == [(1, 9)]


def test_alignment_and_places(spark):
    b = lambda *x: dict(zip(("x0", "y0", "x1", "y1"), map(float, x), strict=True))
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    labels = spark.createDataFrame([(1, "level", "NE5", b(0, 20, 10, 30)), (1, "level", "NE7", b(0, 40, 10, 50)), (1, "season", "winter", b(20, 0, 40, 10)), (1, "season", "spring", b(50, 0, 70, 10))], f"page int, kind string, label string, bbox {kind}")
    values = spark.createDataFrame([(1, "a", b(22, 20, 38, 30), "NE5", "winter"), (1, "b", b(52, 20, 68, 30), "NE5", "winter"), (2, "c", b(0, 0, 1, 1), "NE5", "winter")], f"page int, value_id string, bbox {kind}, level_label string, season_label string")
    assert {r.value_id: r.aligned for r in grounding.cell_alignment(values, labels, ["page"]).collect()} == {"a": True, "b": False, "c": None}
    places = spark.createDataFrame([(1, 95.0, False, b(0, 0, 10, 10)), (1, 95.0, True, b(0, 0, 10, 20)), (1, 91.0, False, b(50, 50, 60, 60))], f"q int, score double, multiline boolean, bbox {kind}")
    assert sorted((r.score, r.multiline) for r in grounding.suppress_contained(places, ["q"]).collect()) == [(91.0, False), (95.0, False)]
