"""Names, long chains, stages of findings and exact quotes on small facts."""

import random

from pyspark.sql import functions as F

from quarterlight.functions import names
from quarterlight.functions.text import plain_key
from quarterlight.operators import grounding, lineage, quality


def test_slugs_and_ids(spark):
    rows = [("Stadtwerke Fürth Netz GmbH & Co. KG", None), ("N-ERGIE Netz GmbH", 2025), ("", None), (None, 2025), ("Électricité ﬁne AG", 0)]
    df = spark.createDataFrame(rows, "name string, year int").withColumn("sha", F.lit("ab" * 32))
    got = {r.name: (r.slug, r.free, r.taken) for r in df.select("name", names.slug(F.col("name")).alias("slug"), names.make_id(F.col("name"), F.col("year"), F.col("sha"), F.array().cast("array<string>")).alias("free"), names.make_id(F.col("name"), F.col("year"), F.col("sha"), F.array(F.lit("n-ergie-netz-2025"))).alias("taken")).collect()}
    assert got["Stadtwerke Fürth Netz GmbH & Co. KG"][:2] == ("stadtwerke-fuerth-netz", "stadtwerke-fuerth-netz")
    assert got["N-ERGIE Netz GmbH"] == ("n-ergie-netz", "n-ergie-netz-2025", "n-ergie-netz-2025-ababab")
    assert got[""][1] == got[None][1] == "upload-ababababab" and got["Électricité ﬁne AG"][0] == "electricite-fine"


def test_names_that_mean_the_same(spark):
    pairs = [("N-ERGIE Netz GmbH", "N-ERGIE Netz"), ("Stadtwerke Passau GmbH", "Stadtwerke Passau Netz GmbH"), ("Stadtwerke Passau GmbH", "Stadtwerke Bayreuth GmbH"), ("GmbH", "AG")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.s for r in df.select(names.same_name(F.col("a"), F.col("b")).alias("s")).collect()] == [True, True, False, False]
    known = spark.createDataFrame([("N-ERGIE Netz GmbH",), ("Stadtwerke Passau GmbH",), ("Werk A Nord",), ("Werk A Nord GmbH",)], "name string")
    asked = spark.createDataFrame([("n-ergie netz gmbh ",), ("Stadtwerke Passau Netz",), ("Werk A Nord AG",), ("Other",)], "name string")
    got = {r.name: r.canonical for r in names.canonical_names(asked, known).collect()}
    assert got == {"n-ergie netz gmbh ": "N-ERGIE Netz GmbH", "Stadtwerke Passau Netz": "Stadtwerke Passau GmbH", "Werk A Nord AG": "Werk A Nord AG", "Other": "Other"}


def test_names_as_printed(spark):
    lines = spark.createDataFrame([("d", 1, 1, "SWW WUNSIEDEL GMBH"), ("d", 1, 2, "SWW Wunsiedel GmbH, Rot-Kreuz-Straße 6"), ("d", 2, 1, "of the Talwerk")], "document_id string, page int, line_no int, text string")
    claims = spark.createDataFrame([("d", "SWW WUNSI... (SWW WUNSI...)"), ("d", "Talwerk"), ("d", "Bergwerk"), ("d", "SW...")], "document_id string, name string")
    got = {r.name: r.printed for r in names.printed_names(claims, lines).collect()}
    assert got == {"SWW WUNSI... (SWW WUNSI...)": "SWW WUNSIEDEL GMBH", "Talwerk": "Talwerk", "Bergwerk": None, "SW...": None}


def test_chains_have_no_longest(spark):
    hops = spark.range(200).selectExpr("concat('e', id) AS entity", "concat('a', id) AS activity", "concat('e', id + 1) AS next")
    agents = spark.createDataFrame([("a0", "tool", "software"), ("a0", "Ann", "person"), ("a1", "tool", "software")], "activity string, agent string, kind string")
    used = spark.createDataFrame([("a0", "e1", "input"), ("a0", "p1", "ground")], "activity string, entity string, role string")
    got = lineage.chain(hops, spark.createDataFrame([("e0",)], "node string"), agents, used).orderBy("step").collect()
    assert [r.entity for r in got] == [f"e{i}" for i in range(201)]
    assert got[0].agents == ["Ann", "tool"] and got[0].used == ["p1", "e1"] and got[2].agents == [] and got[200].activity is None


def test_entities_without_an_activity_keep_their_predecessor(spark):
    empty = lambda s: spark.createDataFrame([], s)
    hops = lineage.next_hops(empty("entity string, activity string"), empty("activity string, started_at long"), empty("activity string, entity string, role string"), empty("entity string, activity string, source string"), spark.createDataFrame([("w@r1", "w")], "entity string, previous string"))
    assert [tuple(r) for r in hops.collect()] == [("w@r1", None, "w")]


def test_stages_of_findings(spark):
    schema = "document_id string, level string, season string, start_min int, end_min int, grounded boolean, consistent boolean, aligned boolean"
    rows = [("a", "NE5", "winter", 0, 400, True, None, None), ("a", "NE5", "winter", 300, 700, True, True, True), ("b", "NE5", "winter", 0, 400, True, False, None), ("b", "NE5", "winter", 300, 700, True, True, True)]
    w = spark.createDataFrame(rows, schema)
    got = {(r.document_id, r.code): r.stage for r in quality.neighbour_findings(w).unionByName(quality.cap_findings(w)).collect()}
    assert got == {("a", "OVERLAP"): "source_document", ("b", "OVERLAP"): "extract", ("a", "DAILY_CAP_EXCEEDED"): "source_document", ("b", "DAILY_CAP_EXCEEDED"): "extract"}
    listed = spark.createDataFrame([("a", "NE5"), ("b", "NE5")], "document_id string, level string")
    seen = spark.createDataFrame([("a", "NE5", "spring")], "document_id string, level string, season string")
    gaps = quality.coverage_findings(listed, w, seen.limit(0), (listed.where("document_id = 'a'"), seen, seen.limit(0))).collect()
    assert sorted((r.document_id, r.target) for r in gaps) == [("a", "NE5/spring"), ("b", "NE5/autumn"), ("b", "NE5/spring"), ("b", "NE5/summer")]
    raw = spark.createDataFrame([("a", "L", "S", None, "winter"), ("a", "L", "S", "NE5", "winter")], "document_id string, level_label string, season_label string, level string, season string")
    assert [r.target for r in quality.empty_cell_findings(raw).collect()] == ["L/S"]


def test_exact_quotes_are_all_found(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["ab", "abc", "b", "cab", "08:00", "9.30", "x-y", "Ä", "the", "the", "the"]
    pages = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(120)] + [(7, "again the page"), (None, "a page without a number here"), (200, None)]
    quotes = [(i, t[a : a + rnd.randint(1, 60)]) for i in range(150) for t in [rnd.choice(pages[:120])[1]] for a in [rnd.randint(0, max(0, len(t) - 1))]]
    quotes += [(500, ""), (501, None), (502, "page without a number"), (503, "nowhere at all in any of them"), (504, "the")]
    p, q = spark.createDataFrame(pages, "page_id long, text string"), spark.createDataFrame(quotes, "quote_id long, quote string")
    key = lambda df, c: df.withColumn(c, plain_key(F.col(c))).collect()
    want = sorted((str(a.quote_id), str(b.page_id)) for a in key(q, "quote") for b in key(p, "text") if a.quote and b.text is not None and a.quote in b.text)
    for most in (4096, 7):
        monkeypatch.setattr(grounding, "SHORT_QUOTES", most)
        assert sorted((str(r.quote_id), str(r.page_id)) for r in grounding.ground_exact(q, p).collect()) == want


def test_canonical_names_equal_all_pairs(spark, monkeypatch):
    """Blocks by words and lengths lose no name that is spelled alike, however the registry is dealt."""
    import numpy as np

    from quarterlight.functions.fuzzy import token_set_of

    monkeypatch.setattr(names, "KNOWN", 15)
    rng = np.random.default_rng(3)
    words = ["stadtwerke", "fuerth", "energie", "nord", "sued", "rhein", "main", "strom", "ab", "kraft", "nord nord"]
    say = lambda: " ".join(rng.choice(words, int(rng.integers(1, 4))))

    def typo(t):
        i = int(rng.integers(0, len(t)))
        return t[:i] + str(rng.choice(list("aex "))) + t[i + int(rng.integers(0, 2)) :]

    known = sorted({say() for _ in range(60)})
    asked = sorted({typo(str(rng.choice(known))) if rng.random() < 0.7 else say() for _ in range(150)} - {""})
    have = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in {*known, *asked}], "name string").select("name", names.name_key(names.F.col("name"))).collect()}
    want = {}
    for a in asked:
        exact = [k for k in known if k.strip().lower() == a.strip().lower()]
        close = [k for k in known if have[a] and have[k] and token_set_of(have[a], have[k]) >= names.SAME]
        want[a] = min(exact) if exact else close[0] if len(close) == 1 else a.strip()
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "name string")
    got = {r.name: r.canonical for r in names.canonical_names(frame(asked), frame(known)).collect()}
    assert got == want and sum(want[a] != a.strip() for a in asked) >= 10
