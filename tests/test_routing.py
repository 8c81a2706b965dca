"""Findings to verdicts, and verdicts to corrections, against plain loops over readings."""

from collections import Counter

import numpy as np

from quarterlight.operators import revisions, routing

GRID = [(0, 60), (60, 120), (420, 540), (480, 540), (990, 1185)]
CELLS = [("NE5", "winter"), ("NE5", "summer"), ("NE7", "winter")]
WINDOW = "array<struct<start_min:int,end_min:int>>"


def some_reading(rng, base=None, fault=0.3):
    if base is not None and rng.random() > fault:
        return base
    windows = [(*c, *GRID[int(rng.integers(0, len(GRID)))]) for c in CELLS if rng.random() < 0.7 for _ in range(int(rng.integers(1, 3)))]
    return windows, [c for c in CELLS if rng.random() < 0.3]


def cell(r, level, season):
    return None if r is None else tuple(sorted({w[2:] for w in r[0] if w[:2] == (level, season)}))


def text(c):
    return ", ".join(f"{a // 60:02}:{a % 60:02}-{b // 60:02}:{b % 60:02}" for a, b in c) or "(empty)"


def wilson(k, n):
    p, z = k / n, 1.96
    d, m = 1 + z * z / n, z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5
    return (p + z * z / (2 * n) - m) / d, (p + z * z / (2 * n) + m) / d


def decide(code, kind, level, season, a, b, stage, doc):
    """stage, confidence, suggestion, suggested, consensus; None without a verdict."""
    t, v, o = (cell(doc[k], level, season) for k in ("text", "vision", "swap"))
    if kind is None:
        return None
    if code in ("TIME_INVALID", "OFF_GRID", "OVERLAP", "DAILY_CAP_EXCEEDED"):
        return ("source_document", "high", None, None, False) if stage == "source_document" and v is not None and t == v else None
    if code not in ("GROUNDING_NOT_FOUND", "GROUNDING_VALUE_MISMATCH", "COVERAGE_GAP", "CROSS_CHECK_DISAGREE"):
        return None
    at = lambda r: cell(r, level, season)
    cross = code == "CROSS_CHECK_DISAGREE" and doc["vision"] is not None
    gap = code == "COVERAGE_GAP" and kind == "cell"
    if gap:
        symptom = lambda r: not at(r) and (level, season) not in r[1]
        says = lambda r: "windows " + text(at(r)) if at(r) else routing.EMPTY if (level, season) in r[1] else routing.NOTHING
    else:
        symptom = (lambda r: (a, b) in at(r)) if kind == "window" and not cross else lambda r: at(r) == t
        says = lambda r: text(at(r))
    good = [r for r in doc["resamples"] if r is not None]
    n, k = len(good), sum(map(symptom, good))
    p = k / n if n else None
    lo, hi = wilson(k, n) if n else (0, 1)
    quorum = n > 0 and 2 * n >= len(doc["resamples"])
    modal, modal_n = Counter(map(at, good)).most_common(1)[0] if n else (None, 0)
    half = lo > 0.5 or hi < 0.5
    if cross and o is not None and not doc["confounded"]:
        stable = n and modal_n / n >= 0.6
        if o == v != t:
            if n and p <= 0.4 and stable and modal == v:
                return "extract", "high" if quorum and hi < 0.5 else "medium", "OCR and vision read " + text(v), v, True
            return "parse", "high" if quorum and (not stable or (p or 0) >= 0.6) else "medium", "OCR and vision read " + text(v), v, True
        if o == t != v:
            return "vision_misread", "high" if (p or 0) >= 0.6 and quorum else "medium", None, None, False
        return "inconclusive", "low", None, None, False
    if p is None:
        return "inconclusive", "low", None, None, False
    said, said_n = Counter(map(says, good)).most_common(1)[0]
    own = f"resamples read {said} ({said_n}/{n})"
    sure = ("high" if half else "medium") if quorum else "low"
    if p <= 0.4:
        return "extract", sure, own, None if gap else modal, False
    if p < 0.6:
        return "inconclusive", "low", own, None, False
    if doc["swap"] is None:
        return "inconclusive", "low", None, None, False
    sure = "medium" if doc["confounded"] and sure == "high" else sure
    if not symptom(doc["swap"]):
        return "parse", sure, "OCR reading: " + says(doc["swap"]), None if gap else o, False
    return "vision_misread" if cross else "source_document", sure, None, None, False


def test_findings_become_verdicts(spark):
    rng = np.random.default_rng(9)
    docs, findings = {}, []
    codes = [r[0] for r in routing.ROUTES] + ["GRID_SOMETHING"]
    for d in range(250):
        base = some_reading(rng)
        other = some_reading(rng)
        maybe = lambda r: None if rng.random() < 0.15 else r  # noqa: B023, E731
        docs[d] = {"text": base, "vision": maybe(some_reading(rng, other, 0.3)), "swap": maybe(other if rng.random() < 0.6 else base), "resamples": [maybe(some_reading(rng, base if rng.random() < 0.5 else other, 0.1)) for _ in range(int(rng.integers(0, 6)))], "confounded": bool(rng.random() < 0.2)}
        for k in range(6):
            level, season = CELLS[int(rng.integers(0, 3))]
            kind = [None, "window", "cell", "cell"][int(rng.integers(0, 4))]
            a, b = GRID[int(rng.integers(0, len(GRID)))]
            findings.append((d, k, str(rng.choice(codes)), str(rng.choice(["source_document", "extract"])), kind, level, season, *((a, b) if kind == "window" else (None, None))))
    docs[0]["vision"] = docs[0]["text"]
    findings.append((0, 90, "OVERLAP", "source_document", "cell", *CELLS[0], None, None))
    findings.append((999, 91, "COVERAGE_GAP", "extract", "cell", *CELLS[0], None, None))
    f = spark.createDataFrame(findings, "document_id int, iid int, code string, suspected_stage string, target_kind string, level string, season string, start_min int, end_min int")
    r = spark.createDataFrame([(d, x["text"], x["vision"], x["swap"], x["resamples"], x["confounded"]) for d, x in docs.items()], f"document_id int, text {routing.READING}, vision {routing.READING}, swap {routing.READING}, resamples array<{routing.READING}>, confounded boolean")
    got = {(x.document_id, x.iid): (x.stage, x.confidence, x.suggestion, None if x.suggested is None else tuple(map(tuple, x.suggested)), x.consensus) for x in routing.attribute(f, r).collect()}
    nothing = {"text": None, "vision": None, "swap": None, "resamples": [], "confounded": False}
    want = {}
    for d, k, code, stage, kind, level, season, a, b in findings:
        if (v := decide(code, kind, level, season, a, b, stage, docs.get(d, nothing))) is not None:
            want[d, k] = v
    assert got == want
    assert len({v[:2] for v in want.values()}) >= 10 and sum(v[4] for v in want.values()) >= 10
    assert routing.attribute(f.limit(0), r).count() == 0


def test_agreed_cells_are_corrected(spark):
    """Vision's proof comes first, the swapped reading's only on a parse fault; a cell with a value unproven, or out of rule, waits."""
    w = [(420, 540), (990, 1185)]
    verdicts = [(1, 1, "parse", w), (2, 1, "parse", w), (3, 1, "extract", w), (4, 1, "parse", [(420, 430)]), (5, 1, "parse", []), (6, 1, "parse", w), (6, 2, "parse", None)]
    v = spark.createDataFrame([(d, i, "CROSS_CHECK_DISAGREE" if i == 1 else "OVERLAP", "cell", "NE5", "winter", s, True, c) for d, i, s, c in verdicts], f"document_id int, iid int, code string, target_kind string, level string, season string, stage string, consensus boolean, suggested {WINDOW}")
    proofs = [(d, 420, 540, "vision", 1, "q1", True, None, None) for d in (1, 2, 3)]
    proofs += [(1, 990, 1185, "vision", 2, "q2", True, True, True), (1, 990, 1185, "swap", 9, "late", True, True, True)]
    proofs += [(2, 990, 1185, "vision", 2, "elsewhere", True, True, False), (2, 990, 1185, "swap", 3, "q3", True, None, None), (3, 990, 1185, "swap", 3, "q3", True, True, None)]
    proofs += [(6, 420, 540, "vision", 1, "no", False, None, None), (6, 990, 1185, "vision", 1, "wrong", True, False, None)]
    p = spark.createDataFrame([(d, "NE5", "winter", *x) for d, *x in proofs], "document_id int, level string, season string, start_min int, end_min int, channel string, page int, quote string, found boolean, consistent boolean, aligned boolean")
    decisions = routing.decide_corrections(v, p)
    got = {r.document_id: (r.applied, r.reason, None if r.evidence is None else [(e.channel, e.page, e.quote) for e in r.evidence]) for r in decisions.collect()}
    assert got == {
        1: (True, None, [("vision", 1, "q1"), ("vision", 2, "q2")]),
        2: (True, None, [("vision", 1, "q1"), ("swap", 3, "q3")]),
        3: (False, "16:30-19:45 is not printed with these times in the NE5 winter cell of the text layer", None),
        4: (False, "the agreed reading breaks a time rule", None),
        5: (True, None, []),
        6: (False, "07:00-09:00 is not printed with these times in the NE5 winter cell of the text layer", None),
    }
    now = [(1, "w/a", 420, 530, 1), (1, "w/b@r2", 0, 60, 2), (2, "w/c", 420, 540, 1), (5, "w/d", 0, 60, 1), (3, "w/e", 0, 60, 1)]
    windows = spark.createDataFrame([(d, e, "NE5", "winter", a, b, r, "needs-review") for d, e, a, b, r in now], "document_id int, entity string, level string, season string, start_min int, end_min int, revision int, status string")
    new, provenance, issues = routing.correct(windows, decisions)
    assert sorted((r.document_id, r.entity, r.start_min, r.end_min, r.revision, r.status, r.previous or "") for r in new.collect()) == [
        (1, "w/a@r2", 420, 540, 2, "auto-corrected", "w/a"),
        (1, "w/b@r3", 0, 60, 3, "rejected", "w/b@r2"),
        (1, "window/1/NE5/winter/990/1185@auto", 990, 1185, 1, "auto-corrected", ""),
        (2, "w/c@r2", 420, 540, 2, "auto-corrected", "w/c"),
        (2, "window/2/NE5/winter/990/1185@auto", 990, 1185, 1, "auto-corrected", ""),
        (5, "w/d@r2", 0, 60, 2, "rejected", "w/d"),
    ]
    assert ("w/a@r2", "revision", "w/a") in {tuple(r) for r in provenance.collect()} and ("w/a@r2", "derived", "issue/1/1") in {tuple(r) for r in provenance.collect()}
    assert sorted((r.document_id, r.iid, r.resolved) for r in issues.collect()) == [(1, 1, 2), (2, 1, 2), (5, 1, 2)]
    after = windows.withColumn("target", revisions.base_entity(windows.entity)).unionByName(new.drop("origin", "previous").withColumn("target", revisions.base_entity(new.entity)))
    assert {(r.document_id, r.start_min, r.end_min) for r in revisions.current(after, ["target"]).where("document_id IN (1, 2, 5)").collect()} == {(1, 420, 540), (1, 990, 1185), (2, 420, 540), (2, 990, 1185)}
