"""Closures of any depth over both kinds of edges, and their documents, against plain loops."""

import json
from collections import deque

import numpy as np

from quarterlight.operators import lineage

G, U, D, A = "entity string, activity string", "activity string, entity string, role string", "entity string, source string, activity string", "activity string, agent string, role string"


def walk(start, generated, used, derived, associated):
    found, open_ = {("entity", start): 0}, deque([("entity", start)])
    while open_:
        kind, x = open_.popleft()
        if kind == "entity":
            onward = [("activity", a) for e, a in generated if e == x] + [("entity", s) for e, s, _ in derived if e == x]
        else:
            onward = [("entity", e) for a, e, _ in used if a == x]
        for n in onward:
            if n[1] is not None and n not in found:
                found[n] = found[kind, x] + 1
                open_.append(n)
    for a, g, _ in associated:
        if ("activity", a) in found:
            found["agent", g] = min(found.get(("agent", g), 10**9), found["activity", a] + 1)
    return found


def test_a_long_chain_is_whole_in_few_rounds(spark, monkeypatch):
    rounds = []
    cut = lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda df: (rounds.append(1), cut(df))[1])
    edges = spark.range(5000).selectExpr("id AS child", "id + 1 AS parent")
    got = lineage.ancestors(edges, spark.createDataFrame([(0,), (4000,)], "node long")).groupBy("origin").agg({"node": "count", "depth": "max"}).collect()
    assert {tuple(r) for r in got} == {(0, 5001, 5000), (4000, 1001, 1000)}
    assert len(rounds) - 2 - 2 * lineage.LEVELS <= 2 * 14  # a round stores what is known and the pairs twice as far apart


def test_random_graphs_with_cycles(spark):
    rng = np.random.default_rng(4)
    for n, m in ((30, 40), (60, 75), (25, 120)):
        edges = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))}
        want = set()
        for s in range(5):
            depth, open_ = {s: 0}, deque([s])
            while open_:
                x = open_.popleft()
                for a, b in edges:
                    if a == x and b not in depth:
                        depth[b] = depth[x] + 1
                        open_.append(b)
            want |= {(s, k, d) for k, d in depth.items()}
        df = spark.createDataFrame([*edges, *list(edges)[:3], (None, 1), (2, None)], "child int, parent int")
        got = lineage.ancestors(df, spark.createDataFrame([(s,) for s in [*range(5), 0, None]], "node int"))
        assert sorted(map(tuple, got.select("origin", "node", "depth").collect())) == sorted(want)


def graph(rng):
    e, a, g = [f"e{k}" for k in range(40)], [f"a{k}" for k in range(15)], ["p1", "p2", "s"]
    pick = lambda x: str(rng.choice(x))
    generated = list({(pick(e), pick(a)) for _ in range(25)})
    used = list({(pick(a), pick(e), str(rng.choice(["page", "tool"]))) for _ in range(25)}) + [("a1", "e2", None)]
    derived = list({(pick(e), pick(e), pick(a)) for _ in range(10)}) + [("e3", "e4", None), ("e4", "e5", "a0"), ("x", None, None)]
    associated = list({(pick(a), pick(g), "did") for _ in range(12)}) + [("a2", "s", None)]
    return e, a, g, generated, used, derived, associated


def test_closure_with_activities_and_agents(spark):
    rng = np.random.default_rng(5)
    for _ in range(3):
        e, a, g, generated, used, derived, associated = graph(rng)
        tables = spark.createDataFrame(generated, G), spark.createDataFrame(used, U), spark.createDataFrame(derived, D), spark.createDataFrame(associated, A)
        starts = ["e0", "e3", "e7", "nowhere"]
        got = lineage.closure(spark.createDataFrame([(s,) for s in starts], "node string"), *tables).collect()
        want = [(s, *k, d) for s in starts for k, d in walk(s, generated, used, derived, associated).items()]
        assert sorted(map(tuple, got)) == sorted(want)


def test_documents(spark):
    rng = np.random.default_rng(6)
    e, a, g, generated, used, derived, associated = graph(rng)
    attrs = '{"page": 3, "share": 0.5, "ok": true, "x:y": "ä \\"q\\"", "deep": {"a": [1, 2]}, "none": null}'
    entities = [(x, "t:Value", f"label {x}" if k % 2 else None, attrs if k % 3 else None) for k, x in enumerate(e[:-3])]
    activities = [(x, "t:Do", None, "2025-01-01T00:00:00+00:00" if k % 2 else None, None, "{}") for k, x in enumerate(a)]
    agents = [(x, "prov:Person", x.upper(), "not json") for x in g]
    tables = spark.createDataFrame(generated, G), spark.createDataFrame(used, U), spark.createDataFrame(derived, D), spark.createDataFrame(associated, A)
    starts = ["e0", "e3", "nowhere"]
    closed = lineage.cut(lineage.closure(spark.createDataFrame([(s,) for s in starts], "node string"), *tables))
    node = "id string, type string, label string, attrs string"
    df = lineage.prov_document(
        closed, spark.createDataFrame(entities, node), spark.createDataFrame(activities, "id string, type string, label string, started_at string, ended_at string, attrs string"), spark.createDataFrame(agents, node),
        *tables, spark.createDataFrame([("e3", "e4")], "entity string, previous string"),
    )
    got = {r.origin: json.loads(r.prov) for r in df.collect()}
    name = lambda t: {"$": t, "type": "prov:QUALIFIED_NAME"}
    for s in starts:
        inside = walk(s, generated, used, derived, associated)
        has = lambda k, x: (k, x) in inside  # noqa: B023, E731
        doc = got.get(s, {})
        assert set(doc.get("entity", {})) == {x for x, *_ in entities if has("entity", x)}
        assert set(doc.get("activity", {})) == {x for x, *_ in activities if has("activity", x)}
        assert set(doc.get("agent", {})) == {x for x, *_ in agents if has("agent", x)}
        for x, t, label, at in entities:
            if has("entity", x):
                want = {"prov:type": name(t)} | ({"prov:label": label} if label else {})
                want |= {"ql:page": 3, "ql:share": 0.5, "ql:ok": True, "x:y": 'ä "q"', "ql:none": "null"} if at else {}
                said = dict(doc["entity"][x])
                assert not at or json.loads(said.pop("ql:deep")) == {"a": [1, 2]}
                assert said == want
        for section, rows in (
            ("used", [{"prov:activity": x, "prov:entity": y} | ({"prov:role": r} if r else {}) for x, y, r in used if has("activity", x) and has("entity", y)]),
            ("wasGeneratedBy", [{"prov:entity": x, "prov:activity": y} for x, y in generated if has("entity", x) and has("activity", y)]),
            ("wasAssociatedWith", [{"prov:activity": x, "prov:agent": y} | ({"prov:role": r} if r else {}) for x, y, r in associated if has("activity", x)]),
            ("wasDerivedFrom", [{"prov:generatedEntity": x, "prov:usedEntity": y} | ({"prov:activity": z} if z and has("activity", z) else {}) | ({"prov:type": name("prov:Revision")} if (x, y) == ("e3", "e4") else {}) for x, y, z in derived if has("entity", x) and y and has("entity", y)]),
        ):
            key = lambda r: json.dumps(r, sort_keys=True)
            assert sorted(doc.get(section, {}).values(), key=key) == sorted(rows, key=key)
        blank = [k for sec in ("used", "wasGeneratedBy", "wasAssociatedWith", "wasDerivedFrom") for k in doc.get(sec, {})]
        assert sorted(blank) == sorted(f"_:r{k}" for k in range(1, len(blank) + 1))


def test_no_level_and_no_closure_is_stored_twice(spark, monkeypatch):
    """Stored are the relations, the starts and each level's new nodes, not all that is known so far."""
    stored = []
    inner = lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda df: stored.append(inner(df)) or stored[-1])
    pairs = lambda rows, a, b: spark.createDataFrame(rows, f"{a} string, {b} string")
    made, took = pairs([("e1", "a1"), ("e2", "a2")], "entity", "activity"), pairs([("a1", "e2")], "activity", "entity")
    out = lineage.closure(made.select("entity").where("entity = 'e1'").toDF("node"), made, took, pairs([], "entity", "source"), pairs([("a1", "p"), ("a2", "p")], "activity", "agent"))
    assert sorted((r.kind, r.id, r.depth) for r in out.collect()) == [("activity", "a1", 1), ("activity", "a2", 3), ("agent", "p", 2), ("entity", "e1", 0), ("entity", "e2", 2)]
    assert sum(df.count() for df in stored) == 5 + 5
