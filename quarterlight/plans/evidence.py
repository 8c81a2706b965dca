"""Queries on evidence: where things stand on a page, what values come from, and how findings become verdicts and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import geometry, lineage, revisions, routing
from .queries import _t


def _line(n, text, x0, y0, x1, y1):
    b = F.struct(*[(F.lit(float(v)) if isinstance(v, (int, float)) else v.cast("double")).alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])
    return F.struct(F.lit(n).alias("line_no"), (F.lit(text) if isinstance(text, str) else text).alias("text"), b.alias("bbox"))


def cell_geometry(spark, d):
    """Each part is a page with two seasons, two levels (one of which may run over two lines) and a cell or two."""
    k, z = F.col("p_partkey"), F.col("p_size")
    p = _t(spark, d, "part").select(k.cast("long").alias("page"), "p_partkey", "p_size")
    wraps, x, y = k % 3 == 0, 100 + 100 * (z % 2) + z % 5, 60 + 20 * (k % 4)
    lines = F.array(
        _line(1, "Winter", 100, 20, 150, 30), _line(2, "Sommer", 200, 20, 250, 30), _line(3, "Mittelspannung", 10, 60, 80, 70),
        _line(4, F.when(wraps, "Umspannung").otherwise("Niederspannung"), 10, 100, 80, 110), _line(5, F.when(wraps, "MS/NS").otherwise("Seite"), 10, F.when(wraps, 112).otherwise(300), 80, F.when(wraps, 122).otherwise(310)),
        _line(6, "07:00", x, y, x + 40, y + 10),
    )
    first, second = _line(0, "", x, y, x + 40, y + 10)["bbox"], _line(0, "", 100, 140, 140, 150)["bbox"]
    level = F.when(k % 2 == 0, "Mittelspannung").when(wraps, "Umspannung MS/NS").otherwise("Niederspannung")
    season = F.element_at(F.array(F.lit("Winter"), F.lit("Sommer"), F.lit("Herbst")), (z % 3 + 1).cast("int"))
    claims = p.select("page", k.alias("value_id"), F.when(k % 5 == 0, F.array(first, second)).otherwise(F.array(first)).alias("places"), level.alias("level_label"), season.alias("season_label"))
    out = geometry.align_cells(claims, p.select("page", F.explode(lines).alias("_l")).select("page", "_l.*"), ["page"])
    return out.select("page", "aligned", F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"))


def _strokes(spark, d) -> DataFrame:
    """An order is a page, its line items are strokes."""
    x0 = (F.col("l_partkey") % 150).cast("double")
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("edge_no"), F.when(F.col("l_returnflag") == "R", "v").otherwise("h").alias("orientation"), x0.alias("x0"), (x0 + 20 + F.col("l_suppkey") % 100).alias("x1"), (F.col("l_quantity").cast("double") / 4).alias("top"))
    return li


def ruling_lines(spark, d):
    return geometry.merge_rules(_strokes(spark, d), ["page"])


def page_layout(spark, d):
    """A customer is a page, an order a line of three columns."""
    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("page"), (20.0 * row).alias("top"), "o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("string").alias("year"))
    cells = [F.struct(F.col(c).alias("text"), F.lit(80.0 * k).alias("x0"), (80 * k + 4.0 * F.length(c)).alias("x1")) for k, c in enumerate(("o_orderstatus", "o_orderpriority", "year"))]
    return geometry.layout_text(o.select("page", "top", F.explode(F.array(*cells)).alias("_c")).select("page", "top", "_c.*"), ["page"])


def _key(prefix: str, c):
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


def provenance_closure(spark, d):
    """Orders come from their load and their customer, these from nations, and nations from a census of their region."""
    o, c, n = _t(spark, d, "orders"), _t(spark, d, "customer"), _t(spark, d, "nation")
    load = _key("load-", F.col("o_orderkey") % 50)
    generated = o.select(_key("o", "o_orderkey").alias("entity"), load.alias("activity")).unionByName(n.select(_key("n", "n_nationkey").alias("entity"), _key("census-", "n_regionkey").alias("activity")))
    used = o.select(load.alias("activity"), _key("n", F.col("o_orderkey") % 50 % 25).alias("entity")).distinct()
    used = used.unionByName(n.select(_key("census-", "n_regionkey").alias("activity"), _key("r", "n_regionkey").alias("entity")).distinct())
    derived = o.select(_key("o", "o_orderkey").alias("entity"), _key("c", "o_custkey").alias("source")).unionByName(c.select(_key("c", "c_custkey").alias("entity"), _key("n", "c_nationkey").alias("source")))
    does = o.select(load.alias("activity"), _key("clerk-", F.col("o_orderkey") % 50 % 7).alias("agent")).distinct()
    does = does.unionByName(n.select(_key("census-", "n_regionkey").alias("activity"), F.lit("bureau").alias("agent")).distinct())
    return lineage.closure(generated.where("entity LIKE 'o%'").select(F.col("entity").alias("node")), generated, used, derived, does)


def event_chains(spark, d):
    """Each event derives from the user's event before it: chains as long as a user's history, from its last event."""
    e = _t(spark, d, "events").select("user_id", F.col("event_id").alias("child"))
    before = Window.partitionBy("user_id").orderBy("child")
    edges = e.withColumn("parent", F.lag("child").over(before))
    last = e.groupBy("user_id").agg(F.max("child").alias("node"))
    found = lineage.ancestors(edges.where("parent IS NOT NULL"), last.select("node"))
    return found.groupBy("origin").agg(F.count(F.lit(1)).alias("events"), F.max("depth").alias("deepest"), F.sum("node").alias("ids"))


#: Codes of the findings, one for each order by its key.
CODES = ("GROUNDING_NOT_FOUND", "GROUNDING_VALUE_MISMATCH", "COVERAGE_GAP", "CROSS_CHECK_DISAGREE", "CROSS_CHECK_DISAGREE", "OVERLAP", "DAILY_CAP_EXCEEDED", "OFF_GRID", "MODEL_ANOMALY")


def finding_verdicts(spark, d):
    """Orders are documents, their line items windows; readings leave some of these out, or are missing."""
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    key, start = F.col("o_orderkey"), F.col("l_linenumber") * 120
    w = F.struct(F.when(F.col("l_returnflag") == "N", "NE5").otherwise("NE7").alias("level"), F.lit("winter").alias("season"), start.cast("int").alias("start_min"), (start + 60).cast("int").alias("end_min"))
    items = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("p"), w.alias("w"))).alias("_i"))
    docs = o.join(items, "o_orderkey", "left").withColumn("_i", F.coalesce("_i", F.array().cast(items.schema["_i"].dataType)))
    empties = F.when(key % 2 == 0, F.array(F.struct(F.lit("NE7").alias("level"), F.lit("winter").alias("season")))).otherwise(F.array().cast("array<struct<level:string,season:string>>"))
    reading = lambda keeps: F.struct(F.transform(F.filter("_i", keeps), lambda x: x["w"]).alias("windows"), empties.alias("empties"))
    left_out = lambda i: lambda x: (x["p"] + i * F.col("o_custkey")) % 3 > 0
    resamples = [F.when((key + i) % 6 > 0, reading(left_out(i))) for i in range(5)]
    readings = docs.select(
        key.alias("document_id"), reading(lambda x: F.lit(True)).alias("text"), F.when(key % 5 > 0, reading(lambda x: x["p"] % 3 > 0)).alias("vision"),
        F.when(key % 7 > 0, reading(lambda x: (x["p"] + F.when(key % 11 < 5, 0).otherwise(key)) % 3 > 0)).alias("swap"), F.array(*resamples).alias("resamples"), (key % 4 == 0).alias("confounded"),
    )
    code = F.element_at(F.array(*map(F.lit, CODES)), (key % len(CODES) + 1).cast("int"))
    window = (F.col("o_custkey") % 3 == 0) & (code != "CROSS_CHECK_DISAGREE")
    findings = o.select(
        key.alias("document_id"), key.alias("iid"), code.alias("code"), F.when(key % 3 > 0, "source_document").otherwise("extract").alias("suspected_stage"), F.when(window, "window").otherwise("cell").alias("target_kind"),
        F.when(F.col("o_custkey") % 2 == 0, "NE5").otherwise("NE7").alias("level"), F.lit("winter").alias("season"), F.when(window, 120).alias("start_min"), F.when(window, 180).alias("end_min"),
    )
    out = routing.attribute(findings, readings)
    figures = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "valid", "persisted")]
    return out.select("document_id", "code", "route", "stage", "confidence", "method", "consensus", *figures, F.round("p_hat", 6).alias("p_hat"), "suggestion")


def consensus_revisions(spark, d):
    """An order's window is corrected to what two readings agree on, where that is printed: the windows that hold then."""
    k, a = F.col("o_orderkey"), F.col("o_custkey") % 10 * 60
    o = _t(spark, d, "orders")
    one = lambda s, e: F.struct(s.cast("int").alias("start_min"), e.cast("int").alias("end_min"))
    old, longer, far = one(a, a + 120), one(a, a + 180), one(a + 720, a + 780)
    pick = F.col("o_custkey") % 4
    suggested = F.when(pick == 0, F.array().cast(routing.CELL)).when(pick == 1, F.array(longer)).when(pick == 2, F.array(far)).otherwise(F.array(old, far))
    cell = [k.alias("document_id"), F.lit("NE5").alias("level"), F.lit("winter").alias("season")]
    found = o.select(*cell, k.alias("iid"), F.lit("CROSS_CHECK_DISAGREE").alias("code"), F.lit("cell").alias("target_kind"), (k % 13 > 0).alias("consensus"), F.when(k % 2 == 0, "parse").otherwise("extract").alias("stage"), suggested.alias("suggested"))
    values = found.select("document_id", "level", "season", F.explode("suggested").alias("_w")).select("document_id", "level", "season", "_w.*")
    b = F.col("document_id") % 5
    proof = lambda channel, there, aligned: values.where(there).withColumns({"channel": F.lit(channel), "page": F.lit(1), "quote": F.lit("q"), "found": F.lit(True), "consistent": F.lit(None).cast("boolean"), "aligned": aligned})
    printed = proof("vision", b < 4, b != 3).unionByName(proof("swap", b >= 2, F.lit(None).cast("boolean")))
    windows = o.select(*cell, _key("w", "o_orderkey").alias("entity"), a.cast("int").alias("start_min"), (a + 120).cast("int").alias("end_min"), F.lit(1).alias("revision"), F.lit("needs-review").alias("status"))
    new, _, _ = routing.correct(windows, routing.decide_corrections(found, printed))
    all_ = windows.unionByName(new.select(*windows.columns)).withColumn("_base", revisions.base_entity(F.col("entity")))
    now = revisions.current(all_, ["_base"])
    return now.select("document_id", "entity", "start_min", "end_min", "revision", "status")


QUERIES = [cell_geometry, ruling_lines, page_layout, provenance_closure, event_chains, finding_verdicts, consensus_revisions]


def sql() -> dict[str, str]:
    out = {}
    out["cell_geometry"] = """WITH p AS (SELECT p_partkey AS page, p_partkey AS k, p_size AS z, p_partkey % 3 = 0 AS wraps, 100 + 100 * (p_size % 2) + p_size % 5 AS x, 60 + 20 * (p_partkey % 4) AS y FROM part),
lines AS (SELECT page, 'Winter' AS t, 100.0 AS x0, 20.0 AS y0, 150.0 AS x1, 30.0 AS y1, NULL AS lv FROM p UNION ALL SELECT page, 'Sommer', 200, 20, 250, 30, NULL FROM p UNION ALL SELECT page, 'Mittelspannung', 10, 60, 80, 70, 'NE5' FROM p
UNION ALL SELECT page, CASE WHEN wraps THEN 'Umspannung' ELSE 'Niederspannung' END, 10, 100, 80, 110, CASE WHEN NOT wraps THEN 'NE7' END FROM p UNION ALL SELECT page, 'MS/NS', 10, 112, 80, 122, 'NE6' FROM p WHERE wraps),
asked AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'Mittelspannung' WHEN wraps THEN 'Umspannung MS/NS' ELSE 'Niederspannung' END AS level, ['Winter', 'Sommer', 'Herbst'][z % 3 + 1] AS season, CASE WHEN k % 2 = 0 THEN 'NE5' WHEN wraps THEN 'NE6' ELSE 'NE7' END AS claimed FROM p),
places AS (SELECT page, 0 AS i, x::DOUBLE AS x0, y::DOUBLE AS y0, x + 40.0 AS x1, y + 10.0 AS y1 FROM p UNION ALL SELECT page, 1, 100, 140, 140, 150 FROM p WHERE k % 5 = 0),
hit AS (SELECT page, t AS label, x0, y0, x1, y1 FROM lines UNION ALL SELECT page, 'Umspannung MS/NS', 10, 100, 80, 122 FROM p WHERE wraps),
near AS (SELECT q.page, q.i, min({'far': abs((b.y0 + b.y1) / 2 - (q.y0 + q.y1) / 2), 'lv': b.lv}) AS best, bool_and(b.lv = a.claimed) AS alone
  FROM places q JOIN asked a USING (page) JOIN (SELECT page, label, y0, y1, x1, NULL AS lv FROM hit WHERE false UNION ALL SELECT h.page, h.label, h.y0, h.y1, h.x1, a2.claimed FROM hit h JOIN asked a2 ON a2.page = h.page AND a2.level = h.label
    UNION ALL SELECT l.page, NULL, l.y0, l.y1, l.x1, l.lv FROM lines l WHERE l.lv IS NOT NULL) b ON b.page = q.page WHERE b.y0 <= q.y1 AND b.x1 <= q.x0 + 1 GROUP BY 1, 2),
judged AS (SELECT a.page, q.i, q.x0, q.y0, (CASE WHEN n.alone AND n.best.far >= 20 THEN
      EXISTS (SELECT 1 FROM hit h WHERE h.page = a.page AND h.label = a.level AND abs((h.y0 + h.y1) / 2 - (q.y0 + q.y1) / 2) < 4) OR coalesce(q.y0 - (SELECT max(h.y0) FROM hit h WHERE h.page = a.page AND h.label = a.level AND h.y0 <= q.y0 + 2) < 60, false)
    ELSE n.best.lv = a.claimed END) AND EXISTS (SELECT 1 FROM hit h WHERE h.page = a.page AND h.label = a.season AND least(h.x1, q.x1) - greatest(h.x0, q.x0) > 2 AND h.y0 < q.y0) AS good,
    EXISTS (SELECT 1 FROM hit h WHERE h.page = a.page AND h.label = a.season) AND EXISTS (SELECT 1 FROM hit h WHERE h.page = a.page AND h.label IN ('Winter', 'Sommer') AND h.label <> a.season AND least(h.x1, q.x1) - greatest(h.x0, q.x0) > 2) AS bad
  FROM asked a JOIN places q USING (page) JOIN near n ON n.page = q.page AND n.i = q.i)
SELECT page, CASE WHEN bool_or(good) THEN true WHEN bool_and(bad) THEN false END AS aligned, coalesce(arg_min(x0, i) FILTER (good), arg_min(x0, i)) AS x0, coalesce(arg_min(y0, i) FILTER (good), arg_min(y0, i)) AS y0 FROM judged GROUP BY page"""
    out["ruling_lines"] = """WITH RECURSIVE e AS (SELECT l_orderkey AS page, (l_partkey % 150)::DOUBLE AS x0, (l_partkey % 150)::DOUBLE + 20 + l_suppkey % 100 AS x1, l_quantity::DOUBLE / 4 AS top, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'R'),
s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top, n, x0, x1) AS r FROM e WHERE x1 - x0 >= 40),
m(page, r, no, y, x0, x1, last) AS (SELECT page, r, 0, top, x0, x1, top FROM s WHERE r = 1
UNION ALL SELECT s.page, s.r, CASE WHEN t THEN m.no ELSE m.no + 1 END, CASE WHEN t THEN m.y ELSE s.top END, CASE WHEN t THEN least(m.x0, s.x0) ELSE s.x0 END, CASE WHEN t THEN greatest(m.x1, s.x1) ELSE s.x1 END, s.top
  FROM m JOIN s ON s.page = m.page AND s.r = m.r + 1, LATERAL (SELECT s.top - m.last <= 2 AND s.x0 <= m.x1 + 1 AND s.x1 >= m.x0 - 1 AS t))
SELECT page, no AS rule_no, arg_max(y, r) AS y, arg_max(x0, r) AS x0, arg_max(x1, r) AS x1 FROM m GROUP BY page, no"""
    out["page_layout"] = """SELECT o_custkey AS page, string_agg(rpad(o_orderstatus, 20, ' ') || rpad(o_orderpriority, 20, ' ') || year(o_orderdate)::VARCHAR, chr(10) || chr(10) ORDER BY o_orderkey) AS layout FROM orders GROUP BY 1"""
    out["provenance_closure"] = """WITH RECURSIVE e(ck, c, pk, p) AS (
SELECT 'entity', 'o' || o_orderkey, 'activity', 'load-' || o_orderkey % 50 FROM orders UNION SELECT 'entity', 'n' || n_nationkey, 'activity', 'census-' || n_regionkey FROM nation
UNION SELECT 'activity', 'load-' || o_orderkey % 50, 'entity', 'n' || o_orderkey % 50 % 25 FROM orders UNION SELECT 'activity', 'census-' || n_regionkey, 'entity', 'r' || n_regionkey FROM nation
UNION SELECT 'entity', 'o' || o_orderkey, 'entity', 'c' || o_custkey FROM orders UNION SELECT 'entity', 'c' || c_custkey, 'entity', 'n' || c_nationkey FROM customer),
w(origin, kind, id, depth) AS (SELECT 'o' || o_orderkey, 'entity', 'o' || o_orderkey, 0 FROM orders UNION SELECT origin, pk, p, depth + 1 FROM w JOIN e ON ck = kind AND c = id),
a AS (SELECT DISTINCT 'load-' || o_orderkey % 50 AS activity, 'clerk-' || o_orderkey % 50 % 7 AS agent FROM orders UNION SELECT 'census-' || n_regionkey, 'bureau' FROM nation)
SELECT origin, kind, id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2, 3 UNION ALL SELECT origin, 'agent', agent, CAST(min(depth) + 1 AS INTEGER) FROM w JOIN a ON kind = 'activity' AND id = activity GROUP BY 1, 3"""
    out["event_chains"] = "SELECT max(event_id) AS origin, count(*) AS events, CAST(count(*) - 1 AS INTEGER) AS deepest, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY user_id"
    kinds = ["(l_partkey + {0} * o_custkey) % 3 > 0".format(i) for i in range(5)]
    there = [f"(o_orderkey + {i}) % 6 > 0" for i in range(5)]
    kinds += ["true", "l_partkey % 3 > 0", "(l_partkey + CASE WHEN o_orderkey % 11 < 5 THEN 0 ELSE o_orderkey END) % 3 > 0"]
    there += ["true", "o_orderkey % 5 > 0", "o_orderkey % 7 > 0"]
    told = "lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':00-' || lpad(CAST(s // 60 + 1 AS VARCHAR), 2, '0') || ':00'"
    codes = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
    each = " UNION ALL ".join(f"SELECT k, {i} AS i, {g} AS there, (SELECT coalesce(string_agg(DISTINCT {told}, ', ' ORDER BY {told}), '(empty)') FROM items WHERE items.k = f.k AND items.level = f.level AND {w}) AS cell, EXISTS (SELECT 1 FROM items WHERE items.k = f.k AND items.level = f.level AND s = 120 AND {w}) AS has FROM f" for i, (w, g) in enumerate(zip(kinds, there, strict=True)))
    each = each.replace("o_orderkey", "f.k").replace("o_custkey", "f.c")
    out["finding_verdicts"] = f"""WITH f AS (SELECT o_orderkey AS k, o_custkey AS c, {codes}[o_orderkey % {len(CODES)} + 1] AS code, o_orderkey % 3 > 0 AS sourced, CASE WHEN o_custkey % 2 = 0 THEN 'NE5' ELSE 'NE7' END AS level, o_custkey % 3 = 0 AS win, o_orderkey % 4 = 0 AS confounded FROM orders),
items AS (SELECT l_orderkey AS k, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'NE5' ELSE 'NE7' END AS level, l_linenumber * 120 AS s FROM lineitem),
r AS ({each}),
g AS (SELECT f.*, code = 'CROSS_CHECK_DISAGREE' AS xcode, win AND code <> 'CROSS_CHECK_DISAGREE' AS window_, t.cell AS t, CASE WHEN v.there THEN v.cell END AS v, CASE WHEN o.there THEN o.cell END AS o, o.has AS o_has FROM f JOIN r t ON t.k = f.k AND t.i = 5 JOIN r v ON v.k = f.k AND v.i = 6 JOIN r o ON o.k = f.k AND o.i = 7),
h AS (SELECT *, code = 'COVERAGE_GAP' AND NOT window_ AS gap, k % 2 = 0 AND level = 'NE7' AS says_empty FROM g),
s AS (SELECT h.k, r.i, r.cell, CASE WHEN gap THEN CASE WHEN r.cell <> '(empty)' THEN 'windows ' || r.cell WHEN says_empty THEN 'an explicit empty cell' ELSE 'nothing (missing)' END ELSE r.cell END AS said,
  CASE WHEN window_ THEN r.has WHEN gap THEN r.cell = '(empty)' AND NOT says_empty ELSE r.cell = t END AS shows, r.there FROM h JOIN r ON r.k = h.k AND r.i < 5),
n AS (SELECT k, count(*) AS n, count(*) FILTER (there) AS valid, count(*) FILTER (there AND shows) AS persisted FROM s GROUP BY k),
m AS (SELECT k, arg_max(cell, (c, -first)) AS modal, max(c) AS modal_n FROM (SELECT k, cell, count(*) AS c, min(i) AS first FROM s WHERE there GROUP BY k, cell) GROUP BY k),
sm AS (SELECT k, arg_max(said, (c, -first)) AS said, max(c) AS said_n FROM (SELECT k, said, count(*) AS c, min(i) AS first FROM s WHERE there GROUP BY k, said) GROUP BY k),
j AS (SELECT h.*, n, valid, persisted, persisted / valid AS p, modal, modal_n, said, said_n, 2 * valid >= n AS quorum, (persisted / valid + 3.8416 / (2 * valid) - 1.96 * sqrt(persisted / valid * (1 - persisted / valid) / valid + 3.8416 / (4 * valid * valid))) / (1 + 3.8416 / valid) AS lo,
  (persisted / valid + 3.8416 / (2 * valid) + 1.96 * sqrt(persisted / valid * (1 - persisted / valid) / valid + 3.8416 / (4 * valid * valid))) / (1 + 3.8416 / valid) AS hi,
  CASE WHEN window_ THEN NOT o_has WHEN gap THEN NOT (o = '(empty)' AND NOT says_empty) ELSE o <> t END AS gone, xcode AND v IS NOT NULL AS crossed FROM h JOIN n USING (k) LEFT JOIN m USING (k) LEFT JOIN sm USING (k)),
q AS (SELECT *, crossed AND o IS NOT NULL AND NOT confounded AS full_, CASE WHEN (lo > 0.5 OR hi < 0.5) AND quorum THEN 'high' WHEN quorum THEN 'medium' ELSE 'low' END AS sure, modal_n / valid >= 0.6 AS stable FROM j),
x AS (SELECT *, o = v AND o <> t AS agreed, p <= 0.4 AND stable AND modal = v AS settled FROM q),
y AS (SELECT *, CASE WHEN full_ THEN CASE WHEN agreed AND settled THEN 'extract' WHEN agreed THEN 'parse' WHEN o = t AND o <> v THEN 'vision_misread' ELSE 'inconclusive' END
  WHEN p <= 0.4 THEN 'extract' WHEN p < 0.6 OR o IS NULL THEN 'inconclusive' WHEN gone THEN 'parse' WHEN crossed THEN 'vision_misread' ELSE 'source_document' END AS stage FROM x WHERE code IN ('GROUNDING_NOT_FOUND', 'GROUNDING_VALUE_MISMATCH', 'COVERAGE_GAP', 'CROSS_CHECK_DISAGREE'))
SELECT k AS document_id, code, CASE WHEN xcode THEN 'cross_check' ELSE 'resample' END AS route, stage,
  CASE WHEN stage = 'inconclusive' THEN 'low' WHEN full_ AND agreed AND settled THEN CASE WHEN quorum AND hi < 0.5 THEN 'high' ELSE 'medium' END WHEN full_ AND agreed THEN CASE WHEN quorum AND (NOT stable OR p >= 0.6) THEN 'high' ELSE 'medium' END
    WHEN full_ THEN CASE WHEN quorum AND p >= 0.6 THEN 'high' ELSE 'medium' END WHEN stage <> 'extract' AND confounded AND sure = 'high' THEN 'medium' ELSE sure END AS confidence,
  CASE WHEN full_ OR (p >= 0.6 AND o IS NOT NULL) THEN 'resample+swap' ELSE 'resample' END AS method, full_ AND agreed AS consensus, n, valid, persisted, round(p, 6) AS p_hat,
  CASE WHEN full_ THEN CASE WHEN agreed THEN 'OCR and vision read ' || v END WHEN p < 0.6 THEN 'resamples read ' || said || ' (' || said_n || '/' || valid || ')'
    WHEN o IS NOT NULL AND gone THEN 'OCR reading: ' || CASE WHEN gap THEN CASE WHEN o <> '(empty)' THEN 'windows ' || o WHEN says_empty THEN 'an explicit empty cell' ELSE 'nothing (missing)' END ELSE o END END AS suggestion FROM y
UNION ALL SELECT k, code, 'agreement', 'source_document', 'high', 'channel_agreement', false, 0, 0, 0, NULL, NULL FROM h WHERE code IN ('OVERLAP', 'DAILY_CAP_EXCEEDED', 'OFF_GRID') AND sourced AND v = t"""
    out["consensus_revisions"] = """WITH w AS (SELECT o_orderkey AS k, 'w' || o_orderkey AS entity, o_custkey % 10 * 60 AS a, o_custkey % 4 AS pick, o_orderkey % 5 AS b, o_orderkey % 2 = 0 AS parse, o_orderkey % 13 > 0 AS consensus FROM orders),
d AS (SELECT *, consensus AND (pick = 0 OR b < 3 OR parse) AS applied FROM w)
SELECT k AS document_id, entity, CAST(a AS INTEGER) AS start_min, CAST(a + 120 AS INTEGER) AS end_min, 1 AS revision, 'needs-review' AS status FROM d WHERE NOT applied
UNION ALL SELECT k, entity || '@r2', CAST(a AS INTEGER), CAST(a + CASE WHEN pick = 1 THEN 180 ELSE 120 END AS INTEGER), 2, 'auto-corrected' FROM d WHERE applied AND pick IN (1, 3)
UNION ALL SELECT k, 'window/' || k || '/NE5/winter/' || (a + 720) || '/' || (a + 780) || '@auto', CAST(a + 720 AS INTEGER), CAST(a + 780 AS INTEGER), 1, 'auto-corrected' FROM d WHERE applied AND pick IN (2, 3)"""
    return out
