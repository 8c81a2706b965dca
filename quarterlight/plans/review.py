"""Queries on what people are shown: evaluation, tracks, histories, proposals and sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report
from .queries import _t
from .surface import KINDS, VALUES


def _windows(spark, d):
    """Line items as windows of their order: extracted, some an hour too long, and some of these corrected or rejected since."""
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    li = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.concat_ws("/", F.lit("w"), "l_orderkey", F.when(F.col("l_returnflag") == "N", "NE5").otherwise("NE7"), "l_linenumber", "l_partkey").alias("base"), F.when(F.col("l_returnflag") == "N", "NE5").otherwise("NE7").alias("level"), F.lit("winter").alias("season"),
        (n * 120).cast("int").alias("start_min"), p.alias("p"),
    ).distinct()
    long = F.col("p") % 5 == 0
    first = li.withColumns({"entity": F.col("base"), "end_min": F.col("start_min") + F.when(long, 120).otherwise(60), "origin": F.lit("extract"), "revision": F.lit(1), "status": F.when(F.col("p") % 3 == 0, "needs-review").otherwise("auto-ok")})
    again = li.where("p % 10 = 0").withColumns({"entity": F.concat("base", F.lit("@r2")), "end_min": F.col("start_min") + 60, "origin": F.lit("auto"), "revision": F.lit(2), "status": F.when(F.col("p") % 20 == 0, "rejected").otherwise("auto-corrected")})
    return first.unionByName(again).withColumn("end_min", F.col("end_min").cast("int"))


def document_evaluation(spark, d):
    o, w = _t(spark, d, "orders"), _windows(spark, d)
    key = F.col("o_orderkey")
    one = F.struct("start_min", (F.col("start_min") + 60).cast("int").alias("end_min"))
    gold = w.where("revision = 1").groupBy("document_id", "level", "season").agg(F.array_distinct(F.collect_list(F.when(F.col("p") % 7 > 0, one))).alias("windows"))
    issues = w.where("revision = 1 AND p % 11 = 0").select("document_id", "level", "season", F.lit("warning").alias("severity"), F.when(F.col("p") % 2 == 0, 2).otherwise(0).alias("resolved"))
    rule = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    rules = lambda *of: o.select(key.alias("document_id"), F.explode(F.array(*of)).alias("_r")).select("document_id", "_r.*")
    calls = o.select(key.alias("document_id"), F.explode(F.sequence(F.lit(0), F.col("o_custkey").cast("int") % 4)).alias("i"), "o_custkey").select("document_id", (F.col("i") % 2).alias("key"), (F.col("i") + 0.5).alias("cost_usd"), (F.col("i") * 100).alias("latency_ms"), F.when(F.col("o_custkey") % 2 == 0, "live").otherwise("cache").alias("source"))
    docs = o.select(key.alias("document_id"), F.lit("a").alias("labeled_by"), F.when(key % 2 == 0, "assumed").otherwise("interval_start").alias("convention"), F.when(key % 3 > 0, "assumed").alias("gold_convention"))
    out = report.evaluate_documents(gold, w, issues, rules(rule("min_kw_diff", F.lit("100")), rule("bridge_days", F.lit('"off_peak"'))), rules(rule("min_kw_diff", F.when(key % 4 == 0, "100.0").otherwise("50"))), calls, docs)
    shares = ("precision", "recall", "raw_precision", "raw_recall", "review_share", "rules_recall")
    return out.withColumns({c: F.round(c, 6) for c in shares})


def edit_proposals(spark, d):
    """Windows against readings of their cell that an open verdict proposes."""
    w = _windows(spark, d).where("revision = 1")
    one = F.struct("start_min", (F.col("start_min") + F.when(F.col("p") % 4 == 0, 60).when(F.col("p") % 4 == 1, 180).otherwise(120)).cast("int").alias("end_min"))
    verdicts = w.where("document_id % 3 > 0").groupBy("document_id", "level", "season").agg(F.collect_set(one).alias("suggested"))
    verdicts = verdicts.withColumns({"iid": F.lit(1), "resolved": (F.col("document_id") % 5 == 0).cast("int"), "stage": F.when(F.col("document_id") % 2 == 0, "parse").otherwise("extract")})
    return report.edit_proposals(w.select("document_id", "entity", *report.KEY), verdicts)


def rule_sentences(spark, d):
    p = _t(spark, d, "part")
    pick = lambda of, n: F.element_at(F.array(*map(F.lit, of)), (n % len(of) + 1).cast("int"))
    fine = [v for v in VALUES if v not in ('{"states": [', "oops")]
    rules = p.select(pick(KINDS, F.col("p_partkey")).alias("kind"), pick(fine, F.col("p_size") + F.col("p_partkey").cast("int") % 7).alias("value"))
    return rules.withColumn("sentence", report.rule_sentence(F.col("kind"), F.col("value"))).groupBy("kind", "value", "sentence").agg(F.count(F.lit(1)).alias("n"))


QUERIES = [document_evaluation, edit_proposals, rule_sentences]


def sql() -> dict[str, str]:
    out = {}
    w = """li AS (SELECT DISTINCT l_orderkey AS k, CASE WHEN l_returnflag = 'N' THEN 'NE5' ELSE 'NE7' END AS level, l_linenumber * 120 AS a, l_partkey AS p, 'w/' || l_orderkey || '/' || CASE WHEN l_returnflag = 'N' THEN 'NE5' ELSE 'NE7' END || '/' || l_linenumber || '/' || l_partkey AS base FROM lineitem)"""
    # The last revision: rejected for a twentieth of the parts, corrected for another; else as extracted.
    out["document_evaluation"] = f"""WITH {w}, last AS (SELECT *, a + CASE WHEN p % 5 = 0 AND p % 10 > 0 THEN 120 ELSE 60 END AS b, p % 3 = 0 AND p % 10 > 0 AS review FROM li WHERE p % 20 > 0),
pred AS (SELECT k, level, a, b, bool_or(review) AS flagged FROM last GROUP BY ALL), gold AS (SELECT DISTINCT k, level, a, a + 60 AS b FROM li WHERE p % 7 > 0), raw AS (SELECT DISTINCT k, level, a, a + CASE WHEN p % 5 = 0 THEN 120 ELSE 60 END AS b FROM li),
doubt AS (SELECT DISTINCT k, level FROM li WHERE p % 11 = 0 AND p % 2 = 1), cells AS (SELECT DISTINCT k, level FROM li),
v AS (SELECT coalesce(pred.k, gold.k) AS k, coalesce(pred.level, gold.level) AS level, pred.k IS NOT NULL AS is_pred, gold.k IS NOT NULL AS is_gold, coalesce(flagged, false) AS flagged FROM pred FULL JOIN gold ON pred.k = gold.k AND pred.level = gold.level AND pred.a = gold.a AND pred.b = gold.b),
c AS (SELECT k, count(*) FILTER (is_gold) AS windows_gold, count(*) FILTER (is_pred) AS windows_pred, count(*) FILTER (is_pred AND is_gold) AS tp, count(*) FILTER (flagged) AS fl, count(*) FILTER (is_pred AND NOT is_gold) AS wrong, count(*) FILTER (is_pred AND NOT is_gold AND flagged) AS wrong_flagged,
  count(*) FILTER (is_gold AND NOT is_pred) AS missed, count(*) FILTER (is_gold AND NOT is_pred AND doubt.k IS NOT NULL) AS missed_flagged FROM v LEFT JOIN doubt USING (k, level) GROUP BY k),
r AS (SELECT raw.k, count(*) AS n, count(gold.k) AS tp FROM raw LEFT JOIN gold ON raw.k = gold.k AND raw.level = gold.level AND raw.a = gold.a AND raw.b = gold.b GROUP BY raw.k),
e AS (SELECT cells.k, count(*) AS cells, count(*) FILTER (u.k IS NULL) AS exact FROM cells LEFT JOIN (SELECT DISTINCT k, level FROM v WHERE is_pred <> is_gold) u USING (k, level) GROUP BY cells.k),
auto AS (SELECT k, count(DISTINCT base) AS n FROM li WHERE p % 10 = 0 GROUP BY k)
SELECT o_orderkey AS document_id, 'a' AS labeled_by, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 2 = 0 END AS convention_ok, coalesce(windows_gold, 0) AS windows_gold, coalesce(windows_pred, 0) AS windows_pred, coalesce(wrong, 0) AS wrong, coalesce(wrong_flagged, 0) AS wrong_flagged, coalesce(missed, 0) AS missed, coalesce(missed_flagged, 0) AS missed_flagged,
  coalesce(cells, 0) AS cells, coalesce(exact, 0) AS cells_exact, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 0.0 END AS rules_recall, CAST(CASE WHEN o_custkey % 4 > 0 THEN 2 ELSE 1 END AS BIGINT) AS llm_calls, [0.5, 2.0, 4.0, 6.0][o_custkey % 4 + 1] AS cost_usd, [0.0, 0.1, 0.3, 0.5][o_custkey % 4 + 1] AS latency_s,
  CASE WHEN o_custkey % 2 = 0 THEN 'live' ELSE 'cache' END AS response_source, coalesce(auto.n, 0) AS auto_corrected, round(CASE WHEN windows_pred > 0 THEN c.tp / windows_pred ELSE 0 END, 6) AS precision, round(CASE WHEN windows_gold > 0 THEN c.tp / windows_gold WHEN coalesce(windows_pred, 0) = 0 THEN 1 ELSE 0 END, 6) AS recall,
  round(CASE WHEN r.n > 0 THEN r.tp / r.n ELSE 0 END, 6) AS raw_precision, round(CASE WHEN windows_gold > 0 THEN r.tp / windows_gold WHEN coalesce(r.n, 0) = 0 THEN 1 ELSE 0 END, 6) AS raw_recall, round(CASE WHEN windows_pred > 0 THEN fl / windows_pred ELSE 0 END, 6) AS review_share
FROM orders LEFT JOIN c ON c.k = o_orderkey LEFT JOIN r ON r.k = o_orderkey LEFT JOIN e ON e.k = o_orderkey LEFT JOIN auto ON auto.k = o_orderkey"""
    out["edit_proposals"] = f"""WITH {w}, x AS (SELECT *, a + CASE WHEN p % 5 = 0 THEN 120 ELSE 60 END AS b FROM li),
s AS (SELECT DISTINCT k, level, a, a + CASE p % 4 WHEN 0 THEN 60 WHEN 1 THEN 180 ELSE 120 END AS b FROM li WHERE k % 3 > 0 AND k % 5 > 0),
f AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.k = s.k AND x.level = s.level AND x.a = s.a AND x.b = s.b)),
m AS (SELECT x.k, x.base, x.level, x.a, x.b, count(*) AS n, min(f.a) AS na, min(f.b) AS nb FROM x JOIN f ON f.k = x.k AND f.level = x.level AND (f.a = x.a OR f.b = x.b OR (f.a < x.b AND x.a < f.b)) GROUP BY ALL)
SELECT DISTINCT m.k AS document_id, m.base AS entity, CAST(na AS INTEGER) AS start_min, CAST(nb AS INTEGER) AS end_min, CASE WHEN m.k % 2 = 0 THEN 'OCR reading' ELSE 'majority of resamples' END AS source FROM m
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.k = m.k AND s.level = m.level AND s.a = m.a AND s.b = m.b)"""
    fine = ", ".join("'" + v.replace("'", "''") + "'" for v in VALUES if v not in ('{"states": [', "oops"))
    n = len(VALUES) - 2
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    out["rule_sentences"] = f"""WITH r AS (SELECT [{kinds}][p_partkey % {len(KINDS)} + 1] AS kind, [{fine}][(p_size + p_partkey % 7) % {n} + 1] AS value FROM part), b AS (SELECT *, CASE WHEN value LIKE '"%' THEN value::JSON->>'$' ELSE value END AS bare FROM r),
t AS (SELECT *, CASE WHEN kind = 'workdays_only' THEN CASE WHEN bare = 'true' THEN 'Monday to Friday only' ELSE 'every day' END WHEN kind = 'bridge_days' AND bare = 'working_day' THEN 'count as working days'
  WHEN kind = 'holiday_handling' AND value LIKE '%"BW"%' THEN 'public holidays in by and BW' WHEN kind = 'holiday_handling' AND value LIKE '%"by"%' THEN 'public holidays in by' WHEN kind = 'holiday_handling' AND value LIKE '{{%' THEN 'public holidays in unspecified states'
  WHEN kind = 'christmas_period' AND value LIKE '%from%' THEN '24.12. to 01.01. off-peak' WHEN kind = 'christmas_period' AND value LIKE '{{%' THEN 'between Christmas and New Year, dates not stated' WHEN kind = 'de_minimis_eur' THEN bare || ' €' ELSE bare END AS sentence FROM b)
SELECT kind, value, sentence, count(*) AS n FROM t GROUP BY ALL"""
    return out
