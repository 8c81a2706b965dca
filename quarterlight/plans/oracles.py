"""The catalogue's queries as SQL for another engine. Holidays are listed from a calendar of its own."""

from __future__ import annotations

from datetime import date, timedelta

SEASON = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'winter' WHEN month({0}) <= 5 THEN 'spring' WHEN month({0}) <= 8 THEN 'summer' ELSE 'autumn' END"
QUARTER = "time_bucket(INTERVAL 15 MINUTE, ts)"
STAMP = "%Y-%m-%d %H:%M"
WINDOWS = "(VALUES ('w1', 'winter', 465, 540), ('w2', 'winter', 990, 1185), ('w3', 'spring', 1005, 1125)) w(window_id, season, a, b)"


def _easter(y: int) -> date:
    a, b, c = y % 19, y // 100, y % 100
    d = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7
    f = d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114
    return date(y, f // 31, f % 31 + 1)


def _holidays(first: int, last: int, both: bool) -> str:
    """Of Bavaria or Baden-Württemberg (or both, without Assumption Day, which Bavaria leaves to its towns)."""
    rows = []
    for y in range(first, last + 1):
        at = lambda n: _easter(y) + timedelta(n)  # noqa: B023, E731
        days = [(date(y, 1, 1), "Neujahr"), (date(y, 1, 6), "Heilige Drei Könige"), (at(-2), "Karfreitag"), (at(1), "Ostermontag"), (date(y, 5, 1), "Erster Mai"), (at(39), "Christi Himmelfahrt"), (at(50), "Pfingstmontag"), (at(60), "Fronleichnam"), (date(y, 10, 3), "Tag der Deutschen Einheit"), (date(y, 11, 1), "Allerheiligen"), (date(y, 12, 25), "Erster Weihnachtstag"), (date(y, 12, 26), "Zweiter Weihnachtstag")]
        if y == 2017:
            days.append((date(y, 10, 31), "Reformationstag"))
        rows += [(d, n, True) for d, n in days]
        if not both:
            rows.append((date(y, 8, 15), "Mariä Himmelfahrt", False))
    # Two holidays on a day are one.
    seen = {}
    for d, n, sure in rows:
        seen.setdefault(d, (n, sure))
    return ", ".join(f"(DATE '{d}', '{n}', {sure})" for d, (n, sure) in seen.items())


def _classes(days: str, first: int, last: int, both: bool) -> str:
    """days(date) with day_type and off_peak."""
    bridge = "false" if both else "true"
    return f"""
h(hd, name, sure) AS (VALUES {_holidays(first, last, both)}),
near AS (SELECT d.date, d.n, h.sure,
  EXISTS (SELECT 1 FROM h x WHERE x.sure AND x.hd = d.date + 1 AND year(x.hd) = year(d.date)) AS nxt,
  EXISTS (SELECT 1 FROM h x WHERE x.sure AND x.hd = d.date - 1 AND year(x.hd) = year(d.date)) AS prv
  FROM {days} d LEFT JOIN h ON h.hd = d.date),
classes AS (SELECT date, n,
  CASE WHEN isodow(date) >= 6 THEN 'weekend' WHEN sure THEN 'holiday' WHEN strftime(date, '%m-%d') >= '12-24' OR strftime(date, '%m-%d') <= '01-01' THEN 'christmas'
    WHEN NOT sure THEN 'holiday' WHEN (isodow(date) = 1 AND nxt) OR (isodow(date) = 5 AND prv) THEN 'bridge' ELSE 'workday' END AS day_type,
  CASE WHEN isodow(date) >= 6 OR sure OR strftime(date, '%m-%d') >= '12-24' OR strftime(date, '%m-%d') <= '01-01' THEN true
    WHEN NOT sure THEN NULL WHEN (isodow(date) = 1 AND nxt) OR (isodow(date) = 5 AND prv) THEN {bridge} ELSE false END AS off_peak
  FROM near)"""


def _day_classes(both: bool) -> str:
    return f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1), {_classes("d", 1994, 2003, both)}
SELECT day_type, off_peak, CAST(sum(n) AS BIGINT) AS n, count(*) AS days FROM classes GROUP BY 1, 2"""


LOCAL = "timezone('Europe/Berlin', timezone('UTC', {0}))"
SPANS = """spans AS (SELECT user_id AS document_id, event_type AS level, strftime(ts, '%Y-%m-%d') AS season,
  hour(ts) * 60 + minute(ts) - minute(ts) % 15 AS a, hour(ts) * 60 + minute(ts) - minute(ts) % 15 + 15 * (1 + CAST(floor(abs(value)) AS BIGINT) % 8) AS b FROM events)"""
REVIEW = """w AS (SELECT doc_id AS document_id, CASE WHEN quality = 1 THEN 'verified' WHEN toxic = 1 THEN 'needs-review' ELSE 'auto-ok' END AS status FROM labels),
i AS (SELECT doc_id AS document_id, CASE WHEN toxic = 1 THEN 'error' WHEN doc_id % 3 = 0 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN doc_id % 2 = 0 THEN 'extract' ELSE 'source_document' END AS stage, CASE WHEN doc_id % 5 = 0 THEN 'x' END AS target
  FROM labels WHERE (quality = 0 OR toxic = 1) AND doc_id % 4 <> 0)"""
EDGES = """e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""
DASHES = "‐‑‒–—―−⁃﹘﹣－"


def _membership(convention: str, both: bool, source: str) -> str:
    """source(start_utc, ...) with season, day_type, inside and off_peak; inside is null where only the open part holds it."""
    early = 15 if convention == "interval_end_labels" else 0
    open_ = 15 if convention in ("interval_end_labels", "interval_end_ambiguous") else 0
    return f"""q AS (SELECT *, {LOCAL.format("start_utc")} AS l FROM {source}),
q2 AS (SELECT *, hour(l) * 60 + minute(l) AS m, {SEASON.format("l")} AS season FROM q),
days AS (SELECT DISTINCT CAST(l AS DATE) AS date, 1 AS n FROM q2), {_classes("days", 2023, 2027, both)},
hit AS (SELECT q2.start_utc, min_by(window_id, a) AS hit FROM (SELECT DISTINCT start_utc, m, season FROM q2) q2 JOIN {WINDOWS} ON w.season = q2.season AND a - {early} <= m AND m + 15 <= b GROUP BY 1),
edge AS (SELECT q2.start_utc, max_by(window_id, a) AS edge FROM (SELECT DISTINCT start_utc, m, season FROM q2) q2 JOIN {WINDOWS} ON w.season = q2.season AND a - {open_} <= m AND m < a - {early} GROUP BY 1),
answers AS (SELECT q2.*, day_type, coalesce(hit, edge) AS window_id,
  CASE WHEN hit IS NOT NULL THEN true WHEN edge IS NOT NULL THEN NULL ELSE false END AND NOT off_peak AS flag
  FROM q2 LEFT JOIN hit USING (start_utc) LEFT JOIN edge USING (start_utc) JOIN classes ON classes.date = CAST(l AS DATE))"""


ANSWER = "CASE WHEN flag THEN 'true' WHEN NOT flag THEN 'false' ELSE 'uncertain' END"


def sql() -> dict[str, str]:
    out = {}
    out["quarter_hour_counts"] = f"SELECT strftime({QUARTER}, '{STAMP}') AS quarter, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"
    out["season_rollup"] = f"SELECT {SEASON.format('o_orderdate')} AS season, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1, 2"
    out["day_classes"], out["day_classes_intersection"] = _day_classes(False), _day_classes(True)
    src = f"(SELECT event_id, event_type, {QUARTER} AS start_utc FROM events)"
    out["window_membership"] = f"WITH {_membership('assumed', True, src)} SELECT event_id, event_type, season, day_type, {ANSWER} AS answer, window_id FROM answers"
    parts = []
    for c in ("interval_start", "interval_end_physical", "interval_end_ambiguous", "interval_end_labels", "assumed"):
        src = f"(SELECT {QUARTER} AS start_utc FROM events)"
        parts.append(f"SELECT * FROM (WITH {_membership(c, False, src)} SELECT '{c}' AS convention, {ANSWER} AS answer, count(*) AS n FROM answers GROUP BY 2)")
    out["membership_conventions"] = " UNION ALL ".join(parts)
    grid = "(SELECT unnest(generate_series(TIMESTAMP '2025-12-31 23:00:00', TIMESTAMP '2026-12-31 22:45:00', INTERVAL 15 MINUTE)) AS start_utc)"
    out["year_mask"] = f"WITH {_membership('interval_end_ambiguous', True, grid)} SELECT strftime(start_utc, '{STAMP}') AS start_utc, strftime(l, '{STAMP}') AS start_local, CASE {ANSWER} WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE 'uncertain' END AS flag, season, day_type, window_id FROM answers"
    out["dst_days"] = f"SELECT strftime(l, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT {LOCAL.format('t')} AS l FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 23:00:00', TIMESTAMP '2026-12-31 22:45:00', INTERVAL 15 MINUTE)) AS t)) GROUP BY 1 HAVING count(*) <> 96"
    out["latest_version"] = """SELECT o_custkey, year, publication_date, document_id, synthetic FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, year ORDER BY synthetic, publication_date DESC, document_id DESC) AS r
FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m-%d') AS publication_date, o_orderkey AS document_id, o_orderstatus = 'P' AS synthetic FROM orders)) WHERE r = 1"""
    cells = "SELECT o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(count(*) // 4 AS INTEGER) AS v FROM orders WHERE year(o_orderdate) = {0} GROUP BY 1, 2"
    out["snapshot_diff"] = f"""SELECT o_orderpriority, month, a.v AS before, b.v AS after, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'changed' END AS change
FROM ({cells.format(1995)}) a FULL JOIN ({cells.format(1996)}) b USING (o_orderpriority, month)"""
    out["version_drift"] = """SELECT document_id, CASE WHEN year = old_year THEN 'SUPERSEDES' ELSE 'YOY_DRIFT' END AS code, CAST(old AS VARCHAR) AS target FROM
(SELECT o_orderkey AS document_id, year(o_orderdate) AS year, o_orderpriority AS p, lag(o_orderpriority) OVER v AS was, lag(o_orderkey) OVER v AS old, lag(year(o_orderdate)) OVER v AS old_year
FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE old IS NOT NULL AND p <> was"""
    out["coverage_gaps"] = f"""SELECT c_custkey AS document_id, 'COVERAGE_GAP' AS code, c_mktsegment || '/' || s AS target FROM customer, (VALUES ('winter'), ('spring'), ('summer'), ('autumn')) v(s)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {SEASON.format('o_orderdate')} = s)"""
    out["overlaps_duplicates"] = f"""WITH {SPANS}, n AS (SELECT *, lag(a) OVER v AS pa, lag(b) OVER v AS pb FROM spans WINDOW v AS (PARTITION BY document_id, level, season ORDER BY a, b)),
f AS (SELECT document_id, 'DUPLICATE_WINDOW' AS code, 'warning' AS severity, 'extract' AS stage FROM n WHERE pa = a AND pb = b
UNION ALL SELECT document_id, 'OVERLAP', 'error', 'source_document' FROM n WHERE NOT (pa = a AND pb = b) AND pb > a AND pa < pb)
SELECT document_id, code, severity, stage, count(*) AS n FROM f GROUP BY ALL"""
    out["daily_cap"] = f"WITH {SPANS} SELECT document_id, 'DAILY_CAP_EXCEEDED' AS code, level || '/' || season AS target, CAST(CAST(sum(b - a) AS BIGINT) AS VARCHAR) || ' minutes a day' AS message FROM spans GROUP BY document_id, level, season HAVING sum(b - a) > 60"
    out["grid_sanity"] = """WITH s AS (SELECT l_orderkey AS d, CAST(trunc(l_quantity * 20) AS INTEGER) AS a, CAST(trunc(l_quantity * 20 + l_linenumber * 75 - 60) AS INTEGER) AS b, l_linenumber FROM lineitem),
f AS (SELECT 'TIME_INVALID' AS code, d, l_linenumber FROM s WHERE NOT (a >= 0 AND a < b AND b <= 1440) UNION ALL SELECT 'OFF_GRID', d, l_linenumber FROM s WHERE a % 15 <> 0 OR b % 15 <> 0)
SELECT code, 'error' AS severity, CASE WHEN l_linenumber < 5 THEN 'source_document' ELSE 'extract' END AS stage, count(*) AS n, count(DISTINCT d) AS documents FROM f GROUP BY 1, 2, 3"""
    out["finding_stages"] = """WITH s AS (SELECT user_id AS d, event_type AS l, strftime(ts, '%Y-%m-%d') AS s, hour(ts) * 60 + minute(ts) - minute(ts) % 15 AS a,
  hour(ts) * 60 + minute(ts) - minute(ts) % 15 + 15 * (1 + CAST(floor(abs(value)) AS BIGINT) % 8) AS b, min(event_id) AS id FROM events GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT *, id % 3 <> 0 AND id % 5 <> 0 AND id % 7 <> 1 AS good FROM s), n AS (SELECT *, lag(a) OVER v AS pa, lag(b) OVER v AS pb, lag(good) OVER v AS pg FROM g WINDOW v AS (PARTITION BY d, l, s ORDER BY a, b)),
f AS (SELECT d, 'TIME_INVALID' AS code, 'error' AS severity, good FROM g WHERE NOT (a >= 0 AND a < b AND b <= 1440)
UNION ALL SELECT d, 'OVERLAP', 'error', good AND pg FROM n WHERE pb > a AND pa < pb
UNION ALL SELECT d, 'DAILY_CAP_EXCEEDED', 'warning', bool_and(good) FROM g GROUP BY d, l, s HAVING sum(greatest(0, b - a)) > 60)
SELECT code, severity, CASE WHEN good THEN 'source_document' ELSE 'extract' END AS stage, count(*) AS n, count(DISTINCT d) AS documents FROM f GROUP BY 1, 2, 3"""
    out["document_rules"] = """WITH f AS (SELECT o_orderkey AS t, 'CONVENTION_ASSUMED' AS code, 'warning' AS severity, 'source_document' AS stage FROM orders WHERE o_orderkey % 5 = 4
UNION ALL SELECT o_orderkey, 'CONVENTION_AMBIGUOUS', 'warning', 'source_document' FROM orders WHERE o_orderkey % 5 = 2
UNION ALL SELECT o_orderkey, 'YEAR_MISMATCH', 'error', CASE WHEN o_custkey % 4 = 3 THEN 'extract' ELSE 'source_document' END FROM orders WHERE o_custkey % 3 = 0
UNION ALL SELECT o_orderkey, 'YEAR_UNGROUNDED', 'warning', 'extract' FROM orders WHERE o_custkey % 4 = 3
UNION ALL SELECT o_orderkey, 'DSO_MISMATCH', 'warning', 'source_document' FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 5 = 0
UNION ALL SELECT o_orderkey, 'NO_WINDOW_TABLE', 'error', 'source_document' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'CORRECTION_NOTED', 'info', 'source_document' FROM orders WHERE o_orderkey % 6 = 0)
SELECT code, severity, stage, count(*) AS n, count(DISTINCT t) AS targets FROM f GROUP BY 1, 2, 3"""
    out["label_rules"] = """WITH p AS (SELECT *, p_size % 5 > 0 AS lv, p_size % 3 > 0 AS sn FROM part),
f AS (SELECT p_brand AS t, 'LEVEL_UNMAPPED' AS code, 'error' AS severity, 'normalize' AS stage FROM p WHERE NOT lv
UNION ALL SELECT p_type, 'SEASON_UNMAPPED', 'error', 'normalize' FROM p WHERE lv AND NOT sn
UNION ALL SELECT 'NE5/winter', 'TIME_UNPARSEABLE', 'error', 'extract' FROM p WHERE lv AND sn AND p_partkey % 4 = 0
UNION ALL SELECT p_brand || '/' || p_type, 'EMPTY_CELL_UNMAPPED', 'warning', 'normalize' FROM p WHERE p_size % 2 = 0 AND NOT (lv AND sn)
UNION ALL SELECT p_brand, 'RULE_VALUE_INVALID', 'warning', 'extract' FROM p WHERE p_size % 11 = 0
UNION ALL SELECT p_brand, 'RULE_AMBIGUOUS', 'warning', 'source_document' FROM p WHERE p_size % 11 <> 0 AND p_size % 2 <> 0
UNION ALL SELECT p_brand, 'RULE_UNGROUNDED', 'warning', 'extract' FROM p WHERE p_size % 7 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'MODEL_ANOMALY', 'info', 'extract' FROM p, (VALUES (1), (2)) v(i) WHERE p_size % 13 = 0)
SELECT code, severity, stage, count(*) AS n, count(DISTINCT t) AS targets FROM f GROUP BY 1, 2, 3"""
    out["name_ids"] = """WITH s AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 > 0 THEN 2000 + s_suppkey % 30 END AS y,
  CASE s_suppkey % 4 WHEN 0 THEN 'Stadtwerke Fürth Netz GmbH & Co. KG' WHEN 1 THEN 'N-ERGIE Netz GmbH' WHEN 2 THEN 'Überlandwerk Groß-Gerau AG' ELSE 'E-Werk und Söhne' END || ' ' || s_name AS name FROM supplier),
w AS (SELECT *, list_filter(string_split_regex(replace(replace(replace(replace(lower(name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+'),
  lambda x: x <> '' AND x NOT IN ('gmbh', 'ag', 'kg', 'co', 'mbh', 'se', 'eg', 'ug', 'und', 'kgaa')) AS words FROM s),
g AS (SELECT *, trim(left(array_to_string(words, '-'), 48), '-') AS slug FROM w), b AS (SELECT *, CASE WHEN y IS NULL THEN slug ELSE slug || '-' || y END AS base FROM g)
SELECT s_suppkey, slug, base AS free_id, base || '-' || left(sha256(s_name), 6) AS taken_id FROM b"""
    out["cross_channel"] = """WITH l AS (SELECT DISTINCT l_orderkey AS d, l_returnflag AS f, l_linenumber AS k, l_quantity AS q FROM lineitem),
a AS (SELECT d, f, list_sort(list(DISTINCT k)) AS s FROM l WHERE q > 5 GROUP BY 1, 2), b AS (SELECT d, f, list_sort(list(DISTINCT k)) AS s FROM l WHERE q < 45 GROUP BY 1, 2)
SELECT d AS document_id, 'CROSS_CHECK_DISAGREE' AS code, f || '/winter' AS target FROM a FULL JOIN b USING (d, f) WHERE a.s IS DISTINCT FROM b.s"""
    out["unmapped_labels"] = """SELECT CASE p_size % 5 WHEN 0 THEN 'NE' || (p_size % 7 + 1) WHEN 1 THEN 'NE4' WHEN 2 THEN 'NE3' END AS level,
CASE p_size % 6 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' WHEN 3 THEN 'autumn' WHEN 5 THEN 'winter' END AS season, count(*) AS n FROM part GROUP BY 1, 2"""
    out["wilson_rates"] = """WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS k, count(*) AS n, k::DOUBLE / n AS p, 1 + 1.96 * 1.96 / n AS z FROM events GROUP BY 1),
b AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / z AS c, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / z AS w FROM u)
SELECT user_id, k, n, round(greatest(0, c - w), 6) AS low, round(least(1, c + w), 6) AS high FROM b"""
    out["majority_reading"] = """SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM
(SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)) WHERE r = 1"""
    out["verdict_ladder"] = """WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 7 <> 0) AS valid, count(*) FILTER (event_id % 7 <> 0 AND (event_id * 7 + user_id) % 10 < user_id % 11) AS persisted FROM events GROUP BY 1),
t AS (SELECT *, persisted::DOUBLE / nullif(valid, 0) AS p, 1 + 1.96 * 1.96 / valid AS z, (p + 1.96 * 1.96 / (2 * valid)) / z AS c, 1.96 * sqrt(p * (1 - p) / valid + 1.96 * 1.96 / (4.0 * valid * valid)) / z AS w FROM s),
v AS (SELECT *, CASE WHEN p IS NULL OR (p > 0.4 AND p < 0.6) THEN 'inconclusive' WHEN p <= 0.4 THEN 'extract' WHEN user_id % 3 = 0 THEN 'inconclusive' WHEN user_id % 3 = 1 THEN 'source_document' ELSE 'parse' END AS stage,
CASE WHEN (greatest(0, c - w) > 0.5 OR least(1, c + w) < 0.5) AND 2 * valid >= n THEN 'high' WHEN 2 * valid >= n THEN 'medium' ELSE 'low' END AS sure FROM t)
SELECT user_id, n, valid, persisted, round(p, 6) AS p_hat, stage, CASE WHEN stage = 'inconclusive' THEN 'low' WHEN p > 0.4 AND user_id % 4 = 0 AND sure = 'high' THEN 'medium' ELSE sure END AS confidence FROM v"""
    out["document_summary"] = f"""WITH {REVIEW}, a AS (SELECT document_id, count(*) AS n_windows, count(*) FILTER (status = 'needs-review') AS n_review, count(*) FILTER (status IN ('verified', 'edited')) AS n_decided FROM w GROUP BY 1),
b AS (SELECT document_id, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info, array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages FROM i GROUP BY 1)
SELECT doc_id AS document_id, source, coalesce(n_windows, 0) AS n_windows, coalesce(n_review, 0) AS n_review, coalesce(n_decided, 0) AS n_decided, coalesce(n_error, 0) AS n_error, coalesce(n_warning, 0) AS n_warning, coalesce(n_info, 0) AS n_info, coalesce(stages, '') AS stages
FROM documents LEFT JOIN a ON a.document_id = doc_id LEFT JOIN b ON b.document_id = doc_id"""
    out["status_derivation"] = f"""WITH {REVIEW}, a AS (SELECT document_id, count(*) AS n, count(*) FILTER (status IN ('auto-ok', 'needs-review', 'auto-corrected')) AS u FROM w GROUP BY 1),
b AS (SELECT document_id, count(*) AS n_open, count(*) FILTER (severity = 'error' OR target IS NOT NULL OR stage <> 'source_document') AS n_block FROM i WHERE severity <> 'info' GROUP BY 1)
SELECT doc_id AS document_id, source, CASE WHEN n_block > 0 THEN 'needs-review' WHEN n_open > 0 THEN 'caveats' WHEN n > 0 AND u = 0 THEN 'verified' ELSE 'auto-ok' END AS doc_status
FROM documents LEFT JOIN a ON a.document_id = doc_id LEFT JOIN b ON b.document_id = doc_id"""
    out["precision_recall"] = """WITH x AS (SELECT lang, count(*) FILTER (n_chars > 500 AND quality = 1) AS tp, count(*) FILTER (n_chars > 500) AS n_found, count(*) FILTER (quality = 1) AS n_gold
FROM documents JOIN labels USING (doc_id) WHERE n_chars > 500 OR quality = 1 GROUP BY 1)
SELECT *, CASE WHEN n_found = 0 THEN 0.0::DOUBLE ELSE round(tp::DOUBLE / n_found, 6) END AS precision, CASE WHEN n_gold > 0 THEN round(tp::DOUBLE / n_gold, 6) WHEN n_found = 0 THEN 1.0 ELSE 0.0 END AS recall FROM x"""
    out["cost_rollup"] = """WITH c AS (SELECT user_id, (event_id % 97) || '-' || event_type AS key, max(round(abs(value), 4)) AS c, max(event_id % 1000) AS l, event_type AS m FROM events GROUP BY user_id, event_id % 97, event_type)
SELECT user_id, round(sum(c), 4) AS cost_usd, CAST(sum(l) AS BIGINT) AS latency_ms, count(*) AS requests, array_to_string(list_sort(list(DISTINCT m)), ',') AS models FROM c GROUP BY 1"""
    out["content_dedupe"] = "SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1"
    health = "CASE WHEN length(t) < 15 THEN CASE WHEN img OR length(t) = 0 THEN 'empty' ELSE 'ok' END ELSE 'ok' END"
    out["text_layer_health"] = f"""SELECT kind, {health} AS health, count(*) AS n FROM (SELECT 'documents' AS kind, trim(coalesce(text, '')) AS t, false AS img FROM documents
UNION ALL SELECT 'pages', trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), true FROM pages) GROUP BY 1, 2"""
    out["page_text_health"] = f"""SELECT {health} AS health, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS t, true AS img FROM pages) GROUP BY 1"""
    out["clock_texts"] = f"""SELECT event_id, CAST(hour(q) * 60 + minute(q) AS INTEGER) AS start_min, CAST(hour(e) * 60 + minute(e) AS INTEGER) AS end_min, CAST(2 AS INTEGER) AS times, CAST(hour(q) * 60 + minute(q) AS INTEGER) AS parsed
FROM (SELECT event_id, {QUARTER} AS q, {QUARTER} + INTERVAL 45 MINUTE AS e FROM events)"""
    out["json_shred"] = """SELECT name, count(*) AS n, count(DISTINCT v) AS n_values, min(v) AS least, max(v) AS most FROM
(SELECT k AS name, json_extract_string(props, '$.' || k) AS v FROM (SELECT props, unnest(json_keys(props)) AS k FROM events)) GROUP BY 1"""
    key = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(translate({0}, '" + DASHES + "', '" + "-" * len(DASHES) + r"')), '─', ' '), '\buhr\b', ' ', 'g'), '(\d)\s*\.\s*(\d\d)\b', '\1:\2', 'g'), '\s*-\s*', '-', 'g'), '\s*:\s*', ':', 'g'), '\s+', ' ', 'g'))"
    padded = "regexp_replace(regexp_replace({0}, '(^|[^0-9])([0-9]):([0-9][0-9])', '\\10\\2:\\3', 'g'), '(^|[^0-9])([0-9]):([0-9][0-9])', '\\10\\2:\\3', 'g')"
    out["match_key_text"] = f"SELECT doc_id, md5({padded.format(key.format('text'))}) AS key_md5 FROM documents"
    out["match_key_full"] = out["match_key_text"]
    out["quote_grounding_exact"] = f"SELECT item_id AS quote_id, doc_id AS page_id FROM (SELECT item_id, {key.format('text')} AS q FROM benchmark) JOIN (SELECT doc_id, {key.format('text')} AS t FROM documents) ON contains(t, q) WHERE q <> ''"
    out["lineage_closure"] = f"""WITH RECURSIVE {EDGES}, c(origin, node, depth) AS (SELECT DISTINCT child, child, 0 FROM e WHERE child LIKE 'c%' OR child LIKE 's%'
UNION SELECT origin, parent, depth + 1 FROM c JOIN e ON child = node) SELECT origin, node, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY 1, 2"""
    out["order_lineage"] = f"""WITH {EDGES}, a AS (SELECT 'o' || o_orderkey AS origin, 'c' || o_custkey AS node FROM orders), b AS (SELECT origin, parent AS node FROM a JOIN e ON child = node), c AS (SELECT origin, parent AS node FROM b JOIN e ON child = node)
SELECT 'o' || o_orderkey AS origin, 'o' || o_orderkey AS node, 0 AS depth FROM orders UNION ALL SELECT *, 1 FROM a UNION ALL SELECT *, 2 FROM b UNION ALL SELECT *, 3 FROM c"""
    out["lineage_chain"] = f"""WITH RECURSIVE {EDGES}, c(origin, step, entity) AS (SELECT DISTINCT child, 0, child FROM e WHERE child LIKE 's%'
UNION SELECT origin, step + 1, (SELECT min(parent) FROM e WHERE child = entity) FROM c WHERE entity IN (SELECT child FROM e))
SELECT origin, step, entity, CASE WHEN entity IN (SELECT child FROM e) THEN 'made-' || entity END AS activity FROM c"""
    out["orphan_check"] = "SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1"
    out["revision_current"] = """SELECT user_id, event_id AS revision, event_type, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_id % 50 = 0) THEN 'needs-review' WHEN event_id % 2 = 0 THEN 'auto-corrected' ELSE 'auto-ok' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'"""
    out["stream_quarter_hours"] = f"SELECT strftime({QUARTER}, '{STAMP}') AS quarter, count(*) AS n FROM events GROUP BY 1"
    out["holiday_calendar"] = f"SELECT strftime(d, '%Y-%m-%d') AS date, n AS name, s AS certain FROM (VALUES {_holidays(2023, 2026, False)}) v(d, n, s)"
    out["budget_admission"] = """SELECT day, count(*) FILTER (run <= 100000) AS admitted, count(*) AS asked FROM (SELECT strftime(ts, '%Y-%m-%d') AS day,
sum(CAST(round(abs(value) * 100) AS BIGINT)) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS run FROM events) GROUP BY 1"""
    defined = "'Der Zeitstempel ' || h || ':15 Uhr definiert den Zeitraum von ' || s || ' Uhr bis ' || h || ':15 Uhr.'"
    mapped = "'Ein Fenster von ' || h || ':00 Uhr bis 23:30 Uhr entspricht den Zeitstempeln von ' || h || ':15 bis 23:30.'"
    listed = "'Die angegebenen Viertelstunden sind Zeitstempel.'"
    out["convention_rules"] = rf"""WITH p AS (SELECT p_partkey AS k, p_size AS z, p_name, p_brand, CAST(10 + p_size % 10 AS VARCHAR) AS h, CASE WHEN p_size % 7 = 0 THEN '01:00' ELSE CAST(10 + p_size % 10 AS VARCHAR) || ':00' END AS s FROM part),
pages AS (SELECT k, 1 AS page, concat_ws(' ', p_name, CASE WHEN z % 2 = 0 THEN {defined} END) AS t FROM p
UNION ALL SELECT k, 2, concat_ws(' ', CASE WHEN z % 3 = 0 THEN {listed} END, CASE WHEN z % 3 = 0 THEN {defined} END, CASE WHEN k % 7 < 3 THEN {mapped} END) FROM p),
r AS (SELECT k, 1 + k % 2 AS page, p_brand, k % 4 IN (1, 2) AND k % 3 > 0 AS example, h || ':00' AS a, h || CASE WHEN k % 5 < 3 THEN ':15' ELSE ':00' END AS b,
CASE WHEN k % 4 = 0 THEN 'interval_start' WHEN k % 4 = 3 THEN 'assumed' WHEN k % 3 = 0 THEN 'interval_end_ambiguous' WHEN k % 5 < 3 THEN 'interval_end_physical' ELSE 'interval_end_labels' END AS was FROM p),
said AS (SELECT *, regexp_extract(t, 'Zeitstempel (\d\d):15 Uhr definiert den Zeitraum von (\d\d):00 Uhr bis (\d\d):15 Uhr', ['x', 'y', 'z']) AS d FROM pages),
first AS (SELECT r.k, arg_min(said.page, CASE WHEN said.page = r.page THEN 0 ELSE said.page END) AS page, arg_min(t, CASE WHEN said.page = r.page THEN 0 ELSE said.page END) AS t
FROM r JOIN said ON said.k = r.k WHERE d.x <> '' AND d.x = d.y AND d.x = d.z GROUP BY r.k),
maps AS (SELECT r.k, bool_or(regexp_matches(t, a || ' Uhr bis [0-9:]+ Uhr.*Zeitstempeln von ' || b || ' bis ')) AS maps FROM r JOIN said ON said.k = r.k GROUP BY r.k),
j AS (SELECT r.*, maps, coalesce(contains(f.t, {listed}), false) AS told, f.page AS new_page, f.t FROM r JOIN maps USING (k) LEFT JOIN first f USING (k)),
c AS (SELECT *, CASE WHEN was = 'interval_start' OR (example AND maps) THEN was WHEN told THEN 'interval_end_labels' WHEN example THEN 'interval_end_ambiguous' ELSE was END AS now FROM j)
SELECT k AS document_id, was, now AS convention, CAST(CASE WHEN now <> was AND told THEN new_page ELSE page END AS INTEGER) AS page,
CASE WHEN now <> was AND told THEN {listed} || ' ' || regexp_extract(t, 'Der Zeitstempel [^.]*\.') ELSE p_brand END AS quote, CASE WHEN now = was THEN NULL WHEN example THEN 'warning' ELSE 'info' END AS severity FROM c"""
    out["rule_values"] = """WITH p AS (SELECT p_partkey AS k, p_size AS z, p_brand, replace(CAST(CAST(floor(p_retailprice * 100) AS BIGINT) AS VARCHAR), '7', '.') AS money FROM part),
q AS (SELECT *, TRY_CAST(money AS DOUBLE) AS number, ['working_day', 'off_peak', 'off_peak_max_one', 'off_peak_max_one_per_week'][z % 4 + 1] AS b FROM p)
SELECT k AS document_id, 'de_minimis_eur' AS kind, CAST(NULL AS VARCHAR) AS value, number, number IS NOT NULL AS resolved, number IS NULL AS has_problem FROM q WHERE k % 4 = 0
UNION ALL SELECT k, 'bridge_days', CASE WHEN z % 3 > 0 THEN b ELSE p_brand END, NULL, z % 3 > 0 AND z % 4 < 2, z % 3 = 0 FROM q WHERE k % 4 = 1
UNION ALL SELECT k, 'workdays_only', CASE WHEN z % 3 > 0 AND z % 2 = 0 THEN 'false' ELSE 'true' END, NULL, true, false FROM q WHERE k % 4 = 2
UNION ALL SELECT k, 'christmas_period', NULL, NULL, z % 3 > 0, z % 3 = 0 FROM q WHERE k % 4 = 3"""
    return {k: v for k, v in out.items() if v}
