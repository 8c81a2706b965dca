"""The operators applied to the driver's tables: events as instants, orders and line items as versions and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import names
from ..functions.clock import floor_quarter, minute_of_day, season_of
from ..functions.text import content_hash, map_level, map_season, match_key, parse_time, plain_key, text_health, time_ranges_in, times_in
from ..operators import attribution, compare, grounding, lineage, normalize, quality, revisions
from ..operators.calendar import DayRules, classify_days, holiday_days
from ..operators.membership import answer, evaluate, mask, quarter_hours

#: window_id, season, start_min, end_min of the level that the queries ask about.
WINDOWS = [("w1", "winter", 465, 540), ("w2", "winter", 990, 1185), ("w3", "spring", 1005, 1125)]
UNION = DayRules(states=("BY", "BW"), bridge="off_peak")
INTERSECTION = DayRules(states=("BY", "BW"), mode="intersection", exclude=("Mariä Himmelfahrt",), bridge="working_day")
CONVENTIONS = ("interval_start", "interval_end_physical", "interval_end_ambiguous", "interval_end_labels", "assumed")
ORDER_YEARS, EVENT_YEARS = (1994, 2003), (2023, 2026)
STAMP = "yyyy-MM-dd HH:mm"


#: What of a page is not its text.
PAGE_MARKUP = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOWS, "window_id string, season string, start_min int, end_min int")


def _rate(c, digits: int = 6):
    return F.round(c, digits)


def quarter_hour_counts(spark, d):
    q = F.date_format(floor_quarter(F.col("ts")), STAMP)
    return _t(spark, d, "events").groupBy(q.alias("quarter"), "event_type").agg(F.count(F.lit(1)).alias("n"), _rate(F.sum("value"), 2).alias("total"))


def season_rollup(spark, d):
    o = _t(spark, d, "orders").select(season_of(F.month("o_orderdate")).alias("season"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return o.groupBy("season", "year").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("o_totalprice") * 100).cast("decimal(20,0)")).cast("long").alias("cents"))


def _day_classes(spark, d, rules):
    o = _t(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    days = o.groupBy("date").agg(F.count(F.lit(1)).alias("n"))  # classes belong to days, not to orders
    out = classify_days(days, rules, *ORDER_YEARS)
    return out.groupBy("day_type", "off_peak").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"))


def day_classes(spark, d):
    return _day_classes(spark, d, UNION)


def day_classes_intersection(spark, d):
    return _day_classes(spark, d, INTERSECTION)


def window_membership(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type", floor_quarter(F.col("ts")).alias("start_utc"))
    out = evaluate(e, _windows(spark), INTERSECTION, EVENT_YEARS)
    return out.select("event_id", "event_type", "season", "day_type", answer(F.col("in_window")).alias("answer"), "window_id")


def membership_conventions(spark, d):
    e = _t(spark, d, "events").select(floor_quarter(F.col("ts")).alias("start_utc")).groupBy("start_utc").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for c in CONVENTIONS:
        one = evaluate(e, _windows(spark), UNION, EVENT_YEARS, c).groupBy(answer(F.col("in_window")).alias("answer")).agg(F.sum("n").alias("n")).select(F.lit(c).alias("convention"), "answer", "n")
        out = one if out is None else out.unionByName(one)
    return out


def year_mask(spark, d):
    m = mask(spark, _windows(spark), INTERSECTION, 2026, "interval_end_ambiguous")
    return m.select(F.date_format("start_utc", STAMP).alias("start_utc"), F.date_format("start_local", STAMP).alias("start_local"), "flag", "season", "day_type", "window_id")


def dst_days(spark, d):
    q = None
    for y in (2024, 2025, 2026):
        q = quarter_hours(spark, y) if q is None else q.unionByName(quarter_hours(spark, y))
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), "start_utc")
    return q.groupBy(F.date_format(local, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n <> 96")


def latest_version(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"), F.col("o_orderkey").alias("document_id"), (F.col("o_orderstatus") == "P").alias("synthetic"))
    return compare.pick_latest(o, ["o_custkey", "year"])


def _cells(spark, d, year):
    o = _t(spark, d, "orders").where(F.year("o_orderdate") == year)
    # Order counts stand for a cell's value.
    return o.groupBy("o_orderpriority", F.month("o_orderdate").alias("month")).agg((F.count(F.lit(1)) / 4).cast("int").alias("v"))


def snapshot_diff(spark, d):
    return compare.snapshot_diff(_cells(spark, d, 1995), _cells(spark, d, 1996), ["o_orderpriority", "month"], "v")


def version_drift(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"), "o_orderpriority")
    docs = o.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("dso"), F.lit(False).alias("synthetic"), "year", "publication_date")
    # An order's priority is its one window: the digit in hours, two hours long.
    w = o.select(F.col("o_orderkey").alias("document_id"), F.lit("NE5").alias("level"), F.lit("winter").alias("season"), (F.left("o_orderpriority", F.lit(1)).cast("int") * 60).alias("start_min")).withColumn("end_min", F.col("start_min") + 120)
    return quality.version_findings(docs, w).select("document_id", "code", "target")


def coverage_gaps(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    listed = c.select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("level"))
    w = o.select(F.col("o_custkey").alias("document_id"), season_of(F.month("o_orderdate")).alias("season")).distinct().join(listed, "document_id").select("document_id", "level", "season")
    none = w.limit(0)
    return quality.coverage_findings(listed, w, none).select("document_id", "code", "target")


def _spans(spark, d):
    """An event as a window of its user's day: from its quarter-hour, as long as its value says."""
    q = floor_quarter(F.col("ts"))
    start = minute_of_day(q)
    length = 15 * (1 + F.floor(F.abs("value")) % 8)
    e = _t(spark, d, "events")
    return e.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("level"), F.date_format("ts", "yyyy-MM-dd").alias("season"), start.cast("int").alias("start_min"), (start + length).cast("int").alias("end_min"), F.lit(None).cast("boolean").alias("grounded"), F.lit(None).cast("boolean").alias("consistent"), F.lit(None).cast("boolean").alias("aligned"))


def overlaps_duplicates(spark, d):
    return quality.neighbour_findings(_spans(spark, d)).groupBy("document_id", "code", "severity", "stage").agg(F.count(F.lit(1)).alias("n"))


def daily_cap(spark, d):
    return quality.cap_findings(_spans(spark, d), 60).select("document_id", "code", "target", "message")


def grid_sanity(spark, d):
    w = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("level"), F.col("l_linestatus").alias("season"), (F.col("l_quantity") * 20).cast("int").alias("start_min"), (F.col("l_quantity") * 20 + F.col("l_linenumber") * 75 - 60).cast("int").alias("end_min"), F.lit(True).alias("grounded"), F.lit(None).cast("boolean").alias("consistent"), (F.col("l_linenumber") < 5).alias("aligned"))
    return quality.time_findings(w).groupBy("code", "severity", "stage").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("documents"))


def finding_stages(spark, d):
    # The events' spans, each once, with flags that say yes, no and nothing.
    q = floor_quarter(F.col("ts"))
    start = minute_of_day(q).cast("int")
    e = _t(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("level"), F.date_format("ts", "yyyy-MM-dd").alias("season"), start.alias("start_min"), (start + 15 * (1 + F.floor(F.abs("value")) % 8)).cast("int").alias("end_min"), "event_id")
    w = e.groupBy("document_id", "level", "season", "start_min", "end_min").agg(F.min("event_id").alias("id"))
    flags = {"grounded": F.col("id") % 3 != 0, "consistent": F.when(F.col("id") % 5 == 0, False).when(F.col("id") % 5 > 1, True), "aligned": F.when(F.col("id") % 7 > 0, F.col("id") % 7 > 1)}
    w = w.withColumns(flags)
    found = quality.union([quality.time_findings(w), quality.neighbour_findings(w), quality.cap_findings(w, 60)])
    return found.groupBy("code", "severity", "stage").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("documents"))


def _tally(found):
    return found.groupBy("code", "severity", "stage").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("targets"))


def document_rules(spark, d):
    o, k, c = _t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    docs = o.select(
        k.alias("document_id"), F.get(F.array(*[F.lit(x) for x in CONVENTIONS]), (k % 5).cast("int")).alias("convention"), F.year("o_orderdate").alias("registry_year"),
        (F.year("o_orderdate") + F.when(c % 3 == 0, 1).otherwise(0)).alias("page_year"), F.when(c % 4 > 0, c % 4 < 3).alias("year_grounded"), F.when(k % 6 == 0, F.lit("corrected")).when(k % 6 == 1, F.lit(" ")).alias("correction_note"),
        (F.col("o_orderstatus") == "P").alias("upload"), (c % 5 != 0).alias("same_name"), (k % 4).alias("n_windows"), (k % 2).alias("n_empty"),
    )
    return _tally(quality.document_findings(docs))


def label_rules(spark, d):
    # Parts stand for cells, rules and notes of a table.
    p, size = _t(spark, d, "part"), F.col("p_size")
    raw = p.select(F.col("p_partkey").alias("document_id"), size.alias("_size"), F.col("p_brand").alias("level_label"), F.col("p_type").alias("season_label"), F.when(size % 5 > 0, "NE5").alias("level"), F.when(size % 3 > 0, "winter").alias("season"), F.when(F.col("p_partkey") % 4 > 0, 60).alias("start_min"), F.lit(120).alias("end_min"))
    rules = p.select(F.col("p_partkey").alias("document_id"), F.col("p_brand").alias("kind"), (size % 2 == 0).alias("resolved"), (size % 7 != 0).alias("grounded"), F.when(size % 11 == 0, F.lit("no number")).alias("problem"))
    notes = p.select(F.col("p_partkey").alias("document_id"), F.when(size % 13 == 0, F.array("p_type", "p_brand")).alias("anomalies"))
    return _tally(quality.union([quality.label_findings(raw), quality.empty_cell_findings(raw.where("_size % 2 = 0")), quality.rule_findings(rules), quality.anomaly_findings(notes)]))


#: What pages say of time stamps; {0}: an hour, {1}: the start of what a stamp is said to stand for.
SAID = (
    "Der Zeitstempel {0}:15 Uhr definiert den Zeitraum von {1} Uhr bis {0}:15 Uhr.",
    "Die angegebenen Viertelstunden sind Zeitstempel.",
    "Ein Fenster von {0}:00 Uhr bis 23:30 Uhr entspricht den Zeitstempeln von {0}:15 bis 23:30.",
)


def convention_rules(spark, d):
    # Parts stand for documents of two pages each and for what was read in them.
    p, k, size = _t(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    hour = (10 + size % 10).cast("string")
    start = F.when(size % 7 == 0, F.lit("01:00")).otherwise(F.concat(hour, F.lit(":00")))
    says = lambda i: F.replace(F.replace(F.lit(SAID[i]), F.lit("{0}"), hour), F.lit("{1}"), start)
    readings = p.select(
        k.alias("document_id"), F.element_at(F.array(*map(F.lit, ("start", "end", "end", "unstated"))), (k % 4 + 1).cast("int")).alias("meter_label"), F.when(k % 3 > 0, F.concat(hour, F.lit(":00"))).alias("listed_start"),
        F.concat(hour, F.when(k % 5 < 3, ":15").otherwise(":00")).alias("first_timestamp"), (k % 2 + 1).cast("int").alias("page"), F.col("p_brand").alias("quote"),
    )
    one = F.concat_ws(" ", "p_name", F.when(size % 2 == 0, says(0)))
    two = F.concat_ws(" ", F.when(size % 3 == 0, F.concat_ws(" ", says(1), says(0))), F.when(k % 7 < 3, says(2)))
    pages = p.select(k.alias("document_id"), F.posexplode(F.array(one, two)).alias("_at", "text")).withColumn("page", F.col("_at") + 1)
    return normalize.resolve_conventions(readings, pages)


def rule_values(spark, d):
    # Prices, brands and sizes stand for values of rules.
    p, k, size = _t(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    bridge = F.element_at(F.array(*map(F.lit, normalize.BRIDGE)), (size % 4 + 1).cast("int"))
    money = F.concat(F.lit('"'), F.replace((F.col("p_retailprice") * 100).cast("long").cast("string"), F.lit("7"), F.lit(",")), F.lit(' €"'))
    kinds = [("de_minimis_eur", money), ("bridge_days", F.concat(F.lit('"'), F.when(size % 3 > 0, bridge).otherwise(F.col("p_brand")), F.lit('"'))), ("workdays_only", F.when(size % 3 > 0, F.when(size % 2 == 0, "false").otherwise("true"))), ("christmas_period", F.when(size % 3 > 0, F.lit('{"from": "12-24", "to": "01-01"}')).otherwise("7"))]
    rules = p.select(k.alias("document_id"), F.element_at(F.array(*[F.struct(F.lit(n).alias("kind"), v.alias("value")) for n, v in kinds]), (k % 4 + 1).cast("int")).alias("_r")).select("document_id", "_r.*")
    told = rules.withColumn("_t", normalize.rule_value(F.col("kind"), F.col("value")))
    text = F.when(F.col("kind").isin("bridge_days", "workdays_only"), F.col("_t.value"))
    number = F.when(F.col("kind") == "de_minimis_eur", F.col("_t.value").try_cast("double"))
    return told.select("document_id", "kind", text.alias("value"), number.alias("number"), "_t.resolved", F.col("_t.problem").isNotNull().alias("has_problem"))


#: Names as operators print them, before a supplier's own.
PRINTED = ("Stadtwerke Fürth Netz GmbH & Co. KG", "N-ERGIE Netz GmbH", "Überlandwerk Groß-Gerau AG", "E-Werk und Söhne")


def name_ids(spark, d):
    k = F.col("s_suppkey")
    s = _t(spark, d, "supplier").select("s_suppkey", F.concat_ws(" ", F.get(F.array(*[F.lit(x) for x in PRINTED]), (k % 4).cast("int")), "s_name").alias("name"), F.when(k % 3 > 0, 2000 + k % 30).cast("int").alias("year"), F.sha2("s_name", 256).alias("sha"))
    s = s.withColumn("slug", names.slug(F.col("name")))
    taken = F.array("slug", F.concat_ws("-", "slug", F.col("year").cast("string")))
    return s.select("s_suppkey", "slug", names.make_id(F.col("name"), F.col("year"), F.col("sha"), F.array(F.lit("x"))).alias("free_id"), names.make_id(F.col("name"), F.col("year"), F.col("sha"), taken).alias("taken_id"))


def cross_channel(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("level"), F.lit("winter").alias("season"), (F.col("l_linenumber") * 60).alias("start_min"), (F.col("l_linenumber") * 60 + 60).alias("end_min"), "l_quantity")
    return quality.cross_channel_findings(li.where("l_quantity > 5"), li.where("l_quantity < 45")).select("document_id", "code", "target")


def unmapped_labels(spark, d):
    # Part types and names say neither levels nor seasons, but for what the ordered patterns find in them.
    p = _t(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("label"), "p_size")
    label = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Netzebene "), (F.col("p_size") % 7 + 1).cast("string"))).when(F.col("p_size") % 5 == 1, F.concat(F.lit("Umspannung in die Mittelspannung "), F.col("label"))).when(F.col("p_size") % 5 == 2, F.concat(F.col("label"), F.lit(" Hochspannung"))).otherwise(F.col("label"))
    s = F.element_at(F.array(*[F.lit(x) for x in ("Winter (Dez-Feb)", "Frühjahr", "Sommer", "Herbst", "ganzjährig", "Jan")]), (F.col("p_size") % 6 + 1).cast("int"))
    return p.select(map_level(label).alias("level"), map_season(s).alias("season")).groupBy("level", "season").agg(F.count(F.lit(1)).alias("n"))


def wilson_rates(spark, d):
    u = _t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = attribution.wilson(F.col("k"), F.col("n"))
    return u.select("user_id", F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), _rate(low).alias("low"), _rate(high).alias("high"))


def majority_reading(spark, d):
    return attribution.majority(_t(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id")


def verdict_ladder(spark, d):
    s = _t(spark, d, "events").select("user_id", (F.col("event_id") % 7 != 0).alias("valid"), (F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(10)) < F.col("user_id") % 11).alias("symptom"))
    stats = attribution.resample_statistics(s, ["user_id"])
    stats = stats.withColumns({"swap_symptom": F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 3 == 1), "confounded": F.col("user_id") % 4 == 0})
    out = attribution.verdicts(stats)
    return out.select("user_id", "n", "valid", "persisted", _rate("p_hat").alias("p_hat"), "stage", "confidence")


def _review(spark, d):
    """Documents with a window each, of a status that its labels give, and an issue each where they are toxic or junk."""
    docs, lab = _t(spark, d, "documents").select("doc_id", "source"), _t(spark, d, "labels")
    w = lab.select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "verified").when(F.col("toxic") == 1, "needs-review").otherwise("auto-ok").alias("status"))
    sev = F.when(F.col("toxic") == 1, "error").when(F.col("doc_id") % 3 == 0, "warning").otherwise("info")
    i = lab.where("quality = 0 OR toxic = 1").select(F.col("doc_id").alias("document_id"), sev.alias("severity"), F.when(F.col("doc_id") % 2 == 0, "extract").otherwise("source_document").alias("stage"), F.when(F.col("doc_id") % 5 == 0, "NE5/winter").alias("target"), (F.col("doc_id") % 4 == 0).cast("int").alias("resolved"))
    return docs.withColumnRenamed("doc_id", "document_id"), w, i


def document_summary(spark, d):
    docs, w, i = _review(spark, d)
    return compare.document_summary(docs, w, i)


def status_derivation(spark, d):
    docs, w, i = _review(spark, d)
    return revisions.document_status(docs, i, w)


def precision_recall(spark, d):
    docs, lab = _t(spark, d, "documents"), _t(spark, d, "labels")
    both = docs.select("doc_id", "lang", "n_chars").join(lab, "doc_id")
    out = compare.precision_recall(both.where("n_chars > 500"), both.where("quality = 1"), ["doc_id"], ["lang"])
    return out.withColumns({"precision": _rate("precision"), "recall": _rate("recall")})


def cost_rollup(spark, d):
    e = _t(spark, d, "events")
    calls = e.select("user_id", F.concat_ws("-", (F.col("event_id") % 97).cast("string"), "event_type").alias("key"), F.round(F.abs("value"), 4).cast("decimal(18,6)").alias("cost_usd"), (F.col("event_id") % 1000).alias("latency_ms"), F.col("event_type").alias("model"))
    out = compare.cost_rollup(calls, ["user_id"])
    return out.withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 4))


def content_dedupe(spark, d):
    h = content_hash(F.coalesce("text", F.lit("")))
    return _t(spark, d, "documents").groupBy(h.alias("sha256")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


def text_layer_health(spark, d):
    a = _t(spark, d, "documents").select(F.lit("documents").alias("kind"), text_health(F.col("text"), F.lit(False)).alias("health"))
    b = _t(spark, d, "pages").select(F.lit("pages").alias("kind"), text_health(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit(True)).alias("health"))
    return a.unionByName(b).groupBy("kind", "health").agg(F.count(F.lit(1)).alias("n"))


def page_text_health(spark, d):
    # The whole text of a page: what is left without scripts, styles, comments and tags.
    t = F.regexp_replace(F.regexp_replace("html", PAGE_MARKUP, " "), "[ \\t\\r\\n]+", " ")
    return _t(spark, d, "pages").select(text_health(t, F.lit(True)).alias("health")).groupBy("health").agg(F.count(F.lit(1)).alias("n"))


def match_key_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(plain_key(F.col("text"))).alias("key_md5"))


def match_key_full(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(match_key(F.col("text"))).alias("key_md5"))


def clock_texts(spark, d):
    # Events as printed lines; the documents hold no clock times.
    q = floor_quarter(F.col("ts"))
    printed = F.concat(F.date_format(q, "H.mm"), F.lit(" – "), F.date_format(q + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(45)), "HH:mm"), F.lit(" Uhr"))
    e = _t(spark, d, "events").select("event_id", printed.alias("line"))
    r = F.get(time_ranges_in(F.col("line")), F.lit(0))
    return e.select("event_id", r["start"].alias("start_min"), r["end"].alias("end_min"), F.size(times_in(F.col("line"))).alias("times"), parse_time(F.regexp_extract("line", "^[0-9.]+", 0)).alias("parsed"))


def json_shred(spark, d):
    e = _t(spark, d, "events")
    kinds = StructType([StructField("k", StringType())])
    one = e.select("event_id", F.from_json("props", "map<string,string>").alias("m"), F.from_json("props", kinds).alias("typed"))
    return one.select("event_id", F.explode("m").alias("name", "value")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"), F.min("value").alias("least"), F.max("value").alias("most"))


def quote_grounding_exact(spark, d):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return grounding.ground_exact(q, _t(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))


def quote_grounding_fuzzy(spark, d):
    # Whole benchmark passages are looked for in all lines, pairs of lines and whole texts of all documents.
    q = _t(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("quote_id"), F.col("text").alias("quote"))
    return grounding.ground_everywhere(q, _t(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))


def _edges(spark, d):
    """Customers come from nations and nations from regions; suppliers likewise."""
    n, c, s = _t(spark, d, "nation"), _t(spark, d, "customer"), _t(spark, d, "supplier")
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    e = n.select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
    e = e.unionByName(c.select(key("c", "c_custkey").alias("child"), key("n", "c_nationkey").alias("parent")))
    return e.unionByName(s.select(key("s", "s_suppkey").alias("child"), key("n", "s_nationkey").alias("parent")))


def lineage_closure(spark, d):
    e = _edges(spark, d)
    starts = e.where("child LIKE 'c%' OR child LIKE 's%'").select(F.col("child").alias("node")).distinct()
    return lineage.ancestors(e, starts)


def order_lineage(spark, d):
    o = _t(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("child"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("parent"))
    return lineage.ancestors(_edges(spark, d).unionByName(o), o.select(F.col("child").alias("node")).distinct())


def lineage_chain(spark, d):
    e = _edges(spark, d)
    hops = e.groupBy("child").agg(F.min("parent").alias("next")).select(F.col("child").alias("entity"), F.concat(F.lit("made-"), F.col("child")).alias("activity"), "next")
    return lineage.chain(hops, e.where("child LIKE 's%'").select(F.col("child").alias("node")).distinct())


def orphan_check(spark, d):
    li, o = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    made = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lineage.orphans(li.select("l_orderkey", "l_linenumber"), made, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


def revision_current(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("revision"), "event_type", F.when(F.col("event_type") == "error", "rejected").otherwise("auto-ok").alias("status"), F.when(F.col("event_id") % 2 == 0, "auto").otherwise("extract").alias("origin"))
    now = revisions.current(e, ["user_id"]).withColumn("target", F.col("user_id").cast("string"))
    flags = e.where("event_id % 50 = 0").select(F.col("user_id").cast("string").alias("target"))
    return revisions.reflag(now, flags).select("user_id", "revision", "event_type", "status")


def stream_quarter_hours(spark, d):
    """Extension: the same events as a stream, tagged, written once, then counted."""
    from uuid import uuid4

    from ..streaming.quarters import read_events, run_once, tag

    shared = (spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints").rstrip("/")
    at = f"{shared}/stream-{uuid4().hex}"
    run_once(tag(read_events(spark, f"{d}/events.parquet")), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").groupBy(F.date_format("quarter", STAMP).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


def holiday_calendar(spark, d):
    return holiday_days(spark, UNION, *EVENT_YEARS).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "name", "certain")


def budget_admission(spark, d):
    e = _t(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("submitted"), F.round(F.abs("value") * 100).cast("long").alias("worst_cost"))
    return compare.admit(e, 100_000).groupBy("day").agg(F.count_if("admitted").alias("admitted"), F.count(F.lit(1)).alias("asked"))


ALL = [
    quarter_hour_counts, season_rollup, day_classes, day_classes_intersection, window_membership, membership_conventions, year_mask, dst_days,
    latest_version, snapshot_diff, version_drift, coverage_gaps, overlaps_duplicates, daily_cap, grid_sanity, finding_stages, document_rules, label_rules, convention_rules, rule_values, name_ids, cross_channel, unmapped_labels,
    wilson_rates, majority_reading, verdict_ladder, document_summary, status_derivation, precision_recall, cost_rollup, content_dedupe,
    text_layer_health, page_text_health, match_key_text, match_key_full, clock_texts, json_shred, quote_grounding_exact, quote_grounding_fuzzy, lineage_closure, order_lineage, lineage_chain,
    orphan_check, revision_current, stream_quarter_hours, holiday_calendar, budget_admission,
]
