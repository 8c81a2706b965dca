"""What people are shown: a document held against its gold standard, tracks of a day, histories, proposals and plain sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import QUARTER, SEASONS, day_percent, hhmm
from .compare import canonical_rule
from .revisions import base_entity, latest

KEY = ("level", "season", "start_min", "end_min")
#: Grid levels in their order, and what rule values are called in a sentence.
GRID = tuple(f"NE{k}" for k in range(1, 8))
BRIDGES = {"working_day": "count as working days", "off_peak": "are off-peak", "off_peak_max_one": "at most one is off-peak; the document does not say which", "off_peak_max_one_per_week": "at most one per week is off-peak; not named"}
UNITS = {"significance_threshold": " %", "min_kw_diff": " kW", "de_minimis_eur": " €"}
SHIFTED = ("interval_end_ambiguous", "interval_end_labels")


def evaluate_documents(gold: DataFrame, windows: DataFrame, issues: DataFrame, gold_rules: DataFrame, rules: DataFrame, calls: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each document of documents (document_id, convention, gold_convention, labeled_by): what was delivered before a person
    looked, held against its gold standard.

    gold: document_id, level, season, windows (array of start_min, end_min; empty for an empty cell). windows: document_id, entity, KEY,
    origin, status, revision; delivered is the last revision by extraction or correction unless it was rejected, raw what was extracted at
    first. issues: document_id, level, season (of their target), severity, resolved. rules and gold_rules: document_id, kind, value (JSON text).
    calls: document_id, key, cost_usd, latency_ms, source; a request that was made again counts once, at its dearest.
    Values count once each. missed_flagged: missing values whose cell has an error or a warning that no correction settled. rules_recall and
    convention_ok are null without a gold standard of them. Without any values found precision is 0, without any in gold recall is 1.
    """
    own = windows.where(F.col("origin").isin("extract", "auto")).withColumn("_base", base_entity(F.col("entity")))
    last = latest(own, ["document_id", "_base"], F.desc("revision"))
    cells = gold.select("document_id", "level", "season").distinct()
    yes, no = F.lit(True), F.lit(False)
    tag = lambda df, pred=no, gold=no, raw=no, flagged=no: df.select("document_id", *KEY, pred.alias("pred"), gold.alias("gold"), raw.alias("raw"), flagged.alias("flagged"))
    wanted = gold.select("document_id", "level", "season", F.explode("windows").alias("_w")).select("document_id", "level", "season", "_w.start_min", "_w.end_min")
    delivered = last.where(F.col("status") != "rejected")
    all_ = tag(delivered, pred=yes, flagged=F.col("status") == "needs-review").unionByName(tag(wanted, gold=yes)).unionByName(tag(own.where("origin = 'extract'"), raw=yes))
    values = all_.groupBy("document_id", *KEY).agg(*[F.bool_or(c).alias(c) for c in ("pred", "gold", "raw", "flagged")])
    doubted = issues.where("severity IN ('error', 'warning') AND resolved <> 2 AND level IS NOT NULL").select("document_id", "level", "season").distinct().withColumn("_doubted", yes)
    values = values.join(doubted, ["document_id", "level", "season"], "left")
    count = lambda c, name: F.count_if(c).alias(name)
    pred, is_gold, raw, flagged = (F.col(c) for c in ("pred", "gold", "raw", "flagged"))
    found = values.groupBy("document_id").agg(
        count(is_gold, "windows_gold"), count(pred, "windows_pred"), count(pred & is_gold, "_tp"), count(raw, "_raw"), count(raw & is_gold, "_raw_tp"), count(flagged, "_flagged"),
        count(pred & ~is_gold, "wrong"), count(pred & ~is_gold & flagged, "wrong_flagged"), count(is_gold & ~pred, "missed"), count(is_gold & ~pred & F.col("_doubted").isNotNull(), "missed_flagged"),
    )
    unlike = values.where(pred != is_gold).select("document_id", "level", "season").distinct().withColumn("_unlike", yes)
    exact = cells.join(unlike, ["document_id", "level", "season"], "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("cells"), count(F.col("_unlike").isNull(), "cells_exact"))
    said = lambda df: df.select("document_id", "kind", canonical_rule(F.col("value")).alias("_v")).distinct()
    kept = said(gold_rules).join(said(rules).withColumn("_hit", yes), ["document_id", "kind", "_v"], "left").groupBy("document_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("rules_recall"))
    once = calls.groupBy("document_id", "key").agg(F.max("cost_usd").alias("c"), F.max("latency_ms").alias("l"), F.min("source").alias("s"))
    cost = once.groupBy("document_id").agg(F.count(F.lit(1)).alias("llm_calls"), F.sum("c").alias("cost_usd"), (F.sum("l") / 1000).alias("latency_s"), F.array_join(F.array_sort(F.collect_set("s")), ",").alias("response_source"))
    auto = last.groupBy("document_id").agg(count(F.col("origin") == "auto", "auto_corrected"))
    out = documents.select("document_id", "labeled_by", F.when(F.col("gold_convention") != "", F.col("convention").eqNullSafe(F.col("gold_convention"))).alias("convention_ok"))
    for part in (found, exact, kept, cost, auto):
        out = out.join(part, "document_id", "left")
    numbers = [c for c in out.columns if c not in ("document_id", "labeled_by", "convention_ok", "rules_recall", "response_source")]
    out = out.fillna(0, numbers).fillna("", ["response_source", "labeled_by"])
    precision = lambda tp, n: F.when(F.col(n) > 0, F.col(tp) / F.col(n)).otherwise(0.0)
    recall = lambda tp, n: F.when(F.col("windows_gold") > 0, F.col(tp) / F.col("windows_gold")).when(F.col(n) == 0, 1.0).otherwise(0.0)
    out = out.withColumns({"precision": precision("_tp", "windows_pred"), "recall": recall("_tp", "windows_pred"), "raw_precision": precision("_raw_tp", "_raw"), "raw_recall": recall("_raw_tp", "_raw"), "review_share": precision("_flagged", "windows_pred")})
    return out.drop("_tp", "_raw", "_raw_tp", "_flagged")


def window_history(windows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (entity, any revision of it) with every revision of the same window in order: asked, entity, revision, label, status_label."""
    base = asked.select(F.col("entity").alias("asked"), base_entity(F.col("entity")).alias("_base")).distinct()
    all_ = windows.withColumn("_base", base_entity(F.col("entity"))).join(base, "_base")
    removed = (F.col("status") == "rejected") & (F.col("origin") == "auto")
    label = F.concat(hhmm(F.col("start_min")), F.lit("–"), hhmm(F.col("end_min")))
    return all_.select("asked", "entity", "revision", label.alias("label"), F.when(removed, "Removed (consensus)").otherwise(F.col("status")).alias("status_label"))


def ribbons(documents: DataFrame, windows: DataFrame, empties: DataFrame, issues: DataFrame) -> DataFrame:
    """A track for each document, level and season: bars on a day of 100 %, hours, and whether the cell is empty, missing or flagged.

    documents: document_id, convention, levels (array, as listed); windows (active ones): document_id, entity, KEY, status; empties: document_id,
    level, season; issues: document_id, target (an entity, or level/season for a cell), severity, resolved. A document has the levels that it lists or that a window or an
    empty cell has, and all seasons of each. A window that ends before it starts is drawn between its times and invalid; bars are a quarter-hour
    wide at least, and with conventions that move the first quarter-hour that part is marked.
    """
    have = windows.select("document_id", "level").unionByName(empties.select("document_id", "level")).unionByName(documents.select("document_id", F.explode("levels").alias("level")))
    levels = have.where(F.col("level").isin(*GRID)).distinct().join(documents.select("document_id", "convention"), "document_id")
    tracks = levels.withColumn("season", F.explode(F.array(*map(F.lit, SEASONS))))
    open_ = issues.where("resolved = 0 AND severity IN ('error', 'warning') AND target IS NOT NULL").select("document_id", "target").distinct()
    cell = open_.select("document_id", F.col("target").alias("_cell"), F.lit(True).alias("flagged"))
    mine = windows.join(open_.withColumnRenamed("target", "entity").withColumn("_flag", F.lit(True)), ["document_id", "entity"], "left")
    a, b = F.col("start_min"), F.col("end_min")
    w = mine.select("document_id", "level", "season", F.struct(a.alias("start_min"), "entity", "status", (b <= a).alias("invalid"), day_percent(F.least(a, b)).alias("left"), day_percent(F.greatest(F.lit(QUARTER), F.abs(b - a))).alias("width"),
        F.concat(hhmm(a), F.lit("–"), hhmm(b)).alias("label"), F.col("_flag").isNotNull().alias("flagged")).alias("_bar"))
    bars = w.groupBy("document_id", "level", "season").agg(F.sort_array(F.collect_list("_bar")).alias("bars"))
    none = empties.select("document_id", "level", "season").distinct().withColumn("empty", F.lit(True))
    out = tracks.join(bars, ["document_id", "level", "season"], "left").join(none, ["document_id", "level", "season"], "left")
    out = out.withColumn("_cell", F.concat_ws("/", "level", "season")).join(cell, ["document_id", "_cell"], "left")
    bars = F.coalesce("bars", F.array().cast(bars.schema["bars"].dataType))
    out = out.withColumns({"empty": F.coalesce("empty", F.lit(False)), "flagged": F.coalesce("flagged", F.lit(False)), "bars": bars})
    moved = F.col("convention").isin(*SHIFTED)
    drawn = F.transform("bars", lambda x: x.withField("boundary", F.when(moved & ~x["invalid"], day_percent(F.lit(QUARTER))).otherwise(0.0)).withField("flagged", x["flagged"] | F.col("flagged")))
    hours = F.round(F.aggregate("bars", F.lit(0.0), lambda n, x: n + x["width"]) * 24 / 100, 2)
    return out.select("document_id", "level", "season", drawn.alias("bars"), hours.alias("hours"), "empty", ((F.size("bars") == 0) & ~F.col("empty")).alias("missing"), "flagged")


def edit_proposals(windows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """windows (document_id, entity, KEY) that an open verdict's reading of their cell would replace by exactly one value.

    verdicts: document_id, iid, level, season, stage, suggested (array of start_min, end_min), resolved. Of a cell's verdicts the first, by iid,
    that has one new value with the same start, the same end or an overlap counts; a value that the reading has too needs none. Gives document_id, entity,
    start_min, end_min and source.
    """
    cell = ["document_id", "level", "season"]
    value = F.struct(F.col("start_min").cast("int").alias("start_min"), F.col("end_min").cast("int").alias("end_min"))
    current = windows.groupBy(*cell).agg(F.collect_set(value).alias("_now"))
    met = windows.withColumn("_v", value).join(current, cell).join(verdicts.where("resolved = 0").select(*cell, "iid", "stage", "suggested"), cell)
    near = lambda x: (x["start_min"] == F.col("_v.start_min")) | (x["end_min"] == F.col("_v.end_min")) | ((x["start_min"] < F.col("_v.end_min")) & (F.col("_v.start_min") < x["end_min"]))
    fresh = F.filter(F.array_except("suggested", "_now"), near)
    good = met.where(~F.array_contains("suggested", F.col("_v"))).withColumn("_one", fresh).where(F.size("_one") == 1)
    first = good.groupBy("document_id", "entity").agg(F.min_by(F.struct(F.get("_one", F.lit(0)).alias("v"), "stage"), "iid").alias("_p"))
    source = F.when(F.col("_p.stage") == "parse", "OCR reading").otherwise("majority of resamples")
    return first.select("document_id", "entity", F.col("_p.v.start_min").alias("start_min"), F.col("_p.v.end_min").alias("end_min"), source.alias("source"))


def acknowledge(issues: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """issues after notes (iid, reviewer, comment, at): those with a comment are resolved and stay; and the activities, one a note that counts."""
    fine = notes.where(F.trim(F.coalesce("comment", F.lit(""))) != "").join(issues.select("iid", "document_id", "code"), "iid")
    activity = F.concat_ws("/", F.lit("ack"), F.col("document_id").cast("string"), F.concat_ws("-", F.col("iid").cast("string"), F.col("at").cast("string")))
    done = fine.select("iid").distinct().withColumn("_done", F.lit(True))
    after = issues.join(done, "iid", "left").withColumn("resolved", F.when(F.col("_done") & (F.col("resolved") == 0), 1).otherwise(F.col("resolved"))).drop("_done")
    return after, fine.select(activity.alias("activity"), F.lit("Review").alias("type"), "reviewer", F.trim("comment").alias("comment"), F.col("iid"), F.col("code").alias("issue"))


def _plain(number: Column) -> Column:
    """A number without a point that it doesn't need."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


def rule_sentence(kind: Column, value: Column) -> Column:
    """A rule's value (JSON text, as normalised) in words; what has none stays as it is."""
    bare = F.when(value.startswith('"'), F.get_json_object(value, "$")).otherwise(value)
    h = F.from_json(value, "states array<string>, mode string, exclude array<string>")
    states = F.coalesce(h["states"], F.array().cast("array<string>"))
    joined = F.when(F.size(states) > 0, F.array_join(states, " and ")).otherwise("unspecified states")
    holidays = F.when((h["mode"] == "intersection") & (F.size(states) > 1), F.concat(F.lit("holidays valid in all of "), joined)).otherwise(F.concat(F.lit("public holidays in "), joined))
    holidays = F.when(F.size(F.coalesce(h["exclude"], F.array().cast("array<string>"))) > 0, F.concat(holidays, F.lit(", except "), F.array_join(h["exclude"], ", "))).otherwise(holidays)
    c = F.from_json(value, "`from` string, `to` string")
    day = lambda x: F.concat(F.substring(x, 4, 5), F.lit("."), F.substring(x, 1, 2), F.lit("."))
    christmas = F.when((F.length(c["from"]) > 0) & (F.length(c["to"]) > 0), F.concat(day(c["from"]), F.lit(" to "), day(c["to"]), F.lit(" off-peak"))).otherwise("between Christmas and New Year, dates not stated")
    number = F.coalesce(_plain(bare.try_cast("double")), bare)
    out = F.when(kind == "workdays_only", F.when(bare == "true", "Monday to Friday only").otherwise("every day"))
    for k, text in BRIDGES.items():
        out = out.when((kind == "bridge_days") & (bare == k), text)
    out = out.when((kind == "holiday_handling") & value.startswith("{"), holidays).when((kind == "christmas_period") & value.startswith("{"), christmas)
    for k, unit in UNITS.items():
        out = out.when(kind == k, F.concat(number, F.lit(unit)))
    return out.otherwise(bare)


def cost_estimate(calls: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: cost, the average cost of live calls a real document so far, null before the first."""
    real = documents.where("NOT synthetic").select("document_id")
    live = calls.where("source = 'live'").join(real, "document_id")
    return live.agg(F.round(F.sum("cost_usd") / F.nullif(F.count_distinct("document_id"), F.lit(0)), 3).alias("cost"))


def run_summary(documents: DataFrame, windows: DataFrame, issues: DataFrame, calls: DataFrame) -> DataFrame:
    """documents (document_id, since) with counts of active windows, of those for review and corrected, open errors and warnings, and
    the calls since then: all, live ones, and what live ones cost."""
    w = windows.where("status <> 'rejected'").groupBy("document_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("status") == "needs-review").alias("review"), F.count_if(F.col("origin") == "auto").alias("auto"))
    i = issues.where("resolved = 0").groupBy("document_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    live = F.col("source") == "live"
    c = calls.join(documents.select("document_id", "since"), "document_id").where(F.col("at") >= F.col("since"))
    c = c.groupBy("document_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(live).alias("live_calls"), F.round(F.sum(F.when(live, F.col("cost_usd"))), 4).alias("cost"))
    out = documents
    for part in (w, i, c):
        out = out.join(part, "document_id", "left")
    return out.fillna(0, ["windows", "review", "auto", "errors", "warnings", "calls", "live_calls", "cost"])


def cell_order(level: Column, season: Column) -> list[Column]:
    """To sort by: grid levels as they are numbered, seasons from winter on, anything else last."""
    at = lambda c, values: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), c), F.lit(0)), F.lit(10))
    return [at(level, GRID), at(season, SEASONS)]


def name_findings(documents: DataFrame) -> DataFrame:
    """DSO_NAME_UNGROUNDED and DSO_NAME_FROM_PAGE of documents (document_id, name as read, printed as names.printed_names() gives it), and
    CROSS_CHECK_UNAVAILABLE where vision_note says why the second channel was not read."""
    read = F.trim(F.coalesce("name", F.lit("")))
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    one = lambda when, code, severity, message: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit("extract").alias("stage"), message.alias("message")))
    found = F.array(
        one(F.col("printed").isNull() & (read != ""), "DSO_NAME_UNGROUNDED", "warning", t("The operator name read from the document ('", read, "') is not printed on its pages; check it.")),
        one(F.col("printed") != read, "DSO_NAME_FROM_PAGE", "info", t("The extractor returned '", read, "'; the operator name is taken from the printed line '", F.col("printed"), "'.")),
        one(F.col("vision_note") != "", "CROSS_CHECK_UNAVAILABLE", "info", t("Vision cross-check not run: ", F.col("vision_note"))),
    )
    return documents.select("document_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_f")).select("document_id", "_f.*")
