"""From findings to verdicts and corrections: a table of codes chooses what is asked of a document's readings.

A reading is a struct (windows: array of (level, season, start_min, end_min), empties: array of (level, season)), null if it failed. A
document carries its readings in one row (text, vision, resamples, swap), so each finding is decided in one
pass over arrays, without a join or a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import hhmm
from .attribution import cross_check_verdicts, sane_reading, verdicts, wilson

WINDOW = "struct<level:string,season:string,start_min:int,end_min:int>"
READING = f"struct<windows:array<{WINDOW}>,empties:array<struct<level:string,season:string>>>"
CELL = "array<struct<start_min:int,end_min:int>>"
#: How a finding's code is decided (resampling, a cross-check of channels, or their agreement), and what counts as its
#: symptom where it points at a window and at a cell. Codes that are not here are not decided.
ROUTES = [
    ("GROUNDING_NOT_FOUND", "resample", "present", "equal"),
    ("GROUNDING_VALUE_MISMATCH", "resample", "present", "equal"),
    ("COVERAGE_GAP", "resample", "present", "gap"),
    ("CROSS_CHECK_DISAGREE", "cross_check", "present", "equal"),
    ("TIME_INVALID", "agreement", None, None),
    ("OFF_GRID", "agreement", None, None),
    ("OVERLAP", "agreement", None, None),
    ("DAILY_CAP_EXCEEDED", "agreement", None, None),
]
NOTHING, EMPTY = "nothing (missing)", "an explicit empty cell"


def routed(findings: DataFrame) -> DataFrame:
    """findings (code, target_kind, ...) with route and symptom; findings of other codes, or without a target, drop out."""
    routes = findings.sparkSession.createDataFrame(ROUTES, "code string, route string, _window string, _cell string")
    met = findings.where(F.col("target_kind").isin("window", "cell")).join(F.broadcast(routes), "code")
    return met.withColumn("symptom", F.when(F.col("target_kind") == "window", F.col("_window")).otherwise(F.col("_cell"))).drop("_window", "_cell")


def cell_of(reading: Column, level: Column, season: Column) -> Column:
    """What a reading has in a cell: its different windows in order; null for a failed reading."""
    here = F.filter(reading["windows"], lambda w: w["level"].eqNullSafe(level) & w["season"].eqNullSafe(season))
    return F.array_sort(F.array_distinct(F.transform(here, lambda w: F.struct(w["start_min"].alias("start_min"), w["end_min"].alias("end_min")))))


def _says_empty(reading: Column, level: Column, season: Column) -> Column:
    return F.coalesce(F.exists(reading["empties"], lambda e: e["level"].eqNullSafe(level) & e["season"].eqNullSafe(season)), F.lit(False))


def shows(reading: Column, symptom: Column, level: Column, season: Column, start: Column, end: Column, observed: Column) -> Column:
    """Whether a reading has the symptom: the window is there, the cell has neither windows nor an explicit blank, or the cell is as observed."""
    cell = cell_of(reading, level, season)
    present = F.exists(cell, lambda w: (w["start_min"] == start) & (w["end_min"] == end))
    gap = (F.size(cell) == 0) & ~_says_empty(reading, level, season)
    return F.when(symptom == "present", present).when(symptom == "gap", gap).when(symptom == "equal", cell.eqNullSafe(observed))


def cell_text(cell: Column) -> Column:
    """Windows as text, (empty) without any."""
    told = F.array_join(F.transform(cell, lambda w: F.concat(hhmm(w["start_min"]), F.lit("-"), hhmm(w["end_min"]))), ", ")
    return F.when(F.size(cell) == 0, "(empty)").otherwise(told)


def _state(reading: Column, symptom: Column, level: Column, season: Column) -> Column:
    """What a suggestion says of a reading: its cell, of a gap in words."""
    cell = cell_of(reading, level, season)
    words = F.when(F.size(cell) > 0, F.concat(F.lit("windows "), cell_text(cell))).when(_says_empty(reading, level, season), EMPTY).otherwise(NOTHING)
    return F.when(symptom == "gap", words).otherwise(cell_text(cell))


def _most(values: Column) -> Column:
    """The most common value of an array with its count; of equal counts the first. Null for an empty array."""
    each = F.transform(F.array_distinct(values), lambda v, i: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("_i"), v.alias("value")))
    return F.array_max(each)


def attribute(findings: DataFrame, readings: DataFrame) -> DataFrame:
    """Findings with stage, confidence, method, suggestion, suggested (a cell or null), consensus and the figures of the resamples.

    findings: document_id, iid, code, suspected_stage, target_kind, level, season, start_min, end_min. readings: one row a document_id with
    text, vision, swap (READING), resamples (array of READING) and confounded. Agreement decides only what is blamed on the
    source, and only where vision read the same cell. A cross-check without vision is decided by resampling. Findings that nothing
    decides (other codes, no target, no agreement) have no row; a document without readings is decided as one whose
    every reading failed.
    """
    f = routed(findings).join(readings, "document_id", "left")
    lv, se, s, a, b = (F.col(c) for c in ("level", "season", "symptom", "start_min", "end_min"))
    f = f.withColumn("_t", cell_of(F.col("text"), lv, se)).withColumn("_v", cell_of(F.col("vision"), lv, se)).withColumn("_o", cell_of(F.col("swap"), lv, se))
    good = F.filter(F.coalesce("resamples", F.array().cast(f"array<{READING}>")), lambda r: r.isNotNull())
    # A cross-check asks whether the cell is as the text has it, whatever it points at.
    asked = F.when((F.col("route") == "cross_check") & F.col("vision").isNotNull(), "equal").otherwise(s)
    f = f.withColumn("_asked", asked).withColumn("_good", good).withColumns({
        "n": F.size(F.coalesce("resamples", F.array().cast(f"array<{READING}>"))).cast("long"), "valid": F.size("_good").cast("long"),
        "persisted": F.size(F.filter("_good", lambda r: shows(r, F.col("_asked"), lv, se, a, b, F.col("_t")))).cast("long"),
        "_cells": F.transform("_good", lambda r: cell_of(r, lv, se)), "_states": F.transform("_good", lambda r: _state(r, F.col("_asked"), lv, se)),
        "swap_symptom": F.when(F.col("swap").isNotNull(), shows(F.col("swap"), F.col("_asked"), lv, se, a, b, F.col("_t"))),
    })
    low, high = wilson(F.col("persisted").cast("double"), F.col("valid").cast("double"))
    f = f.withColumns({"p_hat": F.col("persisted") / F.nullif(F.col("valid"), F.lit(0)), "ci_low": low, "ci_high": high, "quorum": (F.col("valid") > 0) & (2 * F.col("valid") >= F.col("n")), "_cell": _most(F.col("_cells")), "_said": _most(F.col("_states"))})
    plain = verdicts(f).withColumn("_gone", ~F.col("swap_symptom")).withColumnsRenamed({"stage": "_stage", "confidence": "_confidence"})
    crossed = plain.withColumnsRenamed({"text": "_text", "vision": "_vision"}).withColumns({"text": F.col("_t"), "vision": F.col("_v"), "ocr": F.col("_o"), "modal": F.col("_cell.value"), "modal_n": F.col("_cell.n")})
    crossed = cross_check_verdicts(crossed).withColumnsRenamed({"stage": "_xstage", "confidence": "_xconfidence", "consensus": "_x"}).drop("text", "vision").withColumnsRenamed({"_text": "text", "_vision": "vision"})
    cross, agree = (F.col("route") == "cross_check") & F.col("vision").isNotNull(), F.col("route") == "agreement"
    consensus = cross & F.coalesce("_x", F.lit(False))
    agreed = agree & (F.col("suspected_stage") == "source_document") & F.col("_v").isNotNull() & F.col("_t").eqNullSafe(F.col("_v"))
    alone = F.col("swap").isNull() | F.coalesce("confounded", F.lit(False))
    stage = F.when(agree, "source_document").when(cross, F.col("_xstage")).otherwise(F.col("_stage"))
    swapped = (cross & ~alone) | (F.col("swap").isNotNull() & (F.col("p_hat") >= 0.6))
    method = F.when(agree, "channel_agreement").when(swapped, "resample+swap").otherwise("resample")
    own = F.concat(F.lit("resamples read "), F.col("_said.value"), F.lit(" ("), F.col("_said.n"), F.lit("/"), F.col("valid"), F.lit(")"))
    by_resamples = ~agree & ~(cross & ~alone) & (F.col("p_hat") < 0.6)
    by_swap = ~agree & ~(cross & ~alone) & (F.col("p_hat") >= 0.6) & F.col("swap").isNotNull() & F.col("_gone")
    suggestion = F.when(consensus, F.concat(F.lit("OCR and vision read "), cell_text(F.col("_v")))).when(by_resamples, own).when(by_swap, F.concat(F.lit("OCR reading: "), _state(F.col("swap"), F.col("_asked"), lv, se)))
    is_cell = F.col("_asked") != "gap"  # a gap's state is words
    suggested = F.when(consensus, F.col("_v")).when(by_resamples & (F.col("p_hat") <= 0.4) & is_cell, F.col("_cell.value")).when(by_swap & is_cell, F.col("_o"))
    out = crossed.where(~agree | agreed).withColumns({"stage": stage, "confidence": F.when(agree, "high").when(cross, F.col("_xconfidence")).otherwise(F.col("_confidence")), "method": method, "suggestion": suggestion, "suggested": suggested, "consensus": consensus})
    figures = [F.when(~agree, F.col(c)).alias(c) for c in ("n", "valid", "persisted", "p_hat")]
    return out.select("document_id", "iid", "code", "target_kind", "level", "season", "route", "stage", "confidence", "method", "suggestion", "suggested", "consensus", *figures)


def decide_corrections(verdicts_: DataFrame, printed: DataFrame) -> DataFrame:
    """One decision for each disputed cell that two readings agree on: what is set, with its evidence, or why not.

    verdicts_: rows of attribute(). printed: document_id, level, season, start_min, end_min, channel (vision, swap), page, quote, found,
    consistent, aligned; where a value of the agreed reading is printed. Each value's evidence is the vision reading's quote if it is on its
    page with these times and in this cell (not aligned elsewhere), else, if the parse is at fault, the swapped one's. Gives
    document_id, iid, level, season, suggested, applied, reason (null if applied) and evidence, an array by start of (start_min, end_min, channel,
    page, quote). A reading that breaks a time rule, or a value without evidence, leaves the cell to a person.
    """
    asked = verdicts_.where((F.col("code") == "CROSS_CHECK_DISAGREE") & (F.col("target_kind") == "cell") & F.col("consensus"))
    asked = asked.select("document_id", "iid", "level", "season", "stage", "suggested")
    sane = sane_reading(F.col("suggested"))
    fine = F.col("found") & F.coalesce("consistent", F.lit(True)) & ((F.col("channel") == "swap") | F.coalesce("aligned", F.lit(True)))
    proof = F.struct(F.when(F.col("channel") == "vision", 0).otherwise(1).alias("rank"), "channel", "page", "quote")
    best = printed.where(fine).groupBy("document_id", "level", "season", "start_min", "end_min", "channel").agg(F.min(proof).alias("proof"))
    each = asked.withColumn("_w", F.explode_outer("suggested"))
    keys = [each["document_id"].eqNullSafe(best["document_id"]), each["level"] == best["level"], each["season"] == best["season"], each["_w"]["start_min"] == best["start_min"], each["_w"]["end_min"] == best["end_min"]]
    keys.append((best["channel"] == "vision") | (each["stage"] == "parse"))
    met = each.join(best, keys, "left").select(each["*"], best["proof"])
    one = met.groupBy("document_id", "iid", "level", "season", "stage", "suggested", "_w").agg(F.min("proof").alias("proof"))
    evidence = F.struct(F.col("_w.start_min").alias("start_min"), F.col("_w.end_min").alias("end_min"), F.col("proof.channel").alias("channel"), F.col("proof.page").alias("page"), F.col("proof.quote").alias("quote"))
    lone = F.min(F.when(F.col("_w").isNotNull() & F.col("proof").isNull(), F.col("_w")))
    out = one.groupBy("document_id", "iid", "level", "season", "suggested").agg(F.sort_array(F.collect_list(F.when(F.col("_w").isNotNull(), evidence))).alias("evidence"), lone.alias("_lone"))
    missing = F.concat(hhmm(F.col("_lone.start_min")), F.lit("-"), hhmm(F.col("_lone.end_min")), F.lit(" is not printed with these times in the "), F.col("level"), F.lit(" "), F.col("season"), F.lit(" cell of the text layer"))
    reason = F.when(~sane, "the agreed reading breaks a time rule").when(F.col("_lone").isNotNull(), missing)
    return out.withColumn("reason", reason).withColumn("applied", F.col("reason").isNull()).withColumn("evidence", F.when(F.col("applied"), F.col("evidence"))).select("document_id", "iid", "level", "season", "suggested", "applied", "reason", "evidence")


def correct(windows: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new revisions, their provenance and the changed issues of decisions (decide_corrections()) over current windows.

    windows: document_id, entity, level, season, start_min, end_min, revision, status. A value in both stays as it is but for its status. An old
    value becomes the new one that shares a bound with it or overlaps it, each taking the first left in order of start; what is
    left over is rejected, or added as a window of revision 1. Revisions: the same columns with origin and previous (the entity
    revised, null for a new one). Provenance: entity, relation (revision, derived), other. Issues: document_id, iid, resolved 2, comment.
    """
    from .revisions import base_entity, reconcile_cells

    cell = ["document_id", "level", "season"]
    applied = decisions.where("applied")
    come = applied.select(*cell, F.explode("suggested").alias("_w")).select(*cell, "_w.start_min", "_w.end_min").distinct()
    old = windows.join(applied.select(*cell).distinct(), cell, "left_semi")
    changes = reconcile_cells(old.select(*cell, "start_min", "end_min"), come, cell)
    met = changes.join(old.select(*cell, "start_min", "end_min", "entity", "revision"), [*cell, "start_min", "end_min"], "left")
    kept = F.col("change").isin("keep", "reject")
    fresh = F.concat_ws("/", F.lit("window"), *[F.col(c).cast("string") for c in (*cell, "new_start", "new_end")])
    number = F.coalesce(F.col("revision"), F.lit(0)) + 1
    entity = F.when(F.col("change") == "add", F.concat(fresh, F.lit("@auto"))).otherwise(F.concat(base_entity(F.col("entity")), F.lit("@r"), number.cast("string")))
    revisions = met.select(*cell, entity.alias("entity"), F.when(kept, F.col("start_min")).otherwise(F.col("new_start")).alias("start_min"), F.when(kept, F.col("end_min")).otherwise(F.col("new_end")).alias("end_min"),
        number.cast("int").alias("revision"), F.when(F.col("change") == "reject", "rejected").otherwise("auto-corrected").alias("status"), F.lit("auto").alias("origin"), F.col("entity").alias("previous"))
    issue = F.concat_ws("/", F.lit("issue"), F.col("document_id").cast("string"), F.col("iid").cast("string"))
    of_issue = revisions.join(applied.select(*cell, issue.alias("other")), cell)
    provenance = revisions.where("previous IS NOT NULL").select("entity", F.lit("revision").alias("relation"), F.col("previous").alias("other")).unionByName(of_issue.select("entity", F.lit("derived").alias("relation"), "other"))
    said = F.concat(F.lit("Auto-corrected to "), cell_text(F.col("suggested")), F.lit(": OCR and vision agree, and every value is printed in this cell."))
    issues = applied.select("document_id", "iid", F.lit(2).alias("resolved"), said.alias("comment"))
    return revisions, provenance, issues
