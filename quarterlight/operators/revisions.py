"""Revisioned facts and review: append-only events folded to the current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_time

UNDECIDED = ("auto-ok", "needs-review", "auto-corrected")
DECISIONS = {"approve": "verified", "edit": "edited", "reject": "rejected"}


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key; a key's rows are reduced in the tasks that read them, before they are dealt."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def current(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """The facts that hold now: the highest revision of each, unless it was rejected."""
    return latest(revisions, keys, F.desc("revision")).where(F.col("status") != "rejected")


def base_entity(entity: Column) -> Column:
    return F.substring_index(entity, "@", 1)


def decision_problem(action: Column, comment: Column, start: Column, end: Column, old_start: Column, old_end: Column) -> Column:
    """Why a review of a window is refused, null if it stands. Times are HH:MM, null keeps the old one."""
    s, e = F.when(start.isNull(), old_start).otherwise(parse_time(start)), F.when(end.isNull(), old_end).otherwise(parse_time(end))
    edit = action == "edit"
    return (
        F.when(action.isNull() | ~action.isin(*DECISIONS), "unknown action")
        .when(action.isin("edit", "reject") & (F.trim(F.coalesce(comment, F.lit(""))) == ""), "comment missing")
        .when(edit & (s.isNull() | e.isNull()), "not a clock time")
        .when(edit & ~((s >= 0) & (s < e) & (e <= 1440) & (s % 15 == 0) & (e % 15 == 0)), "not a window on the grid")
        .when(edit & (s == old_start) & (e == old_end), "no change")
    )


def apply_reviews(windows: DataFrame, events: DataFrame) -> DataFrame:
    """New revisions from each current window's first valid event (entity, action, comment, start, end, at)."""
    met = windows.join(events, "entity")
    met = met.withColumn("problem", decision_problem(*(F.col(c) for c in ("action", "comment", "start", "end", "start_min", "end_min")))).where("problem IS NULL")
    met = latest(met, ["entity"], F.asc("at"))
    status = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])[F.col("action")]
    edit = F.col("action") == "edit"
    new = {
        "start_min": F.when(edit, F.coalesce(parse_time(F.col("start")), "start_min")).otherwise(F.col("start_min")),
        "end_min": F.when(edit, F.coalesce(parse_time(F.col("end")), "end_min")).otherwise(F.col("end_min")),
        "status": status,
        "revision": F.col("revision") + 1,
        "entity": F.concat(base_entity(F.col("entity")), F.lit("@r"), (F.col("revision") + 1).cast("string")),
    }
    return met.withColumns(new).select(*windows.columns)


def reflag(windows: DataFrame, open_targets: DataFrame) -> DataFrame:
    """Status of undecided windows again: flagged ones need review, corrected ones stay corrected, the rest are fine."""
    flagged = open_targets.select("target").distinct().withColumn("_f", F.lit(True))
    w = windows.join(flagged, windows["target"] == flagged["target"], "left").drop(flagged["target"])
    again = F.when(F.col("_f").isNotNull(), "needs-review").when(F.col("origin") == "auto", "auto-corrected").otherwise("auto-ok")
    return w.withColumn("status", F.when(F.col("status").isin(*UNDECIDED), again).otherwise(F.col("status"))).drop("_f")


def document_status(documents: DataFrame, issues: DataFrame, windows: DataFrame) -> DataFrame:
    """needs-review, caveats, verified or auto-ok for each document.

    Open issues block if they are errors, have a target or aren't blamed on the source; others are caveats.
    Verified takes at least one window and none undecided.
    """
    blocks = (F.col("severity") == "error") | F.col("target").isNotNull() | (F.col("stage") != "source_document")
    i = issues.where("resolved = 0 AND severity <> 'info'").groupBy("document_id").agg(F.count_if(blocks).alias("_block"), F.count(F.lit(1)).alias("_open"))
    w = windows.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status").isin(*UNDECIDED)).alias("_u"))
    out = documents.join(i, "document_id", "left").join(w, "document_id", "left")
    status = F.when(F.col("_block") > 0, "needs-review").when(F.col("_open") > 0, "caveats").when((F.col("_n") > 0) & (F.col("_u") == 0), "verified").otherwise("auto-ok")
    return out.withColumn("doc_status", status).drop("_block", "_open", "_n", "_u")


def reconcile_cells(current_cells: DataFrame, readings: DataFrame, keys: list[str]) -> DataFrame:
    """Sets cells to a reading: one row (keys, change, start_min, end_min, new_start, new_end) for each value.

    Values in both are kept; a value that goes and one that comes form a revision if they share a bound or overlap,
    each old value taking the first such new one in order of start; what is left is rejected or added. A cell
    holds a few windows of one day: they come together as two arrays, over which the old ones are folded.
    """
    value = F.struct(F.col("start_min").cast("int").alias("a"), F.col("end_min").cast("int").alias("b"))
    both = current_cells.select(*keys, value.alias("_w"), F.lit(False).alias("_new")).unionByName(readings.select(*keys, value.alias("_w"), F.lit(True).alias("_new")))
    of = lambda new: F.sort_array(F.collect_set(F.when(F.col("_new") == new, F.col("_w"))))
    cells = both.groupBy(*keys).agg(of(False).alias("_old"), of(True).alias("_come"))
    none = F.lit(None).cast("int")

    def row(change, start, end, new_start, new_end):
        return F.struct(F.lit(change).alias("change"), start.alias("start_min"), end.alias("end_min"), new_start.alias("new_start"), new_end.alias("new_end"))

    def fold(state, x):
        near = F.filter(state["come"], lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"]) | ((y["a"] < x["b"]) & (x["a"] < y["b"])))
        first = F.get(near, F.lit(0))
        out = F.when(F.size(near) > 0, row("revise", x["a"], x["b"], first["a"], first["b"])).otherwise(row("reject", x["a"], x["b"], none, none))
        return F.struct(F.filter(state["come"], lambda y: ~y.eqNullSafe(first)).alias("come"), F.concat(state["out"], F.array(out)).alias("out"))

    kept = F.transform(F.array_intersect("_old", "_come"), lambda x: row("keep", x["a"], x["b"], x["a"], x["b"]))
    gone = F.sort_array(F.array_except("_old", "_come"))
    start = F.struct(F.sort_array(F.array_except("_come", "_old")).alias("come"), F.array().cast("array<struct<change:string,start_min:int,end_min:int,new_start:int,new_end:int>>").alias("out"))
    cells = cells.select(*keys, kept.alias("_kept"), F.aggregate(gone, start, fold).alias("_s"))
    added = F.transform("_s.come", lambda y: row("add", none, none, y["a"], y["b"]))
    return cells.select(*keys, F.explode(F.concat("_kept", "_s.out", added)).alias("_r")).select(*keys, "_r.*")
