"""Rules of data quality over windows: each gives findings (code, severity, stage, target, message).

Each rule is one filtered projection; findings() is their union. windows: document_id, level, season, start_min,
end_min and, where grounding ran, grounded, consistent, aligned (null: not determined), page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import QUARTER, SEASONS, hhmm

DAY_CAP = 600
CELL = ("document_id", "level", "season")
FIELDS = ("document_id", "code", "severity", "stage", "target", "message")


def finding(code: str, severity: str, stage: str | Column, target: Column, message: Column) -> list[Column]:
    return [F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(stage) if isinstance(stage, str) else stage).alias("stage"), target.alias("target"), message.alias("message")]


def span() -> Column:
    return F.concat_ws("-", hhmm(F.col("start_min")), hhmm(F.col("end_min")))


def target() -> Column:
    return F.concat_ws("/", "level", "season", span())


def blame() -> Column:
    """The printed source, if nothing speaks against the reading: a null is not a no."""
    good = lambda c: F.coalesce(F.col(c), F.lit(True))
    return F.when(good("grounded") & good("consistent") & good("aligned"), "source_document").otherwise("extract")


def time_findings(windows: DataFrame) -> DataFrame:
    """TIME_INVALID and OFF_GRID."""
    bad = ~((F.col("start_min") >= 0) & (F.col("start_min") < F.col("end_min")) & (F.col("end_min") <= 1440))
    off = (F.col("start_min") % QUARTER != 0) | (F.col("end_min") % QUARTER != 0)
    a = windows.where(bad).select("document_id", *finding("TIME_INVALID", "error", blame(), target(), F.concat(span(), F.lit(" is no window of a day"))))
    b = windows.where(off).select("document_id", *finding("OFF_GRID", "error", blame(), target(), F.concat(span(), F.lit(" is off the quarter-hour grid"))))
    return a.unionByName(b)


def neighbours(windows: DataFrame, *keys: str) -> DataFrame:
    """windows with the one before in the same cell, by start and end: _start, _end, _well (it is well formed) and _blame."""
    before = F.lag(F.struct("start_min", "end_min", blame().alias("blame"))).over(Window.partitionBy(*keys).orderBy("start_min", "end_min"))
    out = windows.withColumn("_b", before)
    return out.withColumns({"_start": F.col("_b.start_min"), "_end": F.col("_b.end_min"), "_blame": F.col("_b.blame")}).withColumn("_well", F.col("_start") < F.col("_end")).drop("_b")


def neighbour_findings(windows: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """DUPLICATE_WINDOW and OVERLAP of each window with the one before, not of all pairs. The source is to blame for an
    overlap if nothing speaks against the reading of either window."""
    n = neighbours(windows, *keys)
    same = (F.col("_start") == F.col("start_min")) & (F.col("_end") == F.col("end_min"))
    over = ~same & (F.col("_end") > F.col("start_min")) & F.col("_well")
    a = n.where(same).select("document_id", *finding("DUPLICATE_WINDOW", "warning", "extract", target(), F.concat(span(), F.lit(" twice"))))
    both = F.when((blame() == "source_document") & (F.col("_blame") == "source_document"), "source_document").otherwise("extract")
    b = n.where(over).select("document_id", *finding("OVERLAP", "error", both, target(), F.concat(span(), F.lit(" begins before "), hhmm(F.col("_end")))))
    return a.unionByName(b)


def grounding_findings(windows: DataFrame, pages: DataFrame) -> DataFrame:
    """GROUNDING_NOT_FOUND, GROUNDING_VALUE_MISMATCH, CELL_MISALIGNED; pages: document_id, page, text_layer, source."""
    read = pages.select("document_id", "page", (~((F.col("text_layer") == "ok") & (F.col("source") == "text_layer"))).alias("_unsafe"))
    w = windows.join(read, ["document_id", "page"], "left")
    lost = F.when(F.coalesce("_unsafe", F.lit(True)), "parse").otherwise("extract")
    rules = [
        (~F.col("grounded"), finding("GROUNDING_NOT_FOUND", "error", lost, target(), F.lit("its quote is not on the page"))),
        (~F.col("consistent"), finding("GROUNDING_VALUE_MISMATCH", "error", "extract", target(), F.lit("it says other times than its quote"))),
        (~F.col("aligned"), finding("CELL_MISALIGNED", "warning", "extract", target(), F.lit("its quote is in another cell"))),
    ]
    return union([w.where(c).select("document_id", *f) for c, f in rules])


def coverage_findings(listed: DataFrame, windows: DataFrame, empties: DataFrame, vision: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """COVERAGE_GAP for listed (document_id, level) without windows or an empty cell in a season; LEVEL_NOT_LISTED.

    vision: the second reading's documents (document_id), windows and empty cells. Where it was read and has no window in a
    cell either, the cell is empty.
    """
    cells = listed.select("document_id", "level", F.explode(F.array(*[F.lit(s) for s in SEASONS])).alias("season"))
    there = windows.select(*CELL).unionByName(empties.select(*CELL)).distinct()
    where = F.concat_ws("/", "level", "season")
    if vision is not None:
        read, seen, blank = vision
        unseen = cells.join(read.select("document_id").distinct(), "document_id", "left_semi").join(seen.select(*CELL).distinct(), list(CELL), "left_anti")
        there = there.unionByName(blank.select(*CELL)).unionByName(unseen.select(*CELL)).distinct()
    gaps = cells.join(there, list(CELL), "left_anti").select("document_id", *finding("COVERAGE_GAP", "warning", "extract", where, F.lit("neither windows nor an empty cell")))
    extra = windows.select("document_id", "level").distinct().join(listed, ["document_id", "level"], "left_anti")
    return gaps.unionByName(extra.select("document_id", *finding("LEVEL_NOT_LISTED", "info", "extract", F.col("level"), F.lit("windows for a level that isn't listed"))))


def cap_findings(windows: DataFrame, cap: int = DAY_CAP, keys: tuple[str, ...] = CELL) -> DataFrame:
    """DAILY_CAP_EXCEEDED where a cell's minutes sum to more than the cap; one doubtful window makes it the reading's."""
    minutes = F.sum(F.greatest(F.lit(0), F.col("end_min") - F.col("start_min"))).alias("minutes")
    total = windows.groupBy(*keys).agg(minutes, F.bool_and(blame() == "source_document").alias("_printed"))
    stage = F.when(F.col("_printed"), "source_document").otherwise("extract")
    return total.where(F.col("minutes") > cap).select("document_id", *finding("DAILY_CAP_EXCEEDED", "warning", stage, F.concat_ws("/", "level", "season"), F.concat(F.col("minutes").cast("string"), F.lit(" minutes a day"))))


def cell_sets(readings: DataFrame, name: str, keys: tuple[str, ...] = CELL) -> DataFrame:
    """One sorted array of distinct (start, end) for each cell."""
    return readings.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start_min", "end_min"))).alias(name))


def cross_channel_findings(text: DataFrame, vision: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """CROSS_CHECK_DISAGREE for cells that two channels read as different sets; a cell missing on one side is empty."""
    both = cell_sets(text, "a", keys).join(cell_sets(vision, "b", keys), list(keys), "full_outer")
    none = F.array().cast("array<struct<start_min:int,end_min:int>>")
    differ = ~F.coalesce("a", none).eqNullSafe(F.coalesce("b", none))
    return both.where(differ).select("document_id", *finding("CROSS_CHECK_DISAGREE", "warning", "extract", F.concat_ws("/", "level", "season"), F.lit("the channels read this cell differently")))


def label_findings(raw: DataFrame) -> DataFrame:
    """What could not be mapped: raw has level_label, season_label, level, season, start_min, end_min."""
    rules = [
        (F.col("level").isNull(), "LEVEL_UNMAPPED", "normalize", F.col("level_label")),
        (F.col("level").isNotNull() & F.col("season").isNull(), "SEASON_UNMAPPED", "normalize", F.col("season_label")),
        (F.col("level").isNotNull() & F.col("season").isNotNull() & (F.col("start_min").isNull() | F.col("end_min").isNull()), "TIME_UNPARSEABLE", "extract", F.concat_ws("/", "level", "season")),
    ]
    return union([raw.where(c).select("document_id", *finding(code, "error", stage, t, F.lit("its label or time has no meaning here"))) for c, code, stage, t in rules])


def empty_cell_findings(raw: DataFrame) -> DataFrame:
    """EMPTY_CELL_UNMAPPED: cells said to be empty (level_label, season_label, level, season) that are none of the table's."""
    lost = raw.where(F.col("level").isNull() | F.col("season").isNull())
    return lost.select("document_id", *finding("EMPTY_CELL_UNMAPPED", "warning", "normalize", F.concat_ws("/", "level_label", "season_label"), F.lit("an empty cell without a meaning here")))


def document_findings(documents: DataFrame) -> DataFrame:
    """Findings on documents: convention, year, name, correction, page and rule state.

    documents: document_id, convention, registry_year, page_year, correction_note, upload, same_name, n_windows, n_empty, and
    year_grounded where the year's quote was looked for: without it on the page the year is the reading's to answer for.
    """
    t = F.col("document_id").cast("string")
    printed = F.coalesce(F.col("year_grounded"), F.lit(True)) if "year_grounded" in documents.columns else F.lit(True)
    rules = [
        (F.col("convention") == "assumed", finding("CONVENTION_ASSUMED", "warning", "source_document", t, F.lit("the meter's time stamps are not explained"))),
        (F.col("convention") == "interval_end_ambiguous", finding("CONVENTION_AMBIGUOUS", "warning", "source_document", t, F.lit("interval ends without an example"))),
        (F.col("page_year") != F.col("registry_year"), finding("YEAR_MISMATCH", "error", F.when(printed, "source_document").otherwise("extract"), t, F.lit("the page names another year"))),
        (~printed, finding("YEAR_UNGROUNDED", "warning", "extract", t, F.lit("the year's quote is not on the page"))),
        (F.col("upload") & ~F.col("same_name"), finding("DSO_MISMATCH", "warning", "source_document", t, F.lit("the page names another operator"))),
        (F.col("upload") & (F.col("n_windows") + F.col("n_empty") == 0), finding("NO_WINDOW_TABLE", "error", "source_document", t, F.lit("no table was found"))),
        (F.length(F.trim("correction_note")) > 0, finding("CORRECTION_NOTED", "info", "source_document", t, F.col("correction_note"))),
    ]
    return union([documents.where(c).select("document_id", *f) for c, f in rules])


def page_findings(pages: DataFrame) -> DataFrame:
    unread = (F.col("text_layer") != "ok") & (F.col("source") != "ocr")
    return pages.where(unread).select("document_id", *finding("PAGE_UNREADABLE", "error", "parse", F.concat(F.lit("page "), F.col("page").cast("string")), F.concat(F.lit("text layer is "), F.col("text_layer"))))


def rule_findings(rules: DataFrame) -> DataFrame:
    """rules: document_id, kind, resolved, grounded, problem."""
    named = [
        (F.col("problem").isNotNull(), finding("RULE_VALUE_INVALID", "warning", "extract", F.col("kind"), F.col("problem"))),
        (F.col("problem").isNull() & ~F.col("resolved"), finding("RULE_AMBIGUOUS", "warning", "source_document", F.col("kind"), F.lit("the rule can't be turned into dates"))),
        (~F.col("grounded"), finding("RULE_UNGROUNDED", "warning", "extract", F.col("kind"), F.lit("its quote is not on the page"))),
    ]
    return union([rules.where(c).select("document_id", *f) for c, f in named])


def anomaly_findings(documents: DataFrame) -> DataFrame:
    each = documents.select("document_id", F.explode("anomalies").alias("_a"))
    return each.select("document_id", *finding("MODEL_ANOMALY", "info", "extract", F.col("document_id").cast("string"), F.col("_a")))


def version_findings(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """YOY_DRIFT and SUPERSEDES: a version whose cells differ from the one before (documents: document_id, dso, synthetic,
    year, publication_date; windows with CELL keys)."""
    order = Window.partitionBy("dso", "synthetic").orderBy("year", F.coalesce("publication_date", F.lit("")), "document_id")
    pairs = documents.withColumns({"old": F.lag("document_id").over(order), "old_year": F.lag("year").over(order)}).where("old IS NOT NULL")
    cells = cell_sets(windows, "cells")
    new = pairs.join(cells, "document_id").select("document_id", "old", "level", "season", "cells")
    old = pairs.select("document_id", "old").join(cells.withColumnRenamed("document_id", "old").withColumnRenamed("cells", "was"), "old")
    met = new.join(old, ["document_id", "old", "level", "season"], "full_outer").where(~F.col("cells").eqNullSafe(F.col("was")))
    count = met.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.join(count, "document_id")
    code = F.when(F.col("year") == F.col("old_year"), "SUPERSEDES").otherwise("YOY_DRIFT")
    return out.select("document_id", code.alias("code"), F.lit("info").alias("severity"), F.lit("source_document").alias("stage"), F.col("old").cast("string").alias("target"), F.concat(F.col("n").cast("string"), F.lit(" cells differ")).alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*FIELDS) for p in parts])


def histogram(findings: DataFrame) -> DataFrame:
    """How many by severity and code, errors first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return findings.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n")).orderBy(rank, F.desc("n"), "code")
