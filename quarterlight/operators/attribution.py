"""Which stage is at fault: resampling statistics, majority readings and the ladders of verdicts, on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96
KEEPS, ESCAPES = 0.6, 0.4


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the 95 % score interval; (0, 1) without trials."""
    n = F.nullif(n, F.lit(0.0))
    p = successes / n
    scale = 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / scale, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0))


def majority(readings: DataFrame, keys: list[str], reading: str, order: str) -> DataFrame:
    """The most common reading of each key with its count; of equal counts the one that came first."""
    n = readings.groupBy(*keys, reading).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "_first"))
    return n.withColumn("_r", best).where("_r = 1").drop("_r", "_first")


def resample_statistics(samples: DataFrame, keys: list[str]) -> DataFrame:
    """samples (keys, valid, symptom) as n, valid, persisted, p_hat, ci_low, ci_high, quorum."""
    out = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & F.col("symptom")).alias("persisted"))
    low, high = wilson(F.col("persisted").cast("double"), F.col("valid").cast("double"))
    return out.withColumns({"p_hat": F.col("persisted") / F.nullif(F.col("valid"), F.lit(0)), "ci_low": low, "ci_high": high, "quorum": 2 * F.col("valid") >= F.col("n")})


def verdicts(stats: DataFrame, cross_check: bool = False) -> DataFrame:
    """stats with swap_symptom (null: no second parse) and confounded, as stage and confidence.

    The symptom mostly gone on resampling: extract. Between the thresholds, or without a second parse:
    inconclusive. Gone with the second parse: parse. Else the source says it, or in a cross-check the vision
    channel misread.
    """
    p = F.col("p_hat")
    low, mid = p <= ESCAPES, (p > ESCAPES) & (p < KEEPS)
    half = (F.col("ci_low") > 0.5) | (F.col("ci_high") < 0.5)
    sure = F.when(half & F.col("quorum"), "high").when(F.col("quorum"), "medium").otherwise("low")
    capped = F.when(F.coalesce("confounded", F.lit(False)) & (sure == "high"), "medium").otherwise(sure)
    stage = F.when(p.isNull() | mid, "inconclusive").when(low, "extract").when(F.col("swap_symptom").isNull(), "inconclusive").when(~F.col("swap_symptom"), "parse").otherwise("vision_misread" if cross_check else "source_document")
    confidence = F.when(stage == "inconclusive", "low").when(low, sure).otherwise(capped)
    return stats.withColumns({"stage": stage, "confidence": confidence})


def cross_check_verdicts(stats: DataFrame) -> DataFrame:
    """stats with readings text, vision, ocr (null or confounded: none) and modal, modal_n, as stage, confidence, consensus.

    OCR and vision agree against the text: extract if the resamples settle on their reading, else parse. OCR and
    text agree: vision misread. Three readings: inconclusive. Without an independent OCR, resampling decides.
    """
    t, v, o, p = (F.col(c) for c in ("text", "vision", "ocr", "p_hat"))
    stable = F.coalesce(F.col("modal_n") / F.nullif(F.col("valid"), F.lit(0)) >= KEEPS, F.lit(False))
    ov, ot = o.eqNullSafe(v), o.eqNullSafe(t)
    alone = o.isNull() | F.coalesce("confounded", F.lit(False))
    settled = F.coalesce((p <= ESCAPES) & stable & F.col("modal").eqNullSafe(v), F.lit(False))
    plain = verdicts(stats.withColumn("swap_symptom", F.when(o.isNotNull(), ot)), cross_check=True)
    stage = F.when(alone, F.col("stage")).when(ov & ~ot & settled, "extract").when(ov & ~ot, "parse").when(ot & ~ov, "vision_misread").otherwise("inconclusive")
    keeps = F.coalesce(p >= KEEPS, F.lit(False))
    strong = F.when(ov & settled, F.col("quorum") & (F.col("ci_high") < 0.5)).when(ov, F.col("quorum") & (~stable | keeps)).otherwise(F.col("quorum") & keeps)
    confidence = F.when(alone, F.col("confidence")).when(stage == "inconclusive", "low").when(strong, "high").otherwise("medium")
    return plain.withColumns({"consensus": ~alone & ov & ~ot, "_s": stage, "_c": confidence}).withColumns({"stage": F.col("_s"), "confidence": F.col("_c")}).drop("_s", "_c")


def channel_agreement(text: Column, vision: Column) -> Column:
    """source_document where two channels read the same, null where there is nothing to say."""
    return F.when(vision.isNotNull() & text.eqNullSafe(vision), "source_document")


def sane_reading(cell: Column, cap: int = 600) -> Column:
    """A cell's sorted array of (start_min, end_min): in range, on the grid, without overlap, within the cap."""
    one = F.forall(cell, lambda x: (x["start_min"] >= 0) & (x["start_min"] < x["end_min"]) & (x["end_min"] <= 1440) & (x["start_min"] % 15 == 0) & (x["end_min"] % 15 == 0))
    apart = F.forall(F.zip_with(F.slice(cell, 1, F.greatest(F.size(cell) - 1, F.lit(0))), F.slice(cell, 2, F.greatest(F.size(cell) - 1, F.lit(0))), lambda a, b: a["end_min"] <= b["start_min"]), lambda x: x)
    return one & apart & (F.aggregate(cell, F.lit(0), lambda a, x: a + x["end_min"] - x["start_min"]) <= cap)


def consensus_corrections(cells: DataFrame) -> DataFrame:
    """Cells (code, consensus, suggested, printed: its values that the cell prints) that are corrected without a person."""
    all_printed = F.size(F.array_except("suggested", "printed")) == 0
    return cells.where((F.col("code") == "CROSS_CHECK_DISAGREE") & F.col("consensus") & sane_reading(F.col("suggested")) & all_printed)
