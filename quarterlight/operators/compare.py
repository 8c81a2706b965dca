"""Versions and snapshots against each other, evaluation against labels, summaries and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: USD per million tokens (fresh input, cached input, output) are given by the caller.
UNDECIDED = ("auto-ok", "needs-review", "auto-corrected")


def pick_latest(documents: DataFrame, keys: list[str]) -> DataFrame:
    """One document for each key: real before synthetic, then the latest publication date, then the largest id."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc("synthetic"), F.desc(F.coalesce("publication_date", F.lit(""))), F.desc("document_id")))
    return documents.withColumn("_r", best).where("_r = 1").drop("_r")


def find_documents(documents: DataFrame, asked: str) -> DataFrame:
    """Case-blind: an exact id or name finds all of the same operator and kind, else parts of names and starts of ids."""
    q = asked.strip().lower()
    name, id_ = F.lower("dso"), F.lower("document_id")
    exact = documents.where((name == q) | (id_ == q)).select("dso", "synthetic").distinct()
    wide = documents.join(F.broadcast(exact), ["dso", "synthetic"], "left_semi")
    partial = documents.where(name.contains(q) | id_.startswith(q)).join(exact.limit(1).select(F.lit(True).alias("_any")), F.lit(True), "left_anti")
    return wide.unionByName(partial)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, before, after and change (added, removed, changed, unchanged) of two keyed tables; a null value is a value."""
    a = old.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    both = a.join(b, [a[k].eqNullSafe(b[k]) for k in keys], "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed")
    return both.select(*[F.coalesce(a[k], b[k]).alias(k) for k in keys], "before", "after", change.alias("change"))


def last_rules(rules: DataFrame) -> DataFrame:
    """One value for each (kind, level), the last by rule id."""
    return rules.groupBy("kind", "level").agg(F.max_by("value", "rule_id").alias("value"))


def canonical_rule(value: Column) -> Column:
    """JSON text to compare rule values by: numbers as doubles, keys as they come from a sorted writer."""
    n = value.try_cast("double")
    return F.when(n.isNotNull(), n.cast("string")).otherwise(F.regexp_replace(value, r"\s*([:,{}\[\]])\s*", "$1"))


def precision_recall(found: DataFrame, gold: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, tp, n_found, n_gold, precision and recall of distinct keys.

    Nothing found: precision 0. No gold: recall 1 if nothing was found either, else 0.
    """
    f, g = found.select(*by, *keys).distinct(), gold.select(*by, *keys).distinct()
    all_ = f.withColumn("_f", F.lit(1)).join(g.withColumn("_g", F.lit(1)), [*by, *keys], "full_outer")
    out = all_.groupBy(*by).agg(F.count_if(F.col("_f").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count("_f").alias("n_found"), F.count("_g").alias("n_gold"))
    return out.withColumns({
        "precision": F.when(F.col("n_found") == 0, 0.0).otherwise(F.col("tp") / F.col("n_found")),
        "recall": F.when(F.col("n_gold") > 0, F.col("tp") / F.col("n_gold")).when(F.col("n_found") == 0, 1.0).otherwise(0.0),
    })


def exact_cells(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and how many of them hold the same set of (start_min, end_min)."""
    s = lambda df, n: df.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start_min", "end_min"))).alias(n))
    both = s(found, "a").join(s(gold, "b"), keys, "full_outer")
    return both.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("exact"))


def review_share(windows: DataFrame, by: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return windows.groupBy(*by).agg((F.count_if(F.col("status") == "needs-review") / n).alias("review_share"))


def token_cost(fresh: Column, cached: Column, output: Column, prices: tuple[float, float, float] | None) -> Column:
    """USD to six decimals; an unknown model costs nothing."""
    p = prices or (0.0, 0.0, 0.0)
    return F.round((fresh * p[0] + cached * p[1] + output * p[2]) / 1e6, 6)


def cost_rollup(calls: DataFrame, by: list[str], request: str = "key") -> DataFrame:
    """Cost and latency of distinct requests: the largest of each request, then sums by `by`."""
    once = calls.groupBy(*by, request).agg(F.max("cost_usd").alias("_c"), F.max("latency_ms").alias("_l"), F.first("model").alias("_m"))
    return once.groupBy(*by).agg(F.round(F.coalesce(F.sum("_c"), F.lit(0)), 6).alias("cost_usd"), F.sum("_l").alias("latency_ms"), F.count(F.lit(1)).alias("requests"), F.array_join(F.array_sort(F.collect_set("_m")), ",").alias("models"))


def document_summary(documents: DataFrame, windows: DataFrame, issues: DataFrame) -> DataFrame:
    """documents with counts of windows by state, open issues by severity and the stages they blame."""
    w = windows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("status") == "needs-review").alias("n_review"), F.count_if(F.col("status").isin("verified", "edited")).alias("n_decided"))
    i = issues.where("resolved = 0").groupBy("document_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("error", "warning", "info")], F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages")
    )
    out = documents.join(w, "document_id", "left").join(i, "document_id", "left")
    return out.fillna(0, ["n_windows", "n_review", "n_decided", "n_error", "n_warning", "n_info"]).fillna("", ["stages"])


def wrong_and_flagged(found: DataFrame, gold: DataFrame, keys: list[str], flagged: DataFrame) -> DataFrame:
    """wrong: found values that gold doesn't have; flagged: those of them that a review was asked for."""
    wrong = found.join(gold.select(*keys), keys, "left_anti")
    hit = wrong.join(flagged.select(*keys).distinct().withColumn("_f", F.lit(True)), keys, "left")
    return hit.agg(F.count(F.lit(1)).alias("wrong"), F.count("_f").alias("flagged"))


def fetch_status(entries: DataFrame, fetched: DataFrame) -> DataFrame:
    """new, unchanged, changed, failed or no-url of each registered publication. entries: id, url, sha; fetched: id, sha, error."""
    f = fetched.select("id", F.col("sha").alias("_new"), "error")
    out = entries.join(f, "id", "left")
    s = F.when(F.col("url").isNull(), "no-url").when(F.col("error").isNotNull() | F.col("_new").isNull(), "failed").when(F.col("sha").isNull(), "new").when(F.col("sha") == F.col("_new"), "unchanged").otherwise("changed")
    return out.withColumn("fetch_status", s).drop("_new", "error")


def admit(calls: DataFrame, budget: float, order: str = "submitted", cost: str = "worst_cost") -> DataFrame:
    """calls with admitted: true while the running sum of worst-case costs stays within the budget, day by day (column day)."""
    run = F.sum(cost).over(Window.partitionBy("day").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("admitted", run <= budget)
