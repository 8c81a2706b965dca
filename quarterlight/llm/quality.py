"""Quality rules: base rules on counts, then robust multivariate outliers by language and source.

Everything runs on DataFrame expressions. Each document gets four statistics that don't depend on its length
(mean word length, symbols a word, share of repeated lines, share of words in repeated windows), transformed
and stored as whole numbers. For each language and source a minimum-covariance-determinant estimate of their centre
and scatter is found by concentration steps over all documents: distances are counted in bins, the bins that hold
the nearest three quarters (COVER) are summed to the next estimate, until no determinant falls any more. Sums are of
whole numbers, so results don't depend on the order of rows. Two starts are followed, the whole group and the one
nearest its medians; the smaller determinant wins.

Clean texts have no symbols and no repeats at all, which says nothing of how far a text may stray: a text of n words says it
within its own sampling error only. So the estimates are made of the vectors with such an error drawn for each (see ERRORS), and hold the
errors' variance; the vectors that are judged have none. No spread is set by hand but for rounding.

Few documents say little: an estimate counts as many documents as it rests on, and PRIOR_DOCUMENTS more are taken as
spread like the language's, whose own estimate is filled up in the same way from that of all documents, and this one
from PRIOR_SPREAD. That holds at every size: a group of one is judged nearly as its language, a large one by itself.
A document is rejected if its squared Mahalanobis distance passes the chi-square quantile.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, cut, row_key, scratch, table, word_list

WINDOW_WORDS = 8
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Statistics are kept in steps of 1/SCALE.
SCALE = 4096
STATS = ("z0", "z1", "z2", "z3")
#: What a text's own length makes each of them scatter by, drawn once a text, in the same steps.
ERRORS = ("e0", "e1", "e2", "e3")
#: Standard deviations that an estimate can't fall below: a few steps of rounding, so that no determinant is zero.
FLOORS = (0.01, 0.01, 0.01, 0.01)
#: A text's counts are a sample, and scatter for that alone: its words' lengths by this variance; its symbols and its repeated words
#: as ones that come ten words at a time (in tables, lists and quotes; a repeat is of two such), its words' lengths likewise; its lines one by one.
LETTERS, CLUMP = 16.0, 10
#: Ratios are drawn to the prior by this many words (of this length, without symbols or repeats) and lines: short
#: texts scatter more.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 50, 5, 10
#: Share of a group that an estimate rests on, most steps of concentration and the fall of a determinant's logarithm
#: that is worth a further one, and the chi-square tail of the verdict.
COVER, STEPS, SETTLED, TAIL = 0.75, 10, 1e-2, 1e-5
#: Documents that the next wider group adds to an estimate, and the standard deviations that stand beyond the widest.
PRIOR_DOCUMENTS, PRIOR_SPREAD = 50, (0.5, 0.25, 0.25, 0.25)
BINS_PER_LOG2, MAX_BIN = 8, 400


def _chi2_cdf(x: float, d: int) -> float:
    """For even d."""
    term = total = math.exp(-x / 2)
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return 1 - total


def _chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        low, high = ((low + high) / 2, high) if _chi2_cdf((low + high) / 2, d) < p else (low, (low + high) / 2)
    return high


#: Makes the scatter of the nearest COVER of normal data estimate the scatter of all.
CONSISTENCY = COVER / _chi2_cdf(_chi2_quantile(COVER, len(STATS)), len(STATS) + 2)
CUTOFF = _chi2_quantile(1 - TAIL, len(STATS))


def word_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, of the whole text; zeros for null.

    Windows of eight words are compared by their 64-bit hash. Work in a row is n log n of its words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_w": word_list(F.col(text)), "_l": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")})
    n = F.size("_w")
    hashes = F.when(n >= WINDOW_WORDS, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW_WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, WINDOW_WORDS))))
    df = df.withColumn("_h", F.coalesce(hashes, F.array().cast("array<bigint>")))
    order = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_o", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), order))
    same = lambda a, b: F.coalesce(F.get(F.col("_o"), a)["h"] == F.get(F.col("_o"), b)["h"], F.lit(False))
    twice = F.filter("_o", lambda x, k: same(k, k - 1) | same(k, k + 1))
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    cover = F.aggregate(
        F.col("_p"),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW_WORDS).alias("at")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW_WORDS), p - a["at"])).alias("n"), p.alias("at")),
        lambda a: a["n"],
    )
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_n_lines": F.size("_l").cast("long"),
        "n_repeat_words": F.coalesce(cover, F.lit(0)).cast("long"),
    }).drop("_w", "_l", "_h", "_o", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_vector(stats: DataFrame, salt: Column | None = None) -> DataFrame:
    """Adds the transformed statistics as whole numbers (only ratios, so a long text is no outlier for its length), and their
    ERRORS: a draw from a normal distribution by a hash of the counts and the salt, so copies differ and reruns agree."""
    words, lines = F.col("n_words") + PRIOR_WORDS, F.col("_n_lines") + PRIOR_LINES
    z = (
        (F.col("word_chars") + PRIOR_WORDS * PRIOR_CHARS) / words,
        F.sqrt(F.col("n_symbols") / words),
        F.asin(F.sqrt(F.col("n_dup_lines") / lines)),
        F.asin(F.sqrt(F.col("n_repeat_words") / words)),
    )
    # Square roots and arcs of counts have the same variance whatever the rate: a quarter over what was counted.
    variance = (LETTERS / words, CLUMP / (4 * words), 1 / (4 * lines), 2 * CLUMP / (4 * words))
    of = [F.lit(0) if salt is None else salt, *map(F.col, ("n_words", "word_chars", "n_symbols", "_n_lines", "n_repeat_words"))]
    chance = lambda k: (F.shiftrightunsigned(F.xxhash64(*of, F.lit(k)), 12) + 0.5) / float(1 << 52)
    wave = lambda k: (F.cos if k % 2 else F.sin)(2 * math.pi * chance(k // 2 + 2)) * F.sqrt(-2 * F.log(chance(k // 2)))
    steps = lambda c: F.round(c * SCALE).cast("long")
    out = {n: steps(c) for n, c in zip(STATS, z, strict=True)}
    return stats.withColumns(out | {n: steps(wave(k) * F.sqrt(v)) for k, (n, v) in enumerate(zip(ERRORS, variance, strict=True))})


def _sums() -> list[Column]:
    whole = lambda c: F.sum(c.cast("decimal(20,0)"))
    out = [F.count(F.lit(1)).alias("n")] + [whole(F.col(a)).alias(f"s_{a}") for a in STATS]
    return out + [whole(F.col(a) * F.col(b)).alias(f"s_{a}{b}") for i, a in enumerate(STATS) for b in STATS[: i + 1]]


_PAIRS = [(a, b) for i, a in enumerate(STATS) for b in STATS[: i + 1]]
_MOMENTS = [f"m_{a}" for a in STATS] + [f"c_{a}{b}" for a, b in _PAIRS]
_TRIANGLE = [f"m_{a}" for a in STATS] + [f"l_{a}{b}" for a, b in _PAIRS]


def _moments(sums: DataFrame, scale: float) -> DataFrame:
    """Adds the centre m_* and the scatter c_**."""
    n = F.col("n").cast("double")
    out = sums.withColumns({f"m_{a}": F.col(f"s_{a}").cast("double") / n / SCALE for a in STATS})
    return out.withColumns({f"c_{a}{b}": (F.col(f"s_{a}{b}").cast("double") / n / (SCALE * SCALE) - F.col(f"m_{a}") * F.col(f"m_{b}")) * scale for a, b in _PAIRS})


def _triangle(out: DataFrame) -> DataFrame:
    """Adds, by Cholesky's method, the triangle l_** of the scatter above its floors, with the log of its determinant."""
    for i, a in enumerate(STATS):
        for j, b in enumerate(STATS[: i + 1]):
            own = F.col(f"c_{a}{b}") + FLOORS[i] ** 2 if i == j else F.col(f"c_{a}{b}")
            rest = reduce(lambda x, k: x - F.col(f"l_{a}{k}") * F.col(f"l_{b}{k}"), STATS[:j], own)
            out = out.withColumn(f"l_{a}{b}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{b}{b}"))
    return out.withColumn("logdet", reduce(lambda x, y: x + y, [F.log(f"l_{a}{a}") for a in STATS]))


def _filled(own: str, wide: str) -> dict[str, Column]:
    """Moments of a mixture: of the structs `own` (with n) and, weighing PRIOR_DOCUMENTS, `wide`."""
    w = F.col(f"{own}.n") / (F.col(f"{own}.n") + PRIOR_DOCUMENTS)
    at = lambda of, name: F.col(f"{of}.{name}")
    off = {a: at(own, f"m_{a}") - at(wide, f"m_{a}") for a in STATS}
    out = {f"m_{a}": w * at(own, f"m_{a}") + (1 - w) * at(wide, f"m_{a}") for a in STATS}
    return out | {f"c_{a}{b}": w * at(own, f"c_{a}{b}") + (1 - w) * at(wide, f"c_{a}{b}") + w * (1 - w) * off[a] * off[b] for a, b in _PAIRS}


def _distance() -> Column:
    """Squared Mahalanobis distance, by forward substitution through the triangle."""
    y: dict[str, Column] = {}
    for i, a in enumerate(STATS):
        rest = reduce(lambda x, b: x - F.col(f"l_{a}{b}") * y[b], STATS[:i], F.col(a) / SCALE - F.col(f"m_{a}"))
        y[a] = rest / F.col(f"l_{a}{a}")
    return reduce(lambda x, v: x + v * v, y.values(), F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.least(F.lit(MAX_BIN), F.floor(F.log2(1 + 256 * d2) * BINS_PER_LOG2)).cast("int")


def _meet(big: DataFrame, small: DataFrame, small_fits: bool, how: str = "inner") -> DataFrame:
    return big.join(F.broadcast(small) if small_fits else small, "group", how)


def _keys(lang: str, source: str) -> tuple[Column, Column, Column]:
    """Names of a document's group, of its language's and of all; null is a value of its own."""
    key = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?")) for c in (lang, source)]
    return F.to_json(F.array(*key)), F.to_json(F.array(key[0])), F.lit("[]")


def estimates(rows: DataFrame, fits: bool) -> DataFrame:
    """group, n (documents) and the moments of the best minimum-covariance-determinant estimate, of rows (group and the statistics).

    Every document counts in every step. A step shuffles one row for each group, start, task and bin; a hot
    source is summed in the tasks that read it. Medians come from exact counts of the stored whole numbers' bins.
    """
    # Start 1: the whole group. Start 2: centred at the medians (of bins 1/64 wide), with the widest prior's scatter.
    whole = _triangle(_moments(rows.groupBy("group").agg(*_sums()), 1.0)).select("group", *_TRIANGLE, F.lit(1).alias("start"))
    bins = rows.select("group", F.explode(F.array(*[F.struct(F.lit(a).alias("z"), F.floor(F.col(a) * 64 / SCALE).alias("v")) for a in STATS])).alias("e")).groupBy("group", "e.z", "e.v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("group", "z")
    ranked = bins.withColumns({"below": F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
    medians = ranked.where(2 * F.col("below") >= F.col("all")).groupBy("group", "z").agg(F.min("v").alias("v")).groupBy("group").agg(*[(F.max(F.when(F.col("z") == a, F.col("v"))) / 64 + 1 / 128).alias(f"m_{a}") for a in STATS])
    spread = {f"l_{a}{b}": F.lit(PRIOR_SPREAD[STATS.index(a)] if a == b else 0.0) for a, b in _PAIRS}
    middle = medians.withColumns(spread).select("group", *_TRIANGLE, F.lit(2).alias("start"))
    now, before = cut(whole.unionByName(middle)), None
    for _ in range(STEPS):
        near = _meet(rows, now, fits).withColumn("bin", _bin(_distance())).groupBy("group", "start", "bin").agg(*_sums())
        w = Window.partitionBy("group", "start")
        near = near.withColumns({"_before": F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("n").over(w)})
        half = near.where(F.col("_before") < F.col("_all") * COVER)
        sums = half.groupBy("group", "start").agg(F.max("_all").alias("_all"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in half.columns if c.startswith("s_")])
        now = cut(_triangle(_moments(sums, CONSISTENCY)).select("group", "start", "_all", *_MOMENTS, *(c for c in _TRIANGLE if c[0] == "l"), "logdet"))
        if before is not None:
            fell = now.join(before, ["group", "start"]).where(F.col("_was") - F.col("logdet") > SETTLED)
            if not fell.limit(1).count():
                break
        before = now.select("group", "start", F.col("logdet").alias("_was"))
    best = now.groupBy("group").agg(F.min_by(F.struct(F.col("_all").alias("n"), *_MOMENTS), F.struct("logdet", "start")).alias("p"))
    return best.select("group", "p.*")


def fit(stats: DataFrame, lang: str = "lang", source: str = "source") -> tuple[DataFrame, bool]:
    """(group, centre and triangle of the scatter; whether these fit a broadcast) from stored vectors of documents that pass the base rules,
    with their ERRORS if the columns are there: the estimates hold what the texts' lengths alone make them scatter by."""
    own, wide, every = _keys(lang, source)
    vector = [(F.col(a) + F.col(e)).alias(a) if e in stats.columns else F.col(a) for a, e in zip(STATS, ERRORS, strict=True)]
    rows = stats.where(~F.col("base_failed")).select(own.alias("own"), wide.alias("wide"), *vector)
    names = cut(rows.select("own", "wide").distinct())
    fits = names.count() <= BROADCAST_KEYS // 4
    each = rows.select(F.explode(F.array("own", "wide", every)).alias("group"), *STATS)
    found = cut(estimates(each, fits))
    struct = lambda name: F.struct("n", *_MOMENTS).alias(name)
    spread = {f"c_{a}{b}": F.lit(PRIOR_SPREAD[STATS.index(a)] ** 2 if a == b else 0.0) for a, b in _PAIRS}
    top = found.where("group = '[]'").select(struct("o"), F.struct(*[F.col(f"m_{a}") for a in STATS], *[c.alias(k) for k, c in spread.items()]).alias("w"))
    top = top.select(F.struct(*[c.alias(k) for k, c in _filled("o", "w").items()]).alias("w"))
    langs = found.join(names.select(F.col("wide").alias("group")).distinct(), "group").select(F.col("group").alias("wide"), struct("o")).join(F.broadcast(top))  # one row
    langs = langs.select("wide", F.struct(*[c.alias(k) for k, c in _filled("o", "w").items()]).alias("w"))
    groups = names.withColumnRenamed("own", "group").join(found.select("group", struct("o")), "group").join(langs, "wide")
    out = _triangle(groups.select("group", *[c.alias(k) for k, c in _filled("o", "w").items()]))
    return cut(out.select("group", *_TRIANGLE)), fits


def judge(stats: DataFrame, best: DataFrame, fits: bool, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds distance2 and kept: false for base failures and outliers."""
    met = _meet(stats.withColumn("group", _keys(lang, source)[0]), best, fits, "left").withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= CUTOFF)
    return met.withColumn("kept", kept).drop("group", *_TRIANGLE)


def measured(df: DataFrame, salt: Column | None = None) -> DataFrame:
    """Statistics and vector of each text, with base_failed."""
    return with_vector(word_stats(df).withColumn("base_failed", base_failed()), salt)


def quality_rules(df: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance2 and kept of every document (columns doc_id, text, lang, source).

    Null text has no words and fails the base rules; null language or source is a group of its own; repeated
    rows are judged alike; an empty table gives an empty result; other columns are ignored. Texts are read
    once: their numbers are stored, and the estimates and verdicts come from these.
    """
    stats = cut(measured(df.select("doc_id", "text", "lang", "source"), F.xxhash64("doc_id")).drop("text"))
    return judge(stats, *fit(stats))


def keep_good(df: DataFrame) -> DataFrame:
    """The rows of df that pass, with df's columns. Rows are written once with their numbers to shared storage, as texts
    cost more to measure than to store, and judged from there. Odd rows are as in quality_rules."""
    spark, own = df.sparkSession, df.columns
    salt = F.xxhash64("doc_id") if "doc_id" in own else row_key(df)
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), salt.alias("_salt"), "text", "lang", "source")
    path = scratch(spark, "measured")
    measured(inner, F.col("_salt")).drop("text", "_salt").write.parquet(path)
    stored = spark.read.parquet(path)
    return judge(stored, *fit(stored.drop("_row"))).where("kept").select("_row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; null texts have no words and fail the base rules."""
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
