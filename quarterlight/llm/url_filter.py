"""URL lists: a blocked Bloom filter passes possible hits to an exact hash join.

Everything runs on DataFrame expressions. A list entry is (host, path, verdict): it fits its host and every
subdomain if the URL's path starts with the entry's path; of the entries that fit, the longest host + path
wins (then the longer host). A URL is turned into its canonical candidate keys, one for each pair of a label
suffix of its host and a prefix of its path that is as long as some entry; a key that the filter may hold
goes to the hash join, which drops the false positives, so the verdict is exact for any filter size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

#: Fixed values of the query: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: 64-bit words of the filter: 8 MB at most, however long the list is.
MAX_WORDS = 1 << 20
ENTRIES_PER_WORD = 4
BITS = 4


def canonical(df: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Adds host (after the first ://, A-Z in lower case) and path (up to ? or #); both empty for null or no ://."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return df.withColumns({host: F.translate(raw, UPPER, LOWER), path: F.regexp_extract(tail, r"^[^?#]*", 0)})


def _spot(h: Column, words: int) -> tuple[Column, Column]:
    """The word of a key's hash and its bits there."""
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")))
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(words)).cast("int"), mask


def build_filter(listed: DataFrame, words: int) -> DataFrame:
    """One row: the filter's words in order, 0 where no entry falls. words <= MAX_WORDS bounds its size."""
    word, mask = _spot(F.xxhash64("host", "path"), words)
    kept = listed.select(word.alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    held = kept.agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("held"))
    return held.select(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.coalesce(F.col("held")[i], F.lit(0).cast("long"))).alias("filter"))


def filter_words(n: int) -> int:
    words = 64
    while words * ENTRIES_PER_WORD < n and words < MAX_WORDS:
        words *= 2
    return words


def judge_urls(df: DataFrame, listed: DataFrame, default: str = "allow", url: str = "url", words: int | None = None) -> DataFrame:
    """df with host, path, rule (host + path of the entry that wins, else null) and verdict (the entry's, else default).

    Columns of df (none a map) keep their names but for those four, which are replaced. Repeated rows stay repeated; a null
    or malformed URL has an empty host and path and fits no entry, nor does anything if the list is empty.
    List entries that are null in host or path are ignored; of equal entries the smallest verdict counts.
    Only rows whose keys pass the filter are shuffled (their own columns and the winner, not the keys).
    """
    listed = listed.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    words = words or filter_words(listed.count())
    own = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    # df's columns travel as one, so that their names can't meet those used here.
    rows = canonical(df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(f"`{url}`").alias("_url")), "_url").drop("_url")
    sizes = listed.agg(F.sort_array(F.collect_set(F.length("host"))).alias("h"), F.sort_array(F.collect_set(F.length("path"))).alias("p"))
    rows = rows.withColumns({"_f": build_filter(listed, words).scalar(), "_hs": sizes.select("h").scalar(), "_ps": sizes.select("p").scalar()})
    fits = F.filter("_hs", lambda n: (n > 0) & ((n == F.length("host")) | ((n < F.length("host")) & (F.substring(F.col("host"), F.length("host") - n, F.lit(1)) == "."))))
    hosts = F.transform(fits, lambda n: F.right(F.col("host"), n))
    paths = F.transform(F.filter("_ps", lambda n: n <= F.length("path")), lambda n: F.left(F.col("path"), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))))

    def possible(k: Column) -> Column:
        word, mask = _spot(F.xxhash64(k["h"], k["p"]), words)
        return F.element_at("_f", word + 1).bitwiseAND(mask) == mask

    rows = rows.withColumn("_keys", F.coalesce(F.filter(keys, possible), F.array()))
    rows = rows.drop("_f", "_hs", "_ps")
    none = rows.where(F.size("_keys") == 0).drop("_keys").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    some = rows.where(F.size("_keys") > 0).withColumn("_n", F.size("_keys")).withColumn("_k", F.explode("_keys")).drop("_keys")
    entries = listed.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v"))
    met = some.join(entries, (F.col("_k.h") == F.col("_h")) & (F.col("_k.p") == F.col("_p")), "left")
    best = F.max(F.when(F.col("_h").isNotNull(), F.struct((F.length("_h") + F.length("_p")).alias("n"), F.length("_h").alias("m"), F.concat("_h", "_p").alias("rule"), F.col("_v").alias("verdict"))))
    won = met.groupBy("_row", "host", "path", "_n").agg(best.alias("_b"), F.count(F.lit(1)).alias("_c"))
    # Equal rows met in one group; each comes back as often as it was there.
    won = won.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), (F.col("_c") / F.col("_n")).cast("long"))))
    won = won.withColumns({"rule": F.col("_b.rule"), "verdict": F.coalesce("_b.verdict", F.lit(default))})
    return none.unionByName(won.select(none.columns)).select("_row.*", "host", "path", "rule", "verdict")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls; null urls and those without a scheme have no host and are allowed."""
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH rules(h, p, v) AS (VALUES {rules}),
cutup AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS h0 FROM cutup),
parts AS (SELECT page_id, translate(h0, '{up}', '{low}') AS host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*', 0) AS path FROM raw),
won AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
        FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN won USING (page_id)
""".format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES), up=UPPER, low=LOWER)
