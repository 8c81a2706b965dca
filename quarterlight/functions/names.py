"""Names of operators: short forms for ids, and whether two spellings mean the same one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .fuzzy import token_set_ratio
from .text import match_key

# Words of a name that tell no operators apart, and how umlauts are written out.
LEGAL_FORMS = ("gmbh", "ag", "kg", "co", "mbh", "se", "eg", "ug", "und", "kgaa")
NETWORK = ("netz", "netze")
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
#: Length of a short form, score from which two names are one, and the length of a printed name.
LONGEST, SAME, LINE = 48, 90.0, 80
#: Known names that go to all tasks at once.
KNOWN = 50_000
ABBREVIATED = r"\.{2,}|…|\("


@F.pandas_udf(StringType())
def _ascii(names: pd.Series) -> pd.Series:
    """Lower case in ASCII, umlauts written out, other accents dropped."""
    out = names.str.normalize("NFKC").str.lower()
    for a, b in UMLAUTS:
        out = out.str.replace(a, b, regex=False)
    return out.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def slug(name: Column) -> Column:
    """Words of a name without legal forms, joined by hyphens, at most LONGEST characters; empty for null."""
    words = F.filter(F.split(_ascii(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*LEGAL_FORMS))
    return F.trim(F.left(F.array_join(words, "-"), F.lit(LONGEST)), F.lit("-"))


def make_id(name: Column, year: Column, sha: Column, taken: Column) -> Column:
    """Name and year, with the start of the content's hash where that id is taken (array); from the hash alone without a name."""
    base = F.when(year.isNotNull() & (year != 0), F.concat(slug(name), F.lit("-"), year.cast("string"))).otherwise(slug(name))
    return F.when(slug(name) == "", F.concat(F.lit("upload-"), F.left(sha, F.lit(10)))).when(F.array_contains(taken, base), F.concat(base, F.lit("-"), F.left(sha, F.lit(6)))).otherwise(base)


def name_key(name: Column) -> Column:
    return F.array_join(F.filter(F.split(slug(name), "-"), lambda w: (w != "") & ~w.isin(*NETWORK)), " ")


def same_name(a: Column, b: Column) -> Column:
    """Two spellings of one operator; never for names of legal forms alone."""
    x, y = name_key(a), name_key(b)
    return (x != "") & (y != "") & (token_set_ratio(x, y) >= SAME)


def canonical_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """names (name) with canonical: the known name (name) that differs in case at most, else the only one that is spelled
    alike, else the name itself.

    known has a row for each operator of a registry: KNOWN of them at a time go to all tasks. There each distinct name is held, once,
    against those that share a word with it, and against those of about its length, as no others can be alike.
    """
    asked = names.select("name").distinct().withColumns({"_k": name_key(F.col("name")), "_l": F.lower(F.trim("name"))})
    have = known.select(F.col("name").alias("_known")).distinct().withColumns({"_kk": name_key(F.col("_known")), "_kl": F.lower(F.trim("_known"))})
    exact = asked.join(have, F.col("_l") == F.col("_kl")).groupBy("name").agg(F.min("_known").alias("_exact"))
    keyed = have.where("_kk <> ''").select("_known", "_kk")
    blocks = max(1, -(-keyed.count() // KNOWN))
    parts = []
    for k in range(blocks):
        rows = [tuple(r) for r in keyed.where(F.pmod(F.xxhash64("_known"), F.lit(blocks)) == k).collect()]  # about KNOWN rows
        sent = names.sparkSession.sparkContext.broadcast(rows)
        parts.append(asked.where("_k <> ''").select("name", F.explode(_alike(sent)("_k")).alias("_close")))
    close = reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("_close").alias("_close")).where("_n = 1")
    found = asked.select("name").join(exact, "name", "left").join(close, "name", "left")
    return names.join(found.select("name", F.coalesce("_exact", "_close", F.trim("name")).alias("canonical")), "name", "left")


def _alike(sent):
    """Of each key the known names that are spelled alike, two at most."""

    @F.pandas_udf("array<string>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from .fuzzy import token_set_of

        by_word: dict[str, list[int]] = {}
        by_size: dict[int, list[int]] = {}
        for i, (_, key) in enumerate(sent.value):
            for word in set(key.split()):
                by_word.setdefault(word, []).append(i)
            by_size.setdefault(len(key), []).append(i)

        def one(key: str) -> list[str]:
            words = set(key.split())
            likely = {i for w in words for i in by_word.get(w, ())}
            # Without a word in common the whole keys are compared, sorted by words: their lengths differ by a tenth of both at most.
            size = len(" ".join(sorted(words)))
            reach = range(int(size * SAME / (200 - SAME)) - 1, int(size * (200 - SAME) / SAME) + 2)
            likely |= {i for n in reach for i in by_size.get(n, ())} | repeated
            found = []
            for i in sorted(likely):
                if token_set_of(key, sent.value[i][1]) >= SAME:
                    found.append(sent.value[i][0])
                    if len(found) == 2:
                        break
            return found

        # Keys that say a word twice are longer than their sets of words.
        repeated = {i for i, (_, key) in enumerate(sent.value) if len(key.split()) != len(set(key.split()))}
        for keys in batches:
            yield keys.map(one)

    return score


def printed_names(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """claims (document_id, name) with printed: the name if it is on a page; else the shortest printed line (document_id,
    page, line_no, text; the earliest of that length) that starts with what stands before an ellipsis; else null."""
    pages = lines.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    c = claims.select("document_id", F.trim("name").alias("name")).distinct().where("name <> ''")
    c = c.withColumns({"_key": match_key(F.col("name")), "_core": match_key(F.get(F.split("name", ABBREVIATED), F.lit(0)))})
    whole = c.join(pages.select("document_id", match_key(F.col("text")).alias("_t")), "document_id").where(F.contains("_t", "_key")).select("document_id", "name").distinct().withColumn("_whole", F.lit(True))
    short = lines.select("document_id", "page", "line_no", F.trim("text").alias("_line")).where(F.length("_line") <= LINE).withColumn("_lk", match_key(F.col("_line")))
    begun = c.where(F.length("_core") >= 4).join(short, "document_id").where(F.startswith("_lk", "_core")).groupBy("document_id", "name").agg(F.min_by("_line", F.struct(F.length("_line"), "page", "line_no")).alias("_begun"))
    out = c.select("document_id", "name").join(whole, ["document_id", "name"], "left").join(begun, ["document_id", "name"], "left")
    out = out.select("document_id", "name", F.when(F.col("_whole"), F.col("name")).otherwise(F.col("_begun")).alias("printed"))
    return claims.withColumn("name", F.trim("name")).join(out, ["document_id", "name"], "left")
