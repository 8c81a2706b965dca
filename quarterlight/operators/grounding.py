"""Is a quote on its page? Exact and fuzzy location, numbers that have to agree, and cells of a printed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import locate
from ..functions.text import plain_key
from .lineage import cut

THRESHOLD = 90.0


def numbers(key: Column) -> Column:
    return F.regexp_extract_all(key, F.lit(r"(\d+)"), F.lit(1))


def numbers_in(quote: Column, text: Column) -> Column:
    """Every number of the quote is in the text, as often as in the quote."""
    q, t = numbers(quote), numbers(text)
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return F.forall(F.array_distinct(q), lambda x: times(q, x) <= times(t, x))


#: Words of an anchor. Quotes with fewer inner words have none: they go to all pages, so many at once.
ANCHOR, SHORT_QUOTES = 3, 4096
#: Rows that go to all tasks without a shuffle, if they are counted to be no more.
FEW_ROWS = 200_000


def _anchored(df: DataFrame, text: Column) -> DataFrame:
    """df with _a, hashes of all runs of ANCHOR words of a text; a row each, none for fewer words."""
    df = df.withColumn("_h", F.transform(F.split(text, " "), lambda w: F.xxhash64(w)))
    n = F.size("_h")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - ANCHOR, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(ANCHOR)]))
    # An inner explode would be given a filter on the array, which is pushed down and makes all of it anew for each word.
    return df.withColumn("_a", F.when(n >= ANCHOR, F.array_distinct(runs))).drop("_h").withColumn("_a", F.explode_outer("_a"))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def ground_exact(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes (quote_id, quote) that stand verbatim on a page (page_id, text), as keys; rows of one page_id count as one page each.

    A quote may begin and end inside a word, but its inner words are whole words of the page. So quotes and pages meet on
    runs of three inner words, of each quote on the run that the fewest pages have, and what meets is verified on the
    whole texts. A page's own runs are looked up where it lies. Quotes with less than three inner words, which say little,
    are searched for in all pages in blocks.
    """
    q = cut(quotes.select("quote_id", plain_key(F.col("quote")).alias("_q")).where("_q <> ''"))
    runs = cut(_anchored(q, F.regexp_replace("_q", r"^\S*\s?|\s?\S*$", ""))).where("_a IS NOT NULL")
    asked = _sent(runs.select("_a").distinct())
    p = pages.select("page_id", "text", F.xxhash64("page_id", "text").alias("_p"))
    text = plain_key(F.col("text"))
    hits = cut(_anchored(p.select("_p", text.alias("_t")), F.col("_t")).select("_p", "_a").join(asked, "_a").distinct())
    often = hits.groupBy("_a").agg(F.count(F.lit(1)).alias("_n"))
    known = runs.join(_sent(often), "_a", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rare = cut(known.groupBy("quote_id", "_q").agg(F.min(F.struct("_n", "_a")).alias("_r")).where("_r._n > 0").select("quote_id", "_q", F.col("_r._a").alias("_a")))
    pairs = cut(hits.join(rare, "_a").select("_p", "quote_id", "_q"))
    found = p.join(_sent(pairs), "_p").where(F.contains(text, F.col("_q"))).select("quote_id", "page_id")  # only these are keyed again
    short = cut(q.join(runs.select("quote_id").distinct(), "quote_id", "left_anti").withColumn("_block", F.pmod(F.xxhash64("quote_id", "_q"), F.lit(1 << 30))))
    blocks = -(-short.count() // SHORT_QUOTES)
    for i in range(blocks):
        some = short.where(F.col("_block") % blocks == i).select("quote_id", "_q")
        found = found.unionByName(p.select("page_id", text.alias("_t")).join(F.broadcast(some), F.contains(F.col("_t"), F.col("_q"))).select("quote_id", "page_id"))
    return found


#: So many quotes are held against a page at once, and sent to all tasks.
BLOCK, QUOTES = 512, 65_536
#: Only at such junctions is the key of two lines other than their keys with a space between.
LINE_END, LINE_START = r"[-:.0-9]$", r"^[-:.0-9]"


def _page_keys(pages: DataFrame) -> DataFrame:
    """Adds to pages (_l: array of structs n, text) _k, the keyed lines that aren't blank, _odd, the key of a line and
    the next where it isn't their keys with a space between, and _whole, the page's key if it has any such."""
    keyed = pages.withColumn("_k", F.filter(F.transform("_l", lambda x: F.struct(x["n"].alias("n"), x["text"].alias("text"), plain_key(x["text"]).alias("key"))), lambda x: x["key"] != ""))
    after = lambda i: F.get(F.col("_k"), i + 1)
    meets = lambda x, i: x["key"].rlike(LINE_END) & after(i)["key"].rlike(LINE_START) | x["key"].rlike("[-:]$") | after(i)["key"].rlike("^[-:]")
    odd = F.transform("_k", lambda x, i: F.when(after(i).isNotNull() & meets(x, i), plain_key(F.concat(x["text"], F.lit(" "), after(i)["text"]))))
    keyed = keyed.withColumn("_odd", odd)
    whole = F.when(F.exists("_odd", lambda x: x.isNotNull()), plain_key(F.array_join(F.transform("_k", lambda x: x["text"]), " ")))
    return keyed.withColumn("_whole", whole).withColumn("_k", F.transform("_k", lambda x: F.struct(x["n"].alias("n"), x["key"].alias("key")))).drop("_l")


def _page(row: dict) -> tuple[list, list, list, str]:
    lines = [(x["n"], x["key"]) for x in row["_k"] or ()]
    odd = list(row["_odd"] or ())
    pairs = [o if o is not None else f"{a[1]} {b[1]}" for o, a, b in zip(odd, lines, lines[1:])]  # noqa: B905
    return lines, pairs, [o for o in odd if o is not None], row["_whole"] if row["_whole"] is not None else " ".join(t for _, t in lines)


def ground_fuzzy(quotes: DataFrame, lines: DataFrame, on: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Places where a quote is found on its own page: quotes (on, quote_id, quote), lines (on, line_no, text).

    Single lines and pairs of consecutive ones (multiline) count, each place once; every number of the quote has to
    be there. A quote without such a place is looked for in the whole page's text: line_no is then null.
    """
    pages = lines.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(F.col("line_no").cast("int").alias("n"), F.coalesce("text", F.lit("")).alias("text")))).alias("_l"))
    met = _page_keys(pages).join(quotes.select(*on, "quote_id", plain_key(F.col("quote")).alias("_q")), on).where("_q <> ''")

    asked = met.select(*on, "quote_id", "_q", "_k", "_odd", "_whole")
    schema = met.select(*on, "quote_id").schema.add("line_no", "integer").add("multiline", "boolean").add("score", "double")

    def run(batches):
        import pyarrow as pa

        types = (pa.int32(), pa.bool_(), pa.float64())
        for b in batches:
            at, found = [], []
            read = [b.column(c).to_pylist() for c in ("_q", "_k", "_odd", "_whole")]
            for i, (q, k, odd, whole) in enumerate(zip(*read, strict=True)):
                lines, pairs, _, page = _page({"_k": k, "_odd": odd, "_whole": whole})
                here = locate.places(q, lines, pairs, page, threshold)
                at += [i] * len(here)
                found += here
            columns = list(zip(*found, strict=True)) or [()] * 3
            keys = [b.column(c).take(pa.array(at, pa.int64())) for c in schema.names[:-3]]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return asked.mapInArrow(run, schema)


def ground_everywhere(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """Places of quotes (quote_id, quote) on all pages (page_id, text), as of ground_fuzzy.

    The quotes, a stated query set, go to every task, at most about QUOTES at a time, and are taken in blocks; pages lie where they
    are. Only pages that share enough pieces with a quote are scored, which loses no place of score 90 or more. Of
    several rounds each is stored before the next begins.
    """
    spark = pages.sparkSession
    keyed = cut(quotes.select("quote_id", plain_key(F.col("quote")).alias("_q")).where("_q <> ''"))
    rounds = max(1, -(-keyed.count() // QUOTES))
    dealt = keyed.withColumn("_round", F.pmod(F.xxhash64("quote_id", "_q"), F.lit(rounds)))
    found = None
    for r in range(rounds):
        sent = spark.sparkContext.broadcast([tuple(x) for x in dealt.where(F.col("_round") == r).select("quote_id", "_q").collect()])
        part = _everywhere(sent, pages)
        if rounds > 1:
            part = cut(part)
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _everywhere(sent, pages: DataFrame) -> DataFrame:
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.cast("int").alias("n"), x.alias("text")))

    def run(batches):
        import pyarrow as pa

        blocks = [locate.Quotes(sent.value[i : i + BLOCK]) for i in range(0, len(sent.value), BLOCK)]
        for b in batches:
            out: list = []
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                page = _page(row)
                out += [(quote, row["page_id"], *place) for block in blocks for quote, *place in block.on(*page)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.float64())
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["quote_id", "page_id", "line_no", "multiline", "score"])

    return _page_keys(pages.select("page_id", lines.alias("_l"))).mapInArrow(run, "quote_id long, page_id long, line_no int, multiline boolean, score double")


def value_consistent(start: Column, end: Column, ranges: Column, times: Column) -> Column:
    """Does a quote print these times? By its ranges, else by its two clock times; null if it has neither."""
    inside = F.exists(ranges, lambda r: (r["start"] == start) & (r["end"] == end))
    two = (F.get(times, F.lit(0)) == start) & (F.get(times, F.lit(1)) == end)
    known = start.isNotNull() & end.isNotNull()
    return F.when(known & (F.size(ranges) > 0), inside).when(known & (F.size(times) == 2), two)


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)])


def same_row(a: Column, b: Column, tolerance: float = 4) -> Column:
    return F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2) < tolerance


def x_overlap(a: Column, b: Column, least: float = 2) -> Column:
    return F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]) > least


def contains_box(a: Column, b: Column, tolerance: float = 1) -> Column:
    return (a["x0"] - tolerance <= b["x0"]) & (a["y0"] - tolerance <= b["y0"]) & (a["x1"] + tolerance >= b["x1"]) & (a["y1"] + tolerance >= b["y1"])


def cell_alignment(values: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """values (on, value_id, bbox, level_label, season_label) with aligned: true if the nearest row label to the left and
    the nearest column label above are the claimed ones, false if both are there and one differs, else null.

    labels: on, kind (level, season), label, bbox. A page has few labels, and pages meet by key.
    """
    met = values.join(labels.select(*on, "kind", "label", F.col("bbox").alias("_b")), on, "left")
    b, v = F.col("_b"), F.col("bbox")
    left = (F.col("kind") == "level") & same_row(b, v) & (b["x0"] < v["x0"])
    above = (F.col("kind") == "season") & x_overlap(b, v) & (b["y0"] < v["y0"])
    near = met.groupBy(*on, "value_id", "level_label", "season_label").agg(
        F.max_by("label", F.when(left, b["x1"])).alias("_level"), F.max_by("label", F.when(above, b["y1"])).alias("_season")
    )
    good = (F.col("_level") == F.col("level_label")) & (F.col("_season") == F.col("season_label"))
    return near.withColumn("aligned", good).drop("_level", "_season")


def suppress_contained(places: DataFrame, keys: list[str]) -> DataFrame:
    """Places (keys, score, multiline, bbox) best first, without those that hold or lie in a better one.

    The choice depends on its order, so a key's few candidate places are settled together.
    """
    schema = places.schema

    def run(rows):
        rows = rows.assign(_h=[b["y1"] - b["y0"] for b in rows.bbox]).sort_values(["score", "multiline", "_h"], ascending=[False, True, True], kind="stable")
        seen, kept = [], []
        holds = lambda a, b: a["x0"] - 1 <= b["x0"] and a["y0"] - 1 <= b["y0"] and a["x1"] + 1 >= b["x1"] and a["y1"] + 1 >= b["y1"]
        for k, b in zip(rows.index, rows.bbox, strict=True):
            if not any(holds(s, b) or holds(b, s) for s in seen):
                seen.append(b)
                kept.append(k)
        return rows.loc[kept].drop(columns="_h")

    return places.groupBy(*keys).applyInPandas(run, schema)
