"""How far the sources of a language are from each other and from the language, by their terms.

Terms are found on bytes: a table of 256 entries marks the bytes of terms in the joined texts of a batch, and a term begins
and ends where the mark changes or a text does. Slices of up to eight bytes meet as numbers; longer ones by their xxHash, and are then
compared byte by byte.
Sparse matrices (documents by terms, then sources by terms) carry the counts, and sums over runs of rows the divergences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table

#: A term is kept that so many documents of its language hold; ranks of terms go to so many; shares are whole numbers of this unit.
DOCUMENTS, RANKS, UNIT = 10, 10, 1_000_000_000
#: Bytes of text that are searched for terms at once (one text at least), and entries of a block of a language's terms.
CHUNK, ENTRIES = 4 << 20, 1 << 14

_COUNTS = "lang string, source string, term string, n long, docs long"
_PARTS = "lang string, source string, part string, item string, value long"


def _tables():
    """Which bytes are a term's (letters and all beyond ASCII), and each byte with A-Z in lower case."""
    import numpy as np

    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    member = np.zeros(256, bool)
    member[65:91] = member[97:123] = member[128:] = True
    return member, lower


def _hash(piece: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(piece)


def slices(data, ends):
    """Lower-cased bytes, and start, end and text of every term in the joined texts `data`, where each text ends at `ends`."""
    import numpy as np

    member, lower = _tables()
    inside = member[data]
    begins = ends[:-1]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[begins[begins < len(data)]] = False
    after[begins[begins > 0] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return lower[data], first, last, np.searchsorted(ends, first, side="right")


def same_bytes(data, first, last):
    """The group of each slice of `data`, and a slice of each group. Slices of up to eight bytes are numbers, and as terms
    have no zero byte, equal numbers are equal slices; longer ones meet by hash."""
    import numpy as np

    size = last - first
    short, long = np.flatnonzero(size <= 8), np.flatnonzero(size > 8)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    _, one, mine = np.unique(eight[first[short]].view("<u8")[:, 0] & masks[size[short]], return_index=True, return_inverse=True)
    other, more = _same_hash(data, first[long], last[long])
    group = np.empty(len(first), np.int64)
    group[short], group[long] = mine, len(one) + other
    return group, np.concatenate([short[one], long[more]])


def _same_hash(data, first, last):
    """As same_bytes, for slices of any length: those of one hash, then each compared with
    the first of its group; what differs in spite of its hash gets a group of its own bytes."""
    import numpy as np

    raw = data.tobytes()
    hashes = np.fromiter((_hash(raw[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
    _, one, group = np.unique(hashes, return_index=True, return_inverse=True)
    size, shown = last - first, first[one][group]
    other = size != (last - first)[one][group]
    for at in range(0, len(first), CHUNK // 4):
        part = np.arange(at, min(at + CHUNK // 4, len(first)))
        part = part[~other[part]]
        starts = np.cumsum(size[part]) - size[part]
        step = np.arange(size[part].sum()) - np.repeat(starts, size[part])
        unlike = data[np.repeat(first[part], size[part]) + step] != data[np.repeat(shown[part], size[part]) + step]
        other[np.repeat(part, size[part])[unlike]] = True
    extra: dict[bytes, int] = {}
    more = list(one)
    for i in np.flatnonzero(other).tolist():
        mine = raw[first[i] : last[i]]
        if mine not in extra:
            extra[mine] = len(more)
            more.append(i)
        group[i] = extra[mine]
    return group, np.array(more, np.int64)


def _sums(keys, *values):
    """The different keys, and the sums of the values of each."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


def _counted(lang, source, text):
    """A batch of _COUNTS for columns of strings; a text counts once in the docs of each of its terms."""
    import numpy as np
    import pyarrow as pa

    raw = [v or b"" for v in text.cast(pa.binary()).to_pylist()]
    data, first, last, doc = slices(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(v) for v in raw], dtype=np.int64))
    if not len(first):
        return None
    group, shown = same_bytes(data, first, last)
    n_terms = len(shown)
    held = np.sort(doc * n_terms + group)
    at = np.flatnonzero(np.diff(held, prepend=-1))
    pair, tf = held[at], np.diff(at, append=len(held))
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    n_sources = len(sources.dictionary)
    row = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
    key, n, docs = _sums(row[pair // n_terms] * n_terms + pair % n_terms, tf, np.ones(len(tf), np.int64))
    row, out = key // n_terms, data.tobytes()
    words = pa.array([out[a:b] for a, b in zip(first[shown].tolist(), last[shown].tolist(), strict=True)], pa.binary()).cast(pa.string()).take(pa.array(key % n_terms))
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(row // n_sources)), sources.dictionary.take(pa.array(row % n_sources)), words, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def term_table(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: how often rows of docs (lang, source, text, no nulls) hold a term, and how many do."""

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            return _counted(*(t.column(c).combine_chunks() for c in ("lang", "source", "text")))

        for b in batches:
            for i in range(0, b.num_rows, 32):
                part = b.slice(i, 32)
                held.append(part)
                size += part.column("text").nbytes
                if size >= CHUNK:
                    if (out := flush()) is not None:
                        yield out
                    held, size = [], 0
        if held and (out := flush()) is not None:
            yield out

    return docs.mapInArrow(run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count, total, n_terms):
    """1 + floor(UNIT * (count + 2) / (total + 2 * n_terms)), by long division, three digits a step: exact to totals of 9e15."""
    import numpy as np

    left, by = np.asarray(count, np.int64) + 2, np.asarray(total, np.int64) + 2 * n_terms
    found = left // by
    for _ in range(3):
        left = left % by * 1000
        found = found * 1000 + left // by
    return found + 1


def apart(p, q):
    return (p - q) * (p - q) // (p + q)


def _block(rows):
    """Parts of the divergences from a block of a language's terms: sums for each pair of sources, best terms of each source.

    rows: source, term and n of the block's terms, and for every source of the language a row without term and
    with its total n; `kept` is the language's number of kept terms.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = rows.filter(pc.is_null(rows.column("term"))).sort_by("source")
    names, totals, kept = whole.column("source").to_pylist(), whole.column("n").to_numpy(), whole.column("kept")[0].as_py()
    entries = rows.filter(pc.is_valid(rows.column("term")))
    words = sorted(set(entries.column("term").to_pylist()), key=str.encode)
    number = {w: i for i, w in enumerate(words)}
    source = np.searchsorted(np.array([n.encode() for n in names], object), np.array([s.encode() for s in entries.column("source").to_pylist()], object))
    term = np.array([number[t] for t in entries.column("term").to_pylist()], np.int64)
    order = np.lexsort((term, source))
    source, term, n = source[order], term[order], entries.column("n").to_numpy()[order]
    ends = np.searchsorted(source, np.arange(len(names) + 1))  # row pointers of the sparse matrix
    filled = np.flatnonzero(np.diff(ends))
    p, none = shares(n, totals[source], kept), shares(np.zeros(len(names), np.int64), totals, kept)
    language = np.zeros(len(words), np.int64)
    np.add.at(language, term, n)
    q = shares(language, totals.sum(), kept)
    found = {"source": [], "part": [], "item": [], "value": []}

    def give(g, part, items, values):
        found["source"] += [names[g]] * len(items)
        found["part"] += [part] * len(items)
        found["item"] += items
        found["value"] += values

    for g in range(len(names)):
        own, mine = term[ends[g] : ends[g + 1]], p[ends[g] : ends[g + 1]]
        value = (len(words) - len(own)) * apart(none[g], none)
        for i in range(0, len(own), max(1, CHUNK // max(1, len(names)))):
            value += apart(mine[i : i + max(1, CHUNK // max(1, len(names)))][None, :], none[:, None]).sum(axis=1)
        dense = np.full(len(words), none[g])
        dense[own] = mine
        against = dense[term]
        change = apart(against, p) - apart(against, none[source])  # where the other source has the term
        value[filled] += np.add.reduceat(change, ends[:-1][filled])
        others = [h for h in range(len(names)) if h != g]
        give(g, "pair", [names[h] for h in others], value[others].tolist())
        more = mine > q[own]
        gain, which = apart(mine[more], q[own][more]), own[more]
        top = np.lexsort((which, -gain))[:RANKS]
        give(g, "term", [words[t] for t in which[top]], gain[top].tolist())
    lang = rows.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(found["source"]), pa.string()), **{k: pa.array(v, pa.int64() if k == "value" else pa.string()) for k, v in found.items()}})


def divergences(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank for docs (lang, source, text).

    Part `pair`: every other source of the language and its divergence over the language's kept terms, 0 where the language
    keeps none. Part `term`: the kept terms that a source has more of than the language, the RANKS most divergent. Null lang,
    source and text are empty; every row is a document, repeated or not; an empty table gives no rows; other columns are dropped.
    A batch's counts are summed before the shuffle; a language's kept terms are dealt by hash to blocks of about ENTRIES counts,
    each with the totals of the language's sources, so neither a large source nor a large language makes a task large.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    with small_batches(spark):
        counts = cut(term_table(rows))
    of_term = Window.partitionBy("lang", "term")
    entries = cut(counts.withColumn("_df", F.sum("docs").over(of_term)).where(F.col("_df") >= DOCUMENTS).select("lang", "source", "term", "n"))
    langs = entries.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("e")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("e").alias("e"))
    langs = cut(langs.select("lang", "kept", F.ceil(F.col("e") / ENTRIES).cast("long").alias("blocks")))
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(groups.select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), "blocks"))
    placed = entries.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n", "kept")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    totals = groups.where("kept > 0").select("lang", blocks, "source", F.lit(None).cast("string").alias("term"), "n", "kept")
    parts = cut(placed.unionByName(totals).groupBy("lang", "block").applyInArrow(_block, _PARTS))
    bare = groups.where("kept = 0")
    other = bare.select("lang", F.col("source").alias("item"))
    empty = bare.join(other, "lang").where(F.col("source") != F.col("item")).select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(empty)
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= RANKS)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all sources of the documents' languages."""
    return divergences(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + ({UNIT}::HUGEINT * (coalesce(c.c, 0) + 2)) // (n.n::HUGEINT + 2 * l.v) AS p,
    1 + ({UNIT}::HUGEINT * (k.c + 2)) // (l.n::HUGEINT + 2 * l.v) AS q
  FROM n JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""
