"""Ranked lexical search over inverted treaps.

Documents lie in shards. A shard holds a treap for each of its terms: the term's postings, a search tree by place of the
document in ascending doc_id order, a heap by impact. A query goes down the treaps of its terms together: an interval of documents
carries the treaps' nodes that rule it, the sum of their largest impacts bounds every score inside, the best interval is
split at the document of its heaviest node, which is scored, and intervals that can't reach the k-th score are left alone.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared_files
from .common import LOWER, UPPER, cut, scratch, small_batches, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 50
#: A shard is cut when it holds this many postings, 20 bytes each.
POSTINGS = 1 << 20
#: Impacts are below 10^6. Heaps go by impact in steps of 2^STEP, then by chance, so that copies, or documents in
#: order of their length, make no treap deep; each node also knows the largest impact below it.
STEP = 12
#: Pairs of item and term that are sent to all executors at once (a longer item goes alone), and nodes that one step of a search handles.
PAIRS, NODES = 65_536, 1 << 15
#: The first wave of a search goes to one in so many tasks' shards, and gives the others the scores to beat.
WAVE = 8

_INDEX = "first boolean, ids binary, nulls int, terms array<string>, ends binary, roots binary, places binary, impacts binary, tops binary, left binary, right binary"
#: A row group for each full shard: Parquet's writer looks at its size every 100 rows by default and would hold so many shards,
#: and readers take the rows of a group together.
_EACH = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def treaps(heap, impacts, starts, ends):
    """left, right, tops and roots of the treaps over the runs [start, end) of postings in search order, with different heap
    values. A place of -1 is no node. A node hangs below the lesser of the nearest higher ones on both sides,
    and rules all between these."""
    import numpy as np

    heap, impacts, starts, ends = np.asarray(heap, np.int64), np.asarray(impacts, np.int32), np.asarray(starts, np.int32), np.asarray(ends, np.int32)
    n = len(heap)
    first, last = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)

    def nearest(step: int, stop):
        """The nearest higher node on one side, or where the run stops: all between is lower, whatever was jumped over."""
        near = np.arange(step, n + step, dtype=np.int32)
        look = np.flatnonzero(near != stop)
        while len(look):
            x = near[look]
            low = heap[x] < heap[look]
            look, x = look[low], x[low]
            near[look] = np.where(near[x] != stop[x], near[x], stop[look])
            look = look[near[look] != stop[look]]
        return near

    before, after = nearest(-1, first - 1), nearest(1, last)
    left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    no_before, no_after = before < first, after >= last
    up, down = heap[np.maximum(before, 0)], heap[np.minimum(after, n - 1)]
    hangs_right = ~no_before & (no_after | (up < down))
    hangs_left = ~no_after & ~hangs_right
    node = np.arange(n, dtype=np.int32)
    right[before[hangs_right]] = node[hangs_right]
    left[after[hangs_left]] = node[hangs_left]
    # The largest impact of a stretch is that of two overlapping ones of a power of two; these double step by step.
    tops, most, size = np.empty(n, np.int32), impacts.copy(), 1
    wide = after - before - 1
    while True:
        at = np.flatnonzero((wide >= size) & (wide < 2 * size))
        tops[at] = np.maximum(most[before[at] + 1], most[after[at] - size])
        if not (wide >= 2 * size).any():
            return left, right, tops, node[no_before & no_after]
        most[: n - size] = np.maximum(most[: n - size], most[size:])
        size *= 2


class _Shard:
    """Gathers documents' postings until they fill a shard."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.clear()

    def clear(self):
        self.vocabulary, self.ids, self.lengths, self.sizes = {}, [], [], []
        self.terms, self.counts = array("i"), array("i")  # four bytes a posting, where lists take forty
        self.filled = 0

    def add(self, doc_id, text: bytes | None):
        words = (text or b"").translate(_BYTES).split()
        if words:
            found, number = Counter(words), self.vocabulary.setdefault
            self.ids.append(doc_id)
            self.lengths.append(len(words))
            self.sizes.append(len(found))
            self.terms.extend([number(t, len(self.vocabulary)) for t in found])
            self.counts.extend(found.values())
            self.filled += len(found)

    def row(self, first: bool) -> dict:
        import numpy as np

        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, tf = (np.array(x, np.int64) for x in (self.terms, self.counts))
        m = 100 - 50 + np.array([50 * n * self.n_docs // self.n_terms for n in self.lengths], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, self.sizes))
        at = np.repeat(place, self.sizes)
        self.terms, self.counts = array("i"), array("i")
        o = np.argsort(term * len(order) + at)
        at, impact = at[o].astype(np.int32), impact[o].astype(np.int32)
        ends = np.cumsum(np.bincount(term, minlength=len(self.vocabulary)))
        del o, tf, term
        chance = np.arange(len(at)) * 0x9E3779B1 & 0xFFFFFFFF
        left, right, tops, roots = (x.tobytes() for x in treaps((impact.astype(np.int64) >> STEP << 32) + chance, impact, np.append(0, ends[:-1]), ends))
        ids = [self.ids[i] for i in order]
        return {"first": first, "ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "nulls": ids.count(None), "terms": [t.decode() for t in self.vocabulary],
                "ends": ends.astype(np.int32).tobytes(), "roots": roots, "places": at.tobytes(), "impacts": impact.tobytes(),
                "tops": tops, "left": left, "right": right}


def term_counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = [len((t or b"").translate(_BYTES).split()) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))], pa.int64()), pa.array([sum(n)], pa.int64())], names=["docs", "terms"])

    with small_batches(docs.sparkSession):
        r = docs.select(F.col("text").cast("string")).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


def build_index(docs: DataFrame, path: str, n_docs: int, n_terms: int) -> None:
    """Writes the shards of docs (doc_id, text): a task's documents as they come, cut every POSTINGS. No shuffle."""

    def run(batches):
        import pyarrow as pa

        from pyspark import TaskContext

        kinds = {"first": pa.bool_(), "nulls": pa.int32(), "terms": pa.list_(pa.string())}
        first = TaskContext.get().partitionId() % WAVE == 0
        shard = _Shard(n_docs, n_terms)

        def cut_off():
            row = shard.row(first)
            shard.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row))

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                shard.add(d, t)
                if shard.filled >= POSTINGS:
                    yield cut_off()
        if shard.filled:
            yield cut_off()

    with small_batches(docs.sparkSession):
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _INDEX).write.options(**_EACH).parquet(path)


class _Treaps:
    """A shard as it is searched."""

    def __init__(self, b):
        import numpy as np

        read = lambda name: np.frombuffer(b.column(name)[0].as_buffer(), np.int32)
        self.ids, self.nulls = np.frombuffer(b.column("ids")[0].as_buffer(), np.int64), b.column("nulls")[0].as_py()
        self.roots, self.places, self.impacts, self.tops, self.left, self.right = map(read, ("roots", "places", "impacts", "tops", "left", "right"))
        self.terms = b.column("terms")[0].values

    def _within(self, node, low, high):
        """The highest node of each treap with a place between low and high, both left out; -1 without any."""
        import numpy as np

        node = node.copy()
        look = np.arange(len(node))
        while True:
            look = look[node[look] >= 0]
            x = node[look]
            at = self.places[x]
            less = at <= low[look]
            out = less | (at >= high[look])
            look, x = look[out], x[out]
            if not len(look):
                return node
            node[look] = np.where(less[out], self.right[x], self.left[x])

    def search(self, lists, weights, k: int, floor: int):
        """Places and scores of the k best documents with a score of at least floor, and above 0; ties to smaller places."""
        import numpy as np

        weights = np.asarray(weights, np.int64)
        nodes = self.roots[np.asarray(lists)]
        floor = max(floor, 1)
        best_at, best = np.empty(0, np.int64), np.empty(0, np.int64)
        heap = [(-int(weights @ self.tops[nodes]), -1, len(self.ids), np.arange(len(nodes)), nodes)]
        while heap:
            last = best_at[-1] if len(best) == k else len(self.ids)
            some, cells = [], 0
            while heap and cells < NODES:
                if -heap[0][0] < floor:
                    heap = []
                    break
                now = heapq.heappop(heap)
                if -now[0] == floor and len(best) == k and now[1] + 1 > last:  # could only tie, behind the k-th
                    continue
                some.append(now)
                cells += len(now[3])
            if not some:
                break
            sizes = np.array([len(s[3]) for s in some])
            term, node = np.concatenate([s[3] for s in some]), np.concatenate([s[4] for s in some])
            ends = np.cumsum(sizes)
            starts = ends - sizes
            share = weights[term] * self.tops[node]
            heavy = np.flatnonzero(share == np.repeat(np.maximum.reduceat(share, starts), sizes))
            heavy = heavy[np.searchsorted(heavy, starts)]  # the first heaviest node of each interval
            at = self.places[node[heavy]].astype(np.int64)
            low, high = np.array([s[1] for s in some]), np.array([s[2] for s in some])
            each, lows, highs = np.repeat(at, sizes), np.repeat(low, sizes), np.repeat(high, sizes)
            here = self._within(node, each - 1, each + 1)
            score = np.add.reduceat(np.where(here >= 0, weights[term] * self.impacts[here], 0), starts)
            best_at, best = np.concatenate([best_at, at]), np.concatenate([best, score])
            keep = best >= floor
            best_at, best = best_at[keep], best[keep]
            first = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[first], best[first]
            if len(best) == k:
                floor = max(floor, int(best[-1]))
            for lo, hi, a, z in ((low, at, lows, each), (at, high, each, highs)):
                part = self._within(node, a, z)
                held = part >= 0
                t, x = term[held], part[held]
                stops = np.concatenate([[0], np.cumsum(held)])[ends]
                begins = np.concatenate([[0], stops[:-1]])
                sums = np.concatenate([[0], np.cumsum(weights[t] * self.tops[x])])
                bound = sums[stops] - sums[begins]
                for i in np.flatnonzero(bound >= floor).tolist():
                    heapq.heappush(heap, (-int(bound[i]), int(lo[i]), int(hi[i]), t[begins[i] : stops[i]], x[begins[i] : stops[i]]))
        return best_at, best


def _document_counts(index: DataFrame, sent) -> DataFrame:
    """number and df of the terms sent that any shard holds."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            for i in range(b.num_rows):
                ends = np.frombuffer(b.column("ends")[i].as_buffer(), np.int32)
                found = pc.index_in(sent.value["terms"], value_set=b.column("terms")[i].values)
                which = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                at = found.drop_null().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(which.astype("int64")), pa.array(np.diff(ends, prepend=0)[at].astype("int64"))], names=["number", "n"])

    return index.select("terms", "ends").mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("df"))


def _wave(index: DataFrame, sent, k: int) -> DataFrame:
    """item (its number in the round), doc_id and score of each shard's best documents."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        told = sent.value
        for b in batches:
            for i in range(b.num_rows):
                shard = _Treaps(b.slice(i, 1))
                at = pc.index_in(told["terms"], value_set=shard.terms).fill_null(-1).to_numpy()
                for item, (numbers, weights) in enumerate(zip(told["items"], told["weights"], strict=True)):
                    lists = at[numbers]
                    held = (lists >= 0) & (weights > 0)
                    if held.any():
                        where, score = shard.search(lists[held], weights[held], k, told["floors"][item])
                        if len(where):
                            ids = pa.array(shard.ids[where], mask=where >= len(shard.ids) - shard.nulls)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), item, np.int64)), ids, pa.array(score)], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def _round(index: DataFrame, pairs: DataFrame, n_docs: int, k: int) -> DataFrame:
    """item_id, rank, doc_id, score for the round's pairs (item_id, term)."""
    import numpy as np
    import pyarrow as pa

    spark = index.sparkSession
    rows = pairs.select("_item", "item_id", "term").orderBy("_item", "term").toArrow()
    numbers: dict = {}
    terms = [numbers.setdefault(t, len(numbers)) for t in rows.column("term").to_pylist()]
    starts = np.flatnonzero(np.diff(rows.column("_item").to_numpy(), prepend=-1))
    items = [np.array(x, np.int64) for x in np.split(np.array(terms, np.int64), starts[1:])]
    names = rows.column("item_id").take(pa.array(starts))
    told = {"terms": pa.array(list(numbers), pa.string())}
    sent = spark.sparkContext.broadcast(told)
    counted = _document_counts(index, sent)
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    weight = np.zeros(len(numbers), np.int64)
    for r in counted.select("number", w.alias("w")).collect():  # as many rows as the round has terms
        weight[r["number"]] = r["w"]
    sent.destroy()
    told |= {"items": items, "weights": [weight[x] for x in items], "floors": [0] * len(items)}
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = None
    for first in (True, False):
        sent = spark.sparkContext.broadcast(told)
        part = _wave(index.where(F.col("first") == first), sent, k)
        found = cut(ranked(part if found is None else part.unionByName(found.drop("rank"))))
        sent.destroy()
        for r in found.where(F.col("rank") == k).select("item", "score").collect():  # a row an item
            told["floors"][r["item"]] = r["score"]
    named = spark.createDataFrame(pa.table({"item": pa.array(range(len(items)), pa.int64()), "item_id": names}))
    return found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of docs (doc_id, text) for every item (item_id, text).

    Rows of docs are documents of their own, repeated or without doc_id too (null comes last among ties); null texts
    have no terms. Rows of one item_id are one item with the terms of them all (those without item_id too). Items
    without a term that any document holds have no rows; an empty table gives none. Other columns are dropped.
    Items go out in rounds of about PAIRS pairs of item and term, and a round in two waves: the first over an eighth of the
    shards, the second over the rest, where each item's k-th score so far prunes. A shard gives k rows an item at most.
    """
    spark = docs.sparkSession
    n_docs, n_terms = term_counts(docs)
    path = scratch(spark, "treaps")
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    pairs = items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    numbered = Window.orderBy("item_id")
    ids = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    total = ids.agg(F.sum("_n")).first()[0] or 0
    rounds = -(-total // PAIRS)
    found = None
    if n_terms and rounds:
        build_index(docs, path, n_docs, n_terms)
        index = spark.read.schema(_INDEX).parquet(path)
        pairs = cut(pairs.withColumn("_round", F.pmod(F.xxhash64("item_id"), F.lit(rounds))))
        with small_batches(spark, 1):
            for r in range(rounds):
                own = pairs.where(F.col("_round") == r).withColumn("_item", F.dense_rank().over(numbered).cast("long") - 1)
                if own.isEmpty():
                    continue
                out = cut(_round(index, own, n_docs, k))
                found = out if found is None else found.unionByName(out)
        shared_files.remove(spark, path)
    if found is None:
        found = items.select("item_id").limit(0).selectExpr("item_id", "CAST(0 AS INT) AS rank", "CAST(0 AS BIGINT) AS doc_id", "CAST(0 AS BIGINT) AS score")
    return found


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM p GROUP BY r, term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
scored AS (SELECT q.item_id, tf.r, any_value(tf.doc_id) AS doc_id,
    CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * s.n_docs) // s.n_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY q.item_id, tf.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scored WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked WHERE k <= {K}
"""
