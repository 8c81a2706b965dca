"""Exact top-k inner products by block-at-a-time pruning.

Vectors of whole numbers lie in blocks, each a forward index: the ids, the dense rows, and for every
dimension the largest and smallest value inside. The dimension with its sign is the term: a query's bound on a
block is the sum over dimensions of its component times the extreme that helps it most. In a task, each query
takes the blocks by falling bound and scores whole blocks until the bound is below its k-th score so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K = 10
SCALE = 1024
EVERY = 100
#: Rows of a block, and of the clusters that order rows before they are cut into blocks.
BLOCK, PIVOTS = 256, 64
#: Queries that go to all executors at once: QUERIES x dimensions x 8 bytes, 8 MB at 64 dimensions.
QUERIES = 16_384
#: Sums of products up to this are exact in float64.
EXACT = 1 << 53

_INDEX = "dims int, ids binary, vectors binary, high binary, low binary"


def quantised(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and whole numbers floor(1024 x); rows whose id or vector is null, or with null or non-finite components, drop out."""
    v = F.col(vector)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull() & fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("v"))


def build_index(vectors: DataFrame) -> DataFrame:
    """Blocks of the rows (id, v): a partition's rows are ordered by their best pivot (rows of the partition's
    start, a bounded number), so that a block holds like rows and its extremes are tight, then cut. No shuffle."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column("v")
            sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            ids, ends = b.column("id").to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            rows = []
            for d in np.unique(sizes):
                mine = np.flatnonzero(sizes == d)
                x = flat[(ends[mine][:, None] + np.arange(d)).ravel()].reshape(len(mine), d)
                f = x.astype(float)
                best = np.argmax(f @ f[:: max(1, len(f) // PIVOTS)].T, axis=1) if d else np.zeros(len(mine), int)
                order = np.argsort(best, kind="stable")
                for i in range(0, len(mine), BLOCK):
                    take = order[i : i + BLOCK]
                    y = x[take]
                    rows.append((int(d), ids[mine][take].tobytes(), y.tobytes(), y.max(axis=0).tobytes() if d else b"", y.min(axis=0).tobytes() if d else b""))
            if rows:
                kinds = [pa.int32()] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["dims", "ids", "vectors", "high", "low"])

    return vectors.mapInArrow(run, _INDEX)


def _search(blocks, query_ids, queries, k):
    """Best k (score, id) of each query over blocks [(ids, vectors, high, low)] of one dimension; arrays by query."""
    import numpy as np

    n = len(query_ids)
    worst = np.iinfo(np.int64).min + 1  # so that it can be negated
    scores, ids = np.full((n, k), worst), np.full((n, k), np.iinfo(np.int64).max)
    largest = max((int(np.abs(b[1]).max(initial=0)) for b in blocks), default=0)
    exact = queries.shape[1] * int(np.abs(queries).max(initial=0)) * largest <= EXACT
    q = queries.astype(float) if exact else queries
    high, low = np.stack([b[2] for b in blocks]).astype(q.dtype), np.stack([b[3] for b in blocks]).astype(q.dtype)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    alive = np.arange(n)
    for wave in range(len(blocks)):
        at = order[alive, wave]
        go = bounds[alive, at] >= scores[alive, k - 1]  # equal: a smaller id may tie
        alive, at = alive[go], at[go]
        if not len(alive):
            break
        for j in np.unique(at):
            who = alive[at == j]
            s = (q[who] @ blocks[j][1].T.astype(q.dtype)).astype(np.int64)
            i = np.broadcast_to(blocks[j][0], s.shape)
            s = np.where(i == query_ids[who][:, None], worst, s)
            if s.shape[1] > k:  # all that reach the k-th score stay for the tie-break
                keep = np.partition(s, -k, axis=1)[:, -k][:, None] <= s
                some = np.flatnonzero(keep.any(axis=0))
                s, i = s[:, some], i[:, some]
            s, i = np.concatenate([scores[who], s], axis=1), np.concatenate([ids[who], i], axis=1)
            first = np.lexsort((i, -s), axis=1)[:, :k]
            scores[who], ids[who] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
    return scores, ids, worst


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows of the index but those of its own id.

    Queries (id, v) go out in rounds of about QUERIES, each round a broadcast of bounded size against all
    blocks where they lie; a task sends k rows a query at most. A round's winners are stored before the next one
    begins, and its broadcast is given back, so neither the plan nor the driver's memory grows with the queries. Ties go to the smaller id. A query meets
    vectors of its own length only; a query given twice counts once; without candidates it has no rows.
    """
    spark = index.sparkSession
    asked = cut(queries.dropDuplicates(["id"]).repartitionByRange(max(1, -(-queries.count() // QUERIES)), "id").withColumn("_round", F.spark_partition_id()))
    found = None
    for r in sorted(x["_round"] for x in asked.select("_round").distinct().collect()):
        rows = asked.where(F.col("_round") == r).select("id", "v").toArrow()
        sent = spark.sparkContext.broadcast(_by_dims(rows.column("id").to_pylist(), rows.column("v").to_pylist()))
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        out = cut(_round(index, sent, k).withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        sent.destroy()
        found = out if found is None else found.unionByName(out)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if found is None else found


def _by_dims(ids: list[int], vectors: list[list[int]]) -> dict:
    import numpy as np

    found = {}
    for d in {len(v) for v in vectors}:
        mine = [i for i, v in enumerate(vectors) if len(v) == d]
        found[d] = (np.array([ids[i] for i in mine], np.int64), np.array([vectors[i] for i in mine], np.int64).reshape(len(mine), d))
    return found


def _round(index: DataFrame, sent, k: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            blocks = {}
            for d, i, v, h, w in zip(*(b.column(c).to_pylist() for c in ("dims", "ids", "vectors", "high", "low")), strict=True):
                i = np.frombuffer(i, np.int64)
                blocks.setdefault(d, []).append((i, np.frombuffer(v, np.int64).reshape(len(i), d), np.frombuffer(h, np.int64), np.frombuffer(w, np.int64)))
            for d, own in blocks.items():
                if d in sent.value:
                    qi, qv = sent.value[d]
                    s, i, worst = _search(own, qi, qv, k)
                    hit = s > worst
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, hit.sum(axis=1))), pa.array(i[hit]), pa.array(s[hit])], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score long")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of every hundredth vector; vectors that are null or hold null or non-finite components take no part."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return search(cut(build_index(vectors)), vectors.where(F.col("id") % EVERY == 0))


ORACLE = f"""
WITH q AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.id AS query_id, b.id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.id <> b.id AND a.id % {EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= {K}
"""
