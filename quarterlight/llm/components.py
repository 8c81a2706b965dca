"""Connected components of a link table, in rounds of joins; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that a task holds at once to hang them on each other: some 100 bytes each.
LINKS = 1 << 20


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def hung(a, b):
    """The nodes of links (arrays a and b), and for each the smallest node that these links reach from it."""
    import numpy as np

    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while True:
        p, q = least[x], least[y]
        unlike = p != q
        if not unlike.any():
            return nodes, nodes[least]
        x, y, p, q = x[unlike], y[unlike], p[unlike], q[unlike]
        np.minimum.at(least, np.maximum(p, q), np.minimum(p, q))
        while (least[least] != least).any():
            least = least[least]


def forest(links: DataFrame) -> tuple[DataFrame, bool]:
    """Stars (a: node, b: the smallest that it reaches, itself too) that join what links (a, b: longs) join, LINKS of these
    hung on each other in a task; and whether one task had them all, so that b is the component's smallest node."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
        if held:
            found = hung(*(np.concatenate(side) for side in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    parts = max(1, -(-links.count() // LINKS))
    # Fewer parts are put together as they lie; more are dealt anew, as nobody knows how full each is.
    dealt = links.coalesce(1) if parts == 1 else links.repartition(parts)
    return cut(dealt.mapInArrow(run, "a long, b long")), parts == 1


def components(links: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for every node of links (a, b: longs; loops and repeats do no harm).

    Alternating large and small stars: each round hangs every node's larger neighbours, then its smaller ones,
    on the smallest node it knows; about log(n) rounds until nothing changes. A round's links are stored on
    shared storage, so lineage stays short. A node with very many links is summed to its minimum in the tasks
    that read them, and the join that follows splits such a key.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(30,0)"))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        # Large star: u's larger neighbours to the smallest of u and its neighbours.
        two = _both(now)
        low = two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = two.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: u and its smaller neighbours to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = cut(small.where("a <> b").distinct())
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    own = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(own.join(roots.select("node"), "node", "left_anti"))
