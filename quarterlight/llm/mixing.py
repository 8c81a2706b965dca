"""Mixing sources to target weights: balanced samples by the cube method.

A source whose target is r times its size takes every document floor(r) times, and once more a sample with
inclusion probability r - floor(r) each. The sample is drawn by the cube method: inclusion probabilities move
through the null space of the constraints (how many documents, how many words) until all but a few are 0 or
1. Each source is dealt into chunks by a hash of doc_id; a chunk's flight leaves at most two documents open;
the chunks' open documents fly together, and the last few land on the choice nearest the words still due.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, NOT_SPACE, cut, free, row_key, table

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Rows of a chunk, about; open rows of a source are dealt into groups of this size again while they are more.
CHUNK = 4096
SEED = 20
EPS = 1e-9


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size) with target.

    In code point order, null last, sources weigh `weights`, repeating. share of all sizes is dealt by weight;
    no target passes cap times its source's size, and what is over goes to the others by weight until none is
    above: with sources in order of cap * size / weight, the first that isn't full and all after it share what
    the full ones before leave. One row a source: the windows over all rows hold nothing else.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1)
    rows = sources.withColumn("_w", w).withColumn("_cap", F.lit(cap) * F.col("source_size"))
    every, order = Window.partitionBy(), Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    rows = rows.withColumns({
        "_due": F.sum("source_size").over(every) * F.lit(share),
        "_full": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    fair = (F.col("_due") - F.col("_full")) / F.col("_rest")
    rows = rows.withColumn("_level", F.when(fair * F.col("_w") <= F.col("_cap"), fair))
    # The first source with a level sets it for all after it; those before are full.
    level = F.first("_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.coalesce(level * F.col("_w"), F.col("_cap"))
    return rows.withColumn("target", F.least(target, F.col("_cap"))).select("source", "source_size", "target")


def fly(size, pi, seed: int):
    """Inclusion probabilities after the flight: all 0 or 1 but at most two, sums of pi and of pi * size unchanged."""
    import random

    toss = random.Random(seed).random
    pi = [float(x) for x in pi]
    size = [float(x) for x in size]
    open_, k = [], 0
    waiting = iter([i for i, x in enumerate(pi) if EPS < x < 1 - EPS])
    while True:
        for k in waiting:
            open_.append(k)
            if len(open_) == 3:
                break
        if len(open_) < 2:
            break
        if len(open_) == 2:
            a, b = open_
            if size[a] != size[b]:
                break
            u = ((a, 1.0), (b, -1.0))
        else:
            a, b, c = open_
            u = ((a, size[c] - size[b]), (b, size[a] - size[c]), (c, size[b] - size[a]))
            if not any(x for _, x in u):
                u = ((a, 1.0), (b, -1.0))
            most = max(abs(x) for _, x in u)
            u = tuple((i, x / most) for i, x in u if x)
        up = min((1 - pi[i]) / x if x > 0 else pi[i] / -x for i, x in u)
        down = min(pi[i] / x if x > 0 else (1 - pi[i]) / -x for i, x in u)
        step = up if toss() * (up + down) < down else -down
        for i, x in u:
            pi[i] = min(1.0, max(0.0, pi[i] + step * x))
        left = [i for i in open_ if EPS < pi[i] < 1 - EPS]
        for i in open_:
            if i not in left:
                pi[i] = float(round(pi[i]))
        open_ = left
    return pi


def land(size, pi):
    """The 0/1 choice for at most a few open rows whose words come nearest their expectation, by trying all."""
    some = [i for i, x in enumerate(pi) if EPS < x < 1 - EPS]
    pi = [float(round(x)) if i not in some else x for i, x in enumerate(pi)]
    due = sum(pi[i] * size[i] for i in some)
    best = min(range(1 << len(some)), key=lambda m: (abs(due - sum(size[i] for k, i in enumerate(some) if m >> k & 1)), m))
    for k, i in enumerate(some):
        pi[i] = float(best >> k & 1)
    return pi


def _flight(last: bool):
    def run(key, rows):
        import numpy as np
        import pyarrow as pa

        rows = rows.sort_by([("size", "descending"), ("_order", "ascending"), ("_id", "ascending")])  # so that what stays open is small
        size, pi = rows.column("size").to_pylist(), rows.column("pi").to_pylist()
        seed = int(np.bitwise_xor.reduce(rows.column("_order").to_numpy())) ^ SEED
        pi = fly(size, pi, seed)
        if last:
            pi = land(size, pi)
        return rows.set_column(rows.schema.get_field_index("pi"), "pi", pa.array(pi, pa.float64()))

    return run


def _is_open() -> Column:
    return (F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)


def balanced_sample(rows: DataFrame) -> DataFrame:
    """rows (_id, source, size, pi, _order) with pi moved to 0 or 1.

    A chunk is a task's group of about CHUNK rows and leaves two open, so the open rows shrink two
    thousandfold each round; the last round has one group for each source, of CHUNK rows at most or what a
    source is if it is smaller.
    """
    schema = rows.select("_id", "source", "size", "pi", "_order").schema
    done, now = None, rows.select(*schema.names)
    while True:
        counts = now.where(_is_open()).groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
        largest = counts.agg(F.max("_n")).first()[0] or 0
        last = largest <= CHUNK
        n_sources = counts.count() if not last else 0
        if last:
            dealt = now.withColumn("_chunk", F.lit(0).cast("long"))
        else:
            counts = counts.withColumnRenamed("source", "_s")
            side = F.broadcast(counts) if n_sources <= BROADCAST_KEYS else counts
            dealt = now.join(side, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_chunk", F.pmod("_order", F.ceil(F.coalesce("_n", F.lit(1)) / CHUNK).cast("long")))
        dealt = dealt.select(*schema.names, "_chunk")
        fixed = dealt.where(~_is_open()).select(*schema.names)
        flown = cut(dealt.where(_is_open()).groupBy("source", "_chunk").applyInArrow(_flight_drop(last), schema))
        done = fixed if done is None else done.unionByName(fixed)
        if last:
            return done.unionByName(flown)
        now = flown


def _flight_drop(last: bool):
    inner = _flight(last)

    def run(key, rows):
        return inner(key, rows.drop_columns(["_chunk"]))

    return run


def mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """rows (doc_id, source, size) with source_size, target and taken.

    taken is a whole number of times the size, never over cap times it; a source's sum is within about one document
    of its target. Order and chance come from doc_id and size alone, so reruns agree whatever the partitions.
    Null sizes count as 0, null sources are one source; rows of one doc_id are drawn for themselves; an empty
    table gives an empty result.
    """
    rows = cut(rows.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")))
    sources = cut(with_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    small = sources.select(F.col("source").alias("_s"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_r"))
    side = F.broadcast(small) if small.count() <= BROADCAST_KEYS else small
    rated = rows.join(side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # Rows that are alike are drawn as one: all but a fraction of one of their hits is certain, so no number of copies makes a chunk large.
    alike = cut(rated.groupBy(F.col("doc_id").alias("_id"), "source", "size", "source_size", "target", "_r").agg(F.count(F.lit(1)).alias("_n")))
    part = F.col("_n") * (F.col("_r") - F.floor("_r"))
    drawn = alike.withColumn("pi", part - F.floor(part)).withColumn("_sure", F.floor(part)).withColumn("_times", F.floor("_r"))
    found = balanced_sample(drawn.withColumn("_order", F.xxhash64("_id", "size", F.lit(SEED))))
    side = found.select(F.col("_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.round("pi").cast("long").alias("_drawn"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    met = drawn.join(side, same).withColumn("_hits", F.col("_sure") + F.col("_drawn"))
    each = met.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    taken = F.col("size") * (F.col("_times") + F.when(F.col("_k") <= F.col("_hits"), 1).otherwise(0))
    return each.select(F.col("_id").alias("doc_id"), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), (F.col("_times") + F.when(F.col("_k") <= F.col("_hits"), 1).otherwise(0)).cast("int").alias("times"))


def counted(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, source and size in words of whole texts."""
    return docs.select(F.col(id_col).alias("doc_id"), "source", F.coalesce(F.regexp_count(F.col(text), F.lit(f"{NOT_SPACE}+")), F.lit(0)).cast("long").alias("size"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with docs' columns.

    Rows are told apart by a hash of all their columns, so null and repeated doc_ids are documents of their own. Rows
    alike in every column share what the mix takes of them: as many of them come out.
    """
    key, times = free(docs.columns, "_key"), free(docs.columns, "_times")
    keyed = docs.withColumn(key, row_key(docs))
    drawn = cut(mix(counted(keyed, id_col=key)).groupBy("doc_id").agg(F.sum("times").alias(times), F.count(F.lit(1)).alias("n")))
    rows = keyed.dropDuplicates([key]) if drawn.where("n > 1").limit(1).count() else keyed
    met = rows.join(drawn.where(F.col(times) > 0).select(F.col("doc_id").alias(key), times), key)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return met.select(own, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; null texts have no words, null sources are one source."""
    return mix(counted(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")
