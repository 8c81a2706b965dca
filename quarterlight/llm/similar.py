"""Near-duplicates by the Jaccard similarity of five-word shingles: SimHash fingerprints that meet by balls, then an
exact join on the rarest shingles for what these miss.

Texts whose fingerprints (simhash) are linked are held against each other first, on their whole sets: one pair for each
text, with the smallest that it is linked to. What this joins is one class, within which the exact join tries no pairs.

Two sets of n and m shingles with similarity t or more share at least t / (1 + t) * (n + m) of them. So with all
shingles in one order, the first n - ceil(t n) + 1 of one set and of the other have one in common, and the places
of the first that they share leave room for enough after it. Only these heads meet, and pairs that have room;
what meets is verified on the whole sets. Any order gives every pair. The order here puts shingles that many texts
have last, so passages that documents share bring nobody together while a text has a tenth of its own.

A group of near copies shares heads, so its pairs would grow with its square. Members of a shingle are held
against one hub first, and what that links is one class. Pairs within a class change nothing and are left out; when
few enough are left, or a round of hubs takes away no more than a round of all pairs would hold, all pairs across classes
are held against each other, PAIRS_EACH for each member of a shingle at a time. So classes are those of all pairs, whatever the hubs, and no table of pairs grows with a square. The
time does where many texts share a rare-looking passage and yet are unlike: one below the frequent table's share (1/ENTRIES of
all shingles) that makes up a fifth of them.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import BROADCAST_KEYS, cut, release, small_batches, tidy
from .components import components, forest

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
#: Shingles that a task sums up before it tells of those it met twice (of all, if they are at most FEW); those with at
#: least LEAST copies and a share of 1/ENTRIES of all are told to every task: at most ENTRIES of 16 bytes. They only
#: set the order, so results don't depend on these.
FLUSH, FEW, LEAST, ENTRIES = 1 << 21, 1 << 16, 16, 1 << 22
#: Pairs across classes are formed at once up to this many for each member of a shingle.
PAIRS_EACH = 2
#: Bits in which a set's shingles are marked, so that most unlike pairs are told before their texts meet.
MARKS = 1024
SLICE = 128
#: Texts whose copies a task leaves out when it makes heads: as many keys as it remembers.
SEEN = 500_000


def shingles(text: str | None, n: int = SHINGLE):
    """Sorted distinct hashes of all n-word shingles, A-Z in lower case; shorter texts are one shingle, empty ones the hash 0."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    whole = b" ".join(words)
    if len(words) <= n:
        return np.array([xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return np.unique(np.array([xxh64_intdigest(whole[a : b - 1], SEED) for a, b in zip([0, *ends], ends[n - 1 :], strict=False)], np.uint64))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _repeated(batches):
    """Shingles that are met more than once, with how often, and by null the count of all."""
    import numpy as np
    import pyarrow as pa

    release()
    held, n = [], 0

    def flush():
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts > (0 if len(keys) <= FEW else 1)
        tokens = pa.array([*keys[many].view(np.int64).tolist(), None], pa.int64())
        held.clear()
        return pa.RecordBatch.from_arrays([tokens, pa.array(np.append(counts[many], n).astype(np.int64))], names=["token", "n"])

    for b in batches:
        for t in b.column("text").to_pylist():
            held.append(shingles(t))
            n += len(held[-1])
            if n >= FLUSH:
                yield flush()
                n = 0
    if held:
        yield flush()


def frequent(docs: DataFrame):
    """Sorted hashes of frequent shingles, and the logarithm of their counts: at most ENTRIES."""
    import numpy as np

    with small_batches(docs.sparkSession):
        sums = cut(docs.select("text").mapInArrow(_repeated, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = sums.where("token IS NULL").agg(F.sum("n")).first()[0] or 0
    found = sums.where(F.col("token").isNotNull() & (F.col("n") >= max(LEAST, -(-total // ENTRIES)))).toArrow()
    keys, counts = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], np.log2(counts[order]).astype(np.uint8)


def head(found, table):
    """The first shingles of a set in the common order, as many as similar sets can't both do without."""
    import numpy as np

    keys, classes = table
    size = len(found) - math.ceil(SIMILAR * len(found)) + 1
    if not len(keys):
        return found[:size]
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    often = np.where(keys[at] == found, classes[at] + np.uint8(1), np.uint8(0))
    return found[np.argsort(often, kind="stable")[:size]]


def marks(found) -> bytes:
    """A bit for each of MARKS remainders that a set's shingles have."""
    import numpy as np

    bits = np.zeros(MARKS, np.uint8)
    bits[(found % np.uint64(MARKS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def possible(n, m, x, y):
    """Whether sets of n and m shingles with marks x and y (rows of words) can be similar: each mark that only one has is
    a shingle that the other lacks."""
    import numpy as np

    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return apart <= (n + m) * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6


def _possible(batches):
    """The pairs (a, b) of (a, b, n, m, x, y) whose marks leave room."""
    import numpy as np
    import pyarrow as pa

    release()
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("x", "y"))
            at = pa.array(possible(b.column("n").to_numpy(), b.column("m").to_numpy(), x, y))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(at), b.column("b").filter(at)], names=["a", "b"])


def _heads(sent):
    """key, size, fingerprint, marks and head of texts, of copies within a task once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        release()
        seen: set[int] = set()
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                new = {k: t for k, t in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True) if k not in seen}
                if len(seen) < SEEN:
                    seen.update(new)
                if new:
                    sets = [shingles(t) for t in new.values()]
                    heads = [head(s, sent.value) for s in sets]
                    ends = np.cumsum([0, *map(len, heads)], dtype=np.int32)
                    tokens = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(heads).view(np.int64)))
                    fp = np.array([simhash._bits_of(s) for s in sets], np.uint64).view(np.int64)
                    told = [pa.array(list(new), pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp), pa.array(map(marks, sets), pa.binary()), tokens]
                    yield pa.RecordBatch.from_arrays(told, names=["key", "size", "fp", "marks", "tokens"])

    return run


def _packed(batches):
    """Texts in less room, for the shuffle."""
    import pyarrow as pa

    release()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([zlib.compress((t or "").encode(), 1) for t in b.column("text").to_pylist()], pa.binary())], names=["key", "text"])


def _verified(batches):
    """Pairs of texts (a, b, x, y) whose shingles are similar enough; a text that stands in a row of pairs is hashed once."""
    import numpy as np
    import pyarrow as pa

    last: dict[str, tuple] = {}

    def of(side: str, key: int, text: bytes):
        if last.get(side, (None,))[0] != key:
            last[side] = key, shingles(zlib.decompress(text).decode())
        return last[side][1]

    release()
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            part = b.slice(i, SLICE)
            good = []
            for a, c, x, y in zip(*(part.column(n).to_pylist() for n in ("a", "b", "x", "y")), strict=True):
                p, q = of("a", a, x), of("b", c, y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= SIMILAR * (len(p) + len(q) - both))
            at = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(at), part.column("b").filter(at)], names=["a", "b"])


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (key, text) are similar enough. Texts, which compress well, meet their pairs rather
    than sets of hashes. A hub is in many pairs, so the joins may be split but not broadcast."""
    if "x" in pairs.columns:
        pairs = pairs.mapInArrow(_possible, "a long, b long")
    with small_batches(pairs.sparkSession, 256):
        pairs = cut(pairs)
        asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        few = asked.count() <= BROADCAST_KEYS
        held = texts.join(F.broadcast(asked) if few else asked.hint("merge"), "key", "left_semi").mapInArrow(_packed, "key long, text binary").dropDuplicates(["key"])
        one, two = held.select(F.col("key").alias("a"), F.col("text").alias("x")), held.select(F.col("key").alias("b"), F.col("text").alias("y"))
        return cut(pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"))


def _limit(size: Column, at: Column) -> Column:
    """The largest set that a set of this size can be similar to if its shingle at this place is the first that both have."""
    return F.floor((size - at) * F.lit((1 + SIMILAR) / SIMILAR) + 1e-6).cast("int") - size


def _both_sizes(size: Column, most: Column) -> Column:
    """Two numbers in one, for the shuffle."""
    return F.shiftleft(size.cast("long"), 32).bitwiseOR(most.cast("long"))


def _apart(sizes: str) -> list[Column]:
    return [F.shiftright(sizes, 32).cast("int").alias("size"), F.col(sizes).bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("most")]


def _open_members(members: DataFrame) -> DataFrame:
    """The members (token, key, size, most, root) that may still link classes: of two sets the smaller one stands where
    its own size is within its limit, so a shingle of one class or without such a member brings nobody together."""
    fits = F.col("most") >= F.col("size")
    of = members.groupBy("token", "root").agg(F.min(F.when(fits, F.col("size"))).alias("least"))
    of = of.groupBy("token").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("roots")).where("roots > 1 AND least IS NOT NULL")
    return cut(members.join(of.select("token", "least").hint("merge"), "token").where("most >= least").drop("least"))


def _marked(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs (a, b) with both sets' sizes n and m and marks x and y."""
    one, two = (heads.select(F.col("key").alias(k), F.col("size").alias(n), F.col("marks").alias(m)) for k, n, m in (("a", "n", "x"), ("b", "m", "y")))
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "n", "m", "x", "y")


def _fingerprint_pairs(heads: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts: those of one fingerprint with the smallest of them, and this one with that of the smallest
    fingerprint that its own is linked to."""
    fps = cut(heads.groupBy("fp").agg(F.min("key").alias("first")))
    near = simhash.links(fps).select(F.greatest("a", "b").alias("fp"), F.least("a", "b").alias("to")).groupBy("fp").agg(F.min("to").alias("to"))
    to = fps.select(F.col("fp").alias("to"), F.col("first").alias("other"))
    across = near.join(fps.hint("merge"), "fp").join(to.hint("merge"), "to").select("first", "other")
    same = heads.select("fp", "key").join(fps.hint("merge"), "fp").select(F.col("key").alias("first"), F.col("first").alias("other"))
    return across.unionByName(same).where("first <> other").select(F.greatest("first", "other").alias("a"), F.least("first", "other").alias("b")).distinct()


def _labels(links: DataFrame | None, new: DataFrame) -> DataFrame | None:
    """node and root, the class that links and new ones (a, b) give a key; none if there are none. Labels are links of their own:
    what is hung on each other already isn't gone through again."""
    links = new if links is None else links.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new)
    stars, whole = forest(links)
    found = stars.withColumnsRenamed({"a": "node", "b": "root"}) if whole else cut(components(stars))
    return found if found.limit(1).count() else None


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with root, the class that labels give their key."""
    if labels is None:
        return members.withColumn("root", F.col("key"))
    labels = labels.withColumnRenamed("root", "_root")
    return cut(members.join(labels, members["key"] == labels["node"], "left").select("token", "key", "size", "most", F.coalesce("_root", "key").alias("root")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text) and root, which names the class, of every row; the class is what links of
    similarity SIMILAR or more reach. Null and empty texts are copies of each other, and texts without words alike."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    texts = docs.select(text_key(F.col("text")).alias("key"), "text")
    sent = spark.sparkContext.broadcast(frequent(docs))
    with small_batches(spark):
        found = texts.mapInArrow(_heads(sent), "key long, size int, fp long, marks binary, tokens array<long>")
        heads = cut(found.groupBy("key").agg(*[F.first(c).alias(c) for c in ("size", "fp", "marks", "tokens")]))
    sent.destroy()
    labels = _labels(None, _similar(_marked(_fingerprint_pairs(heads), heads), texts))
    tidy(spark)
    each = heads.select("key", "size", F.posexplode("tokens").alias("at", "token"))
    each = each.select("token", "key", _both_sizes(F.col("size"), _limit(F.col("size"), F.col("at"))).alias("sizes"))
    # One shuffle finds the tokens that several texts have and keeps their rows.
    shared = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("n > 1")
    now, last, before = _labelled(cut(shared.select("token", "key", *_apart("sizes"))), labels), False, None
    for turn in range(1_000_000):
        now = _open_members(now)
        tidy(spark)
        fits = F.col("most") >= F.col("size")
        of = now.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(fits, 1)).alias("f"))
        of = of.groupBy("token").agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(F.col("n") * F.col("f")).alias("same"))
        across, held = of.agg(F.sum(F.col("n") * F.col("f") - F.col("same")), F.sum("n")).first()
        if not across:
            break
        at_once = PAIRS_EACH * int(held)
        # Each round adds its plans to the driver: hubs go on only while they save more than one round of all pairs.
        last = last or across <= at_once or (before is not None and before - across <= at_once)
        before = across
        if last:
            # Blocks of the one side, so that a round forms as many pairs as are formed at once anywhere.
            rounds = -(-int(across) // at_once)
            for r in range(rounds):
                own = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(rounds)) == r
                one = now.where(fits & own).select("token", F.col("key").alias("a"), F.col("root").alias("_root"), F.col("size").alias("_size"), F.col("most").alias("_most"))
                met = now.join(one.hint("merge"), "token").where((F.col("key") != F.col("a")) & (F.col("root") != F.col("_root")) & F.col("size").between(F.col("_size"), F.col("_most")) & (F.col("_size") <= F.col("most")))
                labels = _labels(labels, _similar(_marked(met.select(F.greatest("a", "key").alias("a"), F.least("a", "key").alias("b")).distinct(), heads), texts))
                tidy(spark)
            break
        # The first hubs are the texts with the fewest shingles of their own before the common ones.
        order = F.struct(F.col("size") - F.col("most") if not turn else F.lit(0), F.xxhash64("key", F.lit(turn)))
        hub = now.where(fits).groupBy("token").agg(F.min_by(F.struct("key", "root", "size", "most", order.alias("by")), order).alias("hub"))
        met = now.join(hub.hint("merge"), "token").where((F.col("root") != F.col("hub.root")) & (F.col("size") <= F.col("hub.most")) & (F.col("hub.size") <= F.col("most")))
        # One hub for each text and round, of those of all its shingles: pairs carry whole sets.
        met = met.groupBy("key").agg(F.min_by("hub.key", "hub.by").alias("hub"))
        pairs = met.select(F.greatest("key", "hub").alias("a"), F.least("key", "hub").alias("b")).distinct()
        new = _similar(_marked(pairs, heads), texts)
        # A round without links leaves the rest to all pairs that have room.
        last = not new.limit(1).count()
        if not last:
            labels = _labels(labels, new)
            now = _labelled(now.drop("root"), labels)
    if labels is None:
        return keyed.withColumn("root", F.col("key"))
    return keyed.join(labels, keyed["key"] == labels["node"], "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their class, one for each class, with docs' columns.

    First is the smallest doc_id, rows without one come last. Rows of one doc_id count as one document: where
    doc_ids repeat, one of their rows stays. Rows without a doc_id are told apart by class and text.
    """
    found = cut(classes(docs).groupBy("doc_id", "key", "root").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")
    first = found.groupBy("root").agg(F.min(order).alias("o")).select("o.*")
    named = first.where("NOT none").groupBy("doc_id").agg(F.min(F.struct("key", "n")).alias("o")).select("doc_id", "o.*")
    first = cut(named.unionByName(first.where("none").select("doc_id", "key", "n")))
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    same = keyed["doc_id"].eqNullSafe(first["doc_id"]) & (keyed["_key"] == first["key"])
    kept = keyed.join(first.drop("n"), same, "left_semi")
    kept = kept.dropDuplicates(["doc_id", "_key"]) if first.where("n > 1").limit(1).count() else kept
    return kept.drop("_key")
