"""SimHash near-duplicates: fingerprints linked by meet-in-the-middle ball hashing.

Two fingerprints within distance r meet at a variant that lies within half of r of each: each emits the ball
of all variants that near, and rows meet on equal variants. For r = 3 whole balls would need radius 2 on one
side, 2081 variants. So the 64 bits are parted in three blocks, and one block at a time is left out: of three
differing bits one lies in some block, and without that block two remain, which radius 1 on both sides
covers: 131 variants of 42 or 43 bits. What meets is then verified on all 64 bits. Each pair counts at one
variant only, the smallest that it shares in the first block left out for which it meets.

A variant that more than CROWD fingerprints share (a large group of near copies) is not paired up: that changes the
plan, not the classes. Its
fingerprints emit whole balls instead: those with an even number of ones radius 2, the others radius 1. Two that
differ by three bits have unequal parity, so they meet; and everything that meets at a variant with an odd
fingerprint there is within three bits of that one, so a star to it links all without forming pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .components import components

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Bit ranges of the blocks, one of which is left out at a time.
BLOCKS = ((0, 21), (21, 42), (42, 64))
CROWD = 32
SLICE = 256


def _bits_of(hashes):
    """Fingerprint from an array of unsigned 64-bit hashes: a bit is set if it is in over half of them."""
    import numpy as np

    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of the whole text: A-Z in lower case, words without white space, space-joined shingles, repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    if len(words) < shingle:
        return _bits_of(np.array([xxh64_intdigest(whole, seed)], np.uint64))
    return _bits_of(np.array([xxh64_intdigest(whole[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row; null text counts as empty."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                fp = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _rests() -> list[tuple[int, list[int]]]:
    """For each block left out: the mask of the other bits, and these bits one by one."""
    out = []
    for lo, hi in BLOCKS:
        mask = (1 << BITS) - 1 & ~(((1 << hi - lo) - 1) << lo)
        out.append((mask, [1 << k for k in range(BITS) if mask >> k & 1]))
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def _numbers(values: list[int]) -> Column:
    """A constant array of longs, folded from one string rather than compiled value by value."""
    return F.split(F.lit(",".join(str(_signed(v)) for v in values)), ",").cast("array<bigint>")


def _balls(fps: DataFrame) -> DataFrame:
    """left_out, variant, fp: all variants within distance 1 in the bits that are kept."""
    rests = F.array(*[F.struct(F.lit(k).cast("byte").alias("k"), F.lit(_signed(m)).alias("mask"), _numbers([0, *bits]).alias("flips")) for k, (m, bits) in enumerate(_rests())])
    each = fps.select("fp", F.explode(rests).alias("r"))
    return each.select(F.col("r.k").alias("left_out"), F.explode("r.flips").alias("_flip"), "fp", F.col("r.mask").alias("_mask")).select("left_out", F.col("fp").bitwiseAND(F.col("_mask")).bitwiseXOR(F.col("_flip")).alias("variant"), "fp")


def _whole_balls(fps: DataFrame) -> DataFrame:
    """variant, fp, odd: radius 2 for fingerprints with an even number of ones, radius 1 (without itself) for the others."""
    one = [1 << i for i in range(BITS)]
    two = [1 << i | 1 << j for i in range(BITS) for j in range(i)]
    odd = F.bit_count("fp") % 2 == 1
    flips = F.when(odd, _numbers(one)).otherwise(_numbers([0, *one, *two]))
    return fps.select("fp", odd.alias("odd"), F.explode(flips).alias("_flip")).select(F.col("fp").bitwiseXOR(F.col("_flip")).alias("variant"), "fp", "odd")


def _count(x):
    import numpy as np

    return np.bitwise_count(x)


def _pairs(k, variant, fp):
    """Verified pairs (a > b unsigned) among equal (k, variant) of sorted arrays, each at its own variant only."""
    import numpy as np

    masks = np.array([m for m, _ in _rests()], np.uint64)
    found = []
    for step in range(1, CROWD):
        same = (k[step:] == k[:-step]) & (variant[step:] == variant[:-step])
        if not same.any():
            break
        at = np.flatnonzero(same)
        a, b, j, v = fp[at], fp[at + step], k[at], variant[at]
        differ = a ^ b
        near = _count(differ) <= RADIUS
        a, b, j, v, differ = a[near], b[near], j[near], v[near], differ[near]
        rest = _count(differ[:, None] & masks[None, :]) <= RADIUS - 1
        mine = rest.argmax(axis=1) == j
        a, b, j, v, differ = a[mine], b[mine], j[mine], v[mine], differ[mine]
        d = differ & masks[j]
        low = d & (~d + np.uint64(1))
        ra, rb = a & masks[j], b & masks[j]
        first = np.where(_count(d) == 2, np.minimum(ra ^ low, rb ^ low), np.minimum(ra, rb))
        mine = first == v
        found.append((np.maximum(a[mine], b[mine]), np.minimum(a[mine], b[mine])))
    return found


def _meet(batches):
    """Rows sorted by (left_out, variant): links of verified pairs, or (fp, null) for each fp of a crowded variant."""
    import numpy as np
    import pyarrow as pa

    def out(k, v, f):
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
        size = np.diff(np.append(np.flatnonzero(new), len(k)))
        crowd = np.repeat(size > CROWD, size)
        some = np.repeat((size > 1) & (size <= CROWD), size)
        pairs = _pairs(k[some], v[some], f[some])
        many = np.unique(f[crowd])
        a = np.concatenate([*(p[0] for p in pairs), many]).astype(np.uint64).view(np.int64)
        b = np.concatenate([*(p[1] for p in pairs), many]).astype(np.uint64).view(np.int64)
        alone = np.concatenate([np.zeros(len(a) - len(many), bool), np.ones(len(many), bool)])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(alone)], names=["a", "b", "crowded"])

    held = [np.empty(0, np.int8), np.empty(0, np.uint64), np.empty(0, np.uint64)]
    for b in batches:
        new = [b.column("left_out").to_numpy(), b.column("variant").to_numpy().view(np.uint64), b.column("fp").to_numpy().view(np.uint64)]
        k, v, f = (np.concatenate([x, y]) for x, y in zip(held, new, strict=True))
        if not len(k):
            continue
        last = len(k) - int(np.argmax(((k != k[-1]) | (v != v[-1]))[::-1])) if ((k != k[-1]) | (v != v[-1])).any() else 0
        # The last variant may go on in the next batch. One that is crowded already can be told of at once,
        # all but a few rows that keep it known as crowded.
        if len(k) - last > 4 * CROWD:
            yield out(k[: len(k) - CROWD - 1], v[: len(k) - CROWD - 1], f[: len(k) - CROWD - 1])
            last = len(k) - CROWD - 1
        elif last:
            yield out(k[:last], v[:last], f[:last])
        held = [k[last:], v[last:], f[last:]]
    if len(held[0]):
        yield out(*held)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join all of the distinct fingerprints fps (fp) within distance RADIUS: every pair that
    differs by so much is connected through links, and every link is such a pair."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # What is stored may lie in one partition: the balls are to be made in many.
    met = cut(_balls(fps.select("fp").repartition(n)).repartition(n, "left_out", "variant").sortWithinPartitions("left_out", "variant").mapInArrow(_meet, "a long, b long, crowded boolean"))
    pairs = met.where("NOT crowded").select("a", "b")
    crowd = met.where("crowded").select(F.col("a").alias("fp")).distinct()
    parity = _whole_balls(crowd)
    # At a variant with an odd number of ones only radius 1 meets: all within two bits. At the others, an odd
    # fingerprint is the hub. Either way one aggregate gives the hub, and the members join it.
    even_variant = F.bit_count("variant") % 2 == 0
    hubs = parity.groupBy("variant").agg(F.min(F.when(~even_variant | F.col("odd"), F.col("fp"))).alias("hub"), F.count(F.lit(1)).alias("n")).where("hub IS NOT NULL AND n > 1").select("variant", "hub")
    # Planned sizes know nothing of the balls, so no side may be broadcast on their account.
    stars = parity.join(hubs.hint("merge"), "variant").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach, of every row.

    Texts are fingerprinted once; then only distinct fingerprints with their smallest doc_id go on, so a group
    of exact copies is one row. Null and empty texts have fingerprint zero and link like any other; rows with a
    null doc_id get a class but never name it (null if the class has no other); repeated rows come out as often;
    other columns are ignored; an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        rows = cut(fingerprints(docs))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(fps))
    named = fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "root").select("fp", "component_id")
    out = rows.join(classes, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents; null and empty texts have fingerprint zero, rows without doc_id name no class."""
    return near_duplicates(table(spark, sf_dir, "documents"))
