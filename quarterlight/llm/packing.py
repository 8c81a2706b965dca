"""Best-fit packing by patterns: non-negative least squares says how often which lengths go together."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, prefix_sums, small_batches, table
from .tokens import Encoder

SIZE = 4096
END_ID = 1
#: Lengths are fitted in steps of SIZE / STEPS tokens; patterns have up to three pieces.
STEPS = 256
SLICE = 64
RANK_BITS = 44


def nnls(a, b, most: int):
    """min |a x - b| for x >= 0, by the active-set method of Lawson and Hanson, in at most `most` rounds."""
    import numpy as np

    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(most):
        gain = a.T @ (b - a @ x)
        gain[active] = 0
        best = int(np.argmax(gain))
        if gain[best] <= 1e-8 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        active[best] = True
        while True:
            cols = np.flatnonzero(active)
            sub = a[:, cols]
            s = np.linalg.lstsq(sub, b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[cols] = s
                break
            low = s <= 0
            step = float(np.min(x[cols][low] / np.maximum(x[cols][low] - s[low], 1e-300)))
            x[cols] += step * (s - x[cols])
            active[cols[(x[cols] <= 1e-12) & low]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def _patterns(steps: int) -> list[tuple[int, ...]]:
    """Up to three whole numbers of steps, falling, that fill a sequence."""
    two = [(a, steps - a) for a in range(steps - 1, steps // 2 - 1, -1) if a >= steps - a > 0]
    three = [(a, b, steps - a - b) for a in range(steps - 2, 0, -1) for b in range(min(a, steps - a - 1), 0, -1) if b >= steps - a - b > 0]
    return two + three


def plan(histogram: dict[int, int], size: int = SIZE, steps: int = STEPS) -> list[tuple[int, list[int]]]:
    """Runs of equal sequences, (how many, lengths inside), that take up a histogram of lengths.

    Patterns of two or three rounded lengths that fill a sequence are fitted to the rounded histogram; each
    takes its rounded count of sequences, the last piece of each chosen to fit what the exact lengths leave.
    What the fit leaves over is packed, longest first, into the smallest gap that holds it, else a new
    sequence. Work and result depend on the number of distinct lengths, at most `size`, not on the rows.
    """
    import numpy as np

    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    unit = max(1, size // steps)
    steps = -(-size // unit)
    runs: list[list] = []  # [count, lengths]
    gaps: dict[int, list[int]] = defaultdict(list)  # free tokens -> runs
    spaces: list[int] = []

    def add(count: int, lengths: list[int]) -> None:
        free = size - sum(lengths)
        if free and not gaps[free]:
            insort(spaces, free)
        gaps[free].append(len(runs))
        runs.append([count, lengths])

    if left[size]:
        add(int(left[size]), [size])
        left[size] = 0
    bins = np.zeros(steps + 1)
    lengths = np.flatnonzero(left)
    np.add.at(bins, np.clip((lengths + unit // 2) // unit, 1, steps), left[lengths])
    usable = [p for p in _patterns(steps) if all(bins[k] for k in p)]
    if usable:
        a = np.zeros((steps + 1, len(usable)))
        for k, p in enumerate(usable):
            for s in p:
                a[s, k] += 1
        repeats = np.rint(nnls(a, bins, 3 * steps)).astype(np.int64)
        top = lambda s, most: next((x for x in range(min(s * unit + unit - unit // 2 - 1, most), max(0, s * unit - unit // 2 - 1), -1) if left[x]), 0)
        for k in np.argsort(-repeats, kind="stable"):
            n = int(repeats[k])
            while n > 0:
                taken: list[int] = []
                for s in usable[k][:-1]:
                    x = top(s, size - sum(taken))
                    if not x:
                        break
                    left[x] -= 1
                    taken.append(x)
                rest = size - sum(taken)
                last = next((x for x in range(rest, max(0, rest - 2 * unit), -1) if left[x]), 0) if len(taken) == len(usable[k]) - 1 else 0
                for x in taken:
                    left[x] += 1
                if not last:
                    break
                taken.append(last)
                need = {x: taken.count(x) for x in taken}
                times = min([n, *(int(left[x]) // c for x, c in need.items())])
                for x, c in need.items():
                    left[x] -= c * times
                add(times, taken)
                n -= times
    for x in range(size, 0, -1):
        n = int(left[x])
        while n:
            at = bisect_left(spaces, x)
            if at < len(spaces):
                free = spaces[at]
                run = gaps[free].pop()
                if not gaps[free]:
                    spaces.pop(at)
                count, inside = runs[run]
                each = min(free // x, n)
                times = min(count, n // each)
                if times < count:
                    add(count - times, inside)
                inside = inside + [x] * each
                runs[run] = [0, []]
                add(times, inside)
                n -= times * each
            else:
                each = min(size // x, n)
                times = n // each
                add(times, [x] * each)
                n -= times * each
    return [(c, inside) for c, inside in runs if c]


def slots(runs: list[tuple[int, list[int]]]):
    """Arrays by key (length, rank of its first row): first sequence and offset of consecutive rows of a length."""
    import numpy as np

    used: dict[int, int] = defaultdict(int)
    found, sequence = [], 0
    for count, inside in runs:
        at = 0
        for x in inside:
            found.append(((x << RANK_BITS) + used[x], sequence, at))
            used[x] += count
            at += x
        sequence += count
    return np.array(sorted(found), np.int64).reshape(-1, 3).T.copy()


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every row of docs (doc_id, text).

    Ids of the whole text (null: none) and the end id; more than `size` of them are cut every `size`. A special
    token's string in a text gives its id, or with special_as_text is text like any other.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder, end, most = Encoder.at(tokenizer, special_as_text), np.array([end_id], "<u4").tobytes(), 4 * size
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                rows = []
                for d, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), most)):
                        own = ids[at : at + most]
                        rows.append((d, k, at // 4, len(own) // 4, zlib.crc32(own)) + ((np.frombuffer(own, "<i4"),) if keep_ids else ()))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def pack(lengths: DataFrame, size: int = SIZE, tie: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """lengths (a column length from 1 to size, and columns that tell rows apart) with sequence_id and offset.

    Only the histogram of lengths, at most `size` rows, goes to the driver; the plan that comes back is as
    small. A row's rank among the rows of its length, from ranges of (length, hash), picks its slot, so a
    length that a third of all rows have is dealt out like any other. Rows that are alike share nothing but
    their order; columns named sequence_id or offset are replaced; an empty table gives an empty result.
    """
    import numpy as np

    with small_batches(lengths.sparkSession):
        lengths = lengths.drop("sequence_id", "offset")
        h, row = free(lengths.columns, "_h"), free(lengths.columns, "_row")
        stored = cut(lengths.withColumn(h, F.xxhash64(*tie)))
    histogram = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys, sequence, offset = slots(plan(histogram, size))
    known = sorted(histogram)
    first = np.concatenate([[0], np.cumsum([histogram[x] for x in known])])[: len(known)].astype(np.int64)
    known = np.array(known, np.int64)
    placed = prefix_sums(stored, ["length", h, *tie], {}, row=row)
    schema = placed.drop(h, row).schema
    names = [f.name for f in schema.fields]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column(row).to_numpy() - first[np.searchsorted(known, length)]
            key = (length << RANK_BITS) + rank
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence[at] + key - keys[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    return placed.mapInArrow(run, schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Every piece of every row of docs with its place; repeated rows are packed as often as they come."""
    return pack(pieces(docs, tokenizer, size, end_id), size, ("doc_id", "piece", "ids_crc32"))


def sequences(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """sequence_id and ids of each sequence, its pieces' ids joined by offset: the training rows themselves."""
    placed = pack(pieces(docs, tokenizer, size, end_id, keep_ids=True), size, ("doc_id", "piece", "ids_crc32"))
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(inside.alias("_p")).select("sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096; a null or empty text is one piece, its end id."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
