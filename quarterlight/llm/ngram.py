"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

Words and bigrams are counted in Spark: tasks sort and sum what they read, one row for each shard of hashes
goes through the shuffle, and the shards' sums become files of sorted hash arrays on shared storage, which
workers memory-map. A word's number is its place in the sorted hashes; a bigram's hash is a one-to-one mixing
of two such numbers, so it stands for that bigram alone. Shards take ranges of hashes: a very common word or
pair is one entry of one shard.

Text tokens: words with A-Z in lower case, then one end. The first word's context is the start.
p(w | u) = (max(c(uw) - D, 0) + g(u) p1(w)) / c(u), p1(w) = (max(k(w) - E, 0) + G / (V + 1)) / K, where k(w) counts the
distinct words before w, K is their sum, the discounts D and E come from how many have counts 1 to 4, g and G
give back what was discounted, and a word that training doesn't know has p1 = G / (V + 1) / K.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared_files
from .common import cut, dealt, once, scratch, small_batches, table

FOLDS, HELD_OUT = 7, 2
END = b"\n"  # no word has white space
START_ID, UNKNOWN_ID = 0xFFFFFFFF, 0xFFFFFFFE
#: Distinct words, then bigram tokens, that a task sums up before it sends them on; tokens scored at once.
FLUSH_WORDS, FLUSH_PAIRS, SCORE_TOKENS = 300_000, 2_000_000, 600_000
#: Words whose numbers a worker remembers for good, and further ones before it forgets these; words over LONG bytes it
#: looks up each time.
KEPT, LATER, LONG = 300_000, 100_000, 48
#: Words of one file of contexts: what the shards of pairs add to a file is one row each, whatever their number.
GROUP = 1 << 17
SLICE = 64


def _mix(x):
    """One-to-one on unsigned 64-bit numbers."""
    import numpy as np

    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _unmix(x):
    import numpy as np

    x = x ^ x >> np.uint64(31) ^ x >> np.uint64(62)
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ x >> np.uint64(27) ^ x >> np.uint64(54)
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ x >> np.uint64(30) ^ x >> np.uint64(60)


def _planes(x, kind: str) -> bytes:
    """The bytes of numbers, all first bytes before all second ones, which the shuffle's compression likes."""
    import numpy as np

    return np.ascontiguousarray(x.astype(kind).view("u1").reshape(len(x), -1).T).tobytes()


def _from_planes(b: bytes, kind: str):
    import numpy as np

    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, "u1").reshape(width, -1).T).view(kind).ravel()


def _squeezed(keys, counts, kind: str = "<u4") -> tuple[bytes, bytes]:
    """Sorted keys as their steps, and counts, as planes; what a task counts between two flushes fits 32 bits."""
    import numpy as np

    return _planes(np.diff(keys, prepend=np.zeros(1, keys.dtype)), keys.dtype.str), _planes(counts, kind)


def _unsqueezed(keys: bytes, counts: bytes):
    import numpy as np

    return np.cumsum(_from_planes(keys, "<u8"), dtype="<u8"), _from_planes(counts, "<u4").astype("<u8")


def _summed(keys, counts):
    """Sorted distinct keys with their counts' sums."""
    import numpy as np

    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _by_shard(keys, bits: int):
    """(shard, from, to) of sorted 64-bit keys: shards are ranges of their first bits."""
    import numpy as np

    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
    edges = np.concatenate([[0], edges, [len(keys)]])
    return [(s, int(a), int(b)) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _rows(found, names, kinds):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)


def _count_words(bits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        counter: Counter = Counter()

        def flush():
            keys = np.fromiter(map(xxh64_intdigest, counter), np.uint64, len(counter))
            keys, counts = _summed(keys, np.fromiter(counter.values(), np.uint64, len(counter)))
            counter.clear()
            found = [(s, *_squeezed(keys[a:b], counts[a:b])) for s, a, b in _by_shard(keys, bits)]
            return _rows(found, ["shard", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()])

        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                for t in part.column("text").to_pylist():
                    counter.update(words_of(t))
                counter[END] += part.num_rows
                if len(counter) > FLUSH_WORDS:
                    yield flush()
        if counter:
            yield flush()

    return run


def _shards(batches, columns):
    """(shard, [rows]) of rows sorted by shard."""
    now, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if row[0] != now:
                if held:
                    yield now, held
                now, held = row[0], []
            held.append(row[1:])
    if held:
        yield now, held


def _write_words(folder: str):
    """Writes words-<shard>, hashes then counts, and gives shard, words and tokens."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for shard, rows in _shards(batches, ["shard", "keys", "counts"]):
            parts = [_unsqueezed(*r) for r in rows]
            keys, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            shared_files.write(folder, f"words-{shard}", [keys, counts])
            yield _rows([(shard, len(keys), int(counts.sum()))], ["shard", "n", "tokens"], [pa.int32(), pa.int64(), pa.int64()])

    return run


@dataclass
class Vocabulary:
    """Where the words' files are; starts[s] is the number of shard s's first word, the last one is V."""

    folder: str
    bits: int
    starts: list[int]
    tokens: int

    @property
    def size(self) -> int:
        return self.starts[-1]

    @property
    def groups(self) -> list[int]:
        """Where the files of contexts start, and V; one more file, numbered last, is the start's."""
        return [*range(0, self.size, GROUP), self.size]


class _Words:
    """A worker's view of the vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v, self.files, self.known, self.later = v, {}, {}, []

    def shard(self, s: int):
        if s not in self.files:
            n = self.v.starts[s + 1] - self.v.starts[s]
            raw = shared_files.mapped(self.v.folder, f"words-{s}").view("<u8") if n else None
            self.files[s] = (raw[:n], raw[n:]) if n else None
        return self.files[s]

    def find(self, words: list[bytes]):
        """Numbers of distinct words, UNKNOWN_ID for those that training doesn't have."""
        import numpy as np
        from xxhash import xxh64_intdigest

        keys = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        order = np.argsort(keys)
        keys, out = keys[order], np.full(len(keys), UNKNOWN_ID, np.uint32)
        for s, a, b in _by_shard(keys, self.v.bits):
            if (held := self.shard(s)) is not None:
                at = np.minimum(np.searchsorted(held[0], keys[a:b]), len(held[0]) - 1)
                out[order[a:b]] = np.where(held[0][at] == keys[a:b], at + self.v.starts[s], UNKNOWN_ID)
        return out

    def numbers(self, texts: list[str | None]):
        """(numbers of all tokens, tokens of each text): words and an end each."""
        import numpy as np

        known, later = self.known, self.later
        if len(later) > LATER:
            for w in later:
                del known[w]
            later.clear()
        parted = [words_of(t) for t in texts]
        for p in parted:
            p.append(END)
        new = [w for w in set().union(*parted) if w not in known]
        if new:
            if len(known) >= KEPT:
                later += [w for w in new if len(w) <= LONG]
            known.update(zip(new, self.find(new).tolist(), strict=True))
        sizes = [len(p) for p in parted]
        found = np.fromiter((x for p in parted for x in map(known.__getitem__, p)), np.uint32, sum(sizes))
        for w in new:
            if len(w) > LONG:
                del known[w]
        return found, np.array(sizes)

    @staticmethod
    def gather(numbers, starts: list[int], read, width: int):
        """read(file) rows of each number, files beginning at starts; zeros for the start and for unknown words."""
        import numpy as np

        once, back = np.unique(numbers, return_inverse=True)
        out = np.zeros((len(once), width))
        edges = np.searchsorted(once, np.array(starts, np.uint64))
        for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a:
                out[a:b] = read(s)[once[a:b].astype(np.int64) - starts[s]]
        return out[back]


def _pairs(numbers, sizes):
    """Mixed hash of each token's (word before, word) and the words before."""
    import numpy as np

    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)] = START_ID
    return _mix(before.astype(np.uint64) << np.uint64(32) | numbers), before


def _count_pairs(v: Vocabulary):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = once(v.folder + "/words", lambda: _Words(v))
        held, n = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            found = [(s, *_squeezed(keys[a:b], counts[a:b])) for s, a, b in _by_shard(keys, v.bits)]
            return _rows(found, ["shard", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()])

        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                numbers, sizes = words.numbers(b.column("text").slice(i, SLICE).to_pylist())
                held.append(_pairs(numbers, sizes)[0])
                n += len(numbers)
                if n > FLUSH_PAIRS:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return run


def _write_pairs(v: Vocabulary):
    """Writes pairs-<shard> (hashes, counts up to 255, the rest's places and counts); gives, by file of contexts,
    what the pairs add to contexts (kind 0: tokens and pairs of count 1, 2, more) and to words (kind 1: words before)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        starts = np.array(v.groups, np.uint64)
        names, kinds = ["shard", "kind", "numbers", "a", "b", "c", "d", "of1", "of2", "of3", "of4"], [pa.int32(), pa.int32()] + [pa.binary()] * 5 + [pa.int64()] * 4

        for shard, rows in _shards(batches, ["shard", "keys", "counts"]):
            parts = [_unsqueezed(*r) for r in rows]
            keys, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            many = np.flatnonzero(counts >= 255)
            shared_files.write(v.folder, f"pairs-{shard}", [np.array([len(keys), len(many)], "<u8"), keys, many.astype("<u8"), counts[many], np.minimum(counts, 255).astype("u1")])
            pair = _unmix(keys)
            before, word = (pair >> np.uint64(32)).astype(np.uint64), pair & np.uint64(0xFFFFFFFF)
            of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            found = [(-1, 2, b"", b"", b"", b"", b"", *of)]
            for kind, ids, sums in ((0, before, [counts, counts == 1, counts == 2, counts > 2]), (1, word, [np.ones(len(keys), np.uint64)])):
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                ids, sums = ids[first], [np.add.reduceat(x[order].astype(np.uint64), first) for x in sums]
                edges = np.append(np.searchsorted(ids, starts), len(ids))
                for s, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    if y > x:
                        base = starts[s] if s < len(starts) - 1 else ids[x]
                        data = [_squeezed(ids[x:y] - base, c[x:y], "<u8") for c in sums]
                        found.append((s, kind, data[0][0], *(d[1] for d in data), *[b""] * (4 - len(data)), 0, 0, 0, 0))
            yield _rows(found, names, kinds)

    return run


def _write_contexts(v: Vocabulary, discounts: list[float]):
    """Writes contexts-<file>: tokens after each word, what its pairs' discounts give back, words before it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for shard, rows in _shards(batches, ["shard", "kind", "numbers", "a", "b", "c", "d"]):
            n = v.groups[shard + 1] - v.groups[shard] if shard < len(v.groups) - 1 else 1
            out = np.zeros((n, 3))
            for kind, ids, *data in rows:
                at = np.cumsum(_from_planes(ids, "<u8"), dtype="<u8").astype(np.int64)
                if kind == 0:
                    tokens, *of = (_from_planes(x, "<u8") for x in data)
                    out[at, 0] += tokens
                    out[at, 1] += sum(d * x for d, x in zip(discounts, of, strict=True))
                else:
                    out[at, 2] += _from_planes(data[0], "<u8")
            shared_files.write(v.folder, f"contexts-{shard}", [out])
            k = out[:, 2]
            yield _rows([(shard, float(k.sum()), *(int((k == x).sum()) for x in (1, 2, 3, 4)), int((k > 2).sum()))], ["shard", "k", "of1", "of2", "of3", "of4", "more"], [pa.int32(), pa.float64()] + [pa.int64()] * 5)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """For counts 1, 2 and more; halves where too few kinds of count are there to estimate from."""
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), k + 0.9) for k, d in enumerate(found)]


@dataclass
class Model:
    words: Vocabulary
    pairs: list[float]
    singles: list[float]
    k: float
    back: float

    @property
    def folder(self) -> str:
        return self.words.folder


def train(docs: DataFrame, folder: str | None = None) -> Model:
    """The model of all rows of docs (text), in files in `folder` on shared storage.

    docs is read twice, for words and for pairs. To the driver go one row of sums a shard, twice as many shards as
    the session's shuffle partitions. Without rows the model knows no word.
    """
    spark = docs.sparkSession
    with small_batches(spark, 128):
        return _train(spark, docs, folder or scratch(spark, "ngram"), dealt(spark))


def _train(spark: SparkSession, docs: DataFrame, folder: str, n: int) -> Model:
    bits = max(1, (2 * n - 1).bit_length())
    sharded = "shard int, keys binary, counts binary"
    met = lambda df: df.repartition(n, "shard").sortWithinPartitions("shard")
    sums = met(docs.select("text").mapInArrow(_count_words(bits), sharded)).mapInArrow(_write_words(folder), "shard int, n long, tokens long").collect()
    sizes = {r["shard"]: r["n"] for r in sums}
    starts = [0]
    for s in range(1 << bits):
        starts.append(starts[-1] + sizes.get(s, 0))
    if starts[-1] >= UNKNOWN_ID:
        raise ValueError(f"{starts[-1]} distinct words: their numbers have 32 bits")
    v = Vocabulary(folder, bits, starts, sum(r["tokens"] for r in sums))
    schema = "shard int, kind int, numbers binary, a binary, b binary, c binary, d binary, of1 long, of2 long, of3 long, of4 long"
    parts = cut(met(docs.select("text").mapInArrow(_count_pairs(v), sharded)).mapInArrow(_write_pairs(v), schema))
    of = parts.where("kind = 2").agg(*[F.sum(f"of{k}") for k in (1, 2, 3, 4)]).first()
    pairs = discounts(*(x or 0 for x in of))
    stats = met(parts.where("kind < 2")).mapInArrow(_write_contexts(v, pairs), "shard int, k double, of1 long, of2 long, of3 long, of4 long, more long").collect()
    total = lambda c: sum(r[c] for r in stats)
    singles = discounts(total("of1"), total("of2"), total("of3"), total("of4"))
    back = sum(d * n for d, n in zip(singles, (total("of1"), total("of2"), total("more")), strict=True))
    return Model(v, pairs, singles, total("k"), back)


class _Scorer:
    def __init__(self, m: Model):
        self.m, self.words, self.files, self.contexts = m, _Words(m.words), {}, {}

    def pairs(self, s: int):
        import numpy as np

        if s not in self.files:
            try:
                raw = shared_files.mapped(self.m.folder, f"pairs-{s}")
                n, many = (int(x) for x in raw[:16].view("<u8"))
                edge = 16 + 8 * n + 16 * many
                self.files[s] = raw[16 : 16 + 8 * n].view("<u8"), raw[edge:], np.array(raw[16 + 8 * n : 16 + 8 * (n + many)].view("<u8")), np.array(raw[16 + 8 * (n + many) : edge].view("<u8"))
            except FileNotFoundError:  # no pair has a hash of this shard
                self.files[s] = None
        return self.files[s]

    def context(self, s: int):
        if s not in self.contexts:
            self.contexts[s] = shared_files.mapped(self.m.folder, f"contexts-{s}").view("<f8").reshape(-1, 3)
        return self.contexts[s]

    def pair_counts(self, keys):
        import numpy as np

        once, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(once))
        for s, a, b in _by_shard(once, self.m.words.bits):
            if (held := self.pairs(s)) is not None:
                hashes, counts, places, large = held
                at = np.minimum(np.searchsorted(hashes, once[a:b]), len(hashes) - 1)
                hit = hashes[at] == once[a:b]
                c = np.where(hit, counts[at], 0).astype(float)
                if len(places):
                    big = c == 255
                    c[big] = large[np.searchsorted(places, at[big].astype(np.uint64))]
                out[a:b] = c
        return out[back]

    def score(self, numbers, sizes):
        """For each text: tokens that training knows, base score, score."""
        import numpy as np

        m, v = self.m, self.m.words
        n, total = v.size, v.tokens
        known = numbers < UNKNOWN_ID
        keys, before = _pairs(numbers, sizes)
        counts = self.words.gather(numbers, v.starts, lambda s: self.words.shard(s)[1][:, None], 1)
        base = np.log10((counts[:, 0] + 1) / (total + (n + 1)))
        if not n:
            score = np.zeros(len(numbers))
        else:
            k = self.words.gather(numbers, v.groups, self.context, 3)[:, 2]
            one = (k - np.where(k > 0, np.array([0.0, *m.singles])[np.minimum(k, 3).astype(int)], 0) + m.back / (n + 1)) / m.k
            context = self.words.gather(before, v.groups, self.context, 3)
            context[before == START_ID] = self.context(len(v.groups) - 1)[0]
            c = np.zeros(len(numbers))
            both = known & (before != UNKNOWN_ID)
            c[both] = self.pair_counts(keys[both])
            top = np.maximum(c - np.array([0.0, *m.pairs])[np.minimum(c, 3).astype(int)], 0) + context[:, 1] * one
            score = np.log10(np.where(context[:, 0] > 0, top / np.maximum(context[:, 0], 1), one))
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(known.astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(score, at)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, and any columns, those of the new names replaced) without text, with n_tokens, n_known, train_tokens, base_score, score and perplexity.

    Null text is empty: its one token is the end. Each row is scored for itself, so repeated rows score alike.
    """
    new = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double", "perplexity": "double"}
    names = [c for c in docs.columns if c != "text" and c not in new]
    schema = docs.select(*[f"`{c}`" for c in names]).schema
    for c, kind in new.items():
        schema = schema.add(c, kind)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scorer = once(model.folder, lambda: _Scorer(model))
        for b in batches:
            done = [[], [], [], []]
            numbers, sizes, n = [], [], 0
            for i in range(0, b.num_rows, SLICE):
                x, y = scorer.words.numbers(b.column("text").slice(i, SLICE).to_pylist())
                numbers.append(x)
                sizes.append(y)
                n += len(x)
                if n > SCORE_TOKENS or i + SLICE >= b.num_rows:
                    y = np.concatenate(sizes)
                    for held, x in zip(done, (y, *scorer.score(np.concatenate(numbers), y)), strict=True):
                        held.append(x)
                    numbers, sizes, n = [], [], 0
            if b.num_rows:
                tokens, known, base, own = (np.concatenate(x) for x in done)
                more = [tokens, known, np.full(len(tokens), model.words.tokens), base, own, np.power(10.0, np.minimum(300, -own / tokens))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *map(pa.array, more)], names=schema.names)

    return docs.select(*[f"`{c}`" for c in names], "text").mapInArrow(run, schema)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a null or empty text is its end, a null doc_id counts as an empty one."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    docs = docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), "text")
    model = train(docs.where("NOT held_out"))
    with small_batches(spark, 1024):
        out = cut(score(docs, model))  # so that the model can go
    shared_files.remove(spark, model.folder)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
