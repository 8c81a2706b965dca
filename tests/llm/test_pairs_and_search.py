"""SimHash links, top-k search and connected components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarterlight.llm import simhash, topk
from quarterlight.llm.components import components


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(values, near):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(near(values[i], values[i + 1 :])):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", ["", " \n\t ", "One", "one two", "A b c d", "Äpfel ÄPFEL x\x0by\u00a0z w", "word " * 20000, None])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_spark_hash_is_the_named_one(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("a b c", 42)


def test_links_connect_exactly_what_is_near(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for size, spread in ([(4, 6)] * 60) + [(700, 4)]:  # small groups, and one that crowds its variants
        base = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(size):
            x = base
            for b in rng.choice(64, int(rng.integers(0, spread + 1)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    u = np.array(sorted(fps), np.uint64)
    near = lambda a, rest: np.bitwise_count(a ^ rest) <= 3
    want = {}
    for x, r in zip(u.view(np.int64), classes(u, near), strict=True):
        want.setdefault(r, set()).add(int(x))
    df = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")
    links = simhash.links(df).toPandas()
    assert (np.bitwise_count(links.a.to_numpy().view(np.uint64) ^ links.b.to_numpy().view(np.uint64)) <= 3).all()
    got = {}
    for r in components(spark.createDataFrame(links)).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert all(k == min(v) for k, v in got.items())
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 400)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, **{i: 1 for i in range(200, 400)}}


DOCS = "doc_id long, text string, fp long, component_id string"


def test_near_duplicates_of_odd_rows(spark):
    long = "some words that go on " * 400
    rows = [(5, None, 1, "x"), (3, "", 1, "x"), (9, long, None, "x"), (8, long.upper(), None, None), (None, long, 0, "x"), (7, "quite another text here", 0, "x"), (7, "quite another text here", 0, "x"), (None, "alone", 0, "y")]
    got = sorted(((r.doc_id, r.component_id, r.fingerprint) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert [g[:2] for g in got] == [(3, 3), (5, 3), (7, 7), (7, 7), (8, 8), (9, 8), (None, None), (None, 8)] or {g[:2] for g in got} == {(3, 3), (5, 3), (7, 7), (8, 8), (9, 8), (None, 8), (None, None)}
    assert all(g[2] == "0" * 16 for g in got if g[0] in (3, 5)) and len(got) == 8
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def brute_topk(rows, k):
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("n", [3, 700])
def test_search_is_exact(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.1 * rng.normal(size=8)]) for i in range(n)]
    rows += [(n + k, rows[1][1]) for k in range(30)]  # ties
    rows += [(100000, None), (100100, [1.0] * 7 + [None]), (100200, [float("nan")] * 8), (100300, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    v = topk.quantised(df)
    got = topk.search(topk.build_index(v), v.where("id % 100 = 0"), 10)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 10)


def test_search_in_rounds_prunes_nothing_that_counts(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(501)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.search(topk.build_index(v), v.where("id % 100 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 5)


def test_search_of_nothing(spark):
    v = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(topk.build_index(v), v).count() == 0
    one = topk.quantised(spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>"))
    assert topk.search(topk.build_index(one), one).count() == 0


def test_blocks_that_cannot_matter_are_not_scored():
    rng = np.random.default_rng(3)
    scored = []

    class Watched(np.ndarray):
        @property
        def T(self):  # noqa: N802
            scored.append(1)
            return np.asarray(self).T

    blocks = []
    for k in range(40):
        x = (1000 * np.eye(8)[k % 8] * (1 + k // 8) + rng.integers(-20, 20, (64, 8))).astype(np.int64)
        blocks.append((np.arange(k * 64, k * 64 + 64), x.view(Watched), x.max(axis=0), x.min(axis=0)))
    query = np.array([[900, 10, 0, 0, 0, 0, 0, 0]], np.int64)
    scores, ids, _ = topk._search(blocks, np.array([-1]), query, 10)
    every = sorted(((-int(np.asarray(v) @ query[0]), int(i)) for b in blocks for i, v in zip(b[0], b[1], strict=True)))[:10]
    assert [(-int(s), int(i)) for s, i in zip(scores[0], ids[0], strict=True)] == every
    assert len(scored) <= 5


def test_large_components_are_multiplied_in_whole_numbers(spark):
    rows = [(i, [float(2**17 + i), float(-(2**17)) + i * 3]) for i in range(130)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.quantised(df)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(topk.build_index(v), v.where("id % 100 = 0")).collect())
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    want = [(i, r + 1, j, -x) for i, v in whole if i % 100 == 0 for r, (x, j) in enumerate(sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i)[:10])]
    assert got == sorted(want)
