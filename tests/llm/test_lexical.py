"""Treaps and the ranked search over them against brute force, and on odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarterlight.llm import lexical

DOCS, ITEMS = "doc_id long, text string, item_id int, term string, rank int", "item_id long, text string, doc_id string, score int"


def terms(text):
    return re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(terms(t))
    found = []
    for i, asked in of.items():
        scores = []
        for d, c in counted:
            if c:
                m = 50 + 50 * sum(c.values()) * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
                if s > 0:
                    scores.append((-s, d is None, d or 0, d))
        found += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return found


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["Été", "中文", "x9", "ÉTÉ"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda m: ", ".join(rng.choice(words, m, p=p / p.sum()))
    return text, [(int(i), text(int(rng.integers(1, 80)))) for i in rng.permutation(n)]


@pytest.mark.parametrize("postings, wave", [(lexical.POSTINGS, 8), (500, 2)])
def test_search_equals_brute_force(spark, monkeypatch, postings, wave):
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(lexical, "WAVE", wave)
    monkeypatch.setattr(lexical, "PAIRS", 30)
    rng = np.random.default_rng(3)
    text, docs = corpus(rng, 700)
    docs += [(None, docs[5][1]), (None, None), (900, None), (901, "  --- "), (902, "")] + [(1000 + i, docs[3][1]) for i in range(150)] + [docs[8]] * 3 + [(905, "w59 " * 30_000)]
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(12)] + [(50, None), (51, "!?"), (52, "nowhere"), (None, "W1 w2"), (None, "w3"), (7, docs[3][1]), (60, docs[3][1]), (61, "w1")]
    rows = [(d, t, 1, "x", 2) for d, t in docs], [(i, t, "x", 3) for i, t in items]
    got = lexical.search(spark.createDataFrame(rows[0], DOCS).repartition(5), spark.createDataFrame(rows[1], ITEMS), 20).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items, 20), key=key)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a", 1, "x", 2)], DOCS), spark.createDataFrame([(1, "a", "x", 3)], ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        got = lexical.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_treaps_keep_both_orders():
    rng = np.random.default_rng(5)
    ends = np.cumsum(rng.integers(1, 200, 40))
    starts = [0, *ends[:-1].tolist()]
    impacts = rng.integers(0, 50, ends[-1])
    impacts[starts[3] : ends[3]] = 7  # copies
    heap = (impacts.astype(np.int64) // 8 << 32) + (np.arange(len(impacts)) * 0x9E3779B1 & 0xFFFFFFFF)
    left, right, tops, roots = lexical.treaps(heap.tolist(), impacts.tolist(), starts, ends.tolist())

    def walk(i, depth=1):
        if i < 0:
            return [], -1, 0
        a, top_a, da = walk(left[i])
        b, top_b, db = walk(right[i])
        assert all(heap[i] > heap[j] for j in (left[i], right[i]) if j >= 0)
        assert tops[i] == max(impacts[i], top_a, top_b)
        return a + [i] + b, tops[i], 1 + max(da, db)

    for s, e, r in zip(starts, ends, roots, strict=True):
        order, _, depth = walk(r)
        assert order == list(range(s, e)) and depth <= 60


def test_search_leaves_most_documents_alone(monkeypatch):
    """Documents that can't reach the k-th score are not scored."""
    rng = np.random.default_rng(6)
    shard = lexical._Shard(5000, 200_000)
    for i in range(5000):
        shard.add(i, " ".join(["common"] * int(rng.integers(1, 3)) + [f"r{rng.integers(0, 100)}"] + ["pad"] * int(rng.integers(20, 60))).encode())
    row = shard.row(True)
    kinds = {"first": pa.bool_(), "nulls": pa.int32(), "terms": pa.list_(pa.string())}
    t = lexical._Treaps(pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row)))
    monkeypatch.setattr(lexical, "NODES", 64)
    split = []
    within = t._within
    monkeypatch.setattr(t, "_within", lambda node, low, high: (split.append(len(np.unique(low))), within(node, low, high))[1])
    names = row["terms"]
    places, scores = t.search([names.index("common"), names.index("r7")], [10, 5000], 10, 0)
    assert len(places) == 10 and sum(split) / 3 < 1000
    more, _ = t.search([names.index("common"), names.index("r7")], [10, 5000], 10, int(scores[3]))
    assert list(more) == list(places[: len(more)]) and len(more) >= 4


def test_a_full_shard_is_built_in_little_memory():
    import tracemalloc

    rnd = np.random.default_rng(4)
    shard = lexical._Shard(2000, 200_000)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 5000, 150)).encode() for _ in range(2000)]
    tracemalloc.start()
    try:
        for i, t in enumerate(texts):
            shard.add(i, t)
        n = shard.filled
        shard.row(True)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 140 * n


def test_shards_are_written_one_by_one(spark, tmp_path, monkeypatch):
    """Also those of one task; the limit of a group is set low here, as a full shard is over it."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(lexical, "POSTINGS", 2000)
    monkeypatch.setattr(lexical, "_EACH", {**lexical._EACH, "parquet.block.size": "1024"})
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 50), x -> concat('w', x * id % 997))) AS text")
    lexical.build_index(docs, str(tmp_path / "index"), 400, 20_000)
    groups = [pq.ParquetFile(f).metadata for f in (tmp_path / "index").glob("*.parquet")]
    assert sum(m.num_rows for m in groups) > 5 and all(m.num_row_groups >= m.num_rows / 2 for m in groups)
