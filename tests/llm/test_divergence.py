"""The divergence audit against whole-number arithmetic on dictionaries, and on odd rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarterlight.llm import divergence

DOCS = "lang string, source string, text string, n int, term string, kept string, value int"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs):
    docs = [(a or "", b or "", terms(t)) for a, b, t in docs]
    found = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= 10]
        of = {s: Counter() for a, s, _ in docs if a == lang}
        for a, s, ts in docs:
            if a == lang:
                of[s].update(t for t in ts if df[t] >= 10)

        def share(c, kept=kept):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: share(c) for s, c in of.items()}
        q = share(sum(of.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in of:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in of if o != s]
            best = [(f(p[s][t], q[t]), t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", best)):
                rows = sorted(rows, key=lambda x: (-x[0], x[1].encode()))
                found += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(rows if part == "pair" else rows[:10], 1)]
    return sorted(found)


def corpus():
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("Ab", "été", "ÉTÉ", "中", "zZ", "q") for b in "abcdefghij"]
    docs = []
    for i in range(400):
        p = rng.dirichlet(np.full(len(words), 0.2))
        lang, source = str(rng.choice(["en", "de"])), str(rng.choice(["hot", "hot", "hot", "s1", "ß", "Z"]))
        docs.append((lang, source, "1 ".join(rng.choice(words, int(rng.integers(0, 60)), p=p))))
    docs += [docs[0]] * 20 + [(None, "x", "a b c"), (None, None, "a"), ("", "x", "a"), ("en", "mute", "12 + 3"), ("en", None, None), ("en", "", "long " * 40_000)]
    return docs + [("en", "s1", "tie Tie TIE\nknot")] * 11


@pytest.mark.parametrize("chunk, entries", [(4 << 20, 1 << 14), (64, 20)])
def test_divergences_equal_brute_force(spark, monkeypatch, chunk, entries):
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, "x", "y", 2) for d in docs], DOCS).repartition(3)
    got = divergence.divergences(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_empty_table(spark):
    assert divergence.divergences(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("hash_", [lambda piece: len(piece), lambda piece: 7, lambda piece: piece[0]])
def test_equal_hashes_are_told_apart_by_bytes(monkeypatch, hash_):
    monkeypatch.setattr(divergence, "_hash", hash_)
    texts = ["one two one été", "", "Three TWO\x00two", "été", "中中 中", "x" * 50_000 + " x"]
    out = divergence._counted(pa.array(["en"] * 6), pa.array(["a", "b", "a", "b", "a", "a"]), pa.array(texts))
    got = {tuple(r.values())[1:] for r in out.to_pylist()}
    want = set()
    for s in "ab":
        mine = [terms(t) for t, x in zip(texts, "ababaa", strict=True) if x == s]
        for t in {t for ts in mine for t in ts}:
            want.add((s, t, sum(ts.count(t) for ts in mine), sum(t in ts for ts in mine)))
    assert got == want


def test_short_terms_take_no_hash(monkeypatch):
    """Terms of up to eight bytes are numbers; of these and longer ones, up to the end of the data, each is counted once."""
    hashed = []
    inner = divergence._hash
    monkeypatch.setattr(divergence, "_hash", lambda piece: hashed.append(piece) or inner(piece))
    texts = ["a ab abcdefgh abcdefghi abcdefg", "éééé ABCDEFGH ééééé ab 中中中", "b", "ab", "abcdefgh"]
    out = divergence._counted(pa.array(["en"] * 5), pa.array(["s"] * 5), pa.array(texts))
    want, docs = Counter(w for t in texts for w in terms(t)), Counter(w for t in texts for w in set(terms(t)))
    assert sorted((r["term"], r["n"], r["docs"]) for r in out.to_pylist()) == sorted((w, n, docs[w]) for w, n in want.items())
    assert sorted(hashed) == sorted(w.encode() for w in ("abcdefghi", "ééééé", "中中中"))


def test_texts_do_not_run_together():
    data = np.frombuffer("abécd e".encode(), np.uint8)
    ends = np.array([2, 2, 6, 8])  # ab | nothing | écd is cut in two | the rest
    _, first, last, doc = divergence.slices(data, ends)
    assert list(zip(first, last, doc, strict=True)) == [(0, 2, 0), (2, 6, 2), (7, 8, 3)]


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    for total, kept in ((0, 1), (5, 3), (8 * 10**15, 10**6), (10**13 + 7, 77)):
        counts = [0, total, *(int(x) for x in rng.integers(0, total + 1, 50))]
        assert divergence.shares(counts, total, kept).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in counts]
