"""Near-duplicates of the pipeline against brute force over all pairs."""

import numpy as np
import pytest

from quarterlight.llm import similar

DOCS = "doc_id long, text string"


def brute_roots(texts):
    """Classes of texts by Jaccard similarity of five-word shingles, from all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def near_copies(rnd, groups, size, changed):
    """Copies of random texts with a few words changed, near 0.8 on both sides."""
    word = lambda: "".join(rnd.choice(list("abcdefghij"), 5))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(int(rnd.integers(60, 150)))]
        for _ in range(size):
            new = list(base)
            for k in rnd.integers(0, len(base), int(rnd.integers(0, changed + 1))):
                new[k] = word()
            out.append(" ".join(new))
    return out


@pytest.mark.parametrize(("groups", "size", "changed"), [(40, 4, 4), (1, 150, 2), (1, 120, 5)])
def test_classes_are_those_of_all_pairs(spark, groups, size, changed):
    texts = near_copies(np.random.default_rng(size), groups, size, changed)
    want = brute_roots(texts)
    got = {r.doc_id: r.root for r in similar.classes(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    names = {}
    for i, r in enumerate(want):
        names.setdefault(r, set()).add(i)
    classes = {}
    for i, r in got.items():
        classes.setdefault(r, set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, names.values()))
    kept = similar.keep_first(spark.createDataFrame(list(enumerate(texts)), DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(names)


def test_the_pipeline_finds_copies_that_fingerprints_miss(spark):
    import corpus_pipeline

    texts = near_copies(np.random.default_rng(5), 30, 2, 3)
    want = set(brute_roots(texts))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), DOCS), "")
    assert {r.doc_id for r in kept.collect()} == want and len(want) < 60


def test_rows_without_ids_and_repeated_ids(spark):
    rows = [(None, "one text all of its own here"), (None, "another text that is not like it"), (None, "another text that is NOT like it"), (4, "x " * 30), (None, "x " * 30), (7, "twice"), (7, "twice"), (8, None), (9, " \n ")]
    kept = similar.keep_first(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["4", "7", "8", "None", "None"]
    assert len({r.text.lower() for r in kept if r.doc_id is None}) == 2
    assert similar.keep_first(spark.createDataFrame([], DOCS)).count() == 0


def test_heads_of_similar_sets_meet():
    rnd = np.random.default_rng(11)
    for _ in range(300):
        pool = rnd.integers(0, 1 << 60, 80).astype(np.uint64)
        a, b = (np.unique(rnd.choice(pool, int(rnd.integers(1, 60)))) for _ in range(2))
        often = np.unique(rnd.choice(pool, 30))
        table = (often, rnd.integers(0, 4, len(often)).astype(np.uint8))
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            assert len(np.intersect1d(similar.head(a, table), similar.head(b, table)))


def test_passages_that_many_share_bring_nobody_together(spark, monkeypatch):
    monkeypatch.setattr(similar, "LEAST", 4)
    rnd = np.random.default_rng(12)
    word = lambda: "".join(rnd.choice(list("abcdefghij"), 5))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(40)) + " " + passage for _ in range(200)]
    met = []
    inner = similar._similar
    monkeypatch.setattr(similar, "_similar", lambda pairs, texts: met.append(pairs.count()) or inner(pairs, texts))
    kept = similar.keep_first(spark.createDataFrame(list(enumerate([*texts, texts[3] + " end"])), DOCS))
    assert {r.doc_id for r in kept.collect()} == set(range(200)) and sum(met) == 1


def test_unlike_texts_that_share_a_rare_looking_passage(spark, monkeypatch):
    """Without a frequent table all pairs have to be tried: in rounds of bounded size, and no link is lost."""
    monkeypatch.setattr(similar, "LEAST", 1 << 40)
    monkeypatch.setattr(similar, "PAIRS_EACH", 2)
    rnd = np.random.default_rng(13)
    word = lambda: "".join(rnd.choice(list("abcdefghij"), 5))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(30)) + " " + passage for _ in range(60)]
    texts += [texts[5] + " end", texts[9] + " tail"]
    met = []
    inner = similar._similar
    monkeypatch.setattr(similar, "_similar", lambda pairs, texts: met.append(pairs.count()) or inner(pairs, texts))
    got = {r.doc_id: r.root for r in similar.classes(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got[5] == got[60] and got[9] == got[61] and len(set(got.values())) == 60
    members = sum(len(similar.head(similar.shingles(t), (np.empty(0, np.uint64), np.empty(0, np.uint8)))) for t in texts)
    assert len(met) > 2 and sum(met) > len(texts) and max(met) <= 2 * members


def test_marks_leave_similar_sets_in():
    rnd = np.random.default_rng(14)
    told = 0
    for _ in range(400):
        pool = rnd.integers(0, 1 << 60, 400).astype(np.uint64)
        a = np.unique(rnd.choice(pool, int(rnd.integers(1, 400))))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < 0.93], rnd.choice(pool, int(rnd.integers(1, 40)))]))
        words = lambda s: np.frombuffer(similar.marks(s), np.uint64).reshape(1, -1)
        left = similar.possible(np.array([len(a)]), np.array([len(b)]), words(a), words(b))[0]
        both = len(np.intersect1d(a, b))
        alike = both >= 0.8 * (len(a) + len(b) - both)
        assert left or not alike
        told += not left
    assert told


def test_fingerprints_bring_near_copies_together_first(spark, monkeypatch):
    """The method's own step links them, so that the exact join has no pairs left to try."""
    texts = near_copies(np.random.default_rng(15), 3, 1, 0)
    texts += [t + " end" for t in texts] + [t + " end." for t in texts]
    met = []
    inner = similar._fingerprint_pairs
    monkeypatch.setattr(similar, "_fingerprint_pairs", lambda heads: met.append(inner(heads).collect()) or inner(heads))
    got = {r.doc_id: r.root for r in similar.classes(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert len(set(got.values())) == 3 and met[0]


def test_hubs_that_save_little_leave_the_rest_to_all_pairs(spark, monkeypatch):
    """Groups of unlike texts with one near pair each, which a round of hubs meets by chance only."""
    monkeypatch.setattr(similar, "LEAST", 1 << 40)
    rnd = np.random.default_rng(16)
    word = lambda: "".join(rnd.choice(list("abcdefghij"), 5))
    texts = []
    for _ in range(30):
        passage = " ".join(word() for _ in range(60))
        own = [[word() for _ in range(30)] for _ in range(12)]
        own.append([*own[0][:15], word(), *own[0][16:]])
        texts += [" ".join(o) + " " + passage for o in own]
    turns = []
    inner = similar._open_members
    monkeypatch.setattr(similar, "_open_members", lambda members: turns.append(1) or inner(members))
    got = {r.doc_id: r.root for r in similar.classes(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    want = brute_roots(texts)
    assert [got[i] == got[j] for i in range(len(texts)) for j in range(i)] == [want[i] == want[j] for i in range(len(texts)) for j in range(i)]
    assert len(turns) <= 3


@pytest.mark.parametrize("at_once", [1 << 20, 16])
def test_labels_take_no_rounds_where_tasks_hold_the_links(spark, monkeypatch, at_once):
    """Each round of stars stores its links and deals them out several times; few links are hung on each other in a task."""
    from quarterlight.llm import components

    texts = near_copies(np.random.default_rng(17), 1, 60, 5)
    cuts = []
    inner = components.cut
    monkeypatch.setattr(components, "LINKS", at_once, raising=False)
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(1) or inner(df))
    turns, again = [], similar._similar
    monkeypatch.setattr(similar, "_similar", lambda pairs, texts: turns.append(1) or again(pairs, texts))
    got = {r.doc_id: r.root for r in similar.classes(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    want = brute_roots(texts)
    assert [got[i] == got[j] for i in range(len(texts)) for j in range(i)] == [want[i] == want[j] for i in range(len(texts)) for j in range(i)]
    assert turns and (len(cuts) <= len(turns)) == (at_once > len(texts))


def test_links_hung_on_each_other():
    from quarterlight.llm.components import hung

    rnd = np.random.default_rng(18)
    for n in (1, 5, 300):
        a, b = rnd.integers(-n, n, n), rnd.integers(-n, n, n)
        root = {int(x): int(x) for x in [*a, *b]}
        for _ in range(n + 1):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                root[x] = root[y] = min(root[x], root[y])
        nodes, least = hung(a, b)
        assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == root
    chain = np.random.default_rng(19).permutation(2000)
    assert (hung(chain[1:], chain[:-1])[1] == 0).all()
