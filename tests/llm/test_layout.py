"""Sharding, packing, mixing, token files and the pipeline: exact round trips, laws and odd input."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarterlight.llm import mixing, packing, sharding, token_files
from quarterlight.llm.tokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, shard int, length int, start string"
ROWS = [(3, "b " * 900, "x", 1, 1, "s"), (1, None, None, 1, 1, "s"), (2, "", "x", 1, 1, "s"), (None, "née €", "y", 1, 1, "s"), (7, "same", "x", 1, 1, "s"), (7, "same", "x", 1, 1, "s"), (9, "word " * 30000, "hot", 1, 1, "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def test_shards_are_contiguous_and_even(spark):
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(0, 400, 3000)]
    df = spark.createDataFrame([(int(i), "x" * s) for i, s in zip(rng.permutation(3000), sizes, strict=True)], "doc_id long, text string")
    got = sharding.assign_shards(sharding.sized(df)).toPandas().sort_values("doc_id")
    assert got["shard"].is_monotonic_increasing and set(got["shard"]) == set(range(40))
    total = got.groupby("shard")["size"].sum()
    assert (total - total.mean()).abs().max() <= 416
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    assert (got["slot"].groupby(got["shard"]).diff().dropna() == 1).all()


def test_shards_of_odd_rows(spark, docs):
    got = sharding.assign_shards(sharding.sized(docs)).collect()
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 16 for _, t, *_ in ROWS)
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t, *_ in ROWS)
    assert sharding.assign_shards(sharding.sized(docs.limit(0))).count() == 0
    path = sharding.write_shards(docs.where("doc_id <> 7"), 4)
    back = spark.read.parquet(path)
    assert back.count() == 4


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoding_is_the_library_s(path, as_text):
    plain = Tokenizer.from_file(path)
    if as_text:
        plain.encode_special_tokens = True
    rng = np.random.default_rng(4)
    letters = list("İabç Z'sé \u0301\n\t  \x1c\x85!?1٣Σς.，中\u3000\r\u200b\U0001f600_*#|'d12-×—|<>")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 40)))) for _ in range(5000)] + ["<|endoftext|> a<|endoftext|>", "hello <|endoftext|> x", "", "don't we'll I'M", "x" * 3000]
    texts += [str(rng.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDoftext|>", "<|endoftext|"])).join(texts[i : i + 3]) for i in range(0, 3000, 3)]
    got = Encoder(path, as_text).encode(texts)
    assert all(list(np.frombuffer(g, "<u4")) == e.ids for g, e in zip(got, plain.encode_batch(texts, add_special_tokens=False), strict=True))


def test_encoder_forgets_later_words(monkeypatch):
    from quarterlight.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 3)
    monkeypatch.setattr(tokens, "LATER", 4)
    e = Encoder(BYTE)
    plain = Tokenizer.from_file(BYTE)
    for k in range(40):
        texts = [f"w{k} and w{k + 1} again", f"v{k}"]
        assert [list(np.frombuffer(g, "<u4")) for g in e.encode(texts)] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert len(e.known) < 20


def test_token_files_round_trip(spark, docs):
    path = token_files.write_token_files(docs, BYTE)
    plain = Tokenizer.from_file(BYTE)
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for d, t, *_ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.token_index(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    one = token_files.read_token_files(spark, path).where("doc_id = 3")
    assert len(one.first().ids) == want[[w[0] for w in want].index(3)][2]
    assert token_files.token_index(spark, token_files.write_token_files(docs.limit(0), BYTE)).count() == 0


def check_packing(rows, size):
    seen = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seen.get(r.sequence_id, 0)
        seen[r.sequence_id] = r.offset + r.length
    assert all(n <= size for n in seen.values())
    return len(seen)


def test_packing_of_documents(spark, docs):
    plain = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(docs, WORD).collect()
    check_packing(rows, 4096)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d, t, *_ in ROWS:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by[d], key=lambda r: r.start)
        if d != 7:
            assert [r.piece for r in own] == list(range(-(-len(ids) // 4096)))
            assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.length == min(4096, len(ids) - r.start) for r in own)
    assert len(by[7]) == 2
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0
    seqs = packing.sequences(docs, WORD).collect()
    assert sum(len(s.ids) for s in seqs) == sum(r.length for r in rows)


@pytest.mark.parametrize("kind", ["short", "long", "halves", "few"])
def test_packing_is_near_the_bound(kind):
    rng = np.random.default_rng(6)
    lengths = {"short": rng.integers(1, 800, 20000), "long": np.minimum(4096, rng.lognormal(7, 1, 20000).astype(int) + 1), "halves": np.full(5001, 2048), "few": np.array([4096, 1, 4095, 3000])}[kind]
    hist = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    runs = packing.plan(hist)
    used = {}
    for count, inside in runs:
        assert sum(inside) <= 4096
        for x in inside:
            used[x] = used.get(x, 0) + count
    assert used == hist
    # No packing beats the tokens' bound, nor one sequence for each piece over half a sequence.
    bound = max(-(-int(lengths.sum()) // 4096), int((lengths > 2048).sum()))
    assert sum(c for c, _ in runs) <= bound * 1.01 + 1


def test_least_squares_stay_above_zero():
    rng = np.random.default_rng(7)
    a = rng.random((30, 50))
    x = packing.nnls(a, a @ np.maximum(rng.normal(size=50), 0), 500)
    assert (x >= 0).all()


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else left * w[s] / sum(w[r] for r in rest) for s in names}
        more = {s for s in rest if target[s] > 2 * sizes[s]}
        if not more:
            return target
        full |= more


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, str(rng.choice(["a", "b", "c", "hot", "hot", "hot"])) if i % 50 else None, int(rng.integers(0, 300))) for i in range(6000)]
    rows += [rows[5]] * 3 + [(None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    target = brute_targets(sizes)
    for s, part in got.assign(source=got.source.where(got.source.notna(), None)).groupby("source", dropna=False):
        s = None if s is None or s != s else s
        assert np.isclose(part.target.iloc[0], target[s]) and part.source_size.iloc[0] == sizes[s]
        assert abs(part.taken.sum() - target[s]) <= 300
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    again = mixing.mix(df.repartition(7)).toPandas()
    key = lambda g: sorted(zip(g.doc_id.fillna(-1), g["size"], g.taken, strict=True))
    assert key(got) == key(again)
    assert mixing.mix(df.limit(0)).count() == 0


def test_flight_keeps_its_totals():
    rng = np.random.default_rng(9)
    size, pi = rng.integers(0, 1000, 500), np.full(500, 0.3)
    out = np.array(mixing.fly(size, pi, 1))
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert np.isclose(out.sum(), pi.sum()) and np.isclose((out * size).sum(), (pi * size).sum())
    assert set(mixing.land(list(map(int, size)), list(out))) <= {0.0, 1.0}


def test_hot_sources_fly_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", 10 + i % 90) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 100


def test_mixed_documents_keep_their_columns(spark, docs):
    out = mixing.mixed(docs.withColumn("_times", F.lit(1)).withColumn("_again", F.lit(2)))
    assert out.columns == [*docs.columns, "_times", "_again"]
    words = out.select(F.sum(F.size(F.split(F.trim("text"), " +")))).first()[0]
    assert words is None or words <= 2 * sum(len((t or "").split()) for _, t, *_ in ROWS)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(10)
    text = lambda n: " ".join("".join(rng.choice(list("aeinorst"), int(rng.integers(2, 9)))) for _ in range(n))
    rows = [(i, text(int(rng.integers(30, 200))), "en", f"s{i % 3}", 0) for i in range(300)]
    rows += [(1000 + i, rows[i][1], "en", "s0", 0) for i in range(20)] + [(2000, "short", "en", "s0", 0), (2001, None, None, None, None)]
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(at)
    docs = spark.read.parquet(at)
    columns = docs.columns
    good = corpus_pipeline.quality_rules(spark, docs, "")
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {r[0] for r in rows} - {2000, 2001}
    one = corpus_pipeline.near_duplicates(spark, good, "")
    assert one.columns == columns and {r.doc_id for r in one.collect()} == set(range(300))
    mixed = corpus_pipeline.mixing(spark, one, "")
    assert mixed.columns == columns
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} <= set(range(300))
    check_packing(packed.collect(), 4096)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "mixing", "packing"]


def test_an_empty_corpus_passes_every_stage(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_every_row_is_written_to_a_shard(spark, docs):
    path = sharding.write_shards(docs, 4)
    got = spark.read.parquet(path).select("doc_id", "text", "source", "length", "start").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in docs.select("doc_id", "text", "source", "length", "start").collect())
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert spark.read.parquet(sharding.write_shards(odd, 2)).count() == 3


CLASHING = "doc_id long, text string, source string, _row long, _before long, _range long, _one long, _h long, _first long, _number long, _key long, _times long, sequence_id long, slot long"


def test_columns_with_clashing_names_stay(spark):
    rows = [(i, f"text number {i} " * (i + 1), "s", *[7] * 11) for i in range(30)]
    df = spark.createDataFrame(rows, CLASHING)
    own = [c for c in df.columns if c not in ("doc_id", "text", "source", "sequence_id", "slot")]
    thin = df.withColumns({"size": F.length("text").cast("long"), "text_crc32": F.col("doc_id"), "length": F.length("text") + 1, "piece": F.lit(0), "shard": F.lit("old")})
    placed = sharding.assign_shards(thin, 4)
    packed = packing.pack(thin.withColumn("length", F.length("text")))
    summed = sharding.prefix_sums(thin, ["doc_id"], {"before": "size"}, row="at")
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    for out in (placed, packed, summed, mixed):
        assert out.count() >= (30 if out is not mixed else 1) and {tuple(r) for r in out.select(*own).collect()} == {(7,) * len(own)}
    assert sorted(r.at for r in summed.collect()) == list(range(30)) and {r.shard for r in placed.collect()} == {0, 1, 2, 3}
    back = spark.read.parquet(sharding.write_shards(df, 4))
    assert back.count() == 30 and {tuple(r) for r in back.select(*own).collect()} == {(7,) * len(own)}


def test_mixed_rows_without_ids_and_repeated_ids(spark):
    rng = np.random.default_rng(13)
    rows = [(None if i % 2 else i % 40, " ".join(["w"] * int(rng.integers(5, 60))) + f" {i}", ["a", "b", None][i % 3]) for i in range(900)]
    rows += [(5, "one two three", "a")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = brute_targets(sizes)
    out = mixing.mixed(df).collect()
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert all(abs(taken[s] - target[s]) <= 61 for s in sizes)


def test_rows_without_ids_go_on_in_the_next_file(spark):
    rows = [(None, f"text {i}") for i in range(3000)] + [(i, "numbered") for i in range(100)]
    path = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), BYTE)
    read = token_files.read_token_files(spark, path)
    assert read.where("doc_id IS NULL").select("file").distinct().count() > 1
    got = sorted(token_files.token_index(spark, path).collect(), key=lambda r: r.start)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False)) and len(got) == 3100
    assert [r.doc_id for r in got[3000:]] == list(range(100)) and all(r.doc_id is None for r in got[:3000])


def rows_scanned(df):
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if "Scan" in node.nodeName():
            found.append(node.metrics().get("numOutputRows").get().value())
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
    return found


def test_filters_reach_indexes_and_bloom_filters(spark):
    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "'a few words' AS text").coalesce(1)
    path = token_files.write_token_files(docs, BYTE)
    scanned = lambda where: sum(rows_scanned(token_files.read_token_files(spark, path).where(where)))
    assert 0 < scanned("doc_id = 20000") <= 1000  # one group of rows
    assert scanned("doc_id BETWEEN 500 AND 600") <= 1000
    # No group holds the odd number: its extremes would let it pass, its Bloom filter does not.
    assert sum(scanned(f"doc_id = {k}") for k in (20001, 20003, 30001)) == 0


def test_long_pieces_are_not_kept():
    e = Encoder(BYTE)
    e.encode(["x" * 10_000 + " short", "y" * 100])
    assert all(len(w) <= 48 for w in e.known) and any("short" in w for w in e.known)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_latin_letter_is_spelt_as_the_library_does(path):
    plain = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x41, 0x250)]
    texts = letters + [f"un{c} {c}{c.upper()}s" for c in letters] + ["".join(letters)]
    got = Encoder(path).encode(texts)
    assert all(list(np.frombuffer(g, "<u4")) == e.ids for g, e in zip(got, plain.encode_batch(texts, add_special_tokens=False), strict=True))


def test_rows_alike_are_drawn_as_one(spark, monkeypatch):
    """Rows without id of one size are one row of the flight, however many they are."""
    seen = []
    sample = mixing.balanced_sample
    monkeypatch.setattr(mixing, "balanced_sample", lambda rows: (seen.append(rows.count()), sample(rows))[1])
    rows = [(None, "a", 10)] * 9000 + [(None, "a", None)] * 50 + [(i, "b", 7) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    assert len(got) == len(rows) and seen == [302]
    by = got.groupby("source").agg({"taken": "sum", "target": "first"})
    assert (by["taken"] - by["target"]).abs().max() <= 10
    assert (got["taken"] <= 2 * got["size"]).all()


def test_shared_folders_have_a_scheme(spark):
    """So that Spark and the workers' own files mean the same place."""
    from types import SimpleNamespace

    from quarterlight.llm import common

    for named, start in (("/tmp/checkpoints", "file:/tmp/checkpoints/x-"), ("file:///tmp/checkpoints/", "file:///tmp/checkpoints/x-")):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: named), sparkContext=spark.sparkContext, _jvm=spark._jvm, _jsc=spark._jsc)  # noqa: B023
        assert common.scratch(session, "x").startswith(start)
