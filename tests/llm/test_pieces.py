"""Pieces, their spans and decoding against the library, normalising against the library's compiled maps."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quarterlight.llm import pieces
from quarterlight.llm.pieces import Codec, Normaliser

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = list("ab cdé  ́▁中𝄞①ﬁＡ\t\n\x00　​﻿�ｶﾞ<s>/Ææ…½")


def texts(n, longest=30):
    rng = np.random.default_rng(0)
    found = ["".join(rng.choice(ODD, int(rng.integers(0, longest)))) for _ in range(n)]
    return [*found, "", " ", "   ", " a  b ", "▁", "▁▁ ▁", "</s><s>", "<0x41>", "Hello  world.\nNext line ", "x" * 5000, "word " * 3000]


def number(n):
    found = b""
    while n > 127:
        found, n = found + bytes([n & 127 | 128]), n >> 7
    return found + bytes([n])


def with_rule(tmp_path, rule, prefix, squeeze):
    """The model with another compiled map: a later field takes the place of an earlier one."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec() + bytes([3 << 3, prefix, 4 << 3, squeeze])
    with open(MODEL, "rb") as f:
        model = f.read() + bytes([3 << 3 | 2]) + number(len(spec)) + spec
    (tmp_path / "model").write_bytes(model)
    return str(tmp_path / "model"), spec


def check(path, samples):
    codec, library = Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in samples:
        ids, begins, ends = codec.encode(t)
        told, at = library.EncodeAsOffsetMapping(t), np.cumsum([0] + [len(c.encode()) for c in t])
        assert ids.tolist() == [1, *told["ids"], 2], t
        assert list(zip(begins[1:-1], ends[1:-1], strict=True)) == [(at[a], at[b]) for a, b in told["offsets"]], t
        assert codec.decode(ids) == library.decode([1, *told["ids"], 2])


def test_ids_spans_and_text_are_the_library_s():
    check(MODEL, texts(3000))


@pytest.mark.parametrize("rule, prefix, squeeze", [("nmt_nfkc", 1, 1), ("nfkc", 1, 0), ("nmt_nfkc_cf", 0, 1), ("nfkc_cf", 0, 0)])
def test_compiled_maps_are_followed(tmp_path, rule, prefix, squeeze):
    path, spec = with_rule(tmp_path, rule, prefix, squeeze)
    check(path, texts(600))
    own, library = Normaliser(spec), sentencepiece.SentencePieceNormalizer(rule_name=rule)
    assert len(own.map) > 200_000
    for key in list(own.map)[::997]:
        assert library.normalize(f"x{key}x").replace("▁", " ").strip() == own.normalise(f"x{key}x")[0].decode().replace("▁", " ").strip()


def test_unknown_pieces_without_bytes_to_fall_back_on(tmp_path):
    """The same pieces, those for bytes unused: what is no piece is unknown, and a run of it one piece."""
    with open(MODEL, "rb") as f:
        model = f.read()
    unused = [bytes([3 << 3, 5]) if dict(pieces._fields(v)).get(3) == 6 else b"" for k, v in pieces._fields(model) if k == 1]
    parts = [v for k, v in pieces._fields(model) if k == 1]
    rest = [(k, v) for k, v in pieces._fields(model) if k != 1]
    out = b"".join(bytes([1 << 3 | 2]) + number(len(v + u)) + v + u for v, u in zip(parts, unused, strict=True))
    out += b"".join(bytes([k << 3 | 2]) + number(len(v)) + v for k, v in rest) + bytes([2 << 3 | 2, 3]) + number(35 << 3) + b"\0"
    (tmp_path / "model").write_bytes(out)
    check(str(tmp_path / "model"), texts(300))


def test_documents(spark):
    rows = [(3, " née € 𝄞 ", "a"), (1, None, "b"), (2, "", "c"), (None, "x  y", "d"), (7, "same", "e"), (7, "same", "e"), (9, "Wort " * 60_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = pieces.encode_documents(docs, MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((d is None, d or 0, np.array([1, *library.encode(t or ""), 2], "<u4").tobytes()) for d, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in encoded.collect()) == want
    texts_ = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in pieces.decode_documents(encoded, MODEL).collect())
    assert texts_ == sorted((d is None, d or 0, t or "") for d, t, _ in rows)
    found = {r.doc_id: r.pieces for r in pieces.spans(encoded).collect()}
    raw = rows[0][1].encode()
    assert b"".join(raw[p.begin : p.end] for p in found[3][1:-1]) == raw
    assert (found[3][0].begin, found[3][0].end, found[3][-1].begin, found[3][-1].end) == (0, 0, len(raw), len(raw)) and [p.id for p in found[2]] == [1, 2]
    assert pieces.encode_documents(docs.limit(0), MODEL).count() == 0 and pieces.spans(encoded.limit(0)).count() == 0


def test_query_is_the_library_s_on_whole_texts(spark):
    data = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.op12_pieces(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
