"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised by the model's compiled character map, the longest prefix that the map has at each place, and every byte of
the result remembers where in the source it comes from. The library's model cuts the normalised text into pieces, whose
lengths give their places in it, and these become byte spans of the source through that memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, once, small_batches, table

#: What stands for a space in pieces.
MARK = "▁"
SLICE = 64
_ENCODED = "doc_id long, ids binary, begins binary, ends binary"


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message: whole numbers, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        found, shift = 0, 0
        while True:
            byte = message[at]
            found |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return found

    while at < len(message):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield field, message[at : at + size]
            at += size


def character_map(compiled: bytes) -> dict[str, str]:
    """Every source string of a compiled map and what takes its place. The map is a double-array trie (its size first, four
    bytes) and after it the replacements, each ended by a zero byte, which the trie's values point at."""
    import numpy as np

    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units, texts = np.frombuffer(compiled[4 : 4 + size], "<u4").astype(np.int64), compiled[4 + size :]
    # Of a unit: bits 0 to 7 and 31 the byte that leads here, 8 whether a value follows, 9 the step of the offset, 10 on the offset.
    label, has_value, offset = units & 0x800000FF, units >> 8 & 1, units >> 10 << ((units & 512) >> 6)
    letters = np.arange(1, 256)
    found, open_ = {}, [(b"", int(offset[0]))]
    while open_:
        key, base = open_.pop()
        at = base ^ letters
        inside = at < len(units)
        at, letter = at[inside], letters[inside]
        hit = label[at] == letter
        for unit, c in zip(at[hit].tolist(), letter[hit].tolist(), strict=True):
            child, below = key + bytes([c]), unit ^ int(offset[unit])
            if has_value[unit]:
                start = int(units[below]) & 0x7FFFFFFF
                found[child.decode()] = texts[start : texts.index(b"\0", start)].decode()
            open_.append((child, below))
    return found


class Normaliser:
    """A model's normalisation with source offsets: the character map, dummy prefix, extra white space and marks for spaces."""

    def __init__(self, spec: bytes = b"", symbols: tuple[str, ...] = ()):
        said = dict(_fields(spec))
        self.map = character_map(said.get(2, b""))
        self.map |= dict.fromkeys(symbols, None)  # a model's own symbols stay as they are, whatever else begins like them
        self.symbols = {s[0] for s in symbols}
        self.prefix, self.squeeze = bool(said.get(3, 1)), bool(said.get(4, 1))
        self.space = MARK if said.get(5, 1) else " "
        self.longest: dict[str, int] = {}
        for key in self.map:
            self.longest[key[0]] = max(self.longest.get(key[0], 0), len(key))
        one = {k for k in self.map if len(k) == 1} | ({" "} if self.squeeze else set())
        two = {(k[0], k[1]) for k in self.map if len(k) > 1}
        in_class = lambda chars: f"[{''.join(map(re.escape, sorted(chars)))}]"
        ways = [in_class(one)] * bool(one) + [f"{in_class({a for a, _ in two})}(?={in_class({b for _, b in two})})"] * bool(two)
        self.changes = re.compile("|".join(ways)).finditer if ways else lambda text: ()

    def _longest(self, text: str, at: int) -> tuple[str, int]:
        """The replacement of the longest prefix of text[at:] that the map has, and how many characters it takes; else the next character."""
        first = text[at]
        lengths = range(min(self.longest.get(first, 0), len(text) - at), 0, -1)
        if first in self.symbols:
            for n in lengths:
                if self.map.get(text[at : at + n], "") is None:
                    return text[at : at + n], n
        for n in lengths:
            if (to := self.map.get(text[at : at + n])) is not None:
                return to, n
        return first, 1

    def normalise(self, text: str):
        """The normalised text as bytes, and for each of its bytes and its end the place in the source's bytes."""
        import numpy as np

        space, parts, places = self.space.encode(), [], []
        after_space, at, byte = self.squeeze, 0, 0

        def take(to: bytes, where):
            """`where`: the place of all of these bytes, or of each one."""
            where = np.broadcast_to(where, len(to))
            if b" " in to and len(space) > 1:
                where = np.repeat(where, np.where(np.frombuffer(to, np.uint8) == 32, len(space), 1))
                to = to.replace(b" ", space)
            parts.append(to)
            places.append(where)

        def plain(upto: int):
            nonlocal at, byte, after_space
            if upto > at:
                raw = text[at:upto].encode()
                take(raw, np.arange(byte, byte + len(raw)))
                at, byte, after_space = upto, byte + len(raw), False

        for m in self.changes(text):
            if m.start() < at:  # inside the last prefix
                continue
            plain(m.start())
            to, n = self._longest(text, at)
            if after_space:
                to = to.lstrip(" ")
            if to:
                take(to.encode(), byte)
                after_space = self.squeeze and to.endswith(" ")
            byte += len(text[at : at + n].encode())
            at += n
        plain(len(text))
        data, where = b"".join(parts), np.concatenate([np.empty(0, np.int64), *places])
        end = byte
        if self.squeeze:
            while data.endswith(space):
                data = data[: -len(space)]
                end = int(where[len(data)])
                where = where[: len(data)]
        if self.prefix and data:
            first = int(where[0])
            data, where = space + data, np.concatenate([np.full(len(space), first), where])
        return data, np.append(where, end)


class Codec:
    """Encodes and decodes as the library does with a model, and tells each piece's byte span in the source."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        kinds, spec, trainer = [], b"", {}
        for field, value in _fields(model):
            if field == 1:
                kinds.append(dict(_fields(value)))
            elif field == 2:
                trainer |= dict(_fields(value))
            elif field == 3:
                spec += value
        if trainer.get(24):
            raise ValueError("models with white space at the end of words are not supported")
        words, kinds = [k[1].decode() for k in kinds], np.array([k.get(3, 1) for k in kinds])
        self.normaliser = Normaliser(spec, tuple(w for w, k in zip(words, kinds, strict=True) if k == 4))
        # The same model without normalisation: a later field takes the place of an earlier one.
        bare = bytes([2 << 3 | 2, 0, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model + bytes([3 << 3 | 2, len(bare)]) + bare)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Bytes that a piece takes up; of pieces for a byte also whether it begins a character.
        self.lone, self.fallback = kinds == 6, bool(trainer.get(35))
        values = np.array([int(w[3:-1], 16) if k == 6 else 0 for w, k in zip(words, kinds, strict=True)])
        self.sizes, self.begins = np.where(self.lone, 1, [len(w.encode()) for w in words]), ~self.lone | (values & 0xC0 != 0x80)

    @classmethod
    def at(cls, path: str) -> "Codec":
        return once(f"pieces {path}", lambda: cls(path))

    def _places(self, data: bytes):
        """ids of the normalised text, and where in its bytes each begins and ends."""
        import numpy as np

        text = data.decode()
        if not self.fallback:  # an unknown piece says nothing of its length
            told = self.bare.EncodeAsOffsetMapping(text)
            widths = np.cumsum([0] + [len(c.encode()) for c in text])
            at = widths[np.array([(0, 0), *told["offsets"]], np.int64)[1:]]
            return np.array(told["ids"], np.int64), at[:, 0], at[:, 1]
        ids = np.array(self.bare.encode(text), np.int64)
        ends = np.cumsum(self.sizes[ids])
        begins = ends - self.sizes[ids]
        lone = self.lone[ids]
        if lone.any():
            first = self.begins[ids]
            begins = np.maximum.accumulate(np.where(first, begins, 0))
            ends = np.where(lone & ~np.append(first[1:], True), begins, ends)
        return ids, begins, ends

    def encode(self, text: str | None):
        """ids, and where each piece begins and ends in the text's UTF-8 bytes; begin and end ids span nothing. Bytes of a
        character that is no piece begin and end at it, but for the last one, which spans it, as the library has it."""
        import numpy as np

        data, source = self.normaliser.normalise(text or "")
        ids, begins, ends = self._places(data)
        join = lambda a, x, b: np.concatenate([[a], x, [b]]).astype("<u4")
        return join(self.library.bos_id(), ids, self.library.eos_id()), join(0, source[begins], source[-1]), join(0, source[ends], source[-1])

    def decode(self, ids) -> str:
        return self.library.decode(ids.tolist())


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, begins and ends of every row of docs (doc_id, text); the arrays are little-endian unsigned 32-bit integers.

    ids have the model's begin and end ids around them; begins and ends are byte offsets in the UTF-8 text. Rows are told apart by
    nothing: repeated rows and those without doc_id come out as often as they come in. Null texts are empty ones, which have begin and
    end ids alone. Other columns are dropped; an empty table gives no rows. Narrow: no shuffle.
    """

    def run(batches):
        import pyarrow as pa

        codec = Codec.at(model)
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                found = [[a.tobytes() for a in codec.encode(t)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.binary()) for x in zip(*found, strict=True))], names=["doc_id", "ids", "begins", "ends"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ENCODED)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and text, the library's decoding of ids (null ids: null)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codec = Codec.at(model)
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                texts = [None if x is None else codec.decode(np.frombuffer(x, "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def spans(encoded: DataFrame) -> DataFrame:
    """doc_id and pieces: an array of (id, begin, end) of each row of encode_documents()."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            read = lambda c: [np.frombuffer(x, "<u4").astype(np.int64) for x in b.column(c).to_pylist()]  # noqa: B023, E731
            ids, begins, ends = read("ids"), read("begins"), read("ends")
            rows = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (ids, begins, ends)], names=["id", "begin", "end"])
            at = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), rows)], names=["doc_id", "pieces"])

    return encoded.mapInArrow(run, "doc_id long, pieces array<struct<id: long, begin: long, end: long>>")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, of where their pieces end, and of what the ids decode to."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    with small_batches(spark):
        decoded = decode_documents(encode_documents(table(spark, sf_dir, "documents"), model), model)
        count = (F.octet_length("ids") / 4).cast("long")
        return cut(decoded.select("doc_id", count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256")))
