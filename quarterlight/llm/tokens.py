"""Tokenizing whole texts with the tokenizers library, remembering the ids of repeated words."""

from __future__ import annotations

import json
import os
import re
from array import array

from .common import once

#: White space as the tokenizers' patterns have it: Python's also counts four separators that they don't.
_BLANK, _SOLID = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
#: Latin letters, without the one that is a letter and a mark in lower case.
_LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
#: These and digits, and ASCII marks without the apostrophe: between the two every pattern parts.
_WORD, _MARK = f"[{_LETTERS}0-9]", r"[!-&(-/:-@\[-`{-~]"
_PIECE = rf"{_WORD}++(?={_MARK}|{_BLANK}|\Z)|{_MARK}++(?={_WORD}|{_BLANK}|\Z)|{_SOLID}+"
#: Pieces that are kept for good, and further ones before these are forgotten; those over LONG characters (unbroken runs
#: of any size) are not kept: about 200 bytes each, 500 at most.
KEPT, LATER, LONG = 300_000, 100_000, 48


def _byte_letters() -> list[str]:
    """The characters by which byte-level models spell the 256 bytes: printable ones stand for themselves, the others follow from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in printable else next(others) for b in range(256)]


class _Pieces(dict):
    """Ids of pieces; a missing one is encoded and, if it is short, remembered: the first ones for good, later ones for a while."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.later = encode, []

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= LONG:
            if len(self) >= KEPT:
                if len(self.later) >= LATER:
                    for old in self.later:
                        del self[old]
                    self.later.clear()
                self.later.append(piece)
            self[piece] = ids
        return ids


class Encoder:
    """Gives each text's ids as little-endian unsigned 32-bit integers.

    Two kinds of tokenizer never join what white space parts: byte-level ones without a normalizer keep it
    at the start of the next word, word-end ones drop it. Nor do they join a word and the marks after it. For
    these a text is the sequence of such pieces, so each is encoded once and remembered: the first ones, which
    the common words are among, for good, later ones for a while. Any other tokenizer encodes whole texts.

    The string of an added token (as <|endoftext|>) in a text gives that token's id, as the library does unless told
    otherwise; with special_as_text such a string is encoded as any other text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path) as f:
            said = json.load(f)
        # Added tokens may stand across pieces: texts that hold one, in any case, are encoded whole.
        added = [t["content"] for t in said.get("added_tokens") or [] if not (special_as_text and t.get("special"))]
        self.added = re.compile("|".join(map(re.escape, added)), re.I).search if added else lambda text: None
        pre, norm = said.get("pre_tokenizer") or {}, said.get("normalizer") or {}
        self.words = None
        # Latin letters alone, or after one space, are one word to both kinds: these go to the library's model as they are.
        self.model, self.lower = self.tokenizer.model, False
        self.spelling = dict(enumerate(_byte_letters()))
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
            self.words = re.compile(f" ?{_WORD}++(?=[ .,])|{_BLANK}*(?:{_PIECE})|{_BLANK}+").findall
            self.lone = re.compile(f" ?[{_LETTERS}]+").fullmatch
        elif pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("type") == "Split" and pre["pretokenizers"][0].get("invert") and {n["type"] for n in norm.get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}:
            self.words = re.compile(_PIECE).findall
            self.lower = True
            self.lone = re.compile(f"[{_LETTERS}]+").fullmatch
        self.known = _Pieces(self._piece)

    @classmethod
    def at(cls, path: str, special_as_text: bool = False) -> "Encoder":
        return once(f"{path} {special_as_text}", lambda: cls(path, special_as_text))

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[bytes]:
        """In slices: what the library says of a text takes far more room than its ids."""
        found = []
        for i in range(0, len(texts), 4096):
            found += [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return found

    def _piece(self, piece: str) -> bytes:
        if not self.lone(piece):
            return self._ids(self.tokenizer, [piece])[0]
        spelt = (piece.lower() if self.lower else piece).encode().decode("latin-1").translate(self.spelling)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if self.words is None:
            return self._ids(self.tokenizer, texts)
        ids = self.known.__getitem__
        return [self._ids(self.tokenizer, [t])[0] if self.added(t) else b"".join(map(ids, self.words(t))) for t in texts]
