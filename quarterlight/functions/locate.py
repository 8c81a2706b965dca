"""Places of a quote on a page: single lines, pairs of lines, else the whole page; and a filter that loses none of them.

Scores of 90 or more leave at most a tenth of both lengths as insertions and deletions, at most a fifth of the
quote. Each spoils one of the quote's disjoint pieces of four characters at most, so a twentieth of the characters'
number of pieces is found unchanged, on diagonals (place less offset) that differ by two elevenths of it at most.
These pieces are a chain: from one to the next it takes as many edits as pieces are left out, and as the diagonal moves,
and all of them together at most a fifth of the quote. The stretch of text there is scored before the page's lines are.
Where the page's text is the shorter, its own pieces have to be in the quote likewise.
"""

from __future__ import annotations

import re

from .fuzzy import partial_of, ratio_of

PIECE, LEAST, BITS = 4, 90.0, 20
#: Cells of a table that tells which pieces stretches of a page have.
TABLE = 1 << 22
#: From this length on a quote may be found fuzzily across the whole page.
MIN_PAGE = 12


def _numbers(t: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for x in re.findall(r"[0-9]+", t):
        out[x] = out.get(x, 0) + 1
    return out


def numbers_in(q: str, t: str) -> bool:
    need, have = _numbers(q), _numbers(t)
    return all(have.get(x, 0) >= n for x, n in need.items())


def partial_both(q: str, t: str, least: float) -> tuple[float, int, int]:
    """As partial_of; of equal lengths, either may be the one that moves."""
    best = partial_of(q, t, least)
    return max(best, (partial_of(t, q, least)[0], 0, len(t))) if len(q) == len(t) and best[0] < 100 else best


def line_score(q: str, t: str, least: float) -> float:
    """A line much shorter than the quote is scored as a whole, one under four fifths of it not at all."""
    if not t or len(t) <= 0.8 * len(q):
        # Very short quotes: a line within two characters counts still.
        if not t or len(t) + 2 < len(q):
            return 0.0
    return ratio_of(q, t) if len(t) + 2 < len(q) else partial_both(q, t, least)[0]


def places(q: str, lines: list[tuple[int, str]], pairs: list[str], whole: str, least: float = LEAST) -> list[tuple[int | None, bool, float]]:
    """(line number, over two lines, score) of all places, best first, those that hold a better one left out; all of
    the quote's numbers have to be there. Without any, the page: (None, False, score) if the quote is in its text."""
    if not q:
        return []
    found = []
    for k, (_, t) in enumerate(lines):
        if (s := line_score(q, t, least)) >= least:
            found.append((round(s, 1), False, k))
        if k < len(pairs) and (s := line_score(q, pairs[k], least)) >= least:
            found.append((round(s, 1), True, k))
    found.sort(key=lambda x: (-x[0], x[1]))
    kept: list[tuple[float, bool, int]] = []
    for s, two, k in found:
        if not any((k <= j <= k + two and j + other <= k + two) or (j <= k <= j + other and k + two <= j + other) for _, other, j in kept):
            kept.append((s, two, k))
    out = [(lines[k][0], two, s) for s, two, k in kept if numbers_in(q, pairs[k] if two else lines[k][1])]
    if out or not whole:
        return out
    if len(q) < MIN_PAGE:
        return [(None, False, 100.0)] if re.search(r"(?<![0-9a-zäöüß/])" + re.escape(q) + r"(?![0-9])", whole) else []
    s, lo, hi = partial_both(q, whole, least)
    region = whole[max(0, lo - 8) : hi + 8] if len(q) <= len(whole) else whole
    return [(None, False, round(s, 1))] if s >= least and numbers_in(q, region) else []


def _codes(t: str):
    import numpy as np

    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) < PIECE:
        return np.empty(0, np.uint32)
    h = c[:-3] * np.uint32(0x9E3779B1)
    for k in range(1, PIECE):
        h = (h ^ c[k : len(c) - 3 + k]) * np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - BITS)


def chained(offsets: list[int], diagonals: list[int], length: int, edits: int) -> bool:
    """May pieces at these offsets of a quote of this length, on these diagonals, be those that so many edits leave?"""
    last = length // PIECE - 1
    done: list[tuple[int, int, int]] = []
    for at, d in sorted((o // PIECE, d) for o, d in zip(offsets, diagonals, strict=True)):
        cost = at
        for i, e, c in done:
            if i < at and (step := c + max(at - i - 1, abs(d - e))) < cost:
                cost = step
        if cost + last - at <= edits:
            return True
        if cost <= edits:
            done.append((at, d, cost))
    return False


class Quotes:
    """Quotes (id, key), ready to be looked for on pages."""

    def __init__(self, quotes: list[tuple[int, str]]):
        import numpy as np

        self.ids, self.keys = [i for i, q in quotes if q], [q for _, q in quotes if q]
        self.grams: list[dict[str, list[int]]] = [{} for _ in self.keys]
        for q, held in zip(self.keys, self.grams, strict=True):
            for i in range(len(q) - PIECE + 1):
                held.setdefault(q[i : i + PIECE], []).append(i)
        # A little more than the bound, for rounding.
        self.edits = np.array([int(0.2 * len(q) + 0.1) for q in self.keys], np.int64)
        self.need = np.array([len(q) // PIECE for q in self.keys], np.int64) - self.edits
        # Pieces drift by the insertions or by the deletions, whichever are more: two elevenths of the quote at most.
        self.drift = np.array([int(2 * len(q) / 11 + 1.1) for q in self.keys], np.int64)
        self.always = [k for k in range(len(self.keys)) if self.need[k] < 1]
        self.by_length: dict[int, list[int]] = {}
        rows = []
        for k, q in enumerate(self.keys):
            for n in range(max(0, len(q) - 2), len(q) + 1):
                self.by_length.setdefault(n, []).append(k)
            if self.need[k] >= 1:
                c = _codes(q)
                rows += [(int(c[i]), k, i) for i in range(0, len(q) - PIECE + 1, PIECE)]
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        self.of, self.offset = table[:, 1], table[:, 2]
        counts = np.bincount(table[:, 0], minlength=1 << BITS)
        self.count, self.start = counts.astype(np.int32), (np.cumsum(counts) - counts).astype(np.int32)

    def _likely(self, text: str) -> set[int]:
        """Quotes with enough pieces near one diagonal of the text."""
        import numpy as np

        out: set[int] = set()
        c = _codes(text)
        at = np.flatnonzero(self.count[c])
        if not len(at):
            return out
        n = self.count[c[at]]
        row = np.repeat(self.start[c[at]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        quote = self.of[row]
        # The quotes are far enough apart that no window reaches from one to the next.
        code = (quote << 40) + np.repeat(at, n) - self.offset[row] + (1 << 32)
        order = np.argsort(code)
        code, offset = code[order], self.offset[row][order]
        quote = code >> 40
        last = np.arange(len(code)) + self.need[quote] - 1
        ok = last < len(code)
        near = np.zeros(len(code), bool)
        near[ok] = code[last[ok]] - code[ok] <= self.drift[quote[ok]]
        first = np.flatnonzero(near)
        end = np.searchsorted(code, code[first] + self.drift[quote[first]], side="right")
        first, end = self._many(first, end, quote, offset)
        seen: dict[int, int] = {}
        needs, all_edits = self.need.tolist(), self.edits.tolist()
        for i, j, k in zip(first.tolist(), end.tolist(), quote[first].tolist(), strict=True):
            d = (int(code[i]) & (1 << 40) - 1) - (1 << 32)
            # A stretch that was tested reaches on for a while.
            if k in out or d < seen.get(k, -(1 << 40)):
                continue
            q, edits, offsets = self.keys[k], all_edits[k], offset[i:j].tolist()
            if len(set(offsets)) < needs[k] or not chained(offsets, (code[i:j] - code[i]).tolist(), len(q), edits):
                continue
            part = text[max(0, d - edits) : d + 2 * len(q) + edits]
            seen[k] = d + len(q) - edits
            # A window that ends with its line is part of one as long as the quote, which has nine elevenths in common with it.
            if len(part) <= len(q) or partial_of(q, part, 81.8)[0]:
                out.add(k)
        return out

    def _many(self, first, end, quote, offset):
        """The stretches of hits with enough different pieces, told in small tables; all of them if too much overlaps."""
        import numpy as np

        wide = end - first
        total, pieces = int(wide.sum()), int(offset.max()) // PIECE + 1
        if total > 16 * TABLE:
            return first, end
        if max(total, len(first) * pieces) > TABLE and len(first) > 1:
            half = len(first) // 2
            parts = [self._many(first[:half], end[:half], quote, offset), self._many(first[half:], end[half:], quote, offset)]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        which = np.repeat(np.arange(len(first)), wide)
        row = np.arange(total) + np.repeat(first - (np.cumsum(wide) - wide), wide)
        met = np.zeros((len(first), pieces), bool)
        met[which, offset[row] // PIECE] = True
        enough = met.sum(axis=1) >= self.need[quote[first]]
        return first[enough], end[enough]

    def _fits(self, t: str, k: int) -> bool:
        """May t, no longer than the quote, score as a part of it?"""
        edits = int(0.2 * len(t) + 0.1)
        if len(t) // PIECE - edits < 1:
            return True
        held = self.grams[k]
        if sum(t[i : i + PIECE] in held for i in range(0, len(t) - PIECE + 1, PIECE)) < len(t) // PIECE - edits:
            return False
        met = [(i, at - i) for i in range(0, len(t) - PIECE + 1, PIECE) for at in held.get(t[i : i + PIECE], ())]
        return chained([i for i, _ in met], [d for _, d in met], len(t), edits)

    def on(self, lines: list[tuple[int, str]], pairs: list[str], odd: list[str], whole: str):
        """(id, line number, over two lines, score) of every quote's places. odd: pairs that aren't the join of their keys."""
        maybe = self._likely("\n".join([whole, " ".join(t for _, t in lines), *odd] if odd else [whole])) | set(self.always)
        for t in [t for _, t in lines] + pairs:
            for k in self.by_length.get(len(t), ()):
                if k not in maybe and self._fits(t, k) and partial_both(self.keys[k], t, LEAST)[0] >= LEAST - 0.1:
                    maybe.add(k)
        for k, q in enumerate(self.keys):
            if whole and MIN_PAGE <= len(q) >= len(whole) and k not in maybe and self._fits(whole, k):
                maybe.add(k)
        for k in sorted(maybe):
            for line, two, score in places(self.keys[k], lines, pairs, whole):
                yield self.ids[k], line, two, score
