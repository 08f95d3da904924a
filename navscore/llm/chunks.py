"""Cutting texts at spaces where no pre-token of the byte-level pattern can span.

The pattern attaches one space to what follows it, and keeps a run of white space together
up to its last character. A space with a character other than white space on either side
therefore always starts a pre-token: the text can be cut there and equal pieces share their
result. Pieces are looked up in a memo whose bytes are bounded; when it is full it keeps what
is wanted just then, which costs time only. Long pieces are not remembered: a text without
spaces is one piece.

``starts`` cuts the bytes of many texts at once, and also between ASCII letters, digits and
marks. It cuts only where the pattern ends a pre-token whatever stands further on, so every
part gives the same pre-tokens alone as in its text; where the neighbours leave that open it
does not cut.

Defined cases: an empty text is one empty piece; no pieces give no results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np

MEMO = 64 << 20  # bytes
ENTRY = 100  # bytes of a dictionary's entry
LONG = 256  # characters
SEGMENT = 1 << 20

_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_AFTER_SPACE = [" " + c for c in _WHITE]
_ASCII_AFTER_SPACE = [pair for pair in _AFTER_SPACE if pair.isascii()]
_SAFE = re.compile(r"(?<=\S) | (?=\S)")

# Classes of bytes. UNSURE may be or begin white space; HIGH are the other bytes of longer characters.
_LETTER, _DIGIT, _SPACE, _LINE, _MARK, _QUOTE, _HIGH, _UNSURE = range(8)


def _classes() -> np.ndarray:
    kinds = np.full(256, _MARK, np.uint8)
    kinds[128:] = _HIGH
    for kind, chars in (
        (_LETTER, [*range(65, 91), *range(97, 123)]),
        (_DIGIT, range(48, 58)),
        (_SPACE, [32]),
        (_LINE, range(9, 14)),
        (_QUOTE, [39]),  # may begin a contraction
        (_UNSURE, [*range(28, 32), *{c.encode()[0] for c in _WHITE if c > "\x7f"}]),
    ):
        kinds[list(chars)] = kind
    return kinds


def _ends() -> np.ndarray:
    """Whether a pre-token ends between two bytes, by their classes."""
    ends = np.zeros((8, 8), bool)
    ends[_LETTER, [_DIGIT, _SPACE, _LINE, _MARK, _QUOTE]] = True
    ends[_DIGIT, [_LETTER, _SPACE, _LINE, _MARK, _QUOTE]] = True
    ends[_MARK, [_LETTER, _DIGIT, _SPACE, _LINE]] = True
    ends[_QUOTE, [_DIGIT, _SPACE, _LINE]] = True
    return ends.ravel()


_CLASS, _END = _classes(), _ends()
_SOLID = np.isin(np.arange(8), [_LETTER, _DIGIT, _MARK, _QUOTE])  # not white space for certain
_WIDE = [int.from_bytes(c.encode()) for c in _WHITE if c > "\x7f"]


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts start in the bytes of texts that lie one behind the other.

    ``offsets`` are the ends of the texts, with 0 before them; empty texts have no part.
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    kind = _CLASS[data]
    pair = kind[:-1] << 3 | kind[1:]
    cut[1:-1] |= _END[pair]
    # white space behind a longer character, unless that is white space
    at = np.flatnonzero((pair == (_HIGH << 3 | _SPACE)) | (pair == (_HIGH << 3 | _LINE))) + 1
    two = data[at - 2].astype(np.int32) << 8 | data[at - 1]
    three = data[at - 3].astype(np.int32) << 16 | two
    cut[at[~(np.isin(two, _WIDE) | np.isin(three, _WIDE))]] = True
    # a single character of white space that the next token does not take
    at = np.flatnonzero(kind[1:-1] == _LINE) + 1
    after = kind[at + 1]
    cut[at[_SOLID[kind[at - 1]] & (_SOLID[after] | (after == _HIGH))] + 1] = True
    return np.flatnonzero(cut[:-1])


def spaced(text: str) -> list[str]:
    """Pieces of a text; every piece but the first has lost the space it starts with."""
    pairs = _ASCII_AFTER_SPACE if text.isascii() else _AFTER_SPACE
    if text.endswith(" ") or any(pair in text for pair in pairs):
        return _SAFE.split(text)
    return text.split(" ")


def segments(text: str) -> Iterator[str]:
    """A text in parts of about ``SEGMENT`` characters cut at safe spaces; all but the first
    part start with a space."""
    start = 0
    while len(text) - start > SEGMENT:
        cut = _SAFE.search(text, start + SEGMENT)
        if cut is None or cut.start() <= start:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Memo:
    """Results of pieces, computed for many new pieces at a time; at most ``size`` bytes of
    pieces and results are remembered from one call to the next."""

    def __init__(self, solve: Callable[[list[str]], list], size: int = MEMO):
        self.solve, self.size = solve, size
        self.known: dict[str, object] = {}
        self.held = 0

    @staticmethod
    def _bytes(entries) -> int:
        """What the entries take that are remembered."""
        return sum(getsizeof(p) + getsizeof(r) + ENTRY for p, r in entries if len(p) <= LONG)

    def _add(self, wanted: set[str], new: list[str]) -> list[str]:
        """Compute ``new`` pieces; those that are not to be remembered are returned."""
        found = self.solve(new)
        held = self._bytes(zip(new, found))
        if self.held + held > self.size:
            self.known = {p: self.known[p] for p in wanted if p in self.known}
            self.held = self._bytes(self.known.items())
        self.known.update(zip(new, found))
        self.held += held
        if self.held > self.size:  # this call alone is larger
            return list(self.known)
        return [p for p in new if len(p) > LONG]

    def forget(self, pieces: list[str]) -> None:
        self.held -= self._bytes((p, self.known[p]) for p in pieces)
        for piece in pieces:
            del self.known[piece]

    def of(self, documents: list[list[str]]) -> list[list]:
        """The results of the pieces of each document; a piece is given with its space."""
        wanted: set[str] = set().union(*documents)
        new = list(wanted.difference(self.known))
        passing = self._add(wanted, new) if new else []
        find = self.known.__getitem__
        found = [list(map(find, pieces)) for pieces in documents]
        self.forget(passing)
        return found


class Recent:
    """Results of distinct pieces, computed for many new pieces at a time and remembered in two
    halves of at most ``size // 2`` bytes: when the newer one is full the older one is
    forgotten, so what was wanted lately stays."""

    def __init__(self, solve: Callable[[list[str]], list], size: int = MEMO):
        self.solve, self.half = solve, size // 2
        self.newer: dict[str, object] = {}
        self.older: dict[str, object] = {}
        self.held = 0  # bytes of the newer half

    def get(self, piece: str):
        """What is remembered of a piece, or None."""
        return self.newer.get(piece, self.older.get(piece))

    def _keep(self, pieces: list[str], results: list) -> None:
        if max(map(len, pieces), default=0) > LONG:
            kept = [(p, r) for p, r in zip(pieces, results) if len(p) <= LONG]
            pieces, results = [p for p, _ in kept], [r for _, r in kept]
        held = sum(map(getsizeof, pieces)) + sum(map(getsizeof, results)) + ENTRY * len(pieces)
        if self.held + held > self.half:
            self.older, self.newer, self.held = self.newer, {}, 0
        if held <= self.half:  # else this call alone is larger
            self.newer.update(zip(pieces, results))
            self.held += held

    def of(self, pieces: list[str]) -> list:
        """The results of the pieces, none of which occurs twice."""
        found = list(map(self.newer.get, pieces))
        missing = [i for i, result in enumerate(found) if result is None]
        new = []
        for i in missing:
            found[i] = self.older.get(pieces[i])
            if found[i] is None:
                new.append(i)
        for i, result in zip(new, self.solve([pieces[i] for i in new]) if new else ()):
            found[i] = result
        if missing:
            self._keep([pieces[i] for i in missing], [found[i] for i in missing])
        return found
