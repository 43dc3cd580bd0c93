"""Batches of texts as arrays of code points, with their words found and hashed by array operations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Characters of a piece of text at most, and of the pieces that are looked at together.
PIECE_CHARS = 1_000_000

#: Code points beyond have no letters.
KNOWN = 0x32400
SPACE, LETTER, UPPER, DIGIT = 1, 2, 4, 8
BASE = 0x9E3779B97F4A7C15


@cache
def traits() -> np.ndarray:
    """SPACE, LETTER, UPPER and DIGIT bits of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in map(chr, range(KNOWN)):
        out[ord(c)] = SPACE * c.isspace() | LETTER * c.isalpha() | UPPER * c.isupper() | DIGIT * c.isdigit()
    return out


@cache
def lower_case() -> np.ndarray:
    """Lower case of each code point, where that is one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in map(chr, range(KNOWN)):
        if len(low := c.lower()) == 1:
            out[ord(c)] = ord(low)
    return out


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below size."""
    up = np.full(size, BASE, np.uint64)
    down = np.full(size, pow(BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Texts:
    """Code points of texts, a line end behind each, and where each text starts."""

    def __init__(self, texts: list[str | None]) -> None:
        whole = "".join(f"{x or ''}\n" for x in texts)
        self.points = np.frombuffer(whole.encode("utf-32-le", "replace"), "<u4")
        self.low = lower_case()[self.points]
        self.kind = traits()[self.points]
        self.size = np.array([len(x or "") for x in texts], np.int64)
        self.start = np.cumsum(self.size + 1) - (self.size + 1)
        self.count = len(texts)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the runs of places that are inside; the last place of all never is."""
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.r_[0, edge] if len(inside) and inside[0] else edge
        return edge[::2], edge[1::2]

    def of(self, places: np.ndarray) -> np.ndarray:
        """The text that each place is in."""
        return np.searchsorted(self.start, places, side="right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray, points: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each run of code points, the same wherever the run stands."""
        size = 1 << max(16, int(len(self.points)).bit_length())
        up, down = powers(size)
        total = np.cumsum(((self.low if points is None else points).astype(np.uint64) + np.uint64(1)) * up[: len(self.points)], dtype=np.uint64)
        total = np.r_[np.uint64(0), total]
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def hash_of(word: str) -> int:
    """The hash of one word as `Texts.hashes` gives it."""
    return int(Texts([word]).hashes(np.array([0]), np.array([len(word)]))[0])


def per_text(of: np.ndarray, count: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(of, weights=values, minlength=count)


def pieces(texts: list[str | None], size: int | None = None) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts in groups of about `size` characters, and the number of the text that each member is from; null is empty.

    A longer text is cut behind the last blank or line end within the bound, so that words stay whole; a word that is longer than the
    bound is cut in it. Where a text is cut depends on that text alone. Each text gives one piece at least.
    """
    size = size or PIECE_CHARS
    held, of, total = [], [], 0
    for k, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            end = at + size
            if end < len(text):
                cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1
                end = cut if cut > at else end
            held.append(text[at:end])
            of.append(k)
            total += len(held[-1])
            if total >= size:
                yield held, np.array(of)
                held, of, total = [], [], 0
            at = end
            if at >= len(text):
                break
    if held:
        yield held, np.array(of)
