"""Words of many texts at once: places and hashes by numpy.

A word is a run of ASCII digits, ASCII letters (A-Z as a-z) and bytes beyond ASCII. Hashes are polynomials over the bytes
of a word, taken from running sums over a whole slice of texts; who relies on equal words compares the words as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text handled at a time; a longer text is one slice.
SLICE = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """For every byte: 0 outside of words, else the byte with A-Z as a-z. Words hold 0-9, letters and all beyond ASCII."""
    table = np.zeros(256, np.uint8)
    for c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        table[c] = c
    for c in range(0x41, 0x5B):
        table[c] = c + 32
    return table


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _P))])
        down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse))])
    return up, down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Slice:
    """Words of consecutive texts: bytes, first and end byte, hash, and the first word of each text (plus the end)."""

    def __init__(self, texts: list[bytes]):
        self.data = _alphabet()[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        inside = self.data > 0
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.first, self.end = edges[0::2], edges[1::2]
        step = max(2 * SLICE, 1 << int(len(self.data)).bit_length())
        up, down = _powers(step)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.data.astype(np.uint64) * up[: len(self.data)])])
        self._sums, self._down = sums, down
        self.hash = self.prefix(len(self.data))
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.words = np.searchsorted(self.first, starts)

    def prefix(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word."""
        end = np.minimum(self.end, self.first + size)
        return mixed((self._sums[end] - self._sums[self.first]) * self._down[self.first])

    def grams(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words that start at each word; the last ones of the slice are left out."""
        n = max(0, len(self.hash) - size + 1)
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = h * _P + self.hash[k : k + n]
        return mixed(h)

    def left(self, size: int) -> np.ndarray:
        """For each word, the words of its text from there on, less ``size``: negative if too few."""
        return np.repeat(self.words[1:], np.diff(self.words)) - np.arange(len(self.hash)) - size

    def kept(self, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the winnowed grams: of all grams in ``span`` words, the smallest (the last one of equals)."""
        window = span - gram + 1
        grams = self.grams(gram)
        n = len(grams) - window + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        low, at = grams[:n].copy(), np.zeros(n, np.int64)
        for k in range(1, window):
            smaller = grams[k : k + n] <= low
            low = np.where(smaller, grams[k : k + n], low)
            at[smaller] = k
        whole = self.left(span)[:n] >= 0
        places = np.unique((np.arange(n) + at)[whole])
        return places, grams[places]

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all runs of ``size`` words."""
        grams = self.grams(size)
        places = np.flatnonzero(self.left(size)[: len(grams)] >= 0)
        return places, grams[places]

    def text(self, a: int, b: int) -> str:
        """Words a to b - 1, joined by blanks."""
        return b" ".join(self.data[i:j].tobytes() for i, j in zip(self.first[a:b], self.end[a:b])).decode("utf-8", "replace")


def slices(texts: Iterable[str | None]) -> Iterator[tuple[int, Slice]]:
    """(number of the first text, slice) over consecutive texts."""
    held: list[bytes] = []
    start = size = 0
    for i, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= SLICE:
            yield start, Slice(held)
            held, start, size = [], i + 1, 0
    if held:
        yield start, Slice(held)
