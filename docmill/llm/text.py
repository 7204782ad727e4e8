"""Vectorised text helpers for the operators of this subpackage.

Words are maximal runs of letters, digits and combining marks, compared without case. A word is
carried as a 64-bit hash, computed for all words of many texts at once from prefix sums of a
polynomial modulo 2**64.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_TABLE_SIZE = 0x40000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> lower-case code point of a word character, else 0."""
    table = np.zeros(_TABLE_SIZE, np.uint32)
    for cp in range(_TABLE_SIZE - 1):
        ch = chr(cp)
        if ch.isalnum() or unicodedata.category(ch)[0] == "M":
            table[cp] = ord(ch.lower()[0])
    return table


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, 0 .. n - 1 at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for factor in (_BASE, inverse):
            steps = np.full(size, factor, _U)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers = (tables[0], tables[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def slices(texts: list[str | None], limit: int = 1 << 19, most: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` texts that hold about ``limit`` characters together; a longer text
    stands alone."""
    start = total = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and (total + n > limit or i - start == most):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Words:
    """The words of some texts: ``hashes``, ``starts`` and ``ends`` (code points of the text), and
    ``offsets``: text i has the words ``offsets[i]:offsets[i + 1]``."""

    def __init__(self, texts: list[str | None]):
        folded = fold_table()[np.minimum(code_points("\0".join(t or "" for t in texts)), _TABLE_SIZE - 1)]
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes + 1, out=begins[1:])
        inside = np.zeros(len(folded) + 2, np.int8)
        inside[1:-1] = folded != 0
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        power, inverse = _power_tables(len(folded) + 1)
        sums = np.zeros(len(folded) + 1, _U)
        np.cumsum(folded.astype(_U) * power[: len(folded)], out=sums[1:])
        self.hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
        self.offsets = np.searchsorted(starts, begins)
        shift = np.repeat(begins[:-1], np.diff(self.offsets))
        self.starts, self.ends = starts - shift, ends - shift


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, and offsets by text. A text of fewer words, but one at
    least, has one shingle of them all."""
    h, off = words.hashes, words.offsets
    counts = np.diff(off)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_off = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n, out=out_off[1:])
    out = np.zeros(out_off[-1], _U)
    if len(h) >= size:
        rolled = np.zeros(len(h) - size + 1, _U)
        for k in range(size):
            rolled = rolled * _U(_BASE) + h[k : len(rolled) + k]
        owner = np.repeat(np.arange(len(counts)), counts)
        whole = np.flatnonzero(owner[: len(rolled)] == owner[size - 1 :])
        at = np.repeat(counts >= size, n)
        out[at] = mix(rolled[whole])
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        x = _U(counts[i])
        with np.errstate(over="ignore"):
            for y in h[off[i] : off[i + 1]]:
                x = x * _U(_BASE) + y
        out[out_off[i]] = mix(np.array([x], _U))[0]
    return out, out_off


def maximal_runs(sums: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs whose last sum lies at most ``slack`` under the first one, and
    which lie in no longer such run. Linear but for a binary search."""
    # for each end the first begin that is low enough: the running minimum over begins falls
    first = np.searchsorted(-np.minimum.accumulate(sums), -(sums + slack), "left")
    later = np.minimum.accumulate(np.append(first[1:], len(sums))[::-1])[::-1]
    last = np.flatnonzero(first < later)
    return first[last], last
