"""Word shingles of Arrow texts as 64-bit numbers, a whole slice of texts at a time.

A word's number is a polynomial over its bytes (A-Z in lower case), taken from
running sums so that no loop visits words; a shingle's number mixes those of
its words by place. Numbers are compared instead of words everywhere below: two
different shingles of a corpus share one with a chance of 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that leaves no pattern (two rounds of xor-shift and multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, start: int) -> np.ndarray:
    """``n`` numbers drawn from ``start``."""
    with np.errstate(over="ignore"):
        return mix(_U(start) + np.arange(1, n + 1, dtype=np.uint64) * _U(_STEP))


_CODES = seeds(256, 1) | _U(1)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_PLACES = seeds(64, 2) | _U(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base, or of its inverse."""
    if len(_powers[which]) < n:
        steps = np.full(max(n, 1 << 16), _BASE if which == "up" else pow(_BASE, -1, 1 << 64), np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:n]


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words, and the place where each text's words begin (and the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    cuts = offsets - offsets[0]
    solid = _SOLID[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = cuts[1:] > cuts[:-1]
    begins, ends = cuts[:-1][full], cuts[1:][full] - 1
    first[begins], last[ends] = solid[begins], solid[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _power("up", len(data)), out=sums[1:])
    numbers = mix((sums[stops] - sums[starts]) * _power("down", len(data))[starts])
    return numbers, np.searchsorted(starts, cuts)


@dataclass
class Sets:
    """Different shingles of texts: sorted numbers, and where each text's begin (and the end)."""

    numbers: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.numbers[self.at[i] : self.at[i + 1]]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of one 64-bit value a shingle, the sum of each text's."""
        running = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=running[1:])
        return running[self.at[1:]] - running[self.at[:-1]]


def shingle_sets(texts: pa.Array, size: int) -> Sets:
    """The different shingles of ``size`` words of every text; a text with fewer words is one shingle, one without words has none."""
    words, at = word_numbers(texts)
    m = np.diff(at)
    count = np.where(m >= size, m - size + 1, np.minimum(m, 1))
    ends = np.cumsum(count)
    first = np.repeat(at[:-1] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
    padded = np.r_[words, np.zeros(size, np.uint64)]
    numbers = np.zeros(len(first), np.uint64)
    for j in range(size):
        numbers += padded[first + j] * _PLACES[j]
    for i in np.flatnonzero((m > 0) & (m < size)):
        numbers[ends[i] - 1] = (words[at[i] : at[i + 1]] * _PLACES[: m[i]]).sum(dtype=np.uint64) + _U(m[i])
    numbers = mix(numbers)
    for lo, hi in zip((ends - count).tolist(), ends.tolist(), strict=True):
        numbers[lo:hi].sort()
    fresh = np.ones(len(numbers), bool)
    fresh[1:] = numbers[1:] != numbers[:-1]
    fresh[(ends - count)[count > 0]] = True
    return Sets(numbers[fresh], np.r_[0, np.cumsum(fresh)][np.r_[0, ends]])


def set_numbers(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell a text's set of shingles from others."""
    return sets.sums(mix(sets.numbers ^ _U(0x5851F42D4C957F2D))), sets.sums(mix(sets.numbers ^ _U(0x14057B7EF767814F)))


def alike(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether two sorted sets have a Jaccard similarity of the fraction ``share`` or more; two empty sets have one of 1."""
    top, low = share
    if min(len(a), len(b)) * low < max(len(a), len(b)) * top:
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * low >= (len(both) - shared) * top
