"""Elias-Fano sequences and the n-gram trie whose levels they are.

A non-decreasing sequence of n numbers below u keeps the lowest
floor(log2(u / n)) bits of each number packed and the rest in unary, with a count
of bits set per word as directory. All look-ups take arrays of questions.
"""

from __future__ import annotations

import tempfile

import numpy as np

_U = np.uint64
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
#: Place of the k-th set bit of a byte.
_SELECT = np.full((256, 8), 8, dtype=np.uint8)
for _byte in range(256):
    _places = [i for i in range(8) if _byte >> i & 1]
    _SELECT[_byte, : len(_places)] = _places


class EliasFano:
    """A sorted uint64 array, compressed. ``place`` turns arrays into stored ones (memory-mapped, say)."""

    def __init__(self, values: np.ndarray, universe: int, place=lambda x: x):
        n = len(values)
        values = values.astype(_U)
        self.n, self.width = n, max(0, (universe // max(1, n)).bit_length() - 1)
        self.low = place(_pack(values & _U((1 << self.width) - 1), self.width))
        high = (values >> _U(self.width)).astype(np.int64)
        self.buckets = (universe >> self.width) + 1
        bits = np.zeros((n + self.buckets + 63) // 64 * 64, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        self.high = place(packed)
        each = _ONES[packed].reshape(-1, 8).sum(1)
        self.ones = place(np.concatenate([[0], np.cumsum(each)]).astype(np.int64))

    def lows(self, i: np.ndarray) -> np.ndarray:
        """Low bits of entries i."""
        return _unpack(self.low, i, self.width)

    def _bit(self, k: np.ndarray, of_zero: bool) -> np.ndarray:
        """Place of the k-th (from 0) set or clear bit of the unary part."""
        before = np.arange(len(self.ones)) * 64 - self.ones if of_zero else self.ones
        word = np.searchsorted(before, k, side="right") - 1
        left = (k - before[word]).astype(np.int64)
        byte = word * 8
        for _ in range(7):
            here = _ONES[self.high[byte]].astype(np.int64)
            here = 8 - here if of_zero else here
            on = left >= here
            left, byte = np.where(on, left - here, left), byte + on
        value = self.high[byte]
        return byte * 8 + _SELECT[~value if of_zero else value, left]

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Entries i."""
        high = self._bit(i, False) - i
        return high.astype(_U) << _U(self.width) | self.lows(i)

    def bucket(self, high: np.ndarray) -> np.ndarray:
        """Place of the first entry whose high part is at least ``high``."""
        out = np.zeros(len(high), dtype=np.int64)
        some = high > 0
        k = np.minimum(high[some], self.buckets) - 1
        out[some] = self._bit(k, True) - k
        return out

    def successor(self, target: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """In entries first to last (exclusive), which must be in one run of questions each, the place of the first of at least target."""
        high = (target >> _U(self.width)).astype(np.int64)
        low = np.maximum(first, self.bucket(high))
        top = np.minimum(last, self.bucket(high + 1))
        want = target & _U((1 << self.width) - 1)
        active = np.flatnonzero(low < top)
        while len(active):
            mid = (low[active] + top[active]) // 2
            less = self.lows(mid) < want[active]
            low[active[less]] = mid[less] + 1
            top[active[~less]] = mid[~less]
            active = active[low[active] < top[active]]
        return low

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.ones.nbytes


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """values of ``width`` bits, side by side in uint64 words."""
    out = np.zeros(len(values) * width // 64 + 2, dtype=_U)
    if not width or not len(values):
        return out
    at = np.arange(len(values), dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(_U)
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[starts]] = np.bitwise_or.reduceat(values << shift, starts)
    over = np.flatnonzero((at & 63) + width > 64)  # at most one value goes over the end of each word
    out[word[over] + 1] |= values[over] >> (_U(64) - shift[over])
    return out


def _unpack(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), dtype=_U)
    at = i.astype(np.int64) * width
    word, shift = at >> 6, (at & 63).astype(_U)
    over = np.where(shift > 0, words[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
    return (words[word] >> shift | over) & _U((1 << width) - 1)


class Mapped:
    """Arrays in an unlinked temporary file, memory-mapped; gone with the object."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()

    def __call__(self, array: np.ndarray) -> np.ndarray:
        if not array.nbytes:
            return array
        at = -(-self.file.seek(0, 2) // 64) * 64
        self.file.seek(at)
        self.file.write(np.ascontiguousarray(array).tobytes())
        self.file.flush()
        return np.memmap(self.file, dtype=array.dtype, mode="r", offset=at, shape=array.shape)


class Level:
    """Children of the entries above, with quantised scores.

    pointers: where each parent's children begin, one more for the end; children: uint32, rising within a parent; scores: one of
    each. Children are made monotone by their parent's rank, so the level is one sequence; pointers are another.
    """

    def __init__(self, pointers: np.ndarray, children: np.ndarray, scores: np.ndarray, codes: int, place):
        parents = len(pointers) - 1
        self.pointers = EliasFano(pointers, int(pointers[-1]) + 1, place)
        rank = np.repeat(np.arange(parents, dtype=_U), np.diff(pointers))
        self.children = EliasFano(rank << _U(32) | children.astype(_U), max(1, parents) << 32, place)
        book, codes = quantise(scores, codes)
        self.book, self.codes = place(book), place(codes)

    def find(self, rank: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Place of each child under the parent of that rank; -1 if the level hasn't it or rank is -1."""
        out = np.full(len(rank), -1, dtype=np.int64)
        some = np.flatnonzero(rank >= 0)
        if not len(some) or not self.children.n:
            return out
        r = rank[some]
        first, last = self.pointers[r].astype(np.int64), self.pointers[r + 1].astype(np.int64)
        key = r.astype(_U) << _U(32) | child[some].astype(_U)
        at = self.children.successor(key, first, last)
        near = np.minimum(at, self.children.n - 1)
        hit = (at < last) & (self.children[near] == key)
        out[some[hit]] = at[hit]
        return out

    def value(self, at: np.ndarray) -> np.ndarray:
        return self.book[self.codes[at]]


class Trie:
    """N-grams by levels: roots (sorted distinct uint64), under each its successors with scores, under those theirs.

    pointers, successors and scores are the first level below the roots, ``deeper`` holds the same three of each further one.
    """

    def __init__(self, contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, scores: np.ndarray, levels: int = 256, deeper: tuple = ()):
        place = Mapped()
        self.n = len(contexts)
        self.contexts = EliasFano(contexts, 1 << 64, place)
        self.levels = [Level(*of, levels, place) for of in ((pointers, successors, scores), *deeper)]

    def find(self, context: np.ndarray) -> np.ndarray:
        """Rank of each root; -1 if it isn't there."""
        if not self.n:
            return np.full(len(context), -1, dtype=np.int64)
        at = self.contexts.successor(context, np.zeros(len(context), dtype=np.int64), np.full(len(context), self.n, dtype=np.int64))
        near = np.minimum(at, self.n - 1)
        return np.where((at < self.n) & (self.contexts[near] == context), at, -1)

    def score(self, rank: np.ndarray, *successors: np.ndarray) -> np.ndarray:
        """Score of the longest n-gram that the trie holds of each root's rank and its successors, in order; NaN if it holds none."""
        out = np.full(len(rank), np.nan)
        for level, child in zip(self.levels, successors, strict=False):
            rank = level.find(rank, child)
            hit = rank >= 0
            out[hit] = level.value(rank[hit])
        return out


def quantise(scores: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """A codebook of the means of equally filled bins, and each score's code."""
    if not len(scores):
        return np.zeros(1), np.zeros(0, dtype=np.uint8)
    kind = np.uint8 if levels <= 256 else np.uint16
    values, places, counts = np.unique(scores, return_inverse=True, return_counts=True)
    if len(values) <= levels:
        return values, places.astype(kind)
    bins = np.minimum((np.cumsum(counts) - counts) * levels // len(scores), levels - 1)
    _, bins = np.unique(bins, return_inverse=True)
    book = np.bincount(bins, values * counts) / np.bincount(bins, counts)
    return book, bins[places].astype(kind)
