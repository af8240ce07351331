"""Elias-Fano sequences and a two-level n-gram trie of them, in memory-mapped files of a task."""

from __future__ import annotations

import tempfile

import numpy as np


#: Values looked up at once, which fit the processor's caches.
_PIECE = 1 << 14


#: Place of each one in each byte.
_BIT = np.array([([i for i in range(8) if x >> i & 1] + [0] * 8)[:8] for x in range(256)])


def mapped(values: np.ndarray) -> np.ndarray:
    """The same array, memory-mapped from a nameless file that goes with it."""
    if not values.nbytes:
        return values
    with tempfile.TemporaryFile() as file:
        file.write(np.ascontiguousarray(values).tobytes())
        file.flush()
        return np.memmap(file, values.dtype, "r", shape=values.shape)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary with a directory of counts per word.

    n numbers below u take about n * (2 + log2(u / n)) bits.
    """

    def __init__(self, values: np.ndarray, universe: int) -> None:
        self.n = len(values)
        self.low_bits = max(0, int(universe // max(self.n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        bits = np.zeros(self.n + int(universe >> self.low_bits) + 65, np.uint8)
        bits[high + np.arange(self.n)] = 1
        bits = np.pad(bits, (0, -len(bits) % 64))
        packed = np.packbits(bits, bitorder="little")
        ones = np.bitwise_count(packed.view(np.uint64)).astype(np.int64)
        self.high = mapped(packed.view(np.uint64))
        self.ones = mapped(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32 if self.n < 1 << 32 else np.int64))
        self.before = self.ones.astype(np.int64)
        self.zeros = np.arange(len(self.before)) * 64 - self.before
        self.low = mapped(self._pack(values & np.uint64((1 << self.low_bits) - 1)))

    def _pack(self, low: np.ndarray) -> np.ndarray:
        width = self.low_bits
        out = np.zeros(self.n * width // 64 + 2, np.uint64)
        if width:
            at = np.arange(self.n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(out, word, low << shift)
            over = (shift + np.uint64(width)) > np.uint64(64)
            np.bitwise_or.at(out, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        width = np.uint64(self.low_bits)
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * width
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | rest) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th one, or of the k-th zero, of the high bits."""
        before = self.before if ones else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        rest = k - before[word]
        bits = self.high[word] if ones else ~self.high[word]
        # the byte of the word that holds the bit, by its ones so far, and the bit by a table
        data = np.ascontiguousarray(bits).view(np.uint8)
        so_far = np.bitwise_count(data).view(np.uint64) * np.uint64(0x0101010101010101)
        byte = (so_far.view(np.uint8).reshape(-1, 8) <= rest.astype(np.uint8)[:, None]).sum(1)
        at = np.arange(len(k)) * 8 + byte
        rest = rest - (so_far << np.uint64(8)).view(np.uint8)[at]
        place = byte * 8 + _BIT[data[at], rest]
        return word * 64 + place

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(i)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number not below each value (successor search), and whether it is that value."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        # numbers with the same high bits lie between two zeros; each run of equal high bits is searched once
        starts = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))[: len(high)]
        tops = high[starts]
        ends = self._select(tops, False) - tops
        begins = np.where(tops > 0, self._select(np.maximum(tops - 1, 0), False) - np.maximum(tops - 1, 0), 0)
        times = np.diff(np.append(starts, len(high)))
        lo, end = np.repeat(begins, times), np.repeat(ends, times)
        hi = end.copy()
        low = values & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            smaller = self._low(np.minimum(mid, self.n - 1)) < low[open_]
            lo[open_[smaller]] = mid[smaller] + 1
            hi[open_[~smaller]] = mid[~smaller]
            open_ = open_[lo[open_] < hi[open_]]
        return lo, (lo < end) & (self._low(np.minimum(lo, self.n - 1)) == low)

    @property
    def nbytes(self) -> int:
        return self.high.nbytes + self.ones.nbytes + self.low.nbytes


class BigramTrie:
    """Contexts, monotone pointers to their successors, the successors, and a code for each.

    Successors are numbered relative to their context: context number * width + rank of the word among
    the words of this trie, so one monotone sequence holds them all and a lookup is a successor search.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, codes: np.ndarray) -> None:
        """``context`` and ``word`` sorted by both, without repetition."""
        names, counts = np.unique(context, return_counts=True)
        words = np.unique(word)
        self.width = max(len(words), 1)
        self.contexts = EliasFano(names, int(names[-1]) + 1 if len(names) else 1)
        self.words = EliasFano(words, int(words[-1]) + 1 if len(words) else 1)
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(counts)]), len(context) + 1)
        relative = np.repeat(np.arange(len(names)), counts) * self.width + np.searchsorted(words, word)
        self.successors = EliasFano(relative, len(names) * self.width + 1)
        self.codes = mapped(codes)

    @staticmethod
    def _at(level: EliasFano, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not level.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        top = int(level[np.array([level.n - 1])][0])
        inside = values <= top
        i = np.zeros(len(values), np.int64)
        for lo in range(0, len(values), _PIECE):
            part, good = slice(lo, lo + _PIECE), inside[lo : lo + _PIECE]
            at, hit = level.find(values[part][good])
            i[part][good] = at
            good[good] = hit
        return i, inside

    def lookup(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, whether the pair is there)."""
        # each context and word is searched once
        names, own = np.unique(context, return_inverse=True)
        c, known = self._at(self.contexts, names)
        words, which = np.unique(word, return_inverse=True)
        w, there = self._at(self.words, words)
        found, code = np.zeros(len(context), bool), np.zeros(len(context), self.codes.dtype)
        at = np.flatnonzero(known[own] & there[which])
        if len(at):
            own = own[at]
            i, hit = self._at(self.successors, c[own] * self.width + w[which[at]])
            # the pointers bound the context's range
            c = np.where(known, c, 0)
            begin, end = self.pointers[c].astype(np.int64), self.pointers[c + 1].astype(np.int64)
            hit &= (i >= begin[own]) & (i < end[own])
            found[at] = hit
            code[at[hit]] = self.codes[i[hit]]
        return code, found

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.contexts, self.words, self.pointers, self.successors, self.codes))
