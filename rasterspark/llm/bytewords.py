"""Words and their hashes over a batch of texts, as numpy arrays inside tasks.

Texts are UTF-8 bytes. Words are runs of bytes other than space and \\x09-\\x0D, which is what
``[^\\x20\\x09-\\x0D]+`` finds in the text. Hashes are 64-bit, a polynomial over random byte values
followed by a mixer, equal in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once; a longer text is a batch of its own.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.RandomState(20240607).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class Prefix:
    """Hashes of any slices of a byte array, in constant time each."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64))


def encode(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that together hold about CHUNK bytes."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words in order: hash, and index of the text it is in."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(space & ~before)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return Prefix(data).of(start, end), np.searchsorted(begins, start, "right") - 1


_FACTORS = np.random.RandomState(7).randint(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words."""
    n = len(words) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        total += words[i : i + n] * _FACTORS[i]
    return mix(total)


def whole(words: np.ndarray) -> np.uint64:
    """Hash of a sequence shorter than a gram; its length keeps it apart from others."""
    total = np.uint64(len(words)) * _FACTORS[63]
    with np.errstate(over="ignore"):
        for i, w in enumerate(words):
            total = total + w * _FACTORS[i]
    return mix(np.array([total], np.uint64))[0]


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased; fewer words make one shingle."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        words, doc = word_hashes([t.lower() for t in texts[lo:hi]])
        bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
        every = grams(words, size)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                out.append(np.unique(every[a : b - size + 1]))
            else:
                out.append(np.array([whole(words[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out
