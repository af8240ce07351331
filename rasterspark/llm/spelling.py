"""Spelling variants of a corpus vocabulary, grouped by edits of one letter.

Bloom-guided neighbourhoods: every word's edits are generated inside tasks and probed against broadcast
filters, one shard per word length, each a blocked Bloom filter (all bits of a word in one block of 512).
Only positives are shuffled, to an exact join with the vocabulary that drops false ones. An insertion is
the other word's deletion, and of two replacements one is enough, so each pair is asked for once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bytewords import mix

#: Letters: a-z and the Latin-1 letters' range, as code points; A-Z is lower-cased before.
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
BITS_PER_WORD = 16
#: Size of all filters together. With more words there are fewer bits for each and more false positives to join; rows stay the same.
FILTER_BYTES = 64 << 20
_PROBES = 6
#: Distinct words of a task before its counts are handed on.
_HELD = 200_000
#: Edits generated at once.
_PAIRS = 200_000

_FOLD = bytearray(b" " * 256)
for _c in LETTERS:
    _FOLD[_c] = _c
for _c in range(0x41, 0x5B):
    _FOLD[_c] = _c + 32
_FOLD = bytes(_FOLD)


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of letters as Latin-1 bytes, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def count_words(docs: DataFrame, min_length: int, min_count: int, slip: int | None) -> DataFrame:
    """(word, n) of words long and frequent enough; counts are combined in each task before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                if not isinstance(text, str):
                    continue
                start = zlib.crc32(f"{key}:".encode()) if slip and isinstance(key, str) else None
                for run, n in Counter(runs_of(text)).items():
                    if start is not None:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % slip == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                    if len(run) >= min_length:
                        total[run] += n
                if len(total) > _HELD:
                    yield _counts(total)
                    total = Counter()
        yield _counts(total)

    counted = docs.select(F.col("doc_id").cast("string").alias("key"), "text").mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _counts(total: Counter) -> pd.DataFrame:
    # a task without words still sends a column of texts
    words = pd.Series([w.decode("latin-1") for w in total], dtype=object)
    return pd.DataFrame({"word": words, "n": np.fromiter(total.values(), np.int64, len(total))})


class EditHashes:
    """Hashes of equally long words and of their edits, each edit in constant time."""

    def __init__(self, letters: np.ndarray) -> None:
        """``letters``: one row of code points per word."""
        self.letters = letters
        length = letters.shape[1]
        self.own = self._of(length)[np.arange(length), letters]
        shifted = np.zeros_like(self.own)
        shifted[:, 1:] = self._of(length)[np.arange(length - 1), letters[:, 1:]] if length > 1 else 0
        self.whole = self.own.sum(1, dtype=np.uint64)
        self.before = np.cumsum(self.own, 1, dtype=np.uint64) - self.own
        self.after = shifted.sum(1, dtype=np.uint64)[:, None] - np.cumsum(shifted, 1, dtype=np.uint64)

    @staticmethod
    def _of(length: int) -> np.ndarray:
        return mix(np.arange(length * 256, dtype=np.uint64) + np.uint64(0x51)).reshape(length, 256)

    def deleted(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[row, at] + self.after[row, at]

    def replaced(self, row: np.ndarray, at: np.ndarray, letter: int) -> np.ndarray:
        new = mix(at.astype(np.uint64) * np.uint64(256) + np.uint64(letter + 0x51))
        return self.whole[row] - self.own[row, at] + new


def _by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, letters) of the words of each length."""
    raw = [w.encode("latin-1") for w in words]
    sizes = np.array([len(w) for w in raw], np.int64)
    for length in np.unique(sizes):
        rows = np.flatnonzero(sizes == length)
        step = max(1, (8 << 20) // int(length))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            yield int(length), part, np.frombuffer(b"".join(raw[i] for i in part), np.uint8).reshape(len(part), length)


def _slots(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and a number whose nine-bit fields name bits in it."""
    h = mix(hashes)
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), mix(h + np.uint64(1))


class LengthShards:
    """Blocked Bloom filters, one per word length."""

    def __init__(self, blocks: dict[int, int]) -> None:
        self.blocks = blocks
        self.first = dict(zip(blocks, np.cumsum([0, *blocks.values()])[:-1].tolist(), strict=True))
        self.bits = np.zeros((sum(blocks.values()), 8), np.uint64)

    @staticmethod
    def sized(words: dict[int, int], bits_per_word: int, filter_bytes: int) -> LengthShards:
        """Shards for so many words of each length, all within ``filter_bytes`` (but one block a length)."""
        share = min(1.0, filter_bytes * 8 / max(1, bits_per_word * sum(words.values())))
        return LengthShards({k: max(1, int(n * bits_per_word * share) // 512) for k, n in sorted(words.items())})

    def set_bits(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block numbers and eight words of bits of each hash."""
        block, fields = _slots(hashes, self.blocks[length])
        bits = np.zeros((len(block), 8), np.uint64)
        for i in range(_PROBES):
            f = (fields >> np.uint64(9 * i)) & np.uint64(511)
            bits[np.arange(len(block)), (f >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (f & np.uint64(63))
        return block + self.first[length], bits

    def may_hold(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes that all their bits are set for."""
        if length not in self.blocks:
            return np.zeros(0, np.int64)
        block, fields = _slots(hashes, self.blocks[length])
        block += self.first[length]
        left = np.arange(len(block))
        for i in range(_PROBES):
            f = (fields[left] >> np.uint64(9 * i)) & np.uint64(511)
            held = self.bits[block[left], (f >> np.uint64(6)).astype(np.int64)] >> (f & np.uint64(63))
            left = left[(held & np.uint64(1)) == 1]
        return left


def build_shards(vocabulary: DataFrame, bits_per_word: int = BITS_PER_WORD, filter_bytes: int = FILTER_BYTES) -> LengthShards:
    """Filters of a vocabulary: blocks are set in tasks, joined by OR and collected, ``filter_bytes`` at most."""
    lengths = vocabulary.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n"))
    shards = LengthShards.sized({r["length"]: r["n"] for r in lengths.collect()}, bits_per_word, filter_bytes)
    names = [f"b{i}" for i in range(8)]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, _, letters in _by_length(batch["word"]):
                block, bits = shards.set_bits(length, EditHashes(letters).whole)
                order = np.argsort(block, kind="stable")
                starts = np.flatnonzero(np.diff(block[order], prepend=-1))
                held = np.bitwise_or.reduceat(bits[order], starts, axis=0).view(np.int64)
                yield pd.DataFrame({"block": block[order][starts], **{n: held[:, i] for i, n in enumerate(names)}})

    filled = vocabulary.select("word").mapInPandas(fill, "block long, " + ", ".join(f"{n} long" for n in names))
    joined = filled.groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names)).toPandas()
    shards.bits[joined["block"].to_numpy(np.int64)] = joined[names].to_numpy(np.int64).view(np.uint64)
    return shards


def candidates(words: pd.Series, shards: LengthShards) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(row numbers, edits) that the filters may hold: deletions, and replacements by a later letter."""
    for length, rows, letters in _by_length(words):
        hashes = EditHashes(letters)
        total = letters.size
        for k in range(0, total, _PAIRS):
            row, at = np.divmod(np.arange(k, min(k + _PAIRS, total)), length)
            here = letters[row, at]
            # deleting any letter of a run of equal ones gives the same
            once = (at == 0) | (letters[row, np.maximum(at - 1, 0)] != here)
            r, a = row[once], at[once]
            hit = shards.may_hold(length - 1, hashes.deleted(r, a))
            yield rows[r[hit]], [_cut(letters[i], j) for i, j in zip(r[hit], a[hit], strict=True)]
            for letter in LETTERS:
                below = here < letter
                r, a = row[below], at[below]
                hit = shards.may_hold(length, hashes.replaced(r, a, letter))
                yield rows[r[hit]], [_swap(letters[i], j, letter) for i, j in zip(r[hit], a[hit], strict=True)]


def _cut(letters: np.ndarray, at: int) -> str:
    word = letters.tobytes()
    return (word[:at] + word[at + 1 :]).decode("latin-1")


def _swap(letters: np.ndarray, at: int, letter: int) -> str:
    word = letters.tobytes()
    return (word[:at] + bytes([letter]) + word[at + 1 :]).decode("latin-1")


def near_words(vocabulary: DataFrame, shards: LengthShards) -> DataFrame:
    """(word, n, near, near_n): every two words one edit apart, both ways round."""
    held = vocabulary.sparkSession.sparkContext.broadcast(shards)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, edits in candidates(batch["word"], held.value):
                if len(rows):
                    yield pd.DataFrame({"a": batch["word"].to_numpy()[rows], "a_n": batch["n"].to_numpy()[rows], "b": edits})

    positives = vocabulary.select("word", "n").mapInPandas(probe, "a string, a_n long, b string")
    exact = positives.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n"))
    return exact.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")


def _roots(forms: DataFrame, depth: int) -> DataFrame:
    """(word, root) by doubling: each round follows twice as many forms."""
    reach, at = 1, cut_lineage(forms)
    while reach < depth:
        ahead = at.select(F.col("word").alias("form"), F.col("root").alias("next"))
        at = cut_lineage(at.join(ahead, at["root"] == ahead["form"], "left").select("word", F.coalesce("next", "root").alias("root")))
        reach *= 2
    return at


def group_variants(
    docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, slip: int | None = None,
    bits_per_word: int = BITS_PER_WORD, filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of every word of the texts.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, of at least ``min_length`` code
    points and ``min_count`` occurrences; null texts have none. Two words are near if one code point
    inserted, deleted or replaced makes one the other. ``form`` is the near word of largest n (ties:
    smallest in code-point order) if that is at least ``ratio`` times the word's n, else null; ``root`` is
    the last of the forms followed from the word, or the word. With ``slip``, a run whose crc32 of
    ``<doc_id>:<run>`` it divides loses the code point that the checksum names first (not where doc_id is
    null). Repeated rows count again; other columns are ignored; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent, or chains of them might not end")
    vocabulary = cut_lineage(count_words(docs, min_length, min_count, slip))
    shards = build_shards(vocabulary, bits_per_word, filter_bytes)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(vocabulary, shards).groupBy("word").agg(F.count("*").alias("n_near"), best)
    formed = -F.col("best.less") >= ratio * F.col("n")
    rows = cut_lineage(vocabulary.join(near, "word", "left").select(
        "word", "n", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    ))
    least, most = rows.agg(F.min("n"), F.max("n")).first()
    depth = 0
    while least and least * ratio ** (depth + 1) <= most:
        depth += 1
    followed = _roots(rows.filter("form is not null").select("word", F.col("form").alias("root")), depth)
    return rows.join(followed, "word", "left").withColumn("root", F.coalesce("root", "word"))
