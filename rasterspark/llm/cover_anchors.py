"""Removal of word runs that already occurred earlier, found by difference-cover anchors.

A difference cover holds offsets modulo ``period`` such that any two positions reach it together
after some shift below ``period``. So two equal windows of ``length`` words share, at one such shift,
an anchor: a run of ``length - period + 1`` words that starts at a cover position in both texts.
Only anchors are hashed and sent, one per block of texts and value. Those that several places share
come back with the first of them, and matches are extended: consecutive anchors that point to one
earlier text at one distance join to a match, and every window inside it is covered. Windows that
hold a shared anchor but lie in no such match (edges, and places where the first texts change) are
sent by their own 128-bit hash, and all but the first of equal ones are covered.

A frequent passage is sent once per block, so no key gathers its copies. Texts are dealt out once by
a hash of id and text; the three passes over them share that exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import partitions, run_starts
from .bytewords import chunks, encode, mix, word_hashes

LENGTH = 20
#: Seven positions of which any two meet in the cover after a shift of at most six.
PERIOD = 7
COVER = (0, 1, 3)
BLOCK_BYTES = 8 << 20
_LAST = np.iinfo(np.int64).max
_COVERED, _ANCHOR, _FIRST, _WINDOW = 0, 1, 2, 3
_ROUTE = "bucket int, home int, kind int, data binary"
_NAMES = ["bucket", "home", "kind", "data"]
_LANES = np.random.RandomState(1109).randint(1, 1 << 62, (3, 256), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def is_difference_cover(cover: Sequence[int], period: int) -> bool:
    """Whether every distance modulo ``period`` lies between two members."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _packed(**columns: np.ndarray) -> bytes:
    sizes = np.array([len(c) for c in columns.values()], np.int32)
    raw = b"".join([sizes.tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns.values())])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(blob: bytes, **types: type) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.int32, len(types)), 4 * len(types), {}
    for size, (name, kind) in zip(sizes.tolist(), types.items(), strict=True):
        out[name] = np.frombuffer(raw, kind, size, at)
        at += out[name].nbytes
    return out


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which compress; ``cumsum`` undoes it."""
    return np.diff(values, prepend=0).astype(np.int32)


def _hashes(words: np.ndarray, start: np.ndarray, size: int, lane: int) -> np.ndarray:
    """Hash of the ``size`` words from each start."""
    total = np.zeros(len(start), np.uint64)
    for i in range(size):
        total += words[start + i] * _LANES[lane, i % 256] + np.uint64(i // 256)
        if i % 256 == 255:
            total = mix(total)
    return mix(total)


class _Block:
    """The texts of one block in order of id and hash; equal rows lie together."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.assign(doc=rows["doc_id"].astype("Int64").fillna(_LAST).astype("int64"))
        self.rows = rows.sort_values(["doc", "print"], kind="stable").reset_index(drop=True)
        self.doc, self.print = self.rows["doc"].to_numpy(), self.rows["print"].to_numpy()
        self.texts = [encode(t if isinstance(t, str) else None) for t in self.rows["text"]]
        found = [(word_hashes(self.texts[a:b]), a) for a, b in chunks(self.texts)]
        self.words = np.concatenate([w for (w, _), _ in found] or [np.zeros(0, np.uint64)])
        self.text = np.concatenate([t + a for (_, t), a in found] or [np.zeros(0, np.int64)])
        self.first = np.searchsorted(self.text, np.arange(len(self.texts)))
        self.count = np.searchsorted(self.text, np.arange(len(self.texts)), "right") - self.first

    def anchors(self, length: int, cover: Sequence[int], period: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and hashes of all anchors."""
        size = length - period + 1
        place = np.arange(len(self.words)) - self.first[self.text]
        count = self.count[self.text]
        aligned = np.isin(np.arange(period), cover)[place % period]
        at = np.flatnonzero(aligned & (count >= length) & (place + size <= count))
        return at, _hashes(self.words, at, size, 0)

    def places(self, at: np.ndarray) -> dict[str, np.ndarray]:
        """Columns that say where words ``at``, in order, are: runs of one text, and places in them."""
        text = self.text[at]
        cut = run_starts(text)
        return {
            "text": text[cut].astype(np.int32), "doc": self.doc[text[cut]], "print": self.print[text[cut]],
            "run": np.diff(np.append(cut, len(at))).astype(np.int32), "place": _steps(at - self.first[text]),
        }


_PLACES = {"text": np.int32, "doc": np.int64, "print": np.int64, "run": np.int32, "place": np.int32}


def _spread(rows: pd.DataFrame, **types: type) -> dict[str, np.ndarray]:
    """All places and further columns of rows, with the row each came in."""
    parts = []
    for i, blob in enumerate(rows["data"]):
        part = _unpacked(blob, **_PLACES, **types)
        part |= {n: np.repeat(part[n], part["run"]) for n in ("text", "doc", "print")}
        part["place"] = np.cumsum(part["place"]).astype(np.int64)
        parts.append(part | {"row": np.full(len(part["place"]), i)})
    names = ["text", "doc", "print", "place", "row", *types]
    return {n: np.concatenate([p[n] for p in parts] or [np.zeros(0, np.int64)]) for n in names}


def _sent(block: _Block, home: int, kind: int, at: np.ndarray, buckets: int, **hashes: np.ndarray) -> list[tuple]:
    """One row per bucket of the first hash; inside it words lie in order."""
    to = (next(iter(hashes.values())) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.append(run_starts(to[order]), len(to))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        pick = order[a:b]
        out.append((int(to[pick[0]]), home, kind, _packed(**block.places(at[pick]), **{n: h[pick] for n, h in hashes.items()})))
    return out


def _answers(rows: pd.DataFrame, kind: int, found: dict[str, np.ndarray], pick: np.ndarray, **more: np.ndarray) -> list[tuple]:
    """Picked places sent back, one row for each row that they came in; ``more`` goes with them."""
    pick_order = np.argsort(found["row"][pick], kind="stable")
    pick, more = pick[pick_order], {n: v[pick_order] for n, v in more.items()}
    row = found["row"][pick]
    cuts = np.append(run_starts(row), len(row))
    homes, out = rows["home"].to_numpy(), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        home = int(homes[row[a]])
        data = _packed(text=found["text"][pick[a:b]].astype(np.int32), place=found["place"][pick[a:b]].astype(np.int32), **{n: v[a:b] for n, v in more.items()})
        out.append((home, home, kind, data))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES)


def _kind(rows: pd.DataFrame, kind: int) -> pd.DataFrame:
    return rows[rows["kind"] == kind].reset_index(drop=True)


def _joined(rows: pd.DataFrame, **types: type) -> dict[str, np.ndarray]:
    parts = [_unpacked(b, text=np.int32, place=np.int32, **types) for b in rows["data"]]
    return {n: np.concatenate([p[n] for p in parts] or [np.zeros(0, np.int64)]) for n in ("text", "place", *types)}


def _extended(block: _Block, firsts: dict[str, np.ndarray], length: int, cover: Sequence[int], period: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows that are covered for sure, and of those that only may be."""
    at, value = block.anchors(length, cover, period)
    size, n = length - period + 1, len(block.words)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, head, own, times = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
    text = block.text[at]
    place = at - block.first[text]
    doc, print_, spot = block.doc[text[head]], block.print[text[head]], place[head].copy()
    shared, foreign = times > 1, np.zeros(len(head), bool)
    if len(firsts["text"]):
        told = own[np.searchsorted(at, block.first[firsts["text"]] + firsts["place"])]
        shared[told] = True
        foreign[told] = (firsts["doc"] != doc[told]) | (firsts["print"] != print_[told]) | (firsts["spot"] != spot[told])
        doc[told], print_[told], spot[told] = firsts["doc"], firsts["print"], firsts["spot"]
    earlier = foreign[own] | (np.arange(len(at)) != head[own])
    doc, print_, shift = doc[own], print_[own], spot[own] - place
    linked = earlier[1:] & earlier[:-1] & (text[1:] == text[:-1]) & (shift[1:] == shift[:-1]) & (doc[1:] == doc[:-1]) & (print_[1:] == print_[:-1])
    begin = np.flatnonzero(earlier & ~np.concatenate([[False], linked]))
    end = np.flatnonzero(earlier & ~np.concatenate([linked, [False]]))
    windows = at[end] - at[begin] + size - length + 1
    begin, windows = at[begin][windows > 0], windows[windows > 0]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, begin, 1)
    np.add.at(mark, begin + windows, -1)
    covered = np.cumsum(mark[:-1]) > 0
    near = np.zeros(n + period + 1, np.int64)
    near[at[shared[own]] + 1] = 1
    near = np.cumsum(near)
    start = np.arange(n)
    whole = start - block.first[block.text] + length <= block.count[block.text]
    open_ = whole & ~covered & (near[start + period] > near[start])
    return np.flatnonzero(covered), np.flatnonzero(open_)


def remove_repeated_words(
    docs: DataFrame, length: int = LENGTH, cover: Sequence[int] = COVER, period: int = PERIOD, carry: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, n_words, spans array<struct<start, length>>, kept) of every document.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none. Every word in a window of ``length`` words
    whose sequence also starts earlier in the input (smaller doc_id, or the same document and an earlier
    start) is removed; windows don't cross documents and are judged on the input. ``spans`` are the
    removed runs by word number, ``kept`` the other words joined by one space. A null doc_id comes after
    all others; rows that share a doc_id are ordered by a hash of their text, and equal rows after one
    another, as documents of their own. Other columns are left out but for those named in ``carry``,
    which come last as a struct ``carried``. An empty table gives no rows.
    """
    if not is_difference_cover(cover, period) or length < period:
        raise ValueError("not a difference cover of a period within the length")
    spark = docs.sparkSession
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(carry)]
    own_names = [f"own_{i}" for i in range(len(own))]
    kinds = "".join(f", own_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    known = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    blocks = partitions(spark, known, BLOCK_BYTES)
    home_of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("print"), home_of.alias("bucket"), *own).repartition(blocks, "bucket")

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        block, home = _Block(rows), int(rows["bucket"].iloc[0])
        at, value = block.anchors(length, cover, period)
        if not len(at):
            return _frame([])
        _, head = np.unique(value, return_index=True)
        head.sort()
        return _frame(_sent(block, home, _ANCHOR, at[head], blocks, hash=value[head]))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        found = _spread(rows, hash=np.uint64)
        order = np.argsort(found["hash"], kind="stable")
        value = found["hash"][order]
        same = value[1:] == value[:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        order = order[np.lexsort([found[n][order] for n in ("place", "print", "doc", "hash")])]
        if not len(order):
            return _frame([])
        starts = run_starts(found["hash"][order])
        first = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
        return _frame(_answers(rows, _FIRST, found, order, doc=found["doc"][first], print=found["print"][first], spot=found["place"][first].astype(np.int32)))

    def extend(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return _frame([])
        block, home = _Block(rows), int(rows["bucket"].iloc[0])
        firsts = _joined(told, doc=np.int64, print=np.int64, spot=np.int32)
        covered, open_ = _extended(block, firsts, length, cover, period)
        one, two = _hashes(block.words, open_, length, 1), _hashes(block.words, open_, length, 2)
        order = np.lexsort((two, one))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        covered, first = np.concatenate([covered, open_[order[~fresh]]]), np.sort(order[fresh])
        out = _sent(block, home, _WINDOW, open_[first], blocks, one=one[first], two=two[first]) if len(first) else []
        if len(covered):
            text = block.text[covered]
            out.append((home, home, _COVERED, _packed(text=text.astype(np.int32), place=(covered - block.first[text]).astype(np.int32))))
        return _frame(out)

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        done, asked = _kind(rows, _COVERED), _kind(rows, _WINDOW)
        found = _spread(asked, one=np.uint64, two=np.uint64)
        order = np.lexsort([found[n] for n in ("place", "print", "doc", "two", "one")])
        one, two = found["one"][order], found["two"][order]
        later = order[1:][(one[1:] == one[:-1]) & (two[1:] == two[:-1])]
        return pd.concat([done.assign(bucket=done["home"]), _frame(_answers(asked, _COVERED, found, later))], ignore_index=True)[_NAMES]

    def remove(rows: pd.DataFrame, covered: pd.DataFrame) -> pd.DataFrame:
        block = _Block(rows)
        hit = _joined(covered)
        mark = np.zeros(len(block.words) + 1, np.int64)
        start = block.first[hit["text"]] + hit["place"] if len(hit["text"]) else np.zeros(0, np.int64)
        np.add.at(mark, start, 1)
        np.add.at(mark, start + length, -1)
        gone = np.cumsum(mark[:-1]) > 0
        out = []
        for i, text in enumerate(block.texts):
            words, mine = text.split(), gone[block.first[i] : block.first[i] + block.count[i]]
            spans = []
            if mine.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                spans = [{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()]
                words = [w for w, g in zip(words, mine.tolist(), strict=True) if not g]
            out.append((int(block.count[i]), spans, b" ".join(words).decode("utf-8", "surrogatepass")))
        result = pd.DataFrame(out, columns=["n_words", "spans", "kept"])
        result.insert(0, "doc_id", block.rows["doc_id"].astype("Int64"))
        return pd.concat([result[["doc_id"]], block.rows[own_names], result.drop(columns="doc_id")], axis=1)

    by_block = texts.groupBy("bucket")
    anchors = by_block.applyInPandas(cut, _ROUTE).repartition(blocks, "bucket")
    firsts = anchors.groupBy("bucket").applyInPandas(match, _ROUTE)
    windows = by_block.cogroup(firsts.groupBy("bucket")).applyInPandas(extend, _ROUTE).repartition(blocks, "bucket")
    covered = windows.groupBy("bucket").applyInPandas(settle, _ROUTE)
    done = by_block.cogroup(covered.groupBy("bucket")).applyInPandas(
        remove, f"doc_id long{kinds}, n_words long, spans array<struct<start: long, length: long>>, kept string"
    )
    carried = [F.struct(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(carry))).alias("carried")] if carry else []
    return done.select("doc_id", "n_words", "spans", "kept", *carried)
