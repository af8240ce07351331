"""Removal of byte strings that already occurred earlier in the corpus.

Every string of ``length`` bytes belongs to the smallest hash of the grams inside it (its anchor), so
equal strings meet under one anchor wherever they stand. Neighbouring strings of one anchor form a
snippet. Equal snippets are settled by their hashes: all but the first are covered. What is left,
different snippets under one anchor, goes into run-length indexes: a run-compressed Burrows-Wheeler
transform whose run heads are sampled. The samples give every text position its neighbour in suffix
order and the length of the match with it (matching statistics), streamed in text order; matches of
``length`` or more chain the occurrences of a string, and all but the first are covered.

Anchors with very many different snippets would fill one task. Their strings are settled one by one
by string hashes instead, combined in every task before they are sent; the result is the same.

Texts are dealt out once by a hash of doc_id; the three passes over them share that exchange.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import pack, partitions, run_starts, unpack
from .bytewords import Prefix, chunks, encode, mix

LENGTH = 100
#: Bytes of a gram. Longer ones meet less by chance, shorter ones make fewer snippets.
GRAM = 40
BLOCK_BYTES = 8 << 20
#: Text bytes of one index, unless one anchor has more.
INDEX_BYTES = 1 << 20
#: Different snippets of one anchor above which its strings are settled one by one.
HOT_SNIPPETS = 20_000
_LAST = np.iinfo(np.int64).max
#: doc, version, lo, count: the strings that start at lo .. lo + count - 1. A snippet's count is negative if it may repeat inside.
_PLACE = ("doc", "version", "lo", "count")
_ROUTE = "bucket int, kind int, doc binary, version binary, lo binary, count binary, anchor binary, print binary, bytes binary"
_COVERED, _ASKED, _SNIPPET, _STRING, _HOT = 0, 1, 2, 3, 4


def _rows(to: np.ndarray, kind: int, **columns: np.ndarray) -> pd.DataFrame:
    """Packed columns, one row for each bucket in ``to``."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    columns = {k: v[order] for k, v in columns.items()}
    cuts = np.append(run_starts(to), len(to))
    out = [
        {"bucket": int(to[a]), "kind": kind, **{k: pack(v[a:b]) for k, v in columns.items()}}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]
    return pd.DataFrame(out, columns=[c.split()[0] for c in _ROUTE.split(", ")])


_TYPES = {"doc": np.int64, "version": np.int32, "lo": np.int64, "count": np.int64, "anchor": np.uint64, "print": np.uint64}


def _columns(rows: pd.DataFrame, kind: int, *names: str) -> list[np.ndarray]:
    rows = rows[rows["kind"] == kind]
    return [np.concatenate([unpack(x, _TYPES[n]) for x in rows[n]] or [np.zeros(0, _TYPES[n])]) for n in names]


def _merged(doc: np.ndarray, version: np.ndarray, lo: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """The same covered starts as few intervals."""
    if not len(doc):
        return [doc, version, lo, count]
    order = np.lexsort((lo, version, doc))
    doc, version, lo, end = doc[order], version[order], lo[order], (lo + np.abs(count))[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])])
    # one running maximum serves all documents: each one's ends are lifted above the former's
    lift = np.cumsum(fresh) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new = fresh.copy()
    new[1:] |= lo[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return [doc[at], version[at], lo[at], reach[last] - lo[at]]


def _sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """np.minimum or np.maximum of every ``width`` neighbours, by doubling."""
    now, span = values, 1
    while 2 * span <= width:
        now = best(now[: len(now) - span], now[span:])
        span *= 2
    rest = width - span
    return best(now[: len(now) - rest], now[rest:]) if rest else now


def _snippets(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text index, start, count of strings, anchor, hash) of all snippets."""
    for first, end in chunks(texts):
        part = texts[first:end]
        data = np.frombuffer(b"".join(part), np.uint8)
        if len(data) < length:
            continue
        sizes = np.array([len(t) for t in part])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        prefix, at, width = Prefix(data), np.arange(len(data) - gram + 1), length - gram + 1
        grams = prefix.of(at, at + gram)
        anchor = _sliding(np.minimum, grams, width)
        # where a gram is the anchor of some string
        at = np.flatnonzero(grams == _sliding(np.maximum, np.pad(anchor, width - 1), width))
        start = np.arange(len(anchor))
        text = np.searchsorted(begins, start, "right") - 1
        valid = start + length <= begins[text + 1]
        start, text, anchor = start[valid], text[valid], anchor[valid]
        if not len(start):
            continue
        cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
        count = np.diff(np.append(cut, len(start)))
        lo, anchor = start[cut], anchor[cut]
        # a string can only repeat inside its snippet if the anchor does
        a, b = np.searchsorted(at, lo), np.searchsorted(at, lo + count - 1 + width)
        own = np.repeat(np.arange(len(lo)), b - a)
        place = np.arange(len(own)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[own]
        times = np.bincount(own, grams[at[place]] == anchor[own], len(lo))
        signed = np.where(times > 1, -count, count)
        yield text[cut] + first, lo - begins[text[cut]], signed, anchor, prefix.of(lo, lo + count - 1 + length)


def _first_of_each(anchor: np.ndarray, prints: np.ndarray, place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by anchor, hash and place, and which of that order are the first of their hash."""
    doc, version, lo, _ = place
    order = np.lexsort((lo, version, doc, prints, anchor))
    a, p = anchor[order], prints[order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1])]) if len(a) else np.zeros(0, bool)


def _combined(kind: int, anchor: np.ndarray, prints: np.ndarray, place: list[np.ndarray], buckets: int) -> list[pd.DataFrame]:
    """First occurrences by bucket of their anchor; the others are covered and travel with them."""
    order, first = _first_of_each(anchor, prints, place)
    if not len(order):
        return []
    keep, later = order[first], order[~first]
    to = (mix(anchor[keep]) % np.uint64(buckets)).astype(np.int64)
    out = [_rows(to, kind, anchor=anchor[keep], print=prints[keep], **{n: c[keep] for n, c in zip(_PLACE, place, strict=True)})]
    if len(later):
        merged = _merged(*(c[later] for c in place))
        out.append(_rows(np.full(len(merged[0]), int(to[0])), _COVERED, **dict(zip(_PLACE, merged, strict=True))))
    return out


def _texts(block: pd.DataFrame) -> pd.DataFrame:
    """The block's rows with the place of their document among equal ids."""
    block = block.drop(columns="bucket")
    block["bytes"] = [encode(None if not isinstance(t, str) else t) for t in block["text"]]
    block["doc"] = block["doc_id"].astype("Int64").fillna(_LAST).astype("int64")
    if block["doc"].duplicated().any():
        block = block.sort_values(["doc", "bytes"], kind="stable")
    block["version"] = block.groupby("doc").cumcount().astype("int32")
    return block.sort_values(["doc", "version"], kind="stable").reset_index(drop=True)


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of snippets, with suffix samples at its run heads.

    Snippets end in terminators of their own, so no match reaches over an end. Kept are the run heads
    in text order (``sample``), the suffix before each in suffix order (``before``) and the length of
    the match of the two (``match``): enough for matching statistics of the whole text, as a position
    that heads no run continues the match of the one before it, shorter by one.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        """``data`` holds the snippets, each followed by one spare byte; bounds: their starts, and the end."""
        ends = bounds[1:] - 1
        order, place = self._suffixes(data, bounds)
        symbols = data.astype(np.int64) + len(ends)
        symbols[ends] = np.arange(len(ends))
        last = symbols[order - 1]  # the transform
        heads = np.flatnonzero(np.concatenate([[False], last[1:] != last[:-1]]))
        self.size, self.runs = len(data), len(heads) + 1
        at = order[heads]
        by_text = np.argsort(at)
        self.sample, self.before = at[by_text], order[heads - 1][by_text]
        self.match = self._common(data, ends, self.sample, self.before)

    @staticmethod
    def _suffixes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order and its inverse, by doubling; only suffixes that are still tied are sorted again.

        Bytes are numbered densely from 1, so that the first sort sees as many of them as fit 64 bits.
        Every terminator is 0 there and what follows it is masked: suffixes that end alike lie in text
        order, which is the order of their terminators, and are tied no more.
        """
        n, ends = len(data), bounds[1:] - 1
        inner = np.ones(n, bool)
        inner[ends] = False
        used = np.bincount(data[inner], minlength=256) > 0
        bits = max(1, int(used.sum()).bit_length())
        span = 63 // bits
        symbols = np.where(inner, np.cumsum(used).astype(np.uint64)[data], np.uint64(0))
        key, shift = np.zeros(n, np.uint64), np.uint64(bits)
        for j in range(span):
            key <<= shift
            key[: n - j] |= symbols[j:]
        room = np.repeat(ends, np.diff(bounds)) - np.arange(n)
        near = np.flatnonzero(room < span)
        cut = ((span - room[near]) * bits).astype(np.uint64)
        key[near] = (key[near] >> cut) << cut
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) | (room[order] < span)
        starts = np.flatnonzero(new)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        while len(slots):
            at = order[slots]
            # a tied suffix has no terminator in its first ``span`` symbols, so at + span is inside its snippet
            pair = rank[at] * n + rank[at + span]
            again = np.argsort(pair)
            at, pair = at[again], pair[again]
            order[slots] = at
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            heads = np.flatnonzero(new)
            rank[at] = np.repeat(slots[heads], np.diff(np.append(heads, len(at))))
            slots = slots[~(new & np.append(new[1:], True))]
            span *= 2
        return order, rank

    @staticmethod
    def _common(data: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common start of suffixes a and b inside their snippets, by halving over hashes."""
        prefix = Prefix(data)
        room = np.minimum(ends[np.searchsorted(ends, a)] - a, ends[np.searchsorted(ends, b)] - b)
        low, high = np.zeros(len(a), np.int64), room.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = prefix.of(a, a + mid) == prefix.of(b, b + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every text position in order: its neighbour in suffix order, and the length of their match."""
        at = np.arange(self.size)
        run = np.searchsorted(self.sample, at, "right") - 1
        past = at - self.sample[np.maximum(run, 0)]
        known = run >= 0
        return (
            np.where(known, self.before[np.maximum(run, 0)] + past, at),
            np.where(known, np.maximum(self.match[np.maximum(run, 0)] - past, 0), 0),
        )

    def repeated(self, length: int) -> np.ndarray:
        """Positions whose ``length`` bytes also stand at a smaller position."""
        neighbour, match = self.statistics()
        linked = np.flatnonzero(match >= length)
        if not len(linked):
            return linked
        down, up = np.arange(self.size), np.arange(self.size)
        down[linked] = neighbour[linked]
        up[neighbour[linked]] = linked
        members = np.union1d(linked, neighbour[linked])
        least = np.arange(self.size)
        for step in (down, up):
            best = np.minimum(least, least[step])
            while (step[members] != step[step[members]]).any():
                best[members] = np.minimum(best[members], best[step[members]])
                step = step[step]
            best[members] = np.minimum(best[members], best[step[members]])
            least = best
        return members[least[members] < members]


def _index(anchor: np.ndarray, place: list[np.ndarray], blobs: list[bytes], length: int) -> list[np.ndarray]:
    """Covered places among snippets that lie in order of anchor and place."""
    doc, version, lo, count = place
    sizes = count + length - 1
    group = np.cumsum(np.concatenate([[0], (anchor[1:] != anchor[:-1]).astype(np.int64)]))
    total = np.bincount(group, sizes)
    batch = (np.cumsum(total) // INDEX_BYTES).astype(np.int64)[group]
    found: list = []
    cuts = np.append(run_starts(batch), len(batch))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        bounds = np.concatenate([[0], np.cumsum(sizes[a:b] + 1)])
        data = np.frombuffer(b"\0".join(blobs[a:b]) + b"\0", np.uint8)
        at = RunLengthIndex(data, bounds).repeated(length)
        own = np.searchsorted(bounds, at, "right") - 1
        i = own + a
        found.append(_merged(doc[i], version[i], lo[i] + at - bounds[own], np.ones(len(i), np.int64)))
    return [np.concatenate([f[k] for f in found]) for k in range(4)]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_SNIPPETS, carry: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, length>>, kept binary) of every document.

    Texts are UTF-8 bytes, null is empty. Every byte of a ``length``-byte string that also starts
    earlier in the input (smaller doc_id, or the same document and an earlier start) is removed;
    ``spans`` are the removed runs and ``kept`` the other bytes. Overlapping strings count; matches
    don't cross documents. A null doc_id comes after all others. Rows that share a doc_id are ordered
    by their bytes, and repeated rows after one another, as documents of their own. Other columns are
    left out but for those named in ``carry``, which come last as a struct ``carried``.
    """
    spark = docs.sparkSession
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(carry)]
    own_names = [f"own_{i}" for i in range(len(own))]
    kinds = "".join(f", own_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    known = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    blocks = partitions(spark, known, BLOCK_BYTES)
    buckets = blocks
    texts = docs.select(
        "doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("bucket"), *own
    ).repartition(blocks, "bucket")

    def cut(block: pd.DataFrame) -> pd.DataFrame:
        rows = _texts(block)
        found = list(_snippets(list(rows["bytes"]), length, gram))
        home = int(block["bucket"].iloc[0])
        if not found:
            return _rows(np.zeros(0, np.int64), _SNIPPET)
        text, lo, count, anchor, prints = (np.concatenate([f[k] for f in found]) for k in range(5))
        place = [rows["doc"].to_numpy()[text], rows["version"].to_numpy()[text], lo, count]
        return pd.concat(_homed(_combined(_SNIPPET, anchor, prints, place, buckets), home), ignore_index=True)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = [rows[rows["kind"] == _COVERED].assign(bucket=lambda r: r["home"])]
        part = rows[rows["kind"] == _SNIPPET]
        if len(part):
            anchor, prints, *place = _columns(part, _SNIPPET, "anchor", "print", *_PLACE)
            sizes = [len(unpack(x, np.int64)) for x in part["doc"]]
            home = np.repeat(part["home"].to_numpy(), sizes)
            order, first = _first_of_each(anchor, prints, place)
            later, keep = order[~first], order[first]
            out.append(_by_home(home[later], _COVERED, place, later))
            a = anchor[keep]
            starts = run_starts(a)
            many = np.repeat(np.diff(np.append(starts, len(a))), np.diff(np.append(starts, len(a))))
            inside = place[3][keep] < 0
            place[3] = np.abs(place[3])
            for kind, ask in ((_ASKED, (many > 1) & (many <= hot) | (many == 1) & inside), (_HOT, many > hot)):
                i = keep[ask]
                out.append(_by_home(home[i], kind, place, i, anchor=anchor))
        return pd.concat(out, ignore_index=True)[_NAMES]

    def fetch(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame(columns=_NAMES)
        home = int(asked["bucket"].iloc[0])
        rows = _texts(block)
        at = {k: i for i, k in enumerate(zip(rows["doc"], rows["version"], strict=True))}
        data = list(rows["bytes"])
        out = []
        covered = _merged(*_columns(asked, _COVERED, *_PLACE))
        if len(covered[0]):
            out.append(_rows(np.full(len(covered[0]), home % buckets), _COVERED, **dict(zip(_PLACE, covered, strict=True))))
        anchor, *place = _columns(asked, _ASKED, "anchor", *_PLACE)
        if len(anchor):
            to = (mix(anchor) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            anchor, to, place = anchor[order], to[order], [c[order] for c in place]
            cuts = np.append(run_starts(to), len(to))
            packed = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                text = b"".join(
                    data[at[d, v]][s : s + k + length - 1]
                    for d, v, s, k in zip(*(c[a:b].tolist() for c in place), strict=True)
                )
                packed.append(pack(np.frombuffer(text, np.uint8)))
            out.append(_rows(to, _SNIPPET, anchor=anchor, **dict(zip(_PLACE, place, strict=True))).assign(bytes=packed))
        _, *place = _columns(asked, _HOT, "anchor", *_PLACE)
        if len(place[0]):
            doc, version, lo, count = place
            strings = [Prefix(np.frombuffer(data[at[d, v]], np.uint8)).of(
                np.arange(s, s + k), np.arange(s, s + k) + length
            ) for d, v, s, k in zip(doc.tolist(), version.tolist(), lo.tolist(), count.tolist(), strict=True)]
            each = np.repeat(np.arange(len(doc)), count)
            prints = np.concatenate(strings)
            start = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            out += _combined(_STRING, prints, mix(prints), [doc[each], version[each], start, np.ones(len(each), np.int64)], buckets)
        return pd.concat(_homed(out, home), ignore_index=True) if out else pd.DataFrame(columns=_NAMES)

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        out = [rows[rows["kind"] == _COVERED].assign(bucket=lambda r: r["home"])]
        part = rows[rows["kind"] == _SNIPPET]
        if len(part):
            anchor, *place = _columns(part, _SNIPPET, "anchor", *_PLACE)
            home = np.repeat(part["home"].to_numpy(), [len(unpack(x, np.int64)) for x in part["doc"]])
            blobs: list[bytes] = []
            for blob, count in zip(part["bytes"], part["count"], strict=True):
                text, sizes = unpack(blob, np.uint8).tobytes(), unpack(count, np.int64) + length - 1
                ends = np.cumsum(sizes)
                blobs += [text[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            doc, version, lo, _ = place
            order = np.lexsort((lo, version, doc, anchor))
            found = _index(anchor[order], [c[order] for c in place], [blobs[i] for i in order], length)
            # a document has one home
            docs_, first = np.unique(doc, return_index=True)
            homes = home[first][np.searchsorted(docs_, found[0])]
            out.append(_by_home(homes, _COVERED, found, np.arange(len(homes))))
        part = rows[rows["kind"] == _STRING]
        if len(part):
            anchor, prints, *place = _columns(part, _STRING, "anchor", "print", *_PLACE)
            home = np.repeat(part["home"].to_numpy(), [len(unpack(x, np.int64)) for x in part["doc"]])
            order, first = _first_of_each(anchor, prints, place)
            later = order[~first]
            out.append(_by_home(home[later], _COVERED, place, later))
        return pd.concat(out, ignore_index=True)[_NAMES]

    def remove(block: pd.DataFrame, covered: pd.DataFrame) -> pd.DataFrame:
        rows = _texts(block)
        doc, version, lo, count = _merged(*_columns(covered, _COVERED, *_PLACE))
        begin = np.searchsorted(doc, rows["doc"].to_numpy(), "left")
        end = np.searchsorted(doc, rows["doc"].to_numpy(), "right")
        out = []
        for i, data in enumerate(rows["bytes"]):
            s = slice(begin[i], end[i])
            mine = version[s] == rows["version"].iat[i]
            spans, kept, at = [], [], 0
            for a, k in zip(lo[s][mine].tolist(), count[s][mine].tolist(), strict=True):
                b = a + k + length - 1
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            out.append((len(data), [{"start": a, "length": b - a} for a, b in spans], b"".join(kept)))
        result = pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])
        result.insert(0, "doc_id", rows["doc_id"].astype("Int64"))
        return pd.concat([result[["doc_id"]], rows[own_names], result.drop(columns="doc_id")], axis=1)

    by_block = texts.groupBy("bucket")
    cuts = by_block.applyInPandas(cut, _HOMED)
    asked = cuts.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(compare, _HOMED)
    fetched = by_block.cogroup(asked.groupBy("bucket")).applyInPandas(fetch, _HOMED)
    covered = fetched.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(mark, _HOMED)
    done = by_block.cogroup(covered.groupBy("bucket")).applyInPandas(
        remove, f"doc_id long{kinds}, n_bytes long, spans array<struct<start: long, length: long>>, kept binary"
    )
    carried = [F.struct(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(carry))).alias("carried")] if carry else []
    return done.select("doc_id", "n_bytes", "spans", "kept", *carried)


_HOMED = _ROUTE + ", home int"
_NAMES = [c.split()[0] for c in _HOMED.split(", ")]


def _homed(parts: list[pd.DataFrame], home: int) -> list[pd.DataFrame]:
    """The block that a row's documents are in, for the way back."""
    return [p.assign(home=home) for p in parts]


def _by_home(home: np.ndarray, kind: int, place: list[np.ndarray], pick: np.ndarray, **more: np.ndarray) -> pd.DataFrame:
    columns = [c[pick] for c in place]
    more = {k: v[pick] for k, v in more.items()}
    if kind == _COVERED and len(pick):
        # merged inside each block
        out = []
        for h in np.unique(home):
            merged = _merged(*(c[home == h] for c in columns))
            out.append(_rows(np.full(len(merged[0]), h), kind, **dict(zip(_PLACE, merged, strict=True))))
        return pd.concat(out, ignore_index=True).assign(home=lambda r: r["bucket"])
    return _rows(home, kind, **dict(zip(_PLACE, columns, strict=True)), **more).assign(home=lambda r: r["bucket"])
