"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

A size-aware join. Sets below a boundary ("light") enumerate their subsets of the size that a link
needs: two of them link exactly if they share such a subset, so nothing is verified. Pairs with a
set at or above the boundary ("heavy") are found by scanning inverted lists of the rare end of each
set. The boundary is where the counted cost of subsets passes that of lists.

Equal sets are one class throughout. Lists are first scanned with a few leaders each, which links large
groups of copies in linear work; after those links are contracted, every list that still holds two
components is scanned for all its pairs, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, store_columns
from .blobs import arrow_batches, pack, partitions, pieces, run_starts, unpack
from .bytewords import encode, mix, shingle_sets
from .components import components

#: Cells of the frequency sketch that orders shingles. Any cell count gives right results; fixed, so 4 MB at most are sent out.
SKETCH_BITS = 22
SLICES = 64
#: Sets up to this size are kept whole, so they can be light.
LIGHT_LIMIT = 16
#: Cost of one posting (shuffled, sorted, scanned and its candidates verified) in subset rows.
POSTING_COST = 4
#: Parts that sets are counted in: two sets differ at least by what these counts differ.
SPREAD = 256
#: Columns of 64 bits that tell which of those parts hold an odd number.
PARITY = [f"parity{i}" for i in range(SPREAD // 64)]
#: Leaders that a set may meet in each round before all pairs of mixed lists are scanned.
COLOURS = (1, 16)
#: Words of 64 bits of the sets that spare rows a shuffle, and how many of them make a row: 2 MB in all.
FILTER_CELLS = 1 << 18
FILTER_ROW = 64
#: Tokens before a posting that it carries, to find a pair once instead of at each token.
RECENT = 4
FLUSH = 500_000
POSTINGS_PER_TASK = 1_000_000


def least_common(n: int, m: int, percent: int) -> int:
    """Smallest intersection of sets of n and m members with 100 * common >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Rarest members of a set of which a linked set shares at least one."""
    return n - -(-percent * n // 100) + 1


def subset_rows(n: int, percent: int) -> int:
    """Subsets that a light set of n members enumerates."""
    return sum(comb(n, least_common(n, m, percent)) for m in _partners(n, percent))


def _partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def _sketch(docs: DataFrame, words: int) -> np.ndarray:
    """About how many documents hold a shingle, by the top bits of its hash, on a log scale of bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held, size = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        shift = np.uint64(64 - SKETCH_BITS)

        def add() -> None:
            nonlocal held, size
            if held:
                cells[:] += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=len(cells))
            held, size = [], 0

        for part in pieces(batches):
            for s in shingle_sets([encode(t) for t in part.column("text").to_pylist()], words):
                held.append(s)
                size += len(s)
                if size > FLUSH:
                    add()
        add()
        if cells.any():
            part = np.minimum(cells, 65535).astype(np.uint16).reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([pack(x) for x in part], pa.binary())], names=["slice", "cells"]
            )

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros((1 << SKETCH_BITS) // SLICES, np.int64)
        for blob in rows["cells"]:
            cells += unpack(blob, np.uint16)
        levels = np.minimum(255, np.round(8 * np.log2(1 + cells))).astype(np.uint8)
        return pd.DataFrame({"slice": [key[0]], "cells": [levels.tobytes()]})

    parts = docs.select("text").mapInArrow(count, "slice int, cells binary")
    found = parts.groupBy("slice").applyInPandas(total, "slice int, cells binary").collect()
    levels = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for row in found:
        levels[row["slice"]] = np.frombuffer(row["cells"], np.uint8)
    return levels.reshape(-1)


def _signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, h1, h2, tokens, spread, parity): identity of the set, its rarest members, rarest first, how its members fall into SPREAD parts, and which parts hold an odd number."""
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(_sketch(docs, words))

    kinds = {"n": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "tokens": pa.binary(), "spread": pa.binary()} | dict.fromkeys(PARITY, pa.int64())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, shift = levels.value, np.uint64(64 - SKETCH_BITS)
        for part in pieces(batches):
            rows = []
            for s in shingle_sets([encode(t) for t in part.column("text").to_pylist()], words):
                n = len(s)
                keep = s[np.lexsort((s, level[(s >> shift).astype(np.int64)]))]
                if n > LIGHT_LIMIT:
                    keep = keep[: prefix_length(n, percent)]
                h1, h2 = s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)
                spread = np.bincount((mix(s) & np.uint64(SPREAD - 1)).astype(np.int64), minlength=SPREAD)
                parity = np.packbits((spread & 1).astype(np.uint8)).view(np.int64)
                counts = np.minimum(spread, 255).astype(np.uint8).tobytes()
                rows.append((n, h1.astype(np.int64), h2.astype(np.int64), keep.tobytes(), counts, *parity))
            made = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=["doc_id", *kinds])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sign, "doc_id long, n long, h1 long, h2 long, tokens binary, spread binary" + "".join(f", {c} long" for c in PARITY)
    )


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """Size from which sets are heavy: the one with the least subsets below plus postings above."""
    cost = lambda x: sum(
        k * (subset_rows(n, percent) if n < x else POSTING_COST * prefix_length(n, percent)) for n, k in sizes.items()
    )
    return min(range(1, LIGHT_LIMIT + 2), key=lambda x: (cost(x), x))


def _cell_of(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER_CELLS))


def _bit_of(c: Column) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(1)), F.lit(64)).cast("int")


def _marked(rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false where ``name`` is surely not in the first column of ``ids``.

    A bit set of fixed size (a Bloom filter of one hash), so that most rows are spared a shuffle. Where ids
    outnumber its bits more rows move, and the results are the same.
    """
    known = F.col(ids.columns[0])
    bits = ids.select(_cell_of(known).alias("_cell"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit_of(known)).alias("_bits"))
    bits = bits.groupBy("_cell").agg(F.bit_or("_bits").alias("_bits"))
    words = F.map_from_entries(F.collect_list(F.struct((F.col("_cell") % FILTER_ROW).cast("int"), "_bits")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(FILTER_ROW - 1)), lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0).cast("long")))
    bits = bits.groupBy(F.floor(F.col("_cell") / FILTER_ROW).alias("_slice")).agg(words.alias("_map")).select("_slice", dense.alias("_words"))
    return _by_bits(rows, cut_lineage(bits), _cell_of(F.col(name)), _bit_of(F.col(name)))


def _by_bits(rows: DataFrame, bits: DataFrame, cell: Column, bit: Column) -> DataFrame:
    # at most FILTER_CELLS / FILTER_ROW rows, whatever the input; stored, as rows are marked in several plans
    met = rows.withColumn("_slice", F.floor(cell / FILTER_ROW)).join(F.broadcast(bits), "_slice", "left")
    maybe = F.coalesce(F.getbit(F.get("_words", (cell % FILTER_ROW).cast("int")), bit) == 1, F.lit(False))
    return met.select(*rows.columns, maybe.alias("maybe"))


def _maybe(rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``name`` is not in the first column of ``ids``."""
    return _marked(rows, name, ids).filter("maybe").drop("maybe")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` without those that ``gone`` holds; they are told by all columns of ``gone``, the first one not null."""
    marked = _marked(rows, gone.columns[0], gone)
    rest = marked.filter("maybe").drop("maybe").join(gone, gone.columns, "left_anti")
    return marked.filter("not maybe").drop("maybe").unionByName(rest)


def _with_components(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``sets`` with the component of each; sets that ``found`` does not name are their own."""
    marked = _marked(sets, "rep", found.select("node"))
    named = marked.filter("maybe").drop("maybe").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    return marked.filter("not maybe").drop("maybe").withColumn("component", F.col("rep")).unionByName(named)


def _light_links(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Links between sets below the boundary, by shared subsets."""

    def enumerate_subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rep, n, blob in zip(batch["rep"], batch["n"], batch["tokens"], strict=True):
                members = np.sort(np.frombuffer(blob, np.uint64))
                for m in _partners(n, percent):
                    if m >= boundary:
                        continue
                    for subset in combinations(members, least_common(n, m, percent)):
                        s = np.array(subset, np.uint64)
                        k1, k2 = s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)
                        rows.append((min(n, m), max(n, m), k1.astype(np.int64), k2.astype(np.int64), n, rep))
            yield pd.DataFrame(rows, columns=["lo", "hi", "k1", "k2", "n", "rep"])

    key = ["lo", "hi", "k1", "k2"]
    rows = sets.filter(F.col("n") < boundary).select("rep", "n", "tokens").mapInPandas(
        enumerate_subsets, "lo long, hi long, k1 long, k2 long, n long, rep long"
    )
    ends = rows.groupBy(*key).agg(
        F.min(F.when(F.col("n") == F.col("lo"), F.col("rep"))).alias("low"),
        F.min(F.when(F.col("n") == F.col("hi"), F.col("rep"))).alias("high"),
    ).filter("low is not null and high is not null")
    met = rows.join(ends, key)
    return met.select(
        F.col("rep").alias("a"), F.when(F.col("n") == F.col("lo"), F.col("high")).otherwise(F.col("low")).alias("b")
    ).filter("a != b").distinct()


def _star_pairs(sets: DataFrame, buckets: int, colours: int, percent: int) -> DataFrame:
    """(a, b): members of inverted lists with a leader of that list, of another component and a fitting size.

    Rows with an ``a`` of null hold, packed in ``touched``, the sets that share a list with any other one.

    The leader is the least by a hash of the id that takes the token's colour in, so one set meets up
    to ``colours`` leaders; with one colour it is the smallest id. A leader meets each component once
    in a task. Tasks send only leaders on, so a list never has more entries than there are tasks.
    """

    def leaders(tokens: np.ndarray, reps: np.ndarray, comps: np.ndarray, sizes: np.ndarray) -> tuple:
        rank = reps if colours == 1 else mix(reps.view(np.uint64) * np.uint64(colours) + mix(tokens) % np.uint64(colours))
        order = np.lexsort((rank, tokens))
        tokens, reps, comps, sizes = tokens[order], reps[order], comps[order], sizes[order]
        starts = run_starts(tokens)
        length = np.diff(np.append(starts, len(tokens)))
        each, shared = np.repeat(starts, length), np.repeat(length > 1, length)
        small, large = np.minimum(sizes[each], sizes), np.maximum(sizes[each], sizes)
        apart = (comps[each] != comps) & (100 * small >= percent * large)
        pairs = np.stack([reps[each], reps, comps], 1)[apart]
        if len(pairs):
            _, first = np.unique(pairs[:, [0, 2]], axis=0, return_index=True)
            pairs = pairs[first, :2]
        return tokens[starts], reps[starts], comps[starts], sizes[starts], pairs[:, :2], np.unique(reps[shared])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        size = 0

        def flush() -> pd.DataFrame:
            *posts, pairs, touched = leaders(*(np.concatenate(x) for x in zip(*held, strict=True)))
            to = (mix(posts[0]) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((posts[1], to))  # by set, so that all but the tokens compresses
            *posts, to = *(x[order] for x in posts), to[order]
            cuts = np.append(run_starts(to), len(to))
            rows = [
                (int(to[x]), *(pack(p[x:y]) for p in posts), None, None)
                for x, y in zip(cuts[:-1], cuts[1:], strict=True)
            ]
            if len(touched):
                rows.append((int(touched[0] % buckets), None, None, None, None, pack(pairs), pack(touched)))
            return pd.DataFrame(rows, columns=["bucket", "tokens", "reps", "comps", "sizes", "pairs", "touched"])

        for batch in batches:
            for rep, comp, n, blob in zip(batch["rep"], batch["component"], batch["n"], batch["tokens"], strict=True):
                t = np.frombuffer(blob, np.uint64)
                held.append((t, *(np.full(len(t), x, np.int64) for x in (rep, comp, n))))
                size += len(t)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        own = [unpack(x, np.int64).reshape(-1, 2) for x in rows["pairs"].dropna()]
        touched = [unpack(x, np.int64) for x in rows["touched"].dropna()]
        posts = rows.dropna(subset=["tokens"])
        if len(posts):
            kinds = (("tokens", np.uint64), ("reps", np.int64), ("comps", np.int64), ("sizes", np.int64))
            *_, pairs, more = leaders(*(np.concatenate([unpack(x, kind) for x in posts[name]]) for name, kind in kinds))
            own.append(pairs)
            touched.append(more)
        pairs = np.concatenate(own)
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        out = pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "touched": None}).astype({"a": "Int64", "b": "Int64"})
        last = pd.DataFrame({"a": [None], "b": [None], "touched": [pack(np.unique(np.concatenate(touched)))]})
        return pd.concat([out, last.astype({"a": "Int64", "b": "Int64"})], ignore_index=True)

    parts = sets.select("rep", "component", "n", "tokens").mapInPandas(
        scan, "bucket int, tokens binary, reps binary, comps binary, sizes binary, pairs binary, touched binary"
    )
    return parts.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(meet, "a long, b long, touched binary")


def _only_touched(sets: DataFrame, stars: DataFrame) -> DataFrame:
    """``sets`` without most of those that share no list with another one.

    The ids meet as bit sets of fixed size, in slices: a list per bucket names an id again in each bucket.
    """
    width = FILTER_CELLS // SLICES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_CELLS, np.uint64)
        for batch in batches:
            for blob in batch.column("touched"):
                folded = _fold(unpack(blob.as_py(), np.uint64))
                at = (folded % np.uint64(FILTER_CELLS)).astype(np.int64)
                np.bitwise_or.at(bits, at, np.uint64(1) << (folded // np.uint64(FILTER_CELLS) % np.uint64(64)))
        used = [i for i in range(SLICES) if bits[i * width : (i + 1) * width].any()]
        if used:
            blobs = [pack(bits[i * width : (i + 1) * width]) for i in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "bits"])

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(width, np.uint64)
        for blob in rows["bits"]:
            bits |= unpack(blob, np.uint64)
        words = bits.view(np.int64).reshape(-1, FILTER_ROW)
        return pd.DataFrame({"_slice": np.arange(len(words)) + int(rows["slice"].iloc[0]) * len(words), "_words": list(words)})

    slices = stars.filter("touched is not null").select("touched").mapInArrow(mark, "slice int, bits binary")
    bits = cut_lineage(slices.groupBy("slice").applyInPandas(unite, "_slice long, _words array<long>"))
    right = lambda c, n: F.call_function("shiftrightunsigned", c, F.lit(n))
    folded = F.col("rep").bitwiseXOR(right(F.col("rep"), 24)).bitwiseXOR(right(F.col("rep"), 48))
    bit = F.pmod(right(folded, FILTER_CELLS.bit_length() - 1), F.lit(64)).cast("int")
    return _by_bits(sets, bits, F.pmod(folded, F.lit(FILTER_CELLS)), bit).filter("maybe").drop("maybe")


def _fold(ids: np.ndarray) -> np.ndarray:
    """Ids whose low bits take all bits in, by steps that columns have too."""
    return ids ^ (ids >> np.uint64(24)) ^ (ids >> np.uint64(48))


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by how their sets fall into parts. What the counts differ by, the sets differ by at least."""
    ids = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep")))
    mine = _maybe(sets.select("rep", "n", "spread"), "rep", ids)
    both = pairs.join(mine.toDF("a", "n_a", "spread_a"), "a").join(mine.toDF("b", "n_b", "spread_b"), "b")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, SPREAD).astype(np.int32) for c in ("spread_a", "spread_b"))
            total = (batch["n_a"] + batch["n_b"]).to_numpy()
            most = total - 2 * -(-percent * total // (100 + percent))
            yield batch.loc[np.abs(x - y).sum(1) <= most, ["a", "b"]]

    return both.mapInPandas(keep, "a long, b long").distinct()


def _mixed_tokens(sets: DataFrame, buckets: int) -> DataFrame:
    """Tokens whose inverted list still holds two components; each task sends its smallest and largest one only."""

    def ends(tokens: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        starts = run_starts(tokens)
        return tokens[starts], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        size = 0

        def flush() -> pd.DataFrame:
            comps = np.concatenate([x[1] for x in held])
            tokens, low, high = ends(np.concatenate([x[0] for x in held]), comps, comps)
            to = (mix(tokens) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((low, to))
            tokens, low, high, to = tokens[order], low[order], high[order], to[order]
            cuts = np.append(run_starts(to), len(to))
            return pd.DataFrame(
                [(int(to[x]), pack(tokens[x:y]), pack(low[x:y]), pack(high[x:y])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)],
                columns=["bucket", "tokens", "low", "high"],
            )

        for batch in batches:
            for comp, blob in zip(batch["component"], batch["tokens"], strict=True):
                t = np.frombuffer(blob, np.uint64)
                held.append((t, np.full(len(t), comp, np.int64)))
                size += len(t)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        tokens, low, high = ends(
            np.concatenate([unpack(x, np.uint64) for x in rows["tokens"]]),
            np.concatenate([unpack(x, np.int64) for x in rows["low"]]),
            np.concatenate([unpack(x, np.int64) for x in rows["high"]]),
        )
        return pd.DataFrame({"token": tokens[low != high].view(np.int64)})

    parts = sets.select("component", "tokens").mapInPandas(scan, "bucket int, tokens binary, low binary, high binary")
    return parts.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(meet, "token long")


def _list_pairs(sets: DataFrame, mixed: DataFrame, boundary: int, percent: int) -> DataFrame:
    """All pairs of different components that share a rare token and may link by size and place in their lists.

    Parts whose parity differs hold a member that the sets don't share. The conditions are alike for both sides, so that
    the postings are shuffled once.
    A pair that also shares one of the tokens just before is left to that one: its places are better, so it holds the pair if this one does.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            tokens = [np.frombuffer(x, np.int64) for x in part.column("tokens").to_pylist()]
            each = np.array([len(t) for t in tokens])
            token, at = np.concatenate(tokens), np.arange(each.sum())
            place = at - np.repeat(np.cumsum(each) - each, each)
            back = np.minimum(place, RECENT)
            ends = np.append(0, np.cumsum(back))
            before = np.repeat(at - back - ends[:-1], back) + np.arange(ends[-1])
            same = [np.repeat(part.column(c).to_numpy(), each) for c in ("rep", "component", "n", *PARITY)]
            recent = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(token[before]))
            yield pa.RecordBatch.from_arrays(
                [recent, *map(pa.array, (token, place, *same))], names=["recent", "token", "place", "rep", "component", "n", *PARITY]
            )

    kind = "recent array<long>, token long, place long, rep long, component long, n long" + "".join(f", {c} long" for c in PARITY)
    posts = _maybe(sets.select("rep", "component", "n", *PARITY, "tokens").mapInArrow(post, kind), "token", mixed)
    posts = posts.join(mixed, "token", "left_semi")
    x, y = posts.alias("x"), posts.alias("y")
    common = F.ceil(F.expr(f"{percent} * (x.n + y.n)") / (100 + percent))
    return (
        x.join(y, F.expr(
            f"x.token = y.token and x.component != y.component and (x.n < y.n or x.n = y.n and x.rep < y.rep)"
            f" and 100 * x.n >= {percent} * y.n and greatest(x.n, y.n) >= {boundary} and not arrays_overlap(x.recent, y.recent)"
        ) & (F.expr("1 + least(x.n - x.place - 1, y.n - y.place - 1)") >= common)
            & (F.expr(" + ".join(f"bit_count(x.{c} ^ y.{c})" for c in PARITY)) <= F.expr("x.n + y.n") - 2 * common))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    )


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id")))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            blobs = [None if t is None else pack(np.frombuffer(encode(t), np.uint8)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(blobs, pa.binary())], names=["doc_id", "text"])

    # a text moves once for each of its pairs, so it moves compressed
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    texts = _maybe(texts, "doc_id", ids).mapInArrow(press, "doc_id long, text binary")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            left, right = (part.column(c).to_pylist() for c in ("text_a", "text_b"))
            names = {}
            for blob in [*left, *right]:
                names.setdefault(blob, len(names))
            sets = shingle_sets([b"" if x is None else unpack(x, np.uint8).tobytes() for x in names], words)
            good = []
            for a, b in zip(left, right, strict=True):
                s, t = sets[names[a]], sets[names[b]]
                common = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * common >= percent * (len(s) + len(t) - common))
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Texts are lower-cased in A-Z and cut into words at white space; a document's set holds its
    distinct ``words``-word shingles, or its whole word sequence where it has fewer. Two documents
    link when 100 * intersection >= ``percent`` * union; component_id is the smallest doc_id
    reachable by links. Null and empty texts have no set and stay alone. Rows that share a doc_id
    are one node. A null doc_id gives n_shingles and a null component_id: it can't name a component.
    Repeated rows come out as often as they went in; other columns are ignored.
    """
    with arrow_batches(docs.sparkSession):
        return _similar(docs.select("doc_id", "text"), words, percent)


def _similar(docs: DataFrame, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    signs, delete_signs = store_columns(_signatures(docs, words, percent))
    stats = signs.filter("n > 0").groupBy(F.least("n", F.lit(LIGHT_LIMIT + 1)).alias("n")).agg(
        F.count("*").alias("k"), F.sum(F.length("tokens") / 8).alias("postings")
    ).collect()
    boundary = choose_boundary({r["n"]: r["k"] for r in stats if r["n"] <= LIGHT_LIMIT}, percent)
    buckets = partitions(spark, sum(r["postings"] for r in stats), POSTINGS_PER_TASK)

    key = ["n", "h1", "h2"]
    classes = signs.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    member = cut_lineage(signs.select("doc_id", *key).join(classes, key, "left").select(
        "doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")
    ))
    copies = cut_lineage(signs.filter("n > 0").select("doc_id", *key).join(classes, key).filter("doc_id != rep").drop("rep").distinct())
    # stored, as every later plan starts from it
    sets, delete_sets = store_columns(_without(signs.filter("n > 0"), copies.select("doc_id", *key)).select(F.col("doc_id").alias("rep"), "n", "tokens", "spread", *PARITY))
    delete_signs()
    heavy = sets.filter(F.col("n") >= percent * boundary // 100).select(
        "rep", "n", *PARITY, F.when(F.col("n") > LIGHT_LIMIT, F.col("tokens")).otherwise(
            F.substring("tokens", F.lit(1), (8 * (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)).cast("int"))
        ).alias("tokens"),
    )

    links, left = _light_links(sets, boundary, percent), heavy.withColumn("component", F.col("rep"))
    found = delete_left = None
    for colours in COLOURS:
        stars = cut_lineage(_star_pairs(left, buckets, colours, percent))
        # buckets name a pair again, and what is known of its sets is much wider
        near = cut_lineage(_near(stars.filter("touched is null").select("a", "b").distinct(), sets, percent))
        links = links.unionAll(_verified(near, docs, words, percent))
        found = components(links)
        if colours == 1:  # sets that share no rare token with another one are done; some of them may stay
            heavy = _only_touched(heavy, stars)
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        if delete_left is not None:
            delete_left()
        left, delete_left = store_columns(_with_components(heavy, found))
    mixed = cut_lineage(_mixed_tokens(left, buckets))
    listed = cut_lineage(_list_pairs(left, mixed, boundary, percent))
    rest = cut_lineage(_near(listed, sets, percent))
    more = _verified(rest, docs, words, percent)
    # all documents of a class, also those whose doc_id has several texts, meet
    same = member.filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    last = components(links.unionAll(more).unionAll(same))
    delete_sets()
    delete_left()

    named = member.select("doc_id", F.col("n").alias("n_shingles")).join(
        last.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    unnamed = docs.filter("doc_id is null")
    return named.unionAll(
        _signatures_of_null(unnamed, words).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    )


def _signatures_of_null(docs: DataFrame, words: int) -> DataFrame:
    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": pd.array([None] * len(batch), "Int64"),
                "n_shingles": [len(s) for s in shingle_sets([encode(t) for t in batch["text"]], words)],
            })

    return docs.select("text").mapInPandas(sizes, "doc_id long, n_shingles long")
