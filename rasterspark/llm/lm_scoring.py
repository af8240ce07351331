"""Scores of texts under an n-gram model of the corpus, kept as Elias-Fano tries that are spread over tasks.

The model is a trigram one (ORDER), interpolated with the orders below down to the smoothed unigram:
p(w|v) = (1 - r) c(v w) / c(v) + r p(w), and p(w|u v) = (1 - s) c(u v w) / c(u v) + s p(w|v). r depends on
how often v occurs, s on how often u v does: for each power of two, the share of pairs, or of triples, seen
once (the mass of unseen ones after Good and Turing). A text's first token has the end before it and no
more; where a context is unknown the order below stands. All of it sums to one over the known words and
one unknown word.

Texts are dealt into blocks, compressed on the way, and read once: a block's tokens are kept as numbers of its
words. A block asks for each of its words once, for each of its pairs once and for each of its triples of two
known pairs once (no other was seen); all questions carry the block's training counts, so the same exchange
counts the corpus and looks it up, and what is frequent is one entry per block. Pairs go to the shard of their
context, triples to that of the pair which is their context (or of context and word for contexts too frequent
for one shard). Each shard builds its level of the trie in memory-mapped files and looks all its questions up;
it numbers its pairs, and the level below points to them. The trie holds counts: a block knows its contexts'
counts and the orders below, so probabilities are made where they are summed and none is shuffled. Questions are
sorted and sent as differences.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .blobs import partitions, run_starts
from .bytewords import chunks, encode, mix, word_hashes
from .elias_fano import BigramTrie

BLOCK_BYTES = 8 << 20
#: Training occurrences of a context above which its words are spread over several shards.
HOT_CONTEXT = 1_000_000
#: A token's score may differ from the model's by less than one of so many steps of log10.
STEP = 2000
_END = np.uint64(0x454E44454E44454E)
_KIND = "bucket int, block int, kind int, a binary, b binary, c binary, d binary, e binary, n long, v long"
_WORDS, _PAIRS, _TOTALS, _TRIPLES, _TOKENS, _LEVEL = 0, 1, 2, 3, 4, 5
_LEVELS = 64
#: Words of the longest n-grams.
ORDER = 3


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 up in the fewest bytes that hold all, as zstandard bytes: their first bytes first, then their second bytes, and so on."""
    values = np.ascontiguousarray(values)
    kind = np.min_scalar_type(int(values.max(initial=0)))
    values = values.astype(kind)
    return bytes([kind.itemsize]) + blobs.pack(values.view(np.uint8).reshape(len(values), kind.itemsize).T)


def unpack(blob: bytes, dtype: type = np.int64) -> np.ndarray:
    """The array that ``pack`` was given."""
    size = blob[0]
    return np.ascontiguousarray(blobs.unpack(blob[1:], np.uint8).reshape(size, -1).T).view(f"u{size}").ravel().astype(dtype)


def held_out(doc_id: int | None) -> bool | None:
    """Whether a document teaches nothing: crc32 of its id as text, modulo 5, is 1."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5 == 1


def read_texts(rows: pd.DataFrame, shards: int) -> tuple[_Block, list[tuple]]:
    """A block of texts, and its words with their training counts: (shard, hashes, counts)."""
    ids, texts = [], []
    for packed_ids, sizes, packed in zip(rows["ids"], rows["sizes"], rows["texts"], strict=True):
        raw, sizes = blobs.unpack(packed, np.uint8).tobytes(), unpack(sizes)
        ends = np.cumsum(sizes)
        ids += json.loads(packed_ids)
        texts += [raw[e - n : e].lower() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    words, doc = [], []
    for lo, hi in chunks(texts):
        w, d = word_hashes(texts[lo:hi])
        words.append(w)
        doc.append(d + lo)
    words, doc = np.concatenate(words), np.concatenate(doc)
    sizes = np.bincount(doc, minlength=len(texts)) + 1
    tokens = np.full(len(words) + len(texts), _END)
    tokens[np.delete(np.arange(len(tokens)), np.cumsum(sizes) - 1)] = words
    names, own = np.unique(tokens, return_inverse=True)
    # words are numbered in order of their shard
    to = (mix(names) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    names, to = names[order], to[order]
    block = _Block(ids, sizes, place[own], len(names), int(np.flatnonzero(names == _END)[0]))
    counts = np.bincount(block.own[block.teach], minlength=len(names))
    cuts = np.append(run_starts(to), len(to))
    return block, [(int(to[a]), names[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class _Block:
    """Tokens of a block's texts as numbers of its distinct words, which stand in order of their shard until they are answered."""

    def __init__(self, ids: list[int | None], sizes: np.ndarray, own: np.ndarray, words: int, end: int) -> None:
        self.ids, self.sizes, self.own, self.words, self.end = ids, sizes, own, words, end
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.teach = np.array([held_out(i) is False for i in ids], bool)[self.doc]

    def store(self) -> tuple[bytes, ...]:
        """The block in bytes; frequent words take few."""
        by_count = np.argsort(-np.bincount(self.own, minlength=self.words), kind="stable")
        rank = np.empty(self.words, np.int64)
        rank[by_count] = np.arange(self.words)
        return pack(rank[self.own]), pack(by_count), pack(self.sizes), json.dumps(self.ids).encode()

    @classmethod
    def of(cls, rows: pd.DataFrame) -> _Block:
        """The block that ``store`` put into the one row of tokens among ``rows``."""
        row = rows[rows["kind"] == _TOKENS].iloc[0]
        by_count = unpack(row["b"])
        return cls(json.loads(row["d"]), unpack(row["c"]), by_count[unpack(row["a"])], len(by_count), int(row["n"]))

    def answers(self, rows: pd.DataFrame) -> None:
        """Take the corpus counts and numbers of the words, which are renumbered in order of their numbers in the corpus."""
        rows = rows[rows["kind"] == _WORDS].sort_values("n")
        total, number = (np.concatenate([unpack(x) for x in rows[k]]) for k in "ab")
        order = np.argsort(number)
        rank = np.empty(self.words, np.int64)
        rank[order] = np.arange(self.words)
        self.total, self.number = total[order], number[order]
        self.own, self.end = rank[self.own], int(rank[self.end])

    def pairs(self, shards: int) -> None:
        """The distinct pairs of known words, in order of their shard, context and word."""
        self.before = before = np.concatenate([[self.end], self.own[:-1]])
        good = (self.total[before] > 0) & (self.total[self.own] > 0)
        self.known_pair = good
        unique, inverse = np.unique(before[good] * self.words + self.own[good], return_inverse=True)
        v, w = unique // self.words, unique % self.words
        seen = np.bincount(inverse[self.teach[good]], minlength=len(unique))
        to = _shard(self.number[v], self.number[w], self.total[v], shards)
        order = np.argsort(to, kind="stable")
        place = np.empty(len(unique), np.int64)
        place[order] = np.arange(len(unique))
        self.shard, self.v, self.w, self.seen = to[order], v[order], w[order], seen[order]
        self.pair = np.full(len(self.own), -1)
        self.pair[good] = place[inverse]

    def pair_answers(self, rows: pd.DataFrame, shards: int) -> None:
        """Take the corpus counts and numbers of the pairs, and set what each token's context is."""
        size = len(self.shard)
        self.pair_total, self.pair_number = np.zeros(size, np.int64), np.full(size, -1)
        begin, rows = _begins(self.shard), rows[rows["kind"] == _PAIRS]
        for shard, total, steps in zip(rows["n"], rows["a"], rows["b"], strict=True):
            total = unpack(total)
            at = begin[int(shard)] + np.arange(len(total))
            self.pair_total[at] = total
            self.pair_number[at[total > 0]] = np.cumsum(unpack(steps)) * shards + int(shard)
        self.context = np.full(len(self.own), -1)  # the pair before, if training has it
        follows = np.flatnonzero((self.doc[1:] == self.doc[:-1]) & (self.pair[:-1] >= 0))
        follows = follows[self.pair_total[self.pair[follows]] > 0]
        self.context[follows + 1] = self.pair[follows]

    def triples(self, shards: int) -> None:
        """The distinct triples of known pairs, in order of their shard, context and word."""
        good = (self.context >= 0) & (self.pair >= 0)
        good[good] = self.pair_total[self.pair[good]] > 0
        self.known_triple = good
        by_number = np.argsort(self.pair_number)
        rank = np.empty(len(by_number), np.int64)
        rank[by_number] = np.arange(len(by_number))
        unique, inverse = np.unique(rank[self.context[good]] * self.words + self.own[good], return_inverse=True)
        context, w = by_number[unique // self.words], unique % self.words
        seen = np.bincount(inverse[self.teach[good]], minlength=len(unique))
        to = _shard(self.pair_number[context], self.number[w], self.pair_total[context], shards)
        order = np.argsort(to, kind="stable")
        self.triple_place = np.empty(len(unique), np.int64)
        self.triple_place[order] = np.arange(len(unique))
        self.triple_inverse, self.triple_shard = inverse, to[order]
        self.triple_context, self.triple_w, self.triple_seen = context[order], w[order], seen[order]

    def triple_answers(self, rows: pd.DataFrame) -> None:
        """Take the corpus counts of the triples."""
        self.triple_total = np.zeros(len(self.triple_shard), np.int64)
        begin, rows = _begins(self.triple_shard), rows[rows["kind"] == _TRIPLES]
        for shard, total in zip(rows["n"], rows["a"], strict=True):
            total = unpack(total)
            self.triple_total[begin[int(shard)] : begin[int(shard)] + len(total)] = total

    def model(self, n: int, v: int, rest: np.ndarray, rest3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of every token: base and model."""
        one = (self.total + 0.5) / (n + 0.5 * (v + 1))
        base = np.log10(one)[self.own]
        after = self.total[self.before]
        model = base + np.where(after > 0, np.log10(np.maximum(rest[_level(after)], 1e-12)), 0.0)
        count = self.total[self.v]
        share = rest[_level(count)]
        two = (1 - share) * self.pair_total / np.maximum(count, 1) + share * one[self.w]
        model[self.known_pair] = np.log10(two)[self.pair[self.known_pair]]
        known = self.context >= 0
        model[known] += np.log10(np.maximum(rest3[_level(self.pair_total[self.context[known]])], 1e-12))
        count = self.pair_total[self.triple_context]
        share = rest3[_level(count)][self.triple_place[self.triple_inverse]]
        seen = (self.triple_total / np.maximum(count, 1))[self.triple_place[self.triple_inverse]]
        model[self.known_triple] = np.log10((1 - share) * seen + share * two[self.pair[self.known_triple]])
        return base, model


def _shard(context: np.ndarray, word: np.ndarray, total: np.ndarray, shards: int) -> np.ndarray:
    salt = mix(word.astype(np.uint64)) % (total // HOT_CONTEXT + 1).astype(np.uint64)
    return (mix(context.astype(np.uint64) * np.uint64(0x9E3779B1) + salt) % np.uint64(shards)).astype(np.int64)


def _begins(shard: np.ndarray) -> dict[int, int]:
    starts = run_starts(shard)
    return dict(zip(shard[starts].tolist(), starts.tolist(), strict=True))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _KIND.split(", ")])


def _level(total: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64), _LEVELS - 1)


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Texts are lower-cased in A-Z; tokens are their words at white space and one end. Documents whose
    crc32(doc_id as text) modulo 5 is 1 are held out. base_score is the log10 probability under the
    smoothed unigram, score under the model of ``ORDER`` words. Null and empty texts are an end alone. Rows with a null
    doc_id have a null held_out and teach nothing; repeated rows teach and score each on their own.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    known = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    blocks = partitions(spark, known, BLOCK_BYTES)
    shards = blocks
    place = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), place.alias("bucket"))

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Texts of one block that lie in one batch as one row of bytes."""
        for batch in batches:
            out = []
            for bucket, rows in batch.groupby("bucket"):
                raw = [encode(t if isinstance(t, str) else None) for t in rows["text"]]
                ids = json.dumps([None if pd.isna(i) else int(i) for i in rows["doc_id"]])
                sizes = pack(np.array([len(t) for t in raw]))
                out.append((int(bucket), ids, sizes, blobs.pack(np.frombuffer(b"".join(raw), np.uint8))))
            yield pd.DataFrame(out, columns=["bucket", "ids", "sizes", "texts"])

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        name = int(rows["bucket"].iloc[0])
        block, words = read_texts(rows, shards)
        out = [
            (shard, name, _WORDS, names.tobytes(), pack(counts), None, None, None, None, None) for shard, names, counts in words
        ]
        return _frame([*out, (name, name, _TOKENS, *block.store(), None, block.end, None)])

    def count_words(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["bucket"].iloc[0])
        rows = rows[rows["kind"] == _WORDS]
        if not len(rows):
            return _frame([])
        words = [np.frombuffer(x, np.uint64) for x in rows["a"]]
        names, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unpack(x) for x in rows["b"]])).astype(np.int64)
        number = np.empty(len(names), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(names)) * shards + shard
        cuts = np.cumsum([0, *map(len, words)])
        out = [
            (int(block), int(block), _WORDS, pack(total[inverse[a:b]]), pack(number[inverse[a:b]]), None, None, None, shard, None)
            for block, a, b in zip(rows["block"], cuts[:-1], cuts[1:], strict=True)
        ]
        return _frame([*out, (-1, -1, _TOTALS, None, None, None, None, None, int(total.sum()), int((total > 0).sum()))])

    def question(shard: int, name: int, kind: int, v: np.ndarray, w: np.ndarray, seen: np.ndarray, count: np.ndarray) -> tuple:
        """A block's questions to a shard, sorted: steps of the context, words (steps inside a context), training counts, and counts of
        the contexts that are spread over shards (0 elsewhere, as there the shard has all of them)."""
        same = np.concatenate([[False], v[1:] == v[:-1]])
        words = np.where(same, w - np.concatenate([[0], w[:-1]]), w)
        hot = np.where(count >= HOT_CONTEXT, count, 0)
        return shard, name, kind, pack(np.diff(v, prepend=0)), pack(words), pack(seen), pack(hot) if hot.any() else None, None, None, None

    def ask_pairs(tokens: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not (tokens["kind"] == _TOKENS).any():
            return _frame([])
        block, name = _Block.of(tokens), int(tokens["bucket"].iloc[0])
        block.answers(answers)
        block.pairs(shards)
        cuts = np.append(run_starts(block.shard), len(block.shard))
        return _frame([
            question(
                int(block.shard[a]), name, _PAIRS, block.number[block.v[a:b]], block.number[block.w[a:b]], block.seen[a:b], block.total[block.v[a:b]]
            )
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ])

    def ask_triples(tokens: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not (tokens["kind"] == _TOKENS).any():
            return _frame([])
        block, name = _Block.of(tokens), int(tokens["bucket"].iloc[0])
        block.answers(answers)
        block.pairs(shards)
        block.pair_answers(answers, shards)
        block.triples(shards)
        cuts = np.append(run_starts(block.triple_shard), len(block.triple_shard))
        return _frame([
            question(
                int(block.triple_shard[a]), name, _TRIPLES, block.pair_number[block.triple_context[a:b]], block.number[block.triple_w[a:b]],
                block.triple_seen[a:b], block.pair_total[block.triple_context[a:b]],
            )
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ])

    def asked(row: tuple) -> tuple[np.ndarray, ...]:
        """Context, word, training count and, for spread contexts, count of the context of a block's questions."""
        v, w, seen = map(unpack, row[:3])
        starts = run_starts(np.cumsum(v))
        v, sums = np.cumsum(v), np.cumsum(w)
        w = sums - np.repeat(sums[starts] - w[starts], np.diff(np.append(starts, len(v))))
        return v, w, seen, np.zeros(len(v), np.int64) if row[3] is None else unpack(row[3])

    def gathered(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Distinct pairs or triples in order with their counts and their contexts', which of them each question is, and where each block's questions begin."""
        parts = [asked(x) for x in zip(*(rows[k] for k in "abcd"), strict=True)]
        v, w, seen, hot = map(np.concatenate, zip(*parts, strict=True))
        width = int(w.max()) + 1
        order = np.argsort(v * width + w) if int(v.max()) + 1 < (1 << 63) // width else np.lexsort((w, v))
        new = np.concatenate([[True], (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])])
        which = np.empty(len(v), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        v, w, hot, total = v[first], w[first], hot[first], np.bincount(which, seen).astype(np.int64)
        starts = run_starts(v)
        # whatever follows a context follows it in training too, so its count is the sum over its words
        count = np.repeat(np.add.reduceat(total, starts), np.diff(np.append(starts, len(v))))
        return v, w, which, total, np.where(hot > 0, hot, count), np.cumsum([0, *(len(x[0]) for x in parts)])

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        """What the shards that answered into this bucket say on each power of two of a context's count: pairs (or triples) seen once, and occurrences."""
        rows = rows[rows["kind"] == _LEVEL]
        levels = [(np.arange(_LEVELS), unpack(a), unpack(b)) for a, b in zip(rows["a"], rows["b"], strict=True)]
        return pd.concat([pd.DataFrame(dict(zip(("level", "once", "all"), x, strict=True))) for x in levels] or [pd.DataFrame(columns=["level", "once", "all"])])

    def look_up(rows: pd.DataFrame) -> pd.DataFrame:
        v, w, which, seen, count, cuts = gathered(rows)
        kind, shard = int(rows["kind"].iloc[0]), int(rows["bucket"].iloc[0])
        there = seen > 0
        counts, codes = np.unique(seen[there], return_inverse=True)
        found, hit = BigramTrie(v[there], w[there], codes.astype(np.min_scalar_type(len(counts)))).lookup(v, w)
        total = np.zeros(len(v), np.int64)
        total[hit] = counts[found[hit]]
        total, number = total[which], (np.cumsum(there) - 1)[which]
        level = _level(count)
        once, every = (np.bincount(level, x, _LEVELS).astype(np.int64) for x in (seen == 1, seen))
        out = [(shard, -1, _LEVEL, pack(once), pack(every), None, None, None, None, None)]
        for block, a, b in zip(rows["block"], cuts[:-1], cuts[1:], strict=True):
            steps = pack(np.diff(number[a:b][total[a:b] > 0], prepend=0)) if kind == _PAIRS else None
            out.append((int(block), int(block), kind, pack(total[a:b]), steps, None, None, None, shard, None))
        return _frame(out)

    def score(tokens: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not (tokens["kind"] == _TOKENS).any():
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        block = _Block.of(tokens)
        n, v = int(answers["all_n"].iloc[0]), int(answers["all_v"].iloc[0])
        rest, rest3 = (np.array(answers[k].iloc[0]) for k in ("rest", "rest3"))
        block.answers(answers)
        block.pairs(shards)
        block.pair_answers(answers, shards)
        block.triples(shards)
        block.triple_answers(answers)
        base, model = block.model(n, v, rest, rest3)
        count = len(block.ids)
        return pd.DataFrame({
            "doc_id": pd.array(block.ids, "Int64"), "held_out": pd.array([held_out(i) for i in block.ids], "boolean"),
            "n_tokens": block.sizes, "n_known": np.bincount(block.doc, block.total[block.own] > 0, count).astype(np.int64),
            "train_tokens": n, "base_score": np.bincount(block.doc, base, count), "score": np.bincount(block.doc, model, count),
        })

    def shares(found: DataFrame, name: str) -> DataFrame:
        """One row: the share of unseen pairs or triples for each of 64 levels."""
        levels = found.groupBy("bucket").applyInPandas(spread, "level int, once double, all double")
        share = F.when(F.sum("all") > 0, F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.sum("once") / F.sum("all")))).otherwise(1.0)
        row = levels.groupBy("level").agg(share.alias("share")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("level", "share"))), lambda x: x["share"]).alias(name)
        )
        return F.broadcast(row.select(F.when(F.size(name) > 0, F.col(name)).otherwise(F.array_repeat(F.lit(1.0), _LEVELS)).alias(name)))

    packed = texts.mapInPandas(compress, "bucket int, ids string, sizes binary, texts binary").repartition(blocks, "bucket")
    # words and tokens go through one exchange, so that texts are read once
    by_block = packed.groupBy("bucket").applyInPandas(ask, _KIND).repartition(shards, "bucket").groupBy("bucket")
    words = by_block.applyInPandas(count_words, _KIND)
    totals = words.filter(F.col("kind") == _TOTALS).agg(F.sum("n").alias("all_n"), F.sum("v").alias("all_v"))
    answers = words.filter(F.col("kind") == _WORDS).repartition(blocks, "bucket")
    pairs = by_block.cogroup(answers.groupBy("bucket")).applyInPandas(ask_pairs, _KIND).repartition(shards, "bucket")
    found = pairs.groupBy("bucket").applyInPandas(look_up, _KIND).repartition(blocks, "bucket")
    known_pairs = answers.unionByName(found)
    triples = by_block.cogroup(known_pairs.groupBy("bucket")).applyInPandas(ask_triples, _KIND).repartition(shards, "bucket")
    found3 = triples.groupBy("bucket").applyInPandas(look_up, _KIND).repartition(blocks, "bucket")
    model = totals.crossJoin(shares(found, "rest")).crossJoin(shares(found3, "rest3"))
    back = known_pairs.unionByName(found3).crossJoin(F.broadcast(model))
    return by_block.cogroup(back.groupBy("bucket")).applyInPandas(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
