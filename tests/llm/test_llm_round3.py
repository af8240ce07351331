"""Cover anchors, spelling variants and the Merkle manifest against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterspark.llm import cover_anchors, merkle, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, word string, tree string, h string, kept string"
LONG = " ".join(f"w{i % 997}x{i // 7}" for i in range(30_000))
RNG = random.Random(4)
BASE = [RNG.choice("abcdefghij") + str(RNG.randrange(40)) for _ in range(60)]


def _row(i, text, source="s"):
    return (i, text, None if i == 4 else "en", source, None, *["clash"] * 5)


ROWS = [
    _row(1, None), _row(2, ""), _row(3, " \n\t", None), _row(4, "one two", None), _row(5, " ".join(BASE)), _row(6, " ".join(BASE), "t"),
    _row(7, " ".join([*BASE[:30], "edit", *BASE[31:]])), _row(8, LONG, "t"), _row(8, LONG, "t"), _row(8, "other words", "t"),
    _row(None, " ".join(BASE), None), _row(None, None), _row(9, "ß" * 300 + " Ünder under", "u"), _row(10, "a b " * 50), _row(10, "a b " * 50),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _order(rows):
    """Documents by id, null last; ties in an order that does not matter where their texts are equal or alone."""
    return sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or "", i))


def _brute_repeats(rows, length):
    seen, out = set(), Counter()
    for i in _order(rows):
        words = (rows[i][1] or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            key = tuple(words[s : s + length])
            if key in seen:
                gone[s : s + length] = [True] * length
            seen.add(key)
        out[rows[i][0], len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()] += 1
    return out


def _found(frame):
    return Counter((r.doc_id, r.n_words, sum(s["length"] for s in r.spans), r.kept) for r in frame.collect())


def test_cover():
    assert cover_anchors.is_difference_cover(cover_anchors.COVER, cover_anchors.PERIOD)
    assert not cover_anchors.is_difference_cover((0, 1), 7)
    with pytest.raises(ValueError):
        cover_anchors.remove_repeated_words(None, 20, (0, 1), 7)


def test_repeated_words_on_awkward_rows(docs, none):
    assert _found(cover_anchors.remove_repeated_words(docs)) == _brute_repeats([(r[0], r[1]) for r in ROWS], 20)
    carried = cover_anchors.remove_repeated_words(docs, carry=["bucket", "kept"]).collect()
    assert len(carried) == len(ROWS) and all(r.carried.bucket == r.carried.kept == "clash" for r in carried)
    assert cover_anchors.remove_repeated_words(none).collect() == []


@pytest.mark.parametrize(("block_bytes", "length"), [(400, 20), (cover_anchors.BLOCK_BYTES, 20), (900, 9)])
def test_repeated_words_by_brute_force(spark, monkeypatch, block_bytes, length):
    """Copies at all offsets, first occurrences that change inside a match, runs in one text; many blocks and one."""
    monkeypatch.setattr(cover_anchors, "BLOCK_BYTES", block_bytes)
    rng = random.Random(block_bytes + length)
    pool = [[rng.choice("abcdef") + str(rng.randrange(9)) for _ in range(rng.choice([8, 19, 20, 21, 40, 70]))] for _ in range(10)]
    rows = []
    for i in range(90):
        words = []
        for _ in range(rng.randrange(5)):
            part = rng.choice(pool)
            a = rng.randrange(len(part))
            words += part[a : a + rng.randrange(5, 60)] if rng.random() < 0.7 else [rng.choice("xyz") for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(words)))
    rows.append((90, "x y " * 60))
    got = _found(cover_anchors.remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), length))
    want = _brute_repeats(rows, length)
    assert got == want and sum(k[2] for k in want) > 300


def _brute_variants(rows, slip, min_length=6, min_count=5, ratio=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{run}".encode())
            if slip and i is not None and h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_length and c >= min_count}

    def edits(w):
        for k in range(len(w) + 1):
            for c in map(chr, spelling.LETTERS):
                yield w[:k] + c + w[k:]
                if k < len(w):
                    yield w[:k] + c + w[k + 1 :]
            yield w[:k] + w[k + 1 :]

    near = {w: {x for x in edits(w) if x in n and x != w} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], form[w], n[form[w]] if form[w] else None, len(near[w]), root)
    return out


def _variants(frame):
    return {r.word: (r.n, r.form, r.form_n, r.n_near, r.root) for r in frame.collect()}


@pytest.mark.parametrize(("slip", "filter_bytes"), [(None, spelling.FILTER_BYTES), (7, spelling.FILTER_BYTES), (7, 64)])
def test_variants_by_brute_force(spark, slip, filter_bytes):
    """Chains of forms, ties, doubled letters, letters beyond ASCII; filters so small that most probes pass change nothing."""
    rng = random.Random(6)
    stems = ["alpine", "aalpine", "alpinne", "glacier", "glaciers", "gläcier", "GLACIER", "rivers", "rivér×", "mountain", "mountains", "xyzzyx"]
    words = []
    for k, stem in enumerate(stems):
        words += [stem] * (5 * 6 ** (k % 4))
        for _ in range(3):
            at = rng.randrange(len(stem))
            words += [stem[:at] + rng.choice("aeß") + stem[at + 1 :]] * rng.randrange(3, 9)
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40]) + ". 123 short") for i in range(40)] + [(40, None), (None, "glacier glacier"), (41, "q" * 3000)] * 5
    got = _variants(spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"), slip=slip, filter_bytes=filter_bytes))
    want = _brute_variants(rows, slip)
    assert got == want and max(len(w) for w in want) >= (2999 if slip else 3000)
    assert any(v[1] and v[4] != v[1] for v in want.values()), "no chain of forms"


def test_variants_on_awkward_rows(docs, none):
    got = _variants(spelling.group_variants(docs, min_length=1, min_count=1))
    assert got == _brute_variants([(r[0], r[1]) for r in ROWS], None, 1, 1)
    assert spelling.group_variants(none).collect() == []
    with pytest.raises(ValueError):
        spelling.group_variants(docs, ratio=1)


def test_filters_miss_nothing_and_edits_hash_alike():
    words = pd.Series(["banana", "bananas", "ananas", "çedilla", "x"])
    shards = spelling.LengthShards.sized(Counter(map(len, words)), 16, 1 << 20)
    for length, _, letters in spelling._by_length(words):
        block, bits = shards.set_bits(length, spelling.EditHashes(letters).whole)
        np.bitwise_or.at(shards.bits, block, bits)
    found = {(words[i], e) for rows, edits in spelling.candidates(words, shards) for i, e in zip(rows, edits, strict=True)}
    assert {("bananas", "banana"), ("bananas", "ananas")} <= found
    one = spelling.EditHashes(np.frombuffer(b"banana", np.uint8).reshape(1, -1))
    other = spelling.EditHashes(np.frombuffer(b"baaana", np.uint8).reshape(1, -1))
    less = spelling.EditHashes(np.frombuffer(b"baana", np.uint8).reshape(1, -1))
    zero, two = np.array([0]), np.array([2])
    assert one.replaced(zero, two, ord("a"))[0] == other.whole[0] and one.deleted(zero, two)[0] == less.whole[0]


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _brute_tree(leaves, fanout):
    """(root, siblings of each leaf level by level as (left, right))."""
    nodes, members, proofs = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        above, held = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for k in range(len(run)):
                for i in members[a + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(_sha(*run))
            held.append([i for m in members[a : a + fanout] for i in m])
        nodes, members = above, held
    return nodes[0], proofs


def _brute_manifest(rows, fanout):
    """rows: (group, key, leaf). Gives a Counter of (group, key, leaf, subroot, root, proof)."""
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in groups:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees.append((own, *_brute_tree([r[2] for r in own], fanout)))
    root, upper = _brute_tree([t[1] for t in trees], fanout)
    return Counter(
        (*r, sub, root, tuple(p + up)) for (own, sub, proofs), up in zip(trees, upper, strict=True) for r, p in zip(own, proofs, strict=True)
    )


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_by_brute_force(spark, fanout):
    rng = random.Random(fanout)
    sizes = {None: 1, "": 2, "a": 1, "é": 17, "zz": 40, "Z": 3} | {f"s{k}": 1 for k in range(15)}
    rows = [(g, rng.choice([None, *range(-5, 60)]), f"{rng.randrange(50):02d}") for g, n in sizes.items() for _ in range(n)]
    frame = spark.createDataFrame(rows, "source string, doc_id long, leaf string").repartition(5)
    found = merkle.prove(frame, F.col("leaf"), fanout=fanout)
    rows_ = found.withColumn("ok", merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).collect()
    assert all(r.ok for r in rows_)
    got = Counter((r.row_group, r.row_key, r.leaf, r.subroot, r.root, tuple((s["left"], s["right"]) for s in r.proof)) for r in rows_)
    assert got == _brute_manifest(rows, fanout)


def test_tampered_rows_fail(docs, none):
    upper = F.col("text").rlike("[A-Z]")
    changed = {"text": merkle.ascii_lower(F.col("text"))}
    rows = merkle.verify(docs, changed, F.col("text").isNotNull()).collect()
    assert len(rows) == len(ROWS) and all(r.verified for r in rows), "no text holds A-Z, so nothing changes"
    shout = docs.withColumn("text", F.when(F.col("doc_id") == 5, F.upper("text")).otherwise(F.col("text")))
    rows = merkle.verify(shout, changed, upper).collect()
    assert [r.row_key for r in rows if not r.verified] == [5]
    want = Counter()
    for i, text, lang, source, n, *_ in ROWS:
        fields = [i, source, lang, n, text.upper() if i == 5 else text]
        want[_sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))] += 1
    assert Counter(r.leaf for r in rows) == want
    assert all(r.proof_sha256 == _sha(*(s["left"] + s["right"] for s in r.proof)) for r in rows)
    assert merkle.verify(none, changed, upper).collect() == []
    lone = merkle.verify(docs.filter("doc_id = 4"), changed, upper).collect()
    assert len(lone) == 1 and lone[0].leaf == lone[0].subroot == lone[0].root == lone[0].folded_root and lone[0].proof == []
