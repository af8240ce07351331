"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from rasterspark.llm import (
    decontaminate, html_content, licenses, lm_scoring, mixture, ngram_join, quality, revisits, suffix_dedup, toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, component_id long, n string, size string, kept string"
LONG = " ".join(f"w{i % 997}x{i // 7}" for i in range(30_000))
RNG = random.Random(11)
BASE = [RNG.choice("abcdefghij") + str(RNG.randrange(40)) for _ in range(80)]


def _row(i, text, source="s"):
    return (i, text, "en" if i != 4 else None, source, None, "clash", 7, "clash", "clash", "clash")


ROWS = [
    _row(1, None), _row(2, ""), _row(3, " \n\t"), _row(4, "one two", None), _row(5, "ONE two", None), _row(6, " ".join(BASE)),
    _row(7, " ".join(BASE)), _row(8, " ".join([*BASE[:40], "edit", *BASE[41:]]), "t"), _row(9, LONG, "t"), _row(9, LONG, "t"),
    _row(10, "ß" * 300, None), _row(None, "lone words here"), _row(None, None), _row(11, "x" * 250),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_join(docs, none):
    rows = ngram_join.similar_documents(docs).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(ROWS)
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[5] == (1, 4)  # equal once lower-cased
    assert got[6][1] == got[7][1] == got[8][1] == 6 and got[9][1] == 9
    assert got[None][1] is None
    assert ngram_join.similar_documents(none).collect() == []


def test_light_sets_never_link_wrongly():
    for n in range(1, 30):
        for m in range(1, 30):
            c = ngram_join.least_common(n, m, 80)
            assert 100 * c >= 80 * (n + m - c) and 100 * (c - 1) < 80 * (n + m - c + 1)
    assert ngram_join.choose_boundary({}, 80) >= 1


def test_repeats(docs, none):
    rows = suffix_dedup.remove_repeats(docs, carry=["bucket"]).collect()
    assert len(rows) == len(ROWS) and all(r.carried.bucket == "clash" for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_bytes == 0 and bytes(by[2][0].kept) == b""
    assert len(by[7][0].kept) == 0 and bytes(by[6][0].kept) == ROWS[5][1].encode()
    assert sorted(len(r.kept) for r in by[9])[0] == 0  # the second of two equal rows
    assert len(by[10][0].kept) == 2 and len(by[11][0].kept) == 1
    assert suffix_dedup.remove_repeats(none).collect() == []


@pytest.mark.parametrize("hot", [1, suffix_dedup.HOT_SNIPPETS])
def test_repeats_by_brute_force(spark, hot):
    rng = random.Random(3)
    pool = ["".join(rng.choice("abc dé") for _ in range(rng.choice([30, 80, 120, 300]))) for _ in range(12)]
    part = lambda: rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(90)))
    rows = [(i, "".join(part() for _ in range(rng.randrange(6)))) for i in range(60)] + [(60, "ab" * 300)]
    seen, want = set(), {}
    for i, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        want[i] = bytes(x for x, g in zip(data, gone, strict=True) if not g)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == want


def test_quality(docs, none):
    rows = quality.judge(docs, keep_columns=True).collect()
    assert len(rows) == len(ROWS) and all(r.bucket == "clash" for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == 0 and by[1].base_failed and by[1].kept is False
    assert by[9].n_words == 30_000 and by[9].base_failed is False
    assert quality.judge(none).collect() == []
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_of_many_languages(spark):
    rng, rows = random.Random(5), []
    for k in range(66):  # words of its own for each language, the 66th in other letters and below the least size of a reference
        first = 0x4E00 + 40 * k if k == 65 else 0x61
        words = [f"{chr(first + k % 26)}{chr(first + k // 26)}{chr(first + i % 26)}{chr(first + i // 26)}" for i in range(40)]
        for j in range(2 if k == 65 else 12):
            rows.append((100 * k + j, " ".join(rng.choices(words, k=200 + 10 * (k < 64))), f"l{k:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r["lang"] for r in quality.language_references(docs)] == [f"l{k:02}" for k in range(65)]
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(r.kept for r in got.values())
    assert got[6400].word_distance < 0.45  # the 65th language by size is held against its own reference
    assert got[6500].class_distance is None and got[6500].word_distance is None
    stray = spark.createDataFrame([(9000, rows[-1][1], "l00"), (9001, rows[-1][1], None)], docs.schema)
    assert {r.doc_id: r.kept for r in quality.judge(docs.unionByName(stray)).collect() if r.doc_id >= 9000} == {9000: False, 9001: False}


def test_repeated_words_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(40))]
        runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hit = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(8)}
        assert quality.repeated_words(words, 8) == len(hit)


def test_mixture(docs, none):
    rows = mixture.mix_sources(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.whole * r.size + r.part
    sources = {r.source: (r.source_size, r.target) for r in rows}
    assert sum(t for _, t in sources.values()) == pytest.approx(sum(s for s, _ in sources.values()))
    for s, (size, target) in sources.items():
        assert target <= 3 * size
        assert abs(sum(r.taken for r in rows if r.source == s) - target) <= len(rows)
    assert rows == mixture.mix_sources(docs).collect() or sorted(map(repr, rows)) == sorted(map(repr, mixture.mix_sources(docs).collect()))
    again = mixture.repetitions(mixture.mix_sources(docs)).collect()
    assert sum(len(re.findall(mixture.WORD, r.text)) for r in again) == sum(r.taken for r in rows)
    assert mixture.mix_sources(none).collect() == []


def test_decontamination(spark, docs, none):
    words = [f"q{i}" for i in range(40)]
    items = spark.createDataFrame(
        [(1, " ".join(words[:20])), (2, "tiny item"), (3, None), (4, "..."), (5, " ".join(words[:20]))], "item_id long, text string"
    )
    texts = spark.createDataFrame(
        [(1, "a b " + " ".join(words[3:17]).upper() + " c"), (2, " ".join(words[5:17])), (3, "x tiny, ITEM y"), (4, None), (4, None),
         (None, "tiny item")], "doc_id long, text string",
    )
    rows = decontaminate.contamination(texts, items).collect()
    assert len(rows) == 6
    got = {r.doc_id: ([tuple(s) for s in r.spans], r["items"]) for r in rows}
    assert got[1] == ([(2, 16)], ["1", "5"]) and got[2] == ([], []) and got[3] == ([(1, 3)], ["2"]) and got[4] == ([], [])
    assert got[None] == ([(0, 2)], ["2"])
    assert {r.doc_id for r in decontaminate.decontaminate(texts, items).collect()} == {2, 4}
    assert {r.doc_id: r.text for r in decontaminate.remove_spans(texts, items).collect()}[3] == "x y"
    assert decontaminate.contamination(none, items).collect() == []
    assert len(decontaminate.contamination(docs, items.limit(0)).collect()) == len(ROWS)


def test_toxicity(spark, docs, none):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice(["sun", "moon", "tree", "river", "stone"]) for _ in range(30))
    rows = [(i, plain() + (f". you are a grobl{i % 3} fool." if i % 4 == 0 else ".")) for i in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = toxicity.score(texts, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    matcher = toxicity.Matcher({})
    event = lambda t: dict(zip(toxicity.EVENTS, matcher.events(t), strict=True))
    assert event("you idiot")["targeted"] == 1 and event("what an idiot")["insult"] == 1
    assert event("you are not an idiot")["negated"] == 1 and event("he said idiot")["reported"] == 1
    assert event("i will kill you")["threat_target"] == 1 and event("skills")["clauses"] == 0
    edge = toxicity.score(docs, labels).collect()
    assert len(edge) == len(ROWS) and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.score(none, labels).collect() == [] and all(r.score == 0 for r in toxicity.score(docs, labels.limit(0)).collect())


def test_toxicity_reads_whole_clauses():
    matcher = toxicity.Matcher({})
    event = lambda t: dict(zip(toxicity.EVENTS, matcher.events(t), strict=True))
    for fill in (10, 400, 5000):
        far = "river " * fill
        assert event(f"you {far}idiot")["targeted"] == 1 and event(f"she. he said {far}idiot")["reported"] == 1
        assert event(f"said you. {far}idiot")["insult"] == 1 and event(f"idiot {far}. you {far}moron")["clauses"] == 2


def test_revisits(spark):
    from datetime import datetime

    at = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [
        (1, "response", "http://A.org:80/x/?b=2&a=1&utm_source=z#f", at(1), {"etag": '"v1"', "server": "s"}, "one"),
        (2, "response", "https://a.org/x?a=1&b=2", at(3), {"etag": '"v2"', "date": "old"}, "two"),
        (3, "revisit", "http://a.org/x?a=1&b=2", at(2), {"etag": 'W/"v1"', "date": "new", "server": "t"}, None),
        (4, "revisit", "http://a.org/x?a=1&b=2", at(3), {"etag": '"v2"'}, None), (5, "revisit", "http://a.org/x?b=2&a=1", at(3, 1), {"etag": '"v2"'}, None),
        (5, "revisit", "http://a.org/x?b=2&a=1", at(3, 1), {"etag": '"v2"'}, None), (6, "revisit", "http://b.org", at(3), None, None),
        (7, "revisit", None, None, None, None), (8, "revisit", "http://a.org/x?a=1&b=2", at(9), None, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, type string, url string, at timestamp, headers map<string,string>, payload string")
    found = revisits.resolve_revisits(records).collect()
    got = {r.record_id: (r.status, r.response_id, r.payload) for r in found}
    assert len(found) == 7
    assert got[3] == ("resolved", 1, "one") and got[4] == ("changed", 1, None) and got[5] == ("resolved", 2, "two")
    assert got[6][0] == got[7][0] == "orphan" and got[8] == ("unchecked", 2, "two")
    assert {r.record_id: r.headers for r in found}[3] == {"etag": 'W/"v1"', "date": "new", "server": "s"}
    assert revisits.resolve_revisits(records.limit(0)).collect() == []


def test_language_model(docs, none):
    rows = lm_scoring.score_documents(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == 1 and by[9].n_tokens == 30_001 and by[None].held_out is None
    assert all(r.score <= 0 and r.base_score <= 0 for r in rows)
    assert by[9].score > by[9].base_score
    assert lm_scoring.score_documents(none).collect() == []


@pytest.mark.parametrize("block_bytes", [300, lm_scoring.BLOCK_BYTES])
def test_language_model_by_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block_bytes)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", f"x{rng.randrange(30)}"]) for _ in range(rng.randrange(40)))) for i in range(60)]
    seqs = {i: ["$", *t.split(), "$"] for i, t in rows}
    one, two, three = Counter(), Counter(), Counter()
    for i, s in seqs.items():
        if not lm_scoring.held_out(i):
            one.update(s[1:])
            two.update(zip(s, s[1:]))
            three.update(zip(s, s[1:], s[2:]))
    def shares(grams, context):  # noqa: E306
        once, every = Counter(), Counter()
        for g, n in grams.items():
            level = context[g[:-1] if len(g) > 2 else g[0]].bit_length()
            once[level] += n == 1
            every[level] += n
        return {k: min(0.98, max(0.02, once[k] / every[k])) for k in every}
    r, s3, n = shares(two, one), shares(three, two), sum(one.values())
    def p2(v, w):  # noqa: E306
        p = (one[w] + 0.5) / (n + 0.5 * (len(one) + 1))
        return p if not one[v] else (1 - r[one[v].bit_length()]) * two[v, w] / one[v] + r[one[v].bit_length()] * p
    def p3(u, v, w):  # noqa: E306
        c = two[u, v]
        return p2(v, w) if not c else (1 - s3[c.bit_length()]) * three[u, v, w] / c + s3[c.bit_length()] * p2(v, w)
    got = {x.doc_id: x for x in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, s in seqs.items():
        want = math.log10(p2(s[0], s[1])) + sum(math.log10(p3(*x)) for x in zip(s, s[1:], s[2:]))
        assert abs(got[i].score - want) <= len(s) * 1.5 / lm_scoring.STEP


def test_language_model_keeps_tokens_in_few_bytes():
    values = np.array([0, 7, 300, 1 << 40])
    assert (lm_scoring.unpack(lm_scoring.pack(values)) == values).all() and len(lm_scoring.unpack(lm_scoring.pack(values[:0]))) == 0
    # 100,000 small numbers travel in less than a byte each; a block's tokens come back as they were
    small = np.random.default_rng(1).integers(0, 16, 100_000)
    assert len(lm_scoring.pack(small)) < 100_000
    block = lm_scoring._Block([4, None], np.array([3, 1]), np.array([2, 0, 1, 1]), 3, 1)
    row = dict(zip("abcd", block.store(), strict=True)) | {"kind": lm_scoring._TOKENS, "n": block.end}
    again = lm_scoring._Block.of(pd.DataFrame([row]))
    assert again.ids == [4, None] and (again.own == block.own).all() and again.end == 1 and (again.teach == block.teach).all()


def test_licenses(spark, docs, none):
    texts = spark.createDataFrame(
        [(1, "a\nreleased under the  MIT license\nb"), (2, "Licensed under the Apache License, Version 2.0."), (3, "my licence to drive"),
         (4, "Released under the BSD License.")], "doc_id long, text string",
    )
    got = {r.doc_id: [f.license for f in r.findings] for r in licenses.scan_licenses(texts).collect()}
    assert got[1] == ["MIT"] and got[2] == ["Apache-2.0"] and got[3] == [None] and got[4] in ([None], ["MIT"])
    assert len(licenses.scan_licenses(docs).collect()) == len(ROWS) and licenses.scan_licenses(none).collect() == []


def test_licenses_anywhere_in_a_text():
    rng, scan = random.Random(2), licenses.Scanner(licenses.TEMPLATES).scan
    prose = lambda n: " ".join(rng.choice("the river and of a house under old work in stone light".split()) for _ in range(n))
    for name, notice in licenses.TEMPLATES.items():
        words = notice.split()
        assert [(f["line"], f["license"]) for f in scan(f"{prose(90)} {notice} {prose(90)}")] == [(0, name)]
        wrapped = "".join(f" * {' '.join(words[i : i + 3])}\n" for i in range(0, len(words), 3))
        assert [(f["line"], f["license"]) for f in scan(f"/*\n{wrapped} */\n{prose(9)}")] == [(1, name)]
        assert [f["license"] for f in scan(f"{prose(9)} {notice.upper()} {prose(9)}")] == [name]
        for other, more in licenses.TEMPLATES.items():
            assert [f["license"] for f in scan(f"{prose(20)} {notice} {more} {prose(20)}")] == [name, other]
        for _ in range(20):  # as many differences as are allowed
            edited, spare = list(words), len(licenses.words_of(notice)) // 5
            for _ in range(spare):
                edited.insert(rng.randrange(1, len(edited)), "river")
            (f,) = scan(f"{prose(rng.randrange(60))} {' '.join(edited)} {prose(rng.randrange(60))}")
            assert f["license"] == name and len(f["changes"]) <= spare
    assert [(f["line"], f["license"]) for f in scan("my licence\nRights\nReserved by us\n")] == [(0, None), (1, None)]


def test_pages(spark):
    page = (
        "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class='ad'>Buy</div>"
        "<article><h1>Head &amp; line</h1><p>First <b>bold</b> words,  with\nspace.<p>Second one.</p></article><div id=comments><p>I disagree</p></div>"
        "<footer>&copy; foot</footer></body></html>"
    )
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page), (4, "w", "< broken <p")], "page_id long, url string, html string")
    got = html_content.extract_pages(pages).collect()
    assert len(got) == 5
    assert [r.text for r in got if r.page_id == 1] == ["Head & line\nFirst bold words, with space.\nSecond one."] * 2
    assert {r.text for r in got if r.page_id in (2, 3)} == {""}
    assert html_content.extract_pages(pages.limit(0)).collect() == []


def test_marginals_are_exact():
    from itertools import product

    import numpy as np

    nodes, _ = html_content.parse("<div class=ad><p>x</p></div><article><p>some words</p><a>link</a></article>")
    model = html_content.TreeModel({("tag:p", True): 5, ("cue:none", True): 9, ("cue:none", False): 7, ("tag:a", False): 3}, {(True, True): 8, (False, False): 6})
    own = np.array([sum((model.node.get(f, np.zeros(2)) for f in fs), np.zeros(2)) for fs in html_content.features(nodes)])
    total, content = 0.0, np.zeros(len(nodes))
    for y in product((0, 1), repeat=len(nodes)):
        w = np.exp(sum(own[i, y[i]] + (model.edge[y[n.parent], y[i]] if n.parent >= 0 else 0) for i, n in enumerate(nodes)))
        total += w
        content += w * np.array(y)
    assert np.allclose(model.marginals(nodes), content / total)


def test_pipeline_stages(spark, docs, sf_dir):
    import corpus_pipeline as cp

    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    assert len(cp.STAGES) == 5 and hashlib.sha256(b"").hexdigest()
