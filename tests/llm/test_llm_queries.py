"""The queries against DuckDB SQL or brute force on the given tables."""

import hashlib
import re
import zlib

import pytest
from check_oracle import connect
from llm_tools import differences

from rasterspark.llm import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, sf_dir, name):
    assert differences(spark, con, name, sf_dir) == []


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def _lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_groups(spark, sf_dir, rows):
    sets, parent = {}, {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and (c := len(sets[i] & sets[j])) and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op7_ngram_join"](spark, sf_dir).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_repeats(spark, sf_dir, rows):
    seen, want = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            h = data[s : s + 100]
            if h in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(h)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        want[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    got = queries.QUERIES["op1_suffix_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_quality_counts(spark, sf_dir, rows):
    got = {r.doc_id: r for r in queries.QUERIES["op9_quality_rules"](spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf_dir, "labels").collect()}
    for i, text in rows:
        text, r = text or "", got[i]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        count = {}
        for x in runs:
            count[x] = count.get(x, 0) + 1
        again = {k + j for k, x in enumerate(runs) if count[x] > 1 for j in range(8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(again) > 30 * len(words))
        assert not (r.kept and r.base_failed)
    good = [i for i, q in labels.items() if q == 1 and i in got and not got[i].base_failed]
    assert sum(got[i].kept for i in good) == len(good)


def test_toxicity_beats_chance(spark, sf_dir):
    got = {r.doc_id: r for r in queries.QUERIES["op2_toxicity"](spark, sf_dir).collect()}
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf_dir, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    wrong = sum(got[i].predicted != t for i, t in labels.items() if i in got)
    assert wrong < sum(t for i, t in labels.items() if i in got)


def test_page_text(spark, sf_dir):
    """Pages of the tables hold one article each, whose text is known from its markup."""
    import html

    from rasterspark.llm import html_content

    truth = {}
    for r in queries.table(spark, sf_dir, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", inner)]
        truth[r.page_id] = "\n".join(b for b in blocks if b)
    got = {r.page_id: r.text for r in html_content.extract_pages(queries.table(spark, sf_dir, "pages")).collect()}
    assert got == truth
