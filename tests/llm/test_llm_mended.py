"""Suffix order, page markup, license wordings, clashing names and empty tables."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark.llm import decontaminate, html_content, licenses, mixture, quality, queries, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("of_doc", "of_text", "gone", "of_source", "__text", "__lang", "N_Words", "Size", "target", "place", "node", "rep", "fingerprint", "carried")


@pytest.mark.parametrize("alphabet", [b"ab", b"a", bytes(range(256)), b"the cat\xc3\xa9"])
def test_suffix_order_by_brute_force(alphabet):
    rng = random.Random(len(alphabet))
    pieces = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(20)]
    pieces += [pieces[0][:7] + p for p in pieces[:6]] + pieces[:3]
    bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
    data = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
    # symbols of one alphabet: terminators first, by piece
    symbols = [x for k, p in enumerate(pieces) for x in [*((1, c) for c in p), (0, k)]]
    order, place = suffix_dedup.RunLengthIndex._suffixes(data, bounds)
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    assert (place[order] == np.arange(len(order))).all()


def _model():
    return html_content.TreeModel({}, {})


def _text(page):
    return html_content.extract(page, _model())[0]


def test_links_comments_and_attributes_in_an_article():
    readers = "".join(f"<div class=c><p>Reader {i} writes a long remark about all of the above, and then some.</p></div>" for i in range(60))
    page = (
        "<body class='has-sidebar'><nav><ul><li><a href=/m>Menu</a></ul></nav><article><h1>Head</h1><p>Opening words of it.</p>"
        "<ul><li><a href=/1>First linked item</a><li><a href=/2>Second linked item</a></ul>"
        f"<div class='comment-list'>{readers}</div><p>The <a title=it's href=x>owner's</a> last words.</p></article><footer>Foot</footer>"
    )
    assert _text(page) == "Head\nOpening words of it.\nFirst linked item\nSecond linked item\nThe owner's last words."
    assert _text("<article><p title=\"a > b\" data-x='<p>'>kept</p><aside>not</aside></article>") == "kept"
    assert _text("<article><p>one</p><article class=comment><p>remark</p></article><p>two</p></article>") == "one\ntwo"


def test_hostile_nesting_is_linear():
    def took(n):
        begin = time.perf_counter()
        html_content.parse("<b>" * n + "</i></p>" * n)
        return time.perf_counter() - begin

    took(1000)
    assert took(32_000) < 12 * max(took(8_000), 0.01)


def test_pages_without_article_markup(spark, sf_dir):
    """The same pages with plain elements for their articles, by the model of the marked ones."""
    pages = queries.table(spark, sf_dir, "pages").filter("html is not null")
    model = html_content.train(pages)
    for r in pages.collect():
        plain = re.sub(r"<(/?)article>", r"<\1div>", r.html)
        assert "<div>" in plain and html_content.extract(plain, model)[0] == html_content.extract(r.html, model)[0]


def test_versions_and_qualifiers_make_another_license():
    known = {k: (t, *([licenses.WORDINGS[k]] if k in licenses.WORDINGS else [])) for k, t in licenses.TEMPLATES.items()}
    scan = licenses.Scanner(known).scan
    names = lambda text: [f["license"] for f in scan(text)]
    assert names("Licensed under the Apache License, Version 1.1.") == [None]
    assert names("This work is licensed under the GNU General Public License, version 2.") == [None]
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == [None]
    assert names("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.") == [None]
    assert names("Released under the BSD License.") == [None]
    assert names("/* Licensed under the Apache License,\n * Version 2.0 (the \"License\") */") == ["Apache-2.0"]
    assert set(names(" * ".join(licenses.WORDINGS["MIT"].partition("obtaining")))) == {"MIT"}
    assert set(names(licenses.WORDINGS["GPL-3.0"].replace(": you", "; you"))) == {"GPL-3.0"}
    assert set(names(licenses.WORDINGS["GPL-3.0"].replace("version 3", "version 2"))) == {None}


def test_templates_without_a_cue_word():
    scan = licenses.Scanner({"house": "Take it and do what pleases you, just keep our names on it."}).scan
    assert [(f["line"], f["license"]) for f in scan("x\ntake it and do what pleases you, just keep our names on it\ny")] == [(1, "house")]
    assert scan("take it or leave it") == []


def test_licenses_by_brute_force():
    """One edited notice a text: found exactly where some stretch of words is near enough and tells the same license."""
    rng, scanner = random.Random(5), licenses.Scanner(licenses.TEMPLATES)
    prose = "the river and of a house under old work in stone light 2.0 license apache nc version".split()

    def confirmed(words, name):
        n, spare = len(scanner.words[name]), scanner.spare[name]
        for a in range(len(words)):
            for b in range(a + n - spare, min(a + n + spare, len(words)) + 1):
                changes = scanner.changes(words[a:b], name)
                telling = any(c[1:] in (scanner.telling[name] if c[0] == "-" else scanner.names) or c[0] == "+" and re.search("[0-9]", c) for c in changes)
                if len(changes) <= spare and not telling:
                    return True
        return False

    hits = 0
    for _ in range(120):
        name = rng.choice([k for k in scanner.words if len(scanner.words[k]) > 4])
        words = list(scanner.words[name])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(1, len(words) - 1)
            words[at : at + rng.randrange(2)] = rng.sample(prose, rng.randrange(2))
        text = [*rng.sample(prose[:11], 5), *words, *rng.sample(prose[:11], 5)]
        found = {f["license"] for f in scanner.scan(" ".join(text))} - {None}
        want = {k[0] for k in scanner.words if confirmed(text, k)}
        assert found == want, (" ".join(text), found, want)
        hits += bool(found)
    assert 30 < hits < 110


@pytest.fixture(scope="module")
def clashing(spark):
    plain = spark.createDataFrame([(i, f"Some plain words of document {i} that say this and that", "en", "s", None) for i in range(4)], DOCS)
    return plain.select("*", *(F.lit("own").alias(c) for c in CLASHES))


def test_clashing_names(spark, clashing):
    items = spark.createDataFrame([(1, "plain words of document 2 that")], "item_id long, text string")
    left = decontaminate.decontaminate(clashing, items)
    assert left.columns == clashing.columns and {r.doc_id for r in left.collect()} == {0, 1, 3}
    assert {r.text for r in decontaminate.remove_spans(clashing, items).filter("doc_id = 2").collect()} == {"some say this and that"}
    mixed = mixture.mix_sources(clashing)
    assert mixed.columns.count("of_source") == 1 and {r.of_source for r in mixed.collect()} == {"own"}
    judged = quality.judge(clashing, keep_columns=True).collect()
    assert {r["__text"] for r in judged} == {r["__lang"] for r in judged} == {"own"} and {r.n_words for r in judged} == {11}
    assert quality.keep_good(clashing).columns[:5] == clashing.columns[:5]


def test_stages_on_clashing_names_and_empty_tables(spark, clashing, sf_dir):
    import corpus_pipeline as cp

    none = spark.createDataFrame([], DOCS)
    for name, stage in cp.STAGES:
        out = stage(spark, none, sf_dir)
        assert out.collect() == [] and (name == "source_mixture" or out.columns == none.columns), name
    twice = clashing.drop("N_Words").unionAll(clashing.drop("N_Words").filter("doc_id = 3"))
    kept = cp.near_duplicates(spark, twice, sf_dir)
    assert kept.columns == twice.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 3]  # rows of one doc_id stay together
    mixed = cp.source_mixture(spark, clashing, sf_dir)
    assert mixed.columns == ["doc_id", "lang", "source", "repetition", "text"]
    want = {r.doc_id: r.taken for r in mixture.mix_sources(clashing).collect()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(mixture.WORD, r.text))
    assert got == {k: v for k, v in want.items() if v}
