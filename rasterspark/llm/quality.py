"""Quality rules: plain counts, and the divergence of a text from its language.

A text's histogram of character classes and of common words is compared with references of the
languages in the corpus by Jensen-Shannon distance. References come from all documents. Short texts
are guarded: below a minimum length a histogram says nothing and its test is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytewords import encode

CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other", "wide")
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules. The base rules are exact in integers; distances lie between 0 and 1."""

    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    common_words: int = 64
    min_reference_words: int = 2000
    min_class_chars: int = 400
    max_class_distance: float = 0.25
    min_word_words: int = 100
    max_word_distance: float = 0.45


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"))
    for name, members in (
        ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", [32, *range(9, 14)]),
        ("punctuation", b".,;:!?'\"()-"), ("symbol", SYMBOLS), ("wide", range(192, 256)),
    ):
        table[list(members)] = CLASSES.index(name)
    table[128:192] = len(CLASSES)  # later bytes of a character
    return table


_TABLE = _class_table()
_SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def class_counts(data: bytes) -> np.ndarray:
    """Characters of each class."""
    return np.bincount(_TABLE[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside runs of ``window`` words that stand in the text twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    marks = np.fromiter(map(hash, words), np.int64, len(words))
    sums = np.zeros(n, np.int64)
    for i in range(window):
        sums += marks[i : i + n] * (2 * i + 3) ** 7
    sums.sort()
    if (sums[1:] != sums[:-1]).all():  # equal windows have equal sums, so there are none
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    span = 1
    while span < window:  # runs of twice the length, or overlapping ones at the end, by pairs of names
        step = min(span, window - span)
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        _, ids = np.unique(pairs, return_inverse=True)
        span += step
    again = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(again)] += again
    edges[window:] -= again[: len(words) + 1 - window]
    return int((np.cumsum(edges)[: len(words)] > 0).sum())


def plain_counts(data: bytes, rules: Rules) -> tuple[list[bytes], dict[str, int | bool]]:
    """Words of a text and the counts of the base rules."""
    words, codes = data.split(), np.frombuffer(data, np.uint8)
    spaces = int(_SPACES[codes].sum())
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    repeat = repeated_words(words, rules.repeat_window)
    return words, {
        "n_words": len(words), "word_chars": int(((codes & 0xC0) != 0x80).sum()) - spaces, "n_symbols": int(_SYMBOL[codes].sum()),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat,
        "base_failed": len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words),
    }


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances (roots of the divergence in bits) of rows of counts and rows of shares."""
    p = p / p.sum(-1, keepdims=True)
    # of a share x, x * log2(x); the mean's share is never 0 where one of the two isn't
    part = lambda x: x * np.log2(np.where(x > 0, x, 1))
    return np.sqrt(np.maximum((part(p) / 2 + part(q) / 2 - part((p + q) / 2)).sum(-1), 0))


def language_references(docs: DataFrame, rules: Rules = Rules()) -> list[dict]:
    """For each language its class counts, its commonest words with counts, and its words.

    Counted over all documents with a language; words are lower-cased in A-Z. Languages with fewer
    than ``min_reference_words`` words give none, all others do, in order of their names. The references
    are the model and come to the driver: ``common_words`` words for each language.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            rows = [(lang, w.decode("utf-8", "replace"), n) for lang, c in held.items() for w, n in c.items()]
            rows += [(lang, f" {name}", int(n)) for lang, c in classes.items() for name, n in zip(CLASSES, c, strict=True)]
            return pd.DataFrame(rows, columns=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                data = encode(text)
                held.setdefault(lang, Counter()).update(data.lower().split())
                classes[lang] = classes.get(lang, 0) + class_counts(data)
            if sum(map(len, held.values())) > 500_000:
                yield flush()
                held, classes = {}, {}
        yield flush()

    counts = docs.filter("lang is not null and text is not null").select("lang", "text").mapInPandas(
        count, "lang string, word string, n long"
    ).groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(64)))
    is_class = F.col("word").startswith(" ")
    # a language may hold most words: ranked in parts, then the best of the parts
    parts = counts.withColumn("total", F.when(~is_class, F.col("n")))
    local = Window.partitionBy("lang", "salt", is_class).orderBy(F.desc("n"), "word")
    sums = Window.partitionBy("lang", "salt", is_class).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = parts.withColumn("place", F.row_number().over(local)).withColumn("total", F.sum("total").over(sums)).filter(
        F.col("place") <= rules.common_words
    )
    lists = best.groupBy("lang").agg(
        F.sum(F.when(F.col("place") == 1, F.col("total"))).alias("total"),
        F.slice(F.sort_array(F.collect_list(F.when(~is_class, F.struct((-F.col("n")).alias("n"), "word")))), 1, rules.common_words).alias("words"),
        F.map_from_entries(F.collect_list(F.when(is_class, F.struct("word", "n")))).alias("classes"),
    ).filter(F.col("total") >= rules.min_reference_words)
    return [
        {
            "lang": r["lang"], "total": r["total"], "words": {w["word"]: -w["n"] for w in r["words"]},
            "classes": [r["classes"].get(f" {name}", 0) for name in CLASSES],
        }
        for r in sorted(lists.collect(), key=lambda r: r["lang"])
    ]


class _Judge:
    """Distances of a text to all references at once."""

    def __init__(self, references: list[dict], rules: Rules) -> None:
        self.rules = rules
        self.names = {w.encode(): i for i, w in enumerate(sorted({w for r in references for w in r["words"]}))}
        shares = lambda rows: [x / x.sum(-1, keepdims=True) for x in [np.array(rows, float)]][0]
        self.languages = {r["lang"] for r in references}
        if not references:
            return
        self.classes = shares([r["classes"] for r in references])
        width = max(len(r["words"]) for r in references)
        # of each reference its words, a spare name where it has fewer, and the rest of its words
        self.picks = np.full((len(references), width), len(self.names) + 1)
        words = np.zeros((len(references), width + 1))
        for i, r in enumerate(references):
            self.picks[i, : len(r["words"])] = [self.names[w.encode()] for w in r["words"]]
            words[i, : len(r["words"])] = list(r["words"].values())
            words[i, -1] = r["total"] - sum(r["words"].values())
        self.words = shares(words)

    def __call__(self, data: bytes, words: list[bytes], lang: str | None) -> tuple[float | None, float | None, bool]:
        if not self.languages or (isinstance(lang, str) and lang not in self.languages):
            return None, None, True
        rules, classes = self.rules, class_counts(data)
        near = np.ones(len(self.classes), bool)
        by_class = by_word = None
        if classes.sum() >= rules.min_class_chars:
            found = jensen_shannon(classes[None, :], self.classes)
            near &= found <= rules.max_class_distance
            by_class = float(found.min())
        if len(words) >= rules.min_word_words:
            get, other = self.names.get, len(self.names)
            seen = np.bincount([get(w, other) for w in data.lower().split()], minlength=other + 2)
            own = seen[self.picks]
            found = jensen_shannon(np.concatenate([own, len(words) - own.sum(1, keepdims=True)], 1), self.words)
            near &= found <= rules.max_word_distance
            by_word = float(found.min())
        return by_class, by_word, bool(near.any())


_FOUND = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " class_distance double, word_distance double, kept boolean"
)


def judge(docs: DataFrame, rules: Rules = Rules(), keep_columns: bool = False) -> DataFrame:
    """The columns of ``_FOUND`` for every document, after doc_id (or after all columns of ``docs``).

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` % of them in
    repeated windows. ``kept``: not base_failed, and near enough in both histograms to one and the same
    language reference, of whichever language. A test is left out (its distance is null then) for texts
    below its minimum length; both are where the document's own ``lang`` has no reference, as those of
    other languages don't speak for it, and where no language has one. A document with a null ``lang`` is
    held against all references. Null and empty texts have no words and fail. Repeated rows are judged alike; a null lang only keeps a row out
    of the references. Of other columns, those named like a result are replaced.
    """
    references = docs.sparkSession.sparkContext.broadcast(language_references(docs, rules))
    names = [c.split()[0] for c in _FOUND.split(", ")]
    rest = [c for c in docs.columns if c.lower() not in names] if keep_columns else ["doc_id"]
    own = max((len(c) for c in rest), default=0) * "_"  # longer than any column's name, so none of them
    own_text, own_lang = f"{own}_text", f"{own}_lang"
    source = docs.select(*rest, F.col("text").alias(own_text), F.col("lang").alias(own_lang))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judged = _Judge(references.value, rules)
        for batch in batches:
            rows = []
            for text, lang in zip(batch[own_text], batch[own_lang], strict=True):
                data = encode(text)
                words, counts = plain_counts(data, rules)
                near = (None, None, False) if counts["base_failed"] else judged(data, words, lang)
                rows.append((*counts.values(), *near))
            found = pd.DataFrame(rows, columns=names, index=batch.index)
            yield pd.concat([batch[rest], found], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*rest).schema)
    return source.mapInPandas(run, f"{kinds}, {_FOUND}")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their columns; one that is named like a result of ``judge`` holds that result."""
    return judge(docs, rules, keep_columns=True).filter("kept").select(*docs.columns)
