"""License scans by conditional compression.

Words that repeat a license notice compress far better once the notice is known. Overlapping windows of
about a template's length, across line ends, that hold enough of its words are compressed plainly and with
the template as a raw zstandard dictionary. Where that saves enough, the wording is compared word by word:
few words may differ, and none that tells licenses apart (versions, names, qualifiers). Confirmed notices
are ranked by the size saved, and of those that share words the first stays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

# Short notices of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "All-rights-reserved": "All rights reserved.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# The licenses' own wordings.
WORDINGS = {
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
}
CUES = ("licen", "rights reserved", "redistribution", "creative commons", "copyright", "permission is")
#: Words that make another license of a notice.
QUALIFIERS = frozenset("noncommercial noderivatives noderivs sharealike nc nd sa lesser library affero academic".split())
#: Share of the plain size that a window must save, and of words that may differ from its template.
MIN_SAVED = 0.3
MAX_DIFFERENCE = 0.2
#: Cost of a word that may not differ.
_NEVER = 1_000_000
_WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")


def words_of(text: str) -> list[str]:
    """Words of a notice for comparison: letters, digits and inner points, lower-cased."""
    return _WORD.findall(text.lower())


def telling_words(text: str) -> frozenset[str]:
    """Words of a template that tell its license: with a digit, or capital inside a sentence and not just "License" or the like."""
    plain = {"license", "version", "software", "foundation", "source", "code", "form", "work"}
    inner = {w for m in re.finditer(r"[A-Z][A-Za-z-]*", text) if m.start() and text[: m.start()].rstrip()[-1:] not in ".!?" for w in words_of(m[0])}
    return frozenset(w for w in words_of(text) if any(c.isdigit() for c in w) or w in inner - plain)


class Scanner:
    """The templates as compressors, and the findings of a text."""

    def __init__(self, templates: dict[str, str | tuple[str, ...]]) -> None:
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        texts = {(k, i): t for k, ts in templates.items() for i, t in enumerate((ts,) if isinstance(ts, str) else ts)}
        self.words = {k: w for k, t in texts.items() if (w := words_of(t))}
        self.telling = {k: telling_words(texts[k]) for k in self.words}
        self.names = frozenset(w for x in self.telling.values() for w in x) | QUALIFIERS
        self.with_template = {
            k: zstandard.ZstdCompressor(
                level=3, write_content_size=False,
                dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for k, w in self.words.items()
        }
        self.ids = {w: i for i, w in enumerate(sorted({w for x in self.words.values() for w in x}))}
        self.own = {k: np.isin(np.arange(len(self.ids) + 1), [self.ids[w] for w in x]) for k, x in self.words.items()}
        self.spare = {k: int(len(w) * MAX_DIFFERENCE + 1e-9) for k, w in self.words.items()}
        # a stretch lacks at most the spare words: it holds all telling ones, and one of any spare + 1 others
        self.all_of = {k: tuple(sorted(x, key=len, reverse=True)) for k, x in self.telling.items()}
        self.any_of = {k: tuple(sorted(w, key=lambda x: (-len(x), x))[: self.spare[k] + 1]) for k, w in self.words.items()}

    def possible(self, low: str) -> list[tuple[str, int]]:
        """Templates that the lower-cased text may hold, by its substrings."""
        return [k for k in self.words if all(w in low for w in self.all_of[k]) and any(w in low for w in self.any_of[k])]

    def price(self, word: str) -> int:
        """Of a word that is added: more than may differ if it tells another license."""
        return _NEVER if word in self.names or any(c.isdigit() for c in word) else 1

    def saved(self, words: list[str], name: tuple[str, int]) -> float:
        """Share of the plain compressed size that a template saves."""
        data = " ".join(words).encode()
        size = len(self.plain.compress(data))
        return (size - len(self.with_template[name].compress(data))) / size

    def stretches(self, words: list[str], name: tuple[str, int]) -> list[tuple[int, int, int]]:
        """(words that differ, begin, end) of all disjoint stretches that confirm the template, best first."""
        want = self.words[name]
        n, drop = len(want), [_NEVER if w in self.telling[name] else 1 for w in want]
        cost, begin, found = [sum(drop[:i]) for i in range(n + 1)], [0] * (n + 1), []
        for j, word in enumerate(words):  # cost[i]: fewest differences of the template's first i words and a stretch that ends here
            before, before_at, add = cost, begin, self.price(word)
            cost, begin = [0] * (n + 1), [j + 1] * (n + 1)
            for i in range(1, n + 1):
                if want[i - 1] == word:  # never worse than the other two
                    cost[i], begin[i] = before[i - 1], before_at[i - 1] if i > 1 else j
                else:
                    cost[i], start = min((before[i] + add, -before_at[i]), (cost[i - 1] + drop[i - 1], -begin[i - 1]))
                    begin[i] = -start
            if cost[n] <= self.spare[name]:
                found.append((cost[n], begin[n], j + 1))
        out: list[tuple[int, int, int]] = []
        for one in sorted(found, key=lambda x: (x[0], x[2] - x[1], x[1])):
            if all(one[2] <= x[1] or x[2] <= one[1] for x in out):
                out.append(one)
        return out

    def changes(self, words: list[str], name: tuple[str, int]) -> list[str]:
        """Fewest words to take from (-) and to add to (+) the template, telling ones last."""
        want, n, m = self.words[name], len(self.words[name]), len(words)
        drop, add = [_NEVER if w in self.telling[name] else 1 for w in want], [self.price(w) for w in words]
        cost = [[0] * (m + 1) for _ in range(n + 1)]  # of what is left from there on
        for i in range(n, -1, -1):
            for j in range(m, -1, -1):
                if i < n and j < m and want[i] == words[j]:
                    cost[i][j] = cost[i + 1][j + 1]
                elif i < n or j < m:
                    less = cost[i + 1][j] + drop[i] if i < n else math.inf
                    more = cost[i][j + 1] + add[j] if j < m else math.inf
                    cost[i][j] = min(less, more)
        i, j, out = 0, 0, []
        while i < n or j < m:
            if i < n and j < m and want[i] == words[j]:
                i, j = i + 1, j + 1
            elif i < n and cost[i][j] == cost[i + 1][j] + drop[i]:
                out.append(f"-{want[i]}")
                i += 1
            else:
                out.append(f"+{words[j]}")
                j += 1
        return out

    def scan(self, text: str | None) -> list[dict]:
        """The confirmed notices, and the lines with a cue and without any, by line."""
        low = (text or "").lower()
        possible = self.possible(low)
        if not possible and not any(c.split()[0] in low for c in CUES):
            return []
        at = list(_WORD.finditer(low))
        words = [m[0] for m in at]
        breaks = np.flatnonzero(np.array([c == "\n" for c in low]))
        line = np.searchsorted(breaks, [m.start() for m in at])
        joined = " ".join(words)
        first = np.cumsum([0, *(len(w) + 1 for w in words)])
        cues = [m.start() for c in CUES for m in re.finditer(c, joined)]
        cue_lines = {int(line[i]) for i in np.searchsorted(first, cues, "right") - 1}
        if not possible and not cue_lines:
            return []
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        ids = np.array([self.ids.get(w, len(self.ids)) for w in words])
        best: dict[int, float] = {}
        confirmed = []
        for name in possible:
            want = self.words[name]
            # windows that hold every stretch which may confirm the template: it has its words but for the spare ones
            step = max(1, len(want) // 4)
            lo = np.arange(0, len(words), step)
            hi = np.minimum(lo + len(want) + self.spare[name] + step - 1, len(words))
            own = sums(self.own[name][ids])
            good = np.flatnonzero(own[hi] - own[lo] >= len(want) - self.spare[name])
            spans: list[list[int]] = []
            for a, b in zip(lo[good].tolist(), hi[good].tolist(), strict=True):
                saved = self.saved(words[a:b], name)
                if saved < MIN_SAVED:
                    continue
                for k in set(line[a:b].tolist()):
                    best[k] = max(best.get(k, 0.0), saved)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            for a, b in spans:
                for _, c, d in self.stretches(words[a:b], name):
                    confirmed.append((-self.saved(words[a + c : a + d], name), name, a + c, a + d))
        taken, found = np.zeros(len(words), bool), []
        for saved, name, a, b in sorted(confirmed):
            if not taken[a:b].any():
                taken[a:b] = True
                found.append((a, {"line": int(line[a]), "license": name[0], "saved": -saved, "changes": self.changes(words[a:b], name)}))
        found = [x for _, x in sorted(found, key=lambda x: x[0])]
        for k in cue_lines - set(line[taken].tolist()):
            found.append({"line": k, "license": None, "saved": best.get(k, 0.0), "changes": []})
        return sorted(found, key=lambda x: x["line"])


def scan_licenses(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, findings array<struct<line, license, saved, changes>>) of every row of ``docs``.

    Whole texts are read. A finding is a confirmed notice, anywhere in a line or over several, with the
    line (from 0) of its first word, the template, the share of the compressed size saved and the words that
    differ; notices that share words are one finding, of the template that saves most (ties go to the smaller
    name). Or it is a line with a cue that no confirmed notice touches: its license is null, and ``saved`` is
    the best of the windows that touch it and hold enough of a template's words, 0 below ``MIN_SAVED``.
    Up to ``MAX_DIFFERENCE`` of a template's words may differ, but none with a digit, none of its names (words with
    a capital inside a sentence), and no name of another template or qualifier may be added. Whether a text is
    looked at follows from the templates' own words. Words are letters, digits and inner points, lower-cased,
    so marks of comments are nothing. Null and empty texts have no findings, repeated
    rows equal ones, other columns are ignored.
    """
    known = {k: (t, *([WORDINGS[k]] if k in WORDINGS else [])) for k, t in TEMPLATES.items()} if templates is None else dict(templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(known)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "findings": [scanner.scan(t) for t in batch["text"]]})

    kind = "doc_id long, findings array<struct<line: int, license: string, saved: double, changes: array<string>>>"
    return docs.select("doc_id", "text").mapInPandas(run, kind)
