"""Main text of web pages by a tree-structured graphical model.

Each element of a page's tree is content or not. A node potential comes from its tag, the words of its
class and id, its links and its text, and from whether it stands in an article or in a part that is set
apart (menu, comments, adverts); an edge potential ties it to its parent. Sum-product messages go up and
down the tree, so every element gets its exact marginal. The potentials are counted on labelled pages:
those whose markup itself tells the article from the rest. Each is counted twice, the second time as if
its markup didn't tell, so that pages without an article element are known as well.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that potentials are counted on, the first by a hash of their id.
MAX_TRAINING_PAGES = 2_000
# a quote opens a value only after an equals sign; elsewhere it is a plain character of a name or an unquoted value
_VALUE = r"""=\s*+(?>"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+|)"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[A-Za-z](?:[^<>=]++|" + _VALUE + r")*+>?|[^<]+|<", re.S
)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/<>"']++)\s*+(?:=\s*+(?>"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*+)|))?+""")
_NAMED = frozenset("class id role".split())
_CUE = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

# Tags by their part in a page.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas select textarea button".split())
RAW = frozenset("script style noscript template svg iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th"
    " thead tr ul hr br".split()
)
APART = frozenset("nav footer aside form menu dialog search".split())
HOLDERS = frozenset("article main".split())
BAD_CUES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer header masthead menu nav navbar navigation newsletter notice pagination popup promo related search share"
    " sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
GOOD_CUES = frozenset("article body content entry main post story text".split())
#: Elements that hold a page or an article whole: their class tells of the layout, not of a part set apart.
WHOLE = HOLDERS | {"html", "body"}


@dataclass
class Node:
    """An element: tag, parent's number, cue words, and its own text runs."""

    tag: str
    parent: int
    cues: frozenset[str]
    text: int = 0
    linked: int = 0
    children: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The elements in page order, and (element, text) runs; a run of None ends a block."""
    nodes = [Node("html", -1, frozenset())]
    runs: list[tuple[int, str | None]] = []
    stack, links, at = [0], 0, 0
    open_: Counter[str] = Counter()
    while (m := _TOKEN.match(page, at)) is not None:
        token, at = m.group(), m.end()
        if token[0] != "<" or token == "<":
            text = html.unescape(token)
            runs.append((stack[-1], text))
            size = len(text.strip())
            nodes[stack[-1]].text += size
            nodes[stack[-1]].linked += size if links else 0
            continue
        name = _TAG.match(token)
        if not name:
            continue
        tag = name.group(1).lower()
        if token[1] == "/":
            while open_[tag]:
                last = nodes[stack.pop()].tag
                open_[last] -= 1
                links -= last == "a"
                if last == tag:
                    break
            if tag in BLOCK:
                runs.append((stack[-1], None))
            continue
        if tag in BLOCK:
            runs.append((stack[-1], None))
            while tag != "br" and len(stack) > 1 and nodes[stack[-1]].tag in ("p", "b", "i", "em", "strong", "span", "a", "font", "u") and open_["p"]:
                last = nodes[stack.pop()].tag
                open_[last] -= 1
                links -= last == "a"
            if tag == "li" and nodes[stack[-1]].tag == "li":
                open_[nodes[stack.pop()].tag] -= 1
        if tag in VOID or token.endswith("/>"):
            continue
        cues = frozenset(
            w for x in _ATTRIBUTE.finditer(token, name.end()) if x.group(1).lower() in _NAMED
            for w in _CUE.findall((x.group(2) or x.group(3) or x.group(4) or "").lower())
        )
        nodes.append(Node(tag, stack[-1], cues))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(len(nodes) - 1)
        open_[tag] += 1
        links += tag == "a"
    return nodes, runs


def apart(nodes: list[Node]) -> list[bool]:
    """Whether each node stands in a part that its markup sets apart, by tag or by a word of its class or id.

    Such words don't count where the element holds an article that has none itself.
    """
    holds = [n.tag in WHOLE and not (n.tag in HOLDERS and n.cues & BAD_CUES) for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        if holds[i]:
            holds[nodes[i].parent] = True
    out = [False] * len(nodes)
    for i, n in enumerate(nodes):
        own = n.tag in APART | SILENT or bool(n.cues & BAD_CUES) and not holds[i]
        out[i] = own or n.parent >= 0 and out[n.parent]
    return out


def features(nodes: list[Node], marked: bool = True) -> list[list[str]]:
    """Names of the features of each node; without ``marked`` as if articles were plain elements."""
    text, linked = [n.text for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        text[nodes[i].parent] += text[i]
        linked[nodes[i].parent] += linked[i]
    away, inside = apart(nodes), [False] * len(nodes)
    out = []
    for i, n in enumerate(nodes):
        inside[i] = n.tag in HOLDERS or n.parent >= 0 and inside[n.parent]
        share = linked[i] / text[i] if text[i] else 0.0
        many = 0 if share < 0.2 else 1 if share < 0.6 else 2
        place = "apart" if away[i] else "article" if inside[i] and marked else "open"
        size = "none" if not text[i] else "short" if text[i] < 25 else "middle" if text[i] < 100 else "long"
        cue = "good" if n.cues & GOOD_CUES else "none"
        # what an article holds is its own, long or short, linked or not
        shape = [f"in:{place}"] if place != "open" else [f"size:{size}", f"links:{many}"]
        out.append([f"tag:{'div' if n.tag in HOLDERS and not marked else n.tag}", f"cue:{cue}", *shape])
    return out


def labels(nodes: list[Node]) -> list[bool] | None:
    """Content or not by the page's own markup; None if it holds no article."""
    if not any(n.tag in HOLDERS for n in nodes):
        return None
    out, away = [False] * len(nodes), apart(nodes)
    for i, n in enumerate(nodes):
        out[i] = (n.parent >= 0 and out[n.parent] or n.tag in HOLDERS) and not away[i]
    return out


#: Logarithm of the odds that markup alone gives: more than the other potentials of a node and its edges.
FIRM = 40.0


class TreeModel:
    """Potentials as logarithms, and marginals by messages."""

    def __init__(self, counts: dict[tuple[str, bool], int], edges: dict[tuple[bool, bool], int]) -> None:
        total = {y: sum(v for (f, k), v in counts.items() if k == y and f.startswith("cue:")) + 2 for y in (False, True)}
        names = {f for f, _ in counts}
        self.node = {
            f: np.log([(counts.get((f, y), 0) + 0.5) / total[y] for y in (False, True)]) for f in names
        }
        # what the few labelled pages may not show is known beforehand
        firm = {"in:apart": (FIRM, 0.0), "in:article": (0.0, FIRM), "links:2": (2.0, 0.0), "size:long": (0.0, 1.0), "cue:good": (0.0, 1.0)}
        for f, (no, yes) in firm.items():
            self.node[f] = self.node.get(f, np.zeros(2)) + np.array([no, yes])
        self.edge = np.log([
            [(edges.get((p, c), 0) + 1) / (edges.get((p, False), 0) + edges.get((p, True), 0) + 2) for c in (False, True)]
            for p in (False, True)
        ])

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """Probability that each node is content, exact on the tree."""
        own = np.array([sum((self.node.get(f, np.zeros(2)) for f in fs), np.zeros(2)) for fs in features(nodes)])
        up = own.copy()  # with the messages of all children
        sent = np.zeros_like(own)
        for i in range(len(nodes) - 1, 0, -1):
            sent[i] = np.logaddexp(self.edge[:, 0] + up[i, 0], self.edge[:, 1] + up[i, 1])
            up[nodes[i].parent] += sent[i]
        full = up.copy()
        for i in range(1, len(nodes)):
            rest = full[nodes[i].parent] - sent[i]
            full[i] = up[i] + np.logaddexp(self.edge[0] + rest[0], self.edge[1] + rest[1])
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700)))


def extract(page: str | None, model: TreeModel) -> tuple[str, float]:
    """The page's main text, and the mean marginal of what was taken."""
    if not page:
        return "", 0.0
    nodes, runs = parse(page)
    chance = model.marginals(nodes)
    silent = [False] * len(nodes)
    for i, n in enumerate(nodes):
        silent[i] = n.tag in SILENT or n.parent >= 0 and silent[n.parent]
    blocks, part, seen = [], [], []
    for i, text in [*runs, (0, None)]:
        if text is None:
            if part and (line := _SPACE.sub(" ", "".join(part)).strip()):
                blocks.append(line)
            part = []
        elif chance[i] >= 0.5 and not silent[i]:
            part.append(text)
            seen.append(chance[i])
    return "\n".join(blocks), float(np.mean(seen)) if seen else 0.0


def train(pages: DataFrame, max_pages: int = MAX_TRAINING_PAGES) -> TreeModel:
    """Potentials counted on up to ``max_pages`` labelled pages; only the counts come to the driver."""
    able = pages.filter("html is not null and (html ilike '%<article%' or html ilike '%<main%')").select("html", F.xxhash64("page_id", "url", "html").alias("place"))
    # only the hashes are ordered; pages are counted where they are read
    last = able.select("place").orderBy("place").limit(max_pages).agg(F.max("place")).first()[0]
    chosen = able.filter(F.col("place") <= F.lit(last).cast("long")).dropDuplicates(["place"]) if last is not None else able.limit(0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, int] = {}
        for batch in batches:
            for page in batch["html"]:
                nodes, _ = parse(page)
                truth = labels(nodes)
                if truth is None:
                    continue
                for marked in (True, False):
                    for n, fs, y in zip(nodes, features(nodes, marked), truth, strict=True):
                        for f in [*fs, *([f"edge:{truth[n.parent]}"] if n.parent >= 0 else [])]:
                            found[f"{f} {y}"] = found.get(f"{f} {y}", 0) + 1
        yield pd.DataFrame(list(found.items()), columns=["name", "n"])

    known = [f"tag:{t}" for t in BLOCK | SILENT | VOID | {"a", "b", "i", "em", "strong", "span", "code", "u", "font"}]
    total = chosen.mapInPandas(count, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    # tags are open-ended; the model keeps those of HTML
    first = F.split("name", " ")[0]
    counts, edges = {}, {}
    for r in total.filter(~first.startswith("tag:") | first.isin(known)).collect():
        name, _, y = r["name"].rpartition(" ")
        if name.startswith("edge:"):
            edges[name == "edge:True", y == "True"] = r["n"]
        else:
            counts[name, y == "True"] = r["n"]
    return TreeModel(counts, edges)


def extract_pages(pages: DataFrame, max_pages: int = MAX_TRAINING_PAGES) -> DataFrame:
    """(page_id, url, text, confidence) of every row of ``pages``.

    The whole html is read. Text of elements with a content marginal of 0.5 or more is taken, character
    references decoded, white space in a block made one space, blocks joined by newlines. Null, empty
    and unlabelled pages are no obstacle: without text the result is an empty string, and without any
    labelled page the potentials known beforehand decide. Scripts, styles, titles and form controls are
    never text. Repeated rows give equal rows; other columns are ignored.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(pages, max_pages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extract(p, model.value) for p in batch["html"]]
            yield pd.DataFrame({
                "page_id": batch["page_id"].astype("Int64"), "url": batch["url"],
                "text": [f[0] for f in found], "confidence": [f[1] for f in found],
            })

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, confidence double")
