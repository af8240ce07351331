"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reported speech, other). Small transducers for
negation, reported speech and targets are composed with those of insults and threats into one machine
that reads a clause and writes events, such as an insult under negation or a threat with a target.
A text's score is a logistic function of its events, with weights learned from labelled rows; single
words score nothing.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows, in the order of a hash of their id, that stems and weights are learned from.
MAX_TRAINING_ROWS = 20_000
MAX_STEMS = 2_000
STEM_LENGTHS = (4, 5, 6, 7)
#: Twice the log-likelihood gain that a stem must show, more where clean texts have it too, and its odds.
MIN_EVIDENCE, WEAK_EVIDENCE = 25.0, 40.0
WEAK_ODDS, STRONG_ODDS = 4.0, 20.0
THRESHOLD = 0.3

# Common words of four languages by their part in a clause.
INSULT = "idiot moron stupid loser pathetic scum worthless clown disgusting trash dumm trottel abschaum imbécile connard crétin idiota estúpido imbécil basura"
THREAT = "kill hurt destroy murder burn beat töten umbringen vernichten tuer frapper détruire matar golpear destruir"
TARGET = "you your yours he she they them du dich dir ihr euch sie tu te toi vous ils elles tú ti usted ustedes ellos"
NEGATION = "not no never isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás tampoco"
REPORTED = "said says wrote claimed quoted reported sagte schrieb behauptete dit écrit affirme dijo dice escribió"

EVENTS = ("insult", "targeted", "weak", "negated", "reported", "threat", "threat_target", "clauses")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_END = re.compile(r"[.!?;\n]")
_SCOPE = 3  # words that a negation reaches


class Transducer:
    """States with arcs (state, symbol) -> (next state, symbol written); other symbols pass unchanged."""

    def __init__(self, arcs: dict[tuple[object, str], tuple[object, str]], start: object = 0) -> None:
        self.arcs, self.start = arcs, start

    def step(self, state: object, symbol: str) -> tuple[object, str]:
        if (state, symbol) in self.arcs:
            return self.arcs[state, symbol]
        after, written = self.arcs.get((state, "*"), (state, "*"))
        return after, symbol if written == "*" else written

    def compose(self, other: Transducer, alphabet: list[str]) -> Transducer:
        """The machine that feeds what this one writes to the other."""
        arcs, todo, seen = {}, [(self.start, other.start)], {(self.start, other.start)}
        while todo:
            a, b = todo.pop()
            for symbol in alphabet:
                x, written = self.step(a, symbol)
                y, out = other.step(b, written)
                arcs[(a, b), symbol] = ((x, y), out)
                if (x, y) not in seen:
                    seen.add((x, y))
                    todo.append((x, y))
        return Transducer(arcs, (self.start, other.start))


def grammar() -> Transducer:
    """Negation, reported speech and target, composed; it writes the event of each insult or threat."""
    negation = Transducer(
        {(k, "N"): (_SCOPE, "N") for k in range(_SCOPE + 1)}
        | {(k, "*"): (k - 1, "*") for k in range(1, _SCOPE + 1)}
        | {(k, "I"): (k - 1, "I-") for k in range(1, _SCOPE + 1)}
        | {(k, "W"): (k - 1, "O") for k in range(1, _SCOPE + 1)}
        | {(k, "T"): (k - 1, "T-") for k in range(1, _SCOPE + 1)}
    )
    reported = Transducer({(0, "R"): (1, "R"), (1, "I"): (1, "I'"), (1, "T"): (1, "T'"), (1, "W"): (1, "O")})
    target = Transducer({(0, "Y"): (1, "Y"), (1, "I"): (1, "I+"), (1, "T"): (1, "T+")})
    signs = ["I", "W", "T", "Y", "N", "R", "O"]
    return negation.compose(reported, signs).compose(target, signs)


#: Event of a written symbol. A negated threat counts as reported: neither is one.
_EVENT = {"I": "insult", "I+": "targeted", "W": "weak", "I-": "negated", "I'": "reported", "T": "threat", "T+": "threat_target", "T-": "reported", "T'": "reported"}


class Matcher:
    """Finds the clauses that hold an insult or threat, and their events."""

    def __init__(self, stems: dict[str, str]) -> None:
        self.machine = grammar()
        self.search = ahocorasick.Automaton()
        for w, symbol in (stems | dict.fromkeys(INSULT.split(), "I") | dict.fromkeys(THREAT.split(), "T")).items():
            self.search.add_word(w, (len(w), symbol))
        self.search.make_automaton()
        self.plain = {w: s for s, words in (("Y", TARGET), ("N", NEGATION), ("R", REPORTED)) for w in words.split()}

    def events(self, text: str | None) -> np.ndarray:
        """Counts of EVENTS in a text; a target behind the insult counts as one before it."""
        found = np.zeros(len(EVENTS))
        if not text:
            return found
        low = text.lower()
        heads: dict[int, str] = {}
        for end, (size, symbol) in self.search.iter(low):
            start = end - size + 1
            if start == 0 or not low[start - 1].isalnum():
                heads[start] = symbol  # longer stems come later and count
        if not heads:
            return found
        ends, done = [m.start() for m in _END.finditer(low)], -1
        for at in sorted(heads):
            if at < done:
                continue
            k = bisect.bisect(ends, at)  # the clause is whole, however far its ends are
            start, done = ends[k - 1] + 1 if k else 0, ends[k] if k < len(ends) else len(low)
            symbols = [heads.get(m.start()) or self.plain.get(m.group(), "O") for m in _WORD.finditer(low, start, done)]
            state, written = self.machine.start, []
            for s in symbols:
                state, out = self.machine.step(state, s)
                written.append(out)
            later_target = "Y" in symbols
            for out in written:
                name = _EVENT.get(out)
                if name:
                    if later_target:
                        name = {"insult": "targeted", "threat": "threat_target"}.get(name, name)
                    found[EVENTS.index(name)] += 1
            found[EVENTS.index("clauses")] += 1
        return found


def _features(events: np.ndarray) -> np.ndarray:
    return np.log1p(events)


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    ids = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = ids.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2).orderBy(
        F.xxhash64("doc_id"), "doc_id"
    ).limit(max_rows)
    # max_rows rows at most
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def learn_stems(rows: DataFrame, positives: int, negatives: int) -> dict[str, str]:
    """Starts of words that labelled texts show to go with toxicity far beyond chance: I, or W if clean texts have them too."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = {w for w in _WORD.findall((text or "").lower()) if len(w) >= min(STEM_LENGTHS)}
                for stem in {w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k}:
                    found.setdefault(stem, [0, 0])[int(toxic)] += 1
        yield pd.DataFrame([(s, p, n) for s, (n, p) in found.items()], columns=["stem", "pos", "neg"])

    share = positives / (positives + negatives)
    counts = rows.select("text", "toxic").mapInPandas(count, "stem string, pos long, neg long")
    pos, neg, n = F.col("pos"), F.col("neg"), F.col("pos") + F.col("neg")
    odds = (pos + 0.5) / (positives + 1) / ((neg + 0.5) / (negatives + 1))
    gain = 2 * (pos * F.log((pos + 1e-9) / (n * share)) + neg * F.log((neg + 1e-9) / (n * (1 - share))))
    good = counts.groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).select(
        "stem", odds.alias("odds"), gain.alias("gain")
    ).filter(
        (F.col("gain") >= MIN_EVIDENCE) & (F.col("odds") >= F.when(F.col("gain") >= WEAK_EVIDENCE, WEAK_ODDS).otherwise(STRONG_ODDS))
    ).orderBy(
        F.desc("gain"), F.length("stem"), "stem"
    ).limit(MAX_STEMS)
    stems: dict[str, str] = {}
    for odds_, stem in sorted(((r["odds"], r["stem"]) for r in good.collect()), key=lambda x: (len(x[1]), x[1])):
        symbol = "I" if odds_ >= STRONG_ODDS else "W"
        known = {stems.get(stem[:k]) for k in range(1, len(stem))}
        if "I" not in known and symbol not in known:
            stems[stem] = symbol
    return stems


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression; the last one is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6) * max(len(x), 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _event_rows(rows: DataFrame, stems: dict[str, str], keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(stems)
        for batch in batches:
            events = np.array([matcher.events(t) for t in batch["text"]]).reshape(-1, len(EVENTS))
            yield pd.concat([batch[keep], pd.DataFrame(events, columns=EVENTS, index=batch.index)], axis=1)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*dict.fromkeys([*keep, "text"])).mapInPandas(run, f"{kinds}, " + ", ".join(f"{e} double" for e in EVENTS))


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, and the counts of EVENTS) of every row of ``docs``.

    ``labels`` has doc_id and toxic; rows whose crc32(doc_id as text) mod 4 is 2 are held out of all
    learning, and of the others ``max_rows`` are used, the first by a hash of their id. Only the text
    is scored, the whole of it. Null and empty texts have no events and get the base score, as any
    text without a matched clause. A null doc_id has a null held_out. Without usable labels every score
    is 0. Repeated rows score alike; several labels of one id count as their largest. Other columns are
    ignored.
    """
    sample = _sample(docs, labels, max_rows)
    sizes = sample.agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).first()
    positives, total = int(sizes["pos"] or 0), int(sizes["n"])
    stems, weights = {}, None
    if 0 < positives < total:
        stems = learn_stems(sample, positives, total - positives)
        seen = _event_rows(sample, stems, ["doc_id", "toxic"]).orderBy("doc_id").toPandas()  # max_rows rows of numbers
        weights = fit(_features(seen[list(EVENTS)].to_numpy()), seen["toxic"].to_numpy(float))
    events = _event_rows(docs.select("doc_id", "text"), stems, ["doc_id"])
    if weights is None:
        chance = F.lit(0.0)
    else:
        total_weight = F.lit(float(weights[-1]))
        for name, w in zip(EVENTS, weights, strict=False):
            total_weight = total_weight + F.log1p(name) * float(w)
        chance = 1 / (1 + F.exp(-total_weight))
    return events.select(
        "doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2).alias("held_out"), chance.alias("score"),
        F.when(chance >= THRESHOLD, 1).otherwise(0).alias("predicted"), *EVENTS,
    )
