"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer reads words as insults and threats (whole words and stems, with weights learned from
labelled rows), targets, intents, negations and reports; other words pass. A learned word is a threat if it mostly follows
an intent. Transducers for insults, threats, targets, negation and reported speech are composed with it into one
deterministic machine, which reads each clause and gives every insult or threat a weight for how it is used: aimed at a
target or announced it counts more, as one of several insults more, negated or reported less. A text's clause weights
are turned into a probability by a logistic fit on the same labelled rows.

Learning takes at most about `most` labelled rows, a documented bound; scoring reads whole texts, each alone.

Defined cases: a null or empty text has no clause and the score of a text without one; equal texts have equal
scores, repeated rows all stay; without labels of both kinds the seed lexicon is used with a fixed fit; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import fold, sample
from tidemark.llm.words import REMEMBERED, Words, slices, tidied, words_of

PASS, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, GAP = SYMBOLS = range(8)
#: Seeds of the lexicon by class, in four languages.
SEEDS = {
    INSULT: "idiot moron stupid scum trash loser clown pathetic worthless disgusting dumb imbecile idiota estúpido idiotin dummkopf abschaum connard crétin",
    THREAT: "kill murder hurt destroy stab shoot hang umbringen töten tuer détruire matar destruir",
    TARGET: "you your yours yourself u ur they them those he she him her du dich dein sie ihr tu toi vous tú usted ustedes vosotros",
    NEGATION: "not never no neither nor without isn't aren't wasn't don't doesn't won't nicht nie kein keine ne pas jamais nunca ni tampoco",
    REPORT: "said says say told tells called calls wrote writes claimed claims quoted according allegedly sagte sagt schrieb laut dit écrit selon dijo dice según",
    INTENT: "will gonna going shall i'll we'll werde werden vais allons voy vamos",
}
SEED_WEIGHT = 3.0
MOST = 20_000
STEM = range(3, 9)
LEAST_G, LEAST_ODDS = 24.0, 3.5
_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@dataclass
class Transducer:
    """Arcs from (state, symbol) to (state, weight factor); what has no arc stays in its state with factor 1."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, float]]

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 1.0))


def compose(*machines: Transducer) -> Transducer:
    """One machine that runs all at once: states are tuples, factors multiply."""
    names = {s: i for i, s in enumerate(product(*(range(m.states) for m in machines)))}
    arcs = {}
    for state, number in names.items():
        for symbol in SYMBOLS:
            steps = [m.step(s, symbol) for m, s in zip(machines, state, strict=True)]
            arcs[number, symbol] = (names[tuple(s for s, _ in steps)], math.prod(f for _, f in steps))
    return Transducer(len(names), arcs)


#: Each further insult of a clause counts more.
INSULTING = Transducer(2, {(0, INSULT): (1, 1.0), (1, INSULT): (1, 1.2)})
#: A threat that someone announces counts more than its word alone.
THREATENING = Transducer(2, {(0, INTENT): (1, 1.0), (1, THREAT): (1, 1.5), (1, GAP): (0, 1.0)})
#: After a target, insults and threats count more; a threat without one counts less.
AIMED = Transducer(2, {(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.5), (1, THREAT): (1, 2.0), (0, THREAT): (0, 0.3)})
#: GAP stands for more than `NEAR` words without a class.
NEAR = 2
#: A negation weakens the insult or threat that follows it closely.
NEGATED = Transducer(2, {(0, NEGATION): (1, 1.0), (1, GAP): (0, 1.0), (1, INSULT): (0, 0.5), (1, THREAT): (0, 0.3)})
#: After a report, the rest of the clause is someone else's.
REPORTED = Transducer(2, {(0, REPORT): (1, 1.0), (1, INSULT): (1, 0.6), (1, THREAT): (1, 0.5)})
MACHINES = (REPORTED, NEGATED, AIMED, INSULTING, THREATENING)
GRAMMAR = compose(*MACHINES)


_NO_STEM = (0.0, PASS)


class Lexicon:
    """Class and weight of words. entries: whole words, or stems with a trailing star, with their weights; threats: those that are threats."""

    def __init__(self, entries: dict[str, float], threats: frozenset[str] = frozenset()) -> None:
        kind = lambda w: THREAT if w in threats else INSULT
        self.exact = {w: (kind, SEED_WEIGHT if kind in (INSULT, THREAT) else 1.0) for kind, words in SEEDS.items() for w in words.split()}
        self.exact |= {w: (kind(w), x) for w, x in entries.items() if w[-1] != "*" and self.exact.get(w, (INSULT,))[0] == INSULT}
        self.stems = {w[:-1]: (x, kind(w)) for w, x in entries.items() if w[-1] == "*"}
        self.known: dict[str, tuple[int, float]] = {}

    def look_up(self, word: str) -> tuple[int, float]:
        best = (PASS, 0.0)
        for core in _LETTERS.findall(word.lower()):
            found = self.exact.get(core)
            if found is None:
                stem, kind = max((self.stems.get(core[:n], _NO_STEM) for n in STEM if n <= len(core)), default=_NO_STEM)
                found = (kind, stem) if stem else (PASS, 0.0)
            if found[0] and (best[0] in (PASS, TARGET, NEGATION, REPORT, INTENT) and found[0] in (INSULT, THREAT) or not best[0] or found[1] > best[1] and found[0] == best[0]):
                best = found
        return best

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and weight of each word, and whether it ends a clause."""
        coded = words.strings().dictionary_encode()
        kinds, weights, ends = [], [], []
        for w in coded.dictionary.to_pylist():
            found = self.known.get(w)
            if found is None:
                found = self.look_up(w)
                if len(self.known) < REMEMBERED:
                    self.known[w] = found
            kinds.append(found[0])
            weights.append(found[1])
            ends.append(w[-1] in ".!?;:")
        code = coded.indices.to_numpy(zero_copy_only=False)
        return np.array(kinds, np.int8)[code], np.array(weights)[code], np.array(ends, bool)[code]


FEATURES, STRONG = ("total", "strongest"), 12.0


def features(words: Words, lexicon: Lexicon) -> np.ndarray:
    """Of each text: the logarithm of the sum of its clause weights, and their maximum, at most `STRONG`."""
    n = len(words.at) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(words.start):
        return out
    kind, weight, ends = lexicon.read(words)
    line = np.cumsum(words.data == 10)[words.start]
    begins = np.ones(len(kind), bool)
    begins[1:] = (words.doc[1:] != words.doc[:-1]) | (line[1:] != line[:-1]) | ends[:-1]
    clause = np.cumsum(begins)
    marked = np.zeros(clause[-1] + 1, bool)
    marked[clause[(kind == INSULT) | (kind == THREAT)]] = True
    at = np.flatnonzero(marked[clause] & (kind != PASS))
    state, last, before = 0, -1, 0
    sums = []
    for i, doc, c, k, w in zip(at.tolist(), words.doc[at].tolist(), clause[at].tolist(), kind[at].tolist(), weight[at].tolist(), strict=True):
        if c != last:
            state, last = 0, c
            sums.append([doc, 0.0])
        elif i - before > NEAR + 1:
            state, _ = GRAMMAR.step(state, GAP)
        before = i
        state, factor = GRAMMAR.step(state, k)
        if k in (INSULT, THREAT):
            sums[-1][1] += w * factor
    for doc, total in sums:
        out[doc, 0] += total
        out[doc, 1] = max(out[doc, 1], total)
    return np.column_stack([np.log1p(out[:, 0]), np.minimum(out[:, 1], STRONG)])


def announced(words: list[str]) -> set[str]:
    """Words that follow an intent within three words."""
    intents = SEEDS[INTENT].split()
    return {w for i, x in enumerate(words) if x in intents for w in words[i + 1 : i + 4]}


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], frozenset[str]]:
    """Words and stems with log-odds of being in texts of label 1, by document counts over the sample, and those of them that are threats.

    What is kept differs from chance (G statistic) and leans to label 1. A threat follows an intent in half of its texts or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _LETTERS.findall((text or "").lower())
                with_stems = lambda cores: cores | {c[:n] + "*" for c in cores for n in STEM if n < len(c)}
                for term in with_stems(set(words)):
                    counts.setdefault(term, [0, 0, 0])[y > 0] += 1
                for term in with_stems(announced(words)) if y > 0 else ():
                    counts[term][2] += 1
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (1, 0, 2))], names=["term", "a", "b", "c"])

    total = train.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    positive, negative = total[0], total[1] - total[0]
    if not positive or not negative:
        return {}, frozenset()
    counts = train.select("text", "y").mapInArrow(tidied(run), "term string, a long, b long, c long").groupBy("term").agg(*(F.sum(x).alias(x) for x in "abc"))
    rate = positive / (positive + negative)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    g = 2 * (a * F.log(a / ((a + b) * rate)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - rate)))).otherwise(0.0))
    odds = F.log((a + 0.5) / (positive + 1)) - F.log((b + 0.5) / (negative + 1))
    rows = counts.filter("a > 2").withColumn("g", g).withColumn("odds", odds).filter((F.col("g") >= LEAST_G) & (F.col("odds") >= LEAST_ODDS))
    kept = rows.select("term", "odds", (2 * F.col("c") >= F.col("a")).alias("threat")).collect()  # of terms of a bounded sample
    return {r["term"]: r["odds"] for r in kept}, frozenset(r["term"] for r in kept if r["threat"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic fit in which the rarer label weighs more, the intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    c = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (c * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


FIXED_FIT = np.array([1.0, 0.8, -2.5])


@dataclass
class Model:
    entries: dict[str, float]
    weights: np.ndarray
    threats: frozenset[str] = frozenset()

    def lexicon(self) -> Lexicon:
        return Lexicon(self.entries, self.threats)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(train: DataFrame) -> Model:
    """The lexicon and the logistic weights of a bounded sample (text, y)."""
    train = train.select("text", "y")
    entries, threats = learn_lexicon(train)
    schema = ", ".join(f"{f} double" for f in FEATURES) + ", y double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries, threats)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                x = features(words_of(batch.column(0).slice(a, b - a)), lexicon)
                y = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), pa.array(y)], names=[*FEATURES, "y"])

    rows = train.mapInArrow(tidied(run), schema).toPandas()  # as many rows as the bounded sample has
    rows = rows.sort_values([*FEATURES, "y"])
    if rows["y"].nunique() < 2:
        return Model(entries, FIXED_FIT, threats)
    return Model(entries, logistic(rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy()), threats)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text, and its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                x = features(words_of(batch.column(1).slice(a, b - a)), lexicon)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.scores(x)), *(pa.array(c) for c in x.T)], names=["doc_id", "score", *FEATURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, score double, " + ", ".join(f"{f} double" for f in FEATURES))


def train_fold(labels_id: str = "doc_id"):
    return fold(F.col(labels_id), 3) != 1


def learned(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Fitted on rows whose fold isn't the held-out one."""
    return fit(sample(docs, labels, "toxic", train_fold(), most))


def filtered(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """docs without the rows that score `limit` or more, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for a, b in slices(text):
                keep = model.scores(features(words_of(text.slice(a, b - a)), lexicon)) < limit
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.mapInArrow(tidied(run), docs.schema)
