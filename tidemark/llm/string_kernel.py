"""Language of whole texts by string kernels.

The kernel of two texts is the number of different n-grams (one to four letters, blended) that both hold, over the geometric
mean of what each holds: a presence kernel. Grams lie within a word and may take in its begin and its end. They are hashed to 2**21
places, and only those that some landmark holds are counted, as no others can be shared with one.

Landmarks are labelled texts, dealt evenly over languages. With K the kernel among them, a text's Nyström features are its
kernels with all landmarks times K**-1/2, in which the plain inner product approximates the kernel. One ridge regression for each
language against the rest, with targets 1 and -1, is solved on the features of a bounded labelled sample. Scoring is three
products of matrices a block of texts: grams (0 or 1) by landmarks, kernels by K**-1/2, features by weights. The first product is
of whole numbers, so a result does not depend on the block; the rest is rounded.

Bounds: `MOST` labelled rows and `LANDMARKS` of them are sampled, evenly over languages by a hash of the text, one of several equal
texts, one row a language at the least. The model that is broadcast has a bit for each landmark and gram. Every text is scored whole.

Defined cases: a null text, and one without a letter, is `und` with score 0; so is every text where nothing can be learned. A text
without a known gram gets the language with most labelled rows in the sample. Equal evidence goes to the language that sorts first.
Repeated rows are scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.labelled import fold
from tidemark.llm.scratch import free, stored
from tidemark.llm.words import mix, slices, tidied

LONGEST, PLACES = 4, 1 << 21
MOST, LANDMARKS, RIDGE = 1200, 128, 1e-3
ROWS, PIECE = 128, 1 << 20
UNKNOWN = "und"
_BLANK = re.compile(r"\s")


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, lower-cased, with one 0 after each run of them, and the text that each symbol belongs to. The first symbol is a 0, too."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) + 1 for t in low])
    code = np.frombuffer((" ".join([*low, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    keep = is_letter | np.append(False, is_letter[:-1])
    code = np.where(is_letter, code, 0)[keep]
    return np.append(np.uint32(0), code).astype(np.uint64), np.append(0, np.repeat(np.arange(len(texts)), size)[keep])


def grams(code: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts and places of all grams, by length. A gram belongs to the text of its last symbol, and holds a 0 at its ends only."""
    solid = code != 0
    value, inside = code.copy(), np.ones(len(code), bool)
    for n in range(1, LONGEST + 1):
        ok = solid if n == 1 else inside
        yield of[n - 1 :][ok], (mix(value + np.uint64(n << 56)) >> np.uint64(43)).astype(np.int64)[ok]
        if n == LONGEST or len(code) <= n:
            return
        value = value[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n:]
        inside = inside[:-1] & (solid[n - 1 : -1] if n > 1 else True)


def pieces(text: str) -> Iterator[str]:
    """A text cut at blanks into about a million characters each: no gram spans a blank."""
    done = 0
    while done < len(text):
        gap = _BLANK.search(text, done + PIECE)
        stop = gap.start() if gap else len(text)
        yield text[done:stop]
        done = stop


def presence(texts: list[str], column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the known grams each text holds, as 0 or 1, and whether it has a letter. column: of each place, -1 if unknown."""
    x, lettered = np.zeros((len(texts), width), np.float32), np.zeros(len(texts), bool)
    at, chunk, size = [], [], 0

    def look() -> None:
        code, of = symbols(chunk)
        who = np.array(at)
        for text, place in grams(code, of):
            row, col = who[text], column[place]
            known = col >= 0
            x[row[known], col[known]] = 1
            lettered[row] = True
        at.clear()
        chunk.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text):
            at.append(i)
            chunk.append(piece)
            size += len(piece)
            if size >= PIECE:
                look()
                size = 0
    if chunk:
        look()
    return x, lettered


@dataclass
class Model:
    """languages, in order; places of the known grams; landmarks by grams as packed bits; K**-1/2; weights by language; and what the sample has without evidence."""

    languages: list[str]
    places: np.ndarray
    bits: np.ndarray
    root: np.ndarray
    weights: np.ndarray
    prior: np.ndarray

    def column(self) -> np.ndarray:
        out = np.full(PLACES, -1, np.int32)
        out[self.places] = np.arange(len(self.places))
        return out

    def landmarks(self) -> np.ndarray:
        return np.unpackbits(self.bits, axis=1, count=len(self.places)).astype(np.float32)


def normed(shared: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Shared grams over the geometric mean of both counts; 0 where one has none."""
    return shared / np.sqrt(np.maximum(np.outer(own, other), 1.0))


class Scorer:
    """A model ready for blocks of texts."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.marks = model, model.column(), model.landmarks()
        self.sizes = self.marks.sum(1, dtype=float)

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and language, about 1 for it and -1 against it; and whether the text has a letter."""
        x, lettered = presence(texts, self.known, len(self.model.places))
        kernel = normed((x @ self.marks.T).astype(float), x.sum(1, dtype=float), self.sizes)
        return np.round(kernel @ self.model.root @ self.model.weights + self.model.prior, 9), lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names = self.model.languages
        if not names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        f, lettered = self.evidence(texts)
        best = f.argmax(1)
        score = np.where(lettered, np.clip((1 + f[np.arange(len(f)), best]) / 2, 0, 1), 0.0)
        return [names[b] if seen else UNKNOWN for b, seen in zip(best.tolist(), lettered.tolist(), strict=True)], score


def sample(docs: DataFrame, train: Column, most: int) -> DataFrame:
    """text, lang of about `most` different texts at the most, evenly over languages; train tells which doc_ids may be learned from."""
    rows = docs.filter(train).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    each = F.greatest(F.lit(1.0), F.lit(float(most)) / F.count("*").over(Window.partitionBy()))  # one row for each language
    sizes = stored(sizes.select("lang", "n", each.alias("each")))
    # Four times as many as are wanted by a bound on the hash, then exactly as many; copies have one hash.
    hashed = rows.withColumn("key", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    near = hashed.join(sizes, "lang").filter(F.col("key") < F.lit(float(1 << 40)) * 4 * F.col("each") / F.col("n"))
    one = near.groupBy("lang", "key").agg(F.min("text").alias("text"), F.first("each").alias("each"))
    order = Window.partitionBy("lang").orderBy("key")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("each")).select("text", "lang", "rank")


def fit(train: DataFrame, landmarks: int = LANDMARKS) -> Model:
    """The model of a bounded sample (text, lang, rank within the language). Places of its texts' grams come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(PLACES)
        for batch in batches:
            for a in range(len(batch)):
                part = batch.slice(a, 1)
                found = np.zeros(PLACES, bool)
                for piece in pieces(part.column(0)[0].as_py()):
                    for _, place in grams(*symbols([piece])):
                        found[place] = True
                yield pa.RecordBatch.from_arrays([pa.array([every[found].astype(np.int32).tobytes()], pa.binary()), part.column(1), part.column(2)], names=["places", "lang", "rank"])

    rows = train.select("text", "lang", "rank").mapInArrow(tidied(run), "places binary, lang string, rank int").collect()
    rows = sorted((r["lang"], r["rank"], np.frombuffer(r["places"], np.int32)) for r in rows if len(r["places"]))
    languages = sorted({r[0] for r in rows})
    empty = Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.uint8), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    if not languages:
        return empty
    each = max(1, landmarks // len(languages))
    marked: dict[str, int] = {}
    marks = []
    for lang, _, places in rows:
        if marked.get(lang, 0) < each:
            marked[lang] = marked.get(lang, 0) + 1
            marks.append(places)
    known = np.unique(np.concatenate(marks))
    column = np.full(PLACES, -1, np.int32)
    column[known] = np.arange(len(known))

    def matrix(lists: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(lists), len(known)), np.float32)
        for i, places in enumerate(lists):
            at = column[places]
            x[i, at[at >= 0]] = 1
        return x

    held = matrix(marks)
    sizes = held.sum(1, dtype=float)
    among = normed((held @ held.T).astype(float), sizes, sizes)
    value, vector = np.linalg.eigh(among)
    good = value > 1e-6 * value.max()
    root = (vector[:, good] / np.sqrt(value[good])) @ vector[:, good].T
    features = []
    for a in range(0, len(rows), ROWS):
        x = matrix([r[2] for r in rows[a : a + ROWS]])
        features.append(normed((x @ held.T).astype(float), x.sum(1, dtype=float), sizes) @ root)
    phi = np.concatenate(features)
    y = np.where(np.array([r[0] for r in rows])[:, None] == np.array(languages), 1.0, -1.0)
    # A language counts as much as any other, however many rows it has.
    weight = np.array([1.0 / sum(r[0] == lang for r in rows) for lang in languages])
    weight = np.sqrt(weight[[languages.index(r[0]) for r in rows]] / len(languages))[:, None]
    prior = y.mean(0) * 1e-3  # tells what to say without evidence, and no more
    weights = np.linalg.solve((phi * weight).T @ (phi * weight) + RIDGE * np.eye(phi.shape[1]), (phi * weight).T @ ((y - prior) * weight))
    return Model(languages, known, np.packbits(held.astype(bool), axis=1), root, weights, prior)


def learned(docs: DataFrame, most: int = MOST, landmarks: int = LANDMARKS) -> Model:
    """Fitted on text and lang of documents whose fold isn't the held-out one."""
    train = stored(sample(docs, fold(F.col("doc_id"), 3) != 1, most))
    model = fit(train, landmarks)
    free(train)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: a bit for each landmark and place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            text = batch.column(1)
            for a, b in slices(text):
                for c in range(a, b, ROWS):
                    part = text.slice(c, min(b, c + ROWS) - c)
                    lang, score = scorer.predict([t or "" for t in part.to_pylist()])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(c, len(part)), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")
