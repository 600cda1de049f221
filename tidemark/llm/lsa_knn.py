"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms of three views (words without case, shapes of words, marks that end them) with terms
for its length and for its shares of repeated words, capital words and marks, hashed into a fixed number of places. Weights and the
latent space (truncated singular vectors) are fitted on a bounded sample of labelled rows; the sample's vectors
are broadcast, at most `MOST` by `LATENT` numbers. Every document's cosine with each of them is computed exactly,
in blocks, and the labels of the nearest vote with weights that grow with similarity.

Coordinates are whole numbers of 2**-SCALE, small enough that every sum of products is exact in 64-bit floating point,
in whatever order it is taken: a text's score depends on the text and the model alone, not on its block or batch.

Defined cases: a null or empty text has its length term alone; equal texts have equal scores, repeated rows all
stay; ties between neighbours are broken by their order in the sample, which is by vector and label; without
labels every score is 0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import fold, sample
from tidemark.llm.words import REMEMBERED, Words, slices, tidied, words_of

PLACES, LATENT, MOST, NEAREST, SHARPNESS = 4096, 48, 5000, 15, 8.0
#: Bits of a coordinate. PLACES products of two are below 2**53.
SCALE = 18
assert PLACES <= 1 << (52 - 2 * SCALE) and MOST < 1 << 16
_RUNS = [(re.compile("[^\\W\\d_a-zß-ÿ]"), "X"), (re.compile(r"[^\W\d_X]"), "x"), (re.compile(r"\d"), "9"), (re.compile(r"(.)\1+"), r"\1\1")]
_END = re.compile(r"[\W_]*$")

#: Steps of shares of a text, and the value of the term for each, which stands for many words.
_SHARES, _TEXT_VALUE = (0.01, 0.05, 0.15, 0.3, 0.6), 6.0
_MARKS = np.frombuffer(b"#*$%&|<>!", np.uint8)


def _place(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) % PLACES


def word_places(w: str) -> tuple[int, int, int]:
    """Of a word: itself without case and marks, its shape, and the marks at its end."""
    end = _END.search(w).group()
    core = w[: len(w) - len(end)].lower()
    shape = w
    for pattern, by in _RUNS:
        shape = pattern.sub(by, shape)
    return _place("w" + core), _place("s" + shape), _place("e" + end)


class _Logs:
    """log(1 + n) of counts, as many as were asked for so far."""

    def __init__(self) -> None:
        self.values = np.log1p(np.arange(1024)).astype(np.float32)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            self.values = np.log1p(np.arange(2 * n)).astype(np.float32)
        return self.values


_LOGS = _Logs()


def whole(x: np.ndarray) -> np.ndarray:
    """Coordinates of at most 1 as whole numbers of 2**-SCALE, in floating point."""
    return np.rint(np.asarray(x, float) * (1 << SCALE))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; one of length 0 stays."""
    x = np.asarray(x, float)
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)


class Bags:
    """Weighted bags of terms of texts; remembers the places of words."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, int]] = {}

    def count(self, words: Words) -> np.ndarray:
        """Texts by places: logarithms of counts."""
        n = len(words.at) - 1
        coded = words.strings().dictionary_encode()
        places = []
        for w in coded.dictionary.to_pylist():
            p = self.known.get(w)
            if p is None:
                p = word_places(w)
                if len(self.known) < 3 * REMEMBERED:
                    self.known[w] = p
            places.append(p)
        code = coded.indices.to_numpy(zero_copy_only=False)
        of = np.array(places, np.int64).reshape(-1, 3)
        base = words.doc * PLACES
        cells = [base + of[code, k] for k in range(3)]
        flat = np.bincount(np.concatenate(cells), minlength=n * PLACES)
        out = _LOGS.upto(int(flat.max(initial=0)) + 1)[flat.reshape(n, PLACES)]
        again = np.zeros(len(code), bool)
        again[1:] = (code[1:] == code[:-1]) & (words.doc[1:] == words.doc[:-1])
        capital, marks = (words.data >= 65) & (words.data <= 90), np.isin(words.data, _MARKS)
        parts = (words.per_doc_words(again), words.counts), (words.per_doc(capital), np.diff(words.at)), (words.per_doc(marks), np.diff(words.at))
        rows = np.arange(n)
        for view, (part, whole) in zip("rcm", parts, strict=True):
            step = np.searchsorted(_SHARES, part / np.maximum(whole, 1), "right")
            out[rows, np.array([_place(f"{view}{k}") for k in step], np.int64)] += np.float32(_TEXT_VALUE)
        out[rows, np.array([_place(f"n{int(k + 1).bit_length() - 1}") for k in words.counts], np.int64)] += np.float32(1.0)
        return out


@dataclass
class Model:
    weight: np.ndarray  # of places
    space: np.ndarray  # places by latent dimensions, in whole numbers of 2**-SCALE
    vectors: np.ndarray  # of the sample, latent vectors of length 1, likewise
    labels: np.ndarray

    def latent(self, bags: np.ndarray) -> np.ndarray:
        """Latent vectors of length 1, in whole numbers of 2**-SCALE."""
        return whole(unit(whole(unit(bags * self.weight)) @ self.space))

    def scores(self, bags: np.ndarray, nearest: int = NEAREST, block: int = 128) -> np.ndarray:
        """Shares of label 1 among the nearest. Of equally near ones those first in the sample count, and votes are added from the nearest on."""
        n = len(self.labels)
        if not n:
            return np.full(len(bags), 0.5)
        k, out = min(nearest, n), np.zeros(len(bags))
        order, bits = np.arange(n)[::-1], n.bit_length()
        for a in range(0, len(bags), block):
            cosine = (self.latent(bags[a : a + block]) @ self.vectors.T).astype(np.int64)
            key = cosine * (1 << bits) + order  # one number for each neighbour, no two alike
            top = np.sort(np.partition(key, n - k, axis=1)[:, n - k :], axis=1)[:, ::-1]
            near = np.maximum((top >> bits) / float(1 << 2 * SCALE), 1e-3) ** SHARPNESS
            label = self.labels[n - 1 - (top & ((1 << bits) - 1))]
            total, ones = np.zeros(len(top)), np.zeros(len(top))
            for j in range(k):
                total += near[:, j]
                ones += near[:, j] * label[:, j]
            out[a : a + block] = ones / total
        return np.clip(out, 0, 1)


def latent_space(x: np.ndarray, size: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], size + 16)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    u, s, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :size]


def fit(train: DataFrame, latent: int = LATENT) -> Model:
    """The space and vectors of a bounded sample (text, y). Sparse bags of the sample come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags()
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                found = bags.count(words_of(part.column(0)))
                at = [np.flatnonzero(x).astype(np.uint16) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([i.tobytes() for i in at], pa.binary()), pa.array([x[i].tobytes() for x, i in zip(found, at, strict=True)], pa.binary()), part.column(1)], names=["place", "value", "y"])

    rows = sorted((bytes(r["place"]), bytes(r["value"]), r["y"]) for r in train.select("text", "y").mapInArrow(tidied(run), "place binary, value binary, y int").collect())
    x = np.zeros((len(rows), PLACES), np.float32)
    for i, (place, value, _) in enumerate(rows):
        x[i, np.frombuffer(place, np.uint16)] = np.frombuffer(value, np.float32)
    y = np.array([float(r[2] > 0) for r in rows])
    if not len(rows):
        return Model(np.ones(PLACES, np.float32), np.zeros((PLACES, 1)), np.zeros((0, 1)), y)
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
    space = whole(latent_space(unit(x * weight).astype(np.float32), min(latent, len(rows))))
    model = Model(weight, space, np.zeros((0, 1)), y)
    model.vectors = np.concatenate([model.latent(x[a : a + 512]) for a in range(0, len(x), 512)])
    return model


def learned(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Fitted on rows whose fold isn't the held-out one."""
    return fit(sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, most))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of the fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                for c in range(a, b, 256):
                    d = min(b, c + 256)
                    found = shared.value.scores(bags.count(words_of(batch.column(1).slice(c, d - c))))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(c, d - c), pa.array(found)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, score double")
