"""Quality rules with robust multivariate outliers.

Each text becomes a vector of transformed statistics. For each language and source a minimum
covariance determinant (MCD) estimate of centre and scatter is made over all of its rows, and rows
whose Mahalanobis distance to it is too large are rejected.

Estimates are made on three levels: of all rows, of each language, of each language and source. A cell
of n rows takes its own centre with weight n / (n + 4) and its own scatter, which takes more rows to know, with
n / (n + 40) (`PRIOR`), and those of the level above with the rest, in every step; the scatter of all rows is shrunk to
a fixed one likewise. So a cell of any size has an estimate, and a row alone cannot vouch for itself.

The estimate is distributed. It begins at coordinatewise medians and median deviations, then takes
concentration steps: one pass puts every row in a bin of its distance and sums moments by cell and
bin on the map side; the nearest bins that hold a share `support` of a cell, the last of them in part, give the
next centre and scatter. Nothing but these sums (at most `BINS` rows a cell) leaves a partition, so a source with a
third of all rows costs no more than any other. A cell is done when the logarithm of its determinant changes by less
than `SETTLED`, which moves distances by a quarter of a percent; one that still moves after `steps` steps is told by `settled`.

Defined cases: a null text is empty; null lang or source is a group of its own; equal rows get equal
verdicts and all stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import cut, stored
from tidemark.llm.words import SPACE, Ranges, Words, covered, mix, slices, tidied, words_of

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The coordinates of a vector, all but the first shrunk towards a fixed value so that short texts are not outliers by chance.
COORDINATES = ("length", "word_length", "symbols", "capitals", "repeats", "dup_lines", "stutter", "digits")
P = len(COORDINATES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
BINS, STEPS = 256, 12
#: How many rows the level above weighs in the centre and in the scatter, and the change of a log-determinant at which a cell is settled.
PRIOR, SETTLED = (4.0, 40.0), 0.02
#: Least standard deviation of each coordinate: a cell whose rows agree in one isn't singular.
FLOOR = (0.2, 0.15, 0.03, 0.05, 0.3, 0.2, 0.1, 0.1)
#: Standard deviations to which the scatter of all rows is shrunk.
WIDE = tuple(5 * f for f in FLOOR)
WINDOW = 8
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_CAPITAL_AFTER_C3 = (np.arange(256) >= 0x80) & (np.arange(256) <= 0x9E)


def dup_lines(column: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    split = pc.split_pattern(column.fill_null(""), "\n")
    doc = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(split).dictionary_encode()
    worded = np.append(pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False), False)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = worded[code]
    doc, code = doc[keep], code[keep]
    distinct = np.unique(doc * (len(coded.dictionary) + 1) + code) // (len(coded.dictionary) + 1)
    return np.bincount(doc, minlength=len(column)) - np.bincount(distinct, minlength=len(column))


def repeat_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words in windows of eight that occur twice or more in their text."""
    start, found = Ranges(hashes).windows(words.first, WINDOW)
    if not len(start):
        return np.zeros(len(words.at) - 1, np.int64)
    key = mix(found + words.doc[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return words.per_doc_words(covered(start[twice], WINDOW, len(words.start)))


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, and its vector."""
    words = words_of(column)
    data, hashes = words.data, words.hashes()
    points = ~SPACE[data] & ((data & 0xC0) != 0x80)
    capital = _CAPITAL[data]
    if len(data) > 1:
        capital[1:] |= (data[:-1] == 0xC3) & _CAPITAL_AFTER_C3[data[1:]]
    out = {
        "n_words": words.counts,
        "word_chars": words.per_doc(points),
        "n_symbols": words.per_doc(_SYMBOL[data]),
        "n_dup_lines": dup_lines(column),
        "n_repeat_words": repeat_words(words, hashes),
    }
    n, chars = out["n_words"].astype(float), out["word_chars"].astype(float)
    share = lambda part, whole, prior, weight: np.arcsin(np.sqrt(np.clip((part + prior * weight) / (whole + weight), 0, 1)))
    lines = 1 + words.per_doc(data == 10)
    stutter = np.zeros(len(hashes), bool)  # words that equal the one before
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    vector = (
        np.log1p(n),
        (chars + 5.5 * 50) / (n + 50),
        share(out["n_symbols"], chars, 0.0, 100),
        share(words.per_doc(capital), chars, 0.02, 200),
        share(out["n_repeat_words"], n, 0.0, 60),
        share(out["n_dup_lines"], lines, 0.0, 10),
        share(words.per_doc_words(stutter), n, 0.0, 30),
        share(words.per_doc(_DIGIT[data]), chars, 0.0, 200),
    )
    return out | {f"x{i}": v for i, v in enumerate(vector)}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts and the vector (x0, x1, ...) of every whole text."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS) + ", " + ", ".join(f"x{i} double" for i in range(P))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(3)
            for a, b in slices(text):
                found = text_statistics(text.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(a, b - a) for k in range(3)] + [pa.array(v) for v in found.values()],
                    names=["doc_id", "lang", "source", *found],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(tidied(run), schema)


def distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of x0.. to a state's m0.. under its inverse Cholesky factor l00.."""
    total = None
    for i in range(P):
        z = sum((F.col(f"{prefix}l{i}{j}") * (F.col(f"x{j}") - F.col(f"{prefix}m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = z * z if total is None else total + z * z
    return total


#: moments and above: P means, then the scatter by PAIRS, of the cell and of the level above; inverse: the inverse Cholesky factor.
STATE = "cell string, n long, logdet double, change double, moments array<double>, inverse array<double>, above array<double>"
_LOW = tuple(np.array(PAIRS).T)


def square(values: np.ndarray) -> np.ndarray:
    """The symmetric matrix of its lower half."""
    out = np.zeros((P, P))
    out[_LOW] = values
    return out + np.tril(out, -1).T


def shrunk(n: int, mean: np.ndarray, cov: np.ndarray, above: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of n rows with those of the level above; without one, a fixed scatter around the own centre."""
    centre, scatter = (n / (n + k) for k in PRIOR)
    up_mean = mean if above is None else above[:P]
    up_cov = np.diag(np.square(WIDE)) if above is None else square(above[P:])
    return centre * mean + (1 - centre) * up_mean, scatter * cov + (1 - scatter) * up_cov


def next_state(support: float):
    """From the binned moments of a cell, and its state before, to its next centre and scatter."""
    # Scatter of the nearest share of a Gaussian, made consistent: its ratio in each direction is F(q, p + 2) / support.
    factor = support / chi2_cdf(chi2_quantile(support, P), P + 2)

    def run(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:  # done before
            return state
        rows = rows.sort_values("bin")
        count = rows["c"].to_numpy()
        n = int(count.sum())
        # How much of each bin lies in the nearest share: the last one counts in part, so that no step jumps by a bin.
        part = np.clip((support * n - (np.cumsum(count) - count)) / count, 0, 1) / (support * n)
        sums = part @ np.stack(rows["sums"])
        mean = sums[:P]
        cov = square(sums[P:]) - np.outer(mean, mean)
        w, v = np.linalg.eigh(cov * factor)
        above = state["above"].iloc[0]
        mean, cov = shrunk(n, mean, (v * np.maximum(w, 0)) @ v.T, above)
        low = np.linalg.cholesky(cov + np.diag(np.square(FLOOR)) * 0.25)
        logdet = 2 * np.log(np.diag(low)).sum()
        moments, inverse = np.concatenate([mean, cov[_LOW]]), np.linalg.inv(low)[_LOW]
        change = abs(logdet - state["logdet"].iloc[0])
        return pd.DataFrame({"cell": state["cell"].to_numpy(), "n": n, "logdet": logdet, "change": change, "moments": [moments], "inverse": [inverse], "above": [above]})

    return run


def chi2_cdf(x: float, k: int) -> float:
    """For even k: one less a finite sum."""
    import math

    term, total = 1.0, 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def levels() -> tuple[Column, ...]:
    """The cells of a row, each the parent of the next; a null is told from an empty name by its absence."""
    return F.lit("{}"), F.to_json(F.struct("lang")), F.to_json(F.struct("lang", "source"))


def placed(state: DataFrame) -> DataFrame:
    """What `distance` reads of a state, by cell."""
    return state.select("cell", *(F.col("moments")[i].alias(f"m{i}") for i in range(P)), *(F.col("inverse")[k].alias(f"l{i}{j}") for k, (i, j) in enumerate(PAIRS)))


def estimates(rows: DataFrame, above: DataFrame | None = None, support: float = 0.75, steps: int = STEPS) -> DataFrame:
    """MCD state of each cell, shrunk to the state of its parent. rows: cell, parent and x0.., stored; above: states of the parents."""
    middle = cut(rows.groupBy("cell").agg(F.first("parent").alias("parent"), F.count("*").alias("n"), *(F.percentile_approx(f"x{i}", 0.5, 2000).alias(f"m{i}") for i in range(P))))
    spread = rows.drop("parent").join(middle, "cell").groupBy("cell").agg(*(F.first(c).alias(c) for c in ("parent", "n", *(f"m{i}" for i in range(P)))), *(F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 2000).alias(f"d{i}") for i in range(P)))
    if above is None:
        spread = spread.withColumn("above", F.lit(None).cast("array<double>"))
    else:
        spread = spread.join(above.select(F.col("cell").alias("parent"), F.col("moments").alias("above")), "parent")
    deviation = [F.greatest(F.col(f"d{i}") * 1.4826, F.lit(FLOOR[i])) for i in range(P)]
    zero = F.lit(0.0)
    moments = F.array(*(f"m{i}" for i in range(P)), *(deviation[i] * deviation[i] if i == j else zero for i, j in PAIRS))
    inverse = F.array(*(1 / deviation[i] if i == j else zero for i, j in PAIRS))
    state = cut(spread.select("cell", "n", zero.alias("logdet"), F.lit(float("inf")).alias("change"), moments.alias("moments"), inverse.alias("inverse"), "above"))
    for _ in range(steps):
        near = rows.join(placed(state.filter(F.col("change") >= SETTLED)), "cell").withColumn("bin", F.least(F.lit(BINS - 1), F.floor(16 * F.log2(1 + distance()))).cast("int"))
        sums = near.groupBy("cell", "bin").agg(F.count("*").alias("c"), F.array(*(F.sum(f"x{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in PAIRS)).alias("sums"))
        # Sums of all tasks meet by cell and bin first; then a cell has no more rows than there are bins.
        state = cut(cut(sums).groupBy("cell").cogroup(state.groupBy("cell")).applyInPandas(next_state(support), STATE))
        moved = state.agg(F.max("change")).first()[0]
        if moved is None or moved < SETTLED:
            break
    return state


def judge(docs: DataFrame, support: float = 0.75, tail: float = 1e-7, slack: float = 2.0) -> DataFrame:
    """Every row's counts, base_failed, squared distance to its cell's estimate, whether that is settled, and kept.

    A row is rejected beyond `slack` times the chi-squared quantile of 1 - tail; slack allows for coordinates
    that are no exact Gaussians.
    """
    rows = stored(statistics(docs))
    state, parent = None, F.lit(None).cast("string")
    for cell in levels():
        state = estimates(rows.select(cell.alias("cell"), parent.alias("parent"), *(f"x{i}" for i in range(P))), state, support)
        parent = cell
    limit = slack * chi2_quantile(1 - tail, P)
    final = placed(state).join(state.select("cell", (F.col("change") < SETTLED).alias("settled")), "cell")
    judged = rows.withColumn("cell", levels()[-1]).join(final, "cell", "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "lang", "source", *STATS, failed.alias("base_failed"), distance().alias("distance2"), "settled").withColumn("kept", ~F.col("base_failed") & (F.col("distance2") <= limit))
