"""Near-duplicate classes by DartMinHash signatures of word shingles.

A text is the weighted set of its five-word shingles, weighted by how often each occurs (a text of fewer
words is one shingle). Hashed darts fall on the plane of weight and rank above each element as a Poisson
process that depends on the element alone; those below the element's weight and a rank that suits the
text's total weight count, and the earliest in each coordinate is the signature: two texts agree in a
coordinate with their weighted Jaccard similarity as probability. A text that leaves a coordinate empty
throws to twice the rank. Bands of coordinates are joined, never paired: in each band bucket every text is
linked to the bucket's center, the text that meets most others, and links are verified on the whole shingle sets.
Classes are connected components of verified links. Where a bucket still holds several components, all its texts
are compared with each other on the whole sets, block by block, but for those of one component: every two texts
that share a band are compared or in one class by then.

A text is known by the MD5 of its bytes, 128 bits that Spark computes, never by its doc_id.

Defined cases: equal texts are one class whatever they hold and are never compared; a null text is a class
of its own and meets no join; a text without words has no shingle and equals only equal texts; rows that share a
doc_id and differ in text are judged each by its own text; a class is named by its least doc_id; repeated rows all
stay, in one class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import free, stored
from tidemark.llm.words import Ranges, mix, slices, tidied, window_starts, words_of

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 36, 6
K = BANDS * ROWS
_NONE = np.zeros(0, np.uint64)
_A, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of some texts, and the text of each."""
    words = words_of(column)
    ranges = Ranges(words.hashes())
    count = words.counts
    start = window_starts(words.first, SHINGLE)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    value = np.concatenate([ranges.hashes(start, start + SHINGLE), ranges.hashes(words.first[short], words.first[short + 1])])
    doc = np.concatenate([words.doc[start], short])
    order = np.lexsort((value, doc))
    return value[order], doc[order]


def weighted(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of sorted shingles: value, text, count."""
    if not len(value):
        return value, doc, np.zeros(0)
    new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))
    at = np.flatnonzero(new)
    return value[at], doc[at], np.diff(np.append(at, len(value))).astype(float)


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(value: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """The earliest accepted dart of each coordinate: n texts by k; zeros for a text without elements.

    Regions of an element split its weight at 1, 2, 4, ...; in a region of some width, ranks of darts are the
    arrivals of a Poisson process of that rate, and each dart has a uniform weight in the region.
    """
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(doc, weight, minlength=n)
    todo = total > 0
    darts = k * (np.log(k) + 2)
    while todo.any():
        use = todo[doc]
        v, d, w = value[use], doc[use], weight[use]
        layers = 1 + np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64)
        at = np.repeat(np.arange(len(v)), layers)
        layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
        width = np.where(layer == 0, 1.0, 2.0 ** (layer - 1.0))
        low = np.where(layer == 0, 0.0, width)
        seed = mix(v[at] + layer.astype(np.uint64) * _C)
        d, w = d[at], w[at]
        limit = darts / total[d]
        rank = np.zeros(len(at))
        best = np.full(n * k, np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        done, block = 0, 1
        while len(seed):
            number = np.arange(done + 1, done + block + 1, dtype=np.uint64)
            h = mix(seed[:, None] + number[None, :] * _A)
            ranks = rank[:, None] + np.cumsum(-np.log(_uniform(h)) / width[:, None], axis=1)
            inside = (ranks < limit[:, None]) & (low[:, None] + width[:, None] * _uniform(mix(h ^ _C)) <= w[:, None])
            row, col = np.nonzero(inside)
            name = mix(h[row, col] ^ _D)
            slot = d[row] * k + (name % np.uint64(k)).astype(np.int64)
            r = ranks[row, col]
            np.minimum.at(best, slot, r)
            found.append((slot, r, name))
            rank = ranks[:, -1]
            go = rank < limit
            seed, d, w, width, low, limit, rank = seed[go], d[go], w[go], width[go], low[go], limit[go], rank[go]
            done += block
            block = max(1, min(256, block * 4, (1 << 18) // max(len(seed), 1)))
        flat = out.reshape(-1)
        for slot, r, name in found:
            first = best[slot] == r
            flat[slot[first]] = name[first]
        todo &= ~np.isfinite(best.reshape(n, k)).all(axis=1)
        darts *= 2
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band's coordinates and number."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    out = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64) * _C, (n, k // rows)).copy()
    for i in range(rows):
        out = mix(out * _A + parts[:, :, i])
    return out


def text_key(text: Column) -> Column:
    """128 bits of a text; null for null."""
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (null for a null text) and bands of every whole text (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            for a, b in slices(text):
                value, doc, weight = weighted(*shingles(text.slice(a, b - a)))
                found = bands(signatures(value, doc, weight, b - a)).view(np.int64)
                empty = np.bincount(doc, minlength=b - a) == 0
                rows = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(found.reshape(-1)), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), rows], names=["doc_id", "key", "bands"])

    return keyed(docs).mapInArrow(tidied(run), "doc_id long, key binary, bands array<long>")


def elements(texts: DataFrame) -> DataFrame:
    """key and the shingles of each row (key, text), a shingle's nth occurrence as an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for a, b in slices(text):
                value, doc = shingles(text.slice(a, b - a))
                if len(value):
                    new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))
                    at = np.flatnonzero(new)
                    nth = np.arange(len(value)) - np.repeat(at, np.diff(np.append(at, len(value))))
                    value = mix(value + nth.astype(np.uint64) * _D)
                    value = value[np.lexsort((value, doc))]
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]) * 8
                sets = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(value)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], names=["key", "elements"])

    return texts.select("key", "text").mapInArrow(tidied(run), "key binary, elements binary")


def similarity(a: bytes | pa.Buffer, b: bytes | pa.Buffer) -> float:
    """Weighted Jaccard similarity of two packed sets."""
    x, y = np.frombuffer(a, np.uint64) if len(a) else _NONE, np.frombuffer(b, np.uint64) if len(b) else _NONE
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(both) - common)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """pairs (key, center) with similar: whether their sets are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column(2), batch.column(3)  # read where they lie: sets are never copied
            fits = [similarity(one[i].as_buffer(), other[i].as_buffer()) >= least for i in range(len(one))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fits, pa.bool_())], names=["key", "center", "similar"])

    both = pairs.join(sets, "key").join(sets.select(F.col("key").alias("center"), F.col("elements").alias("other")), "center")
    return both.select("key", "center", "elements", "other").mapInArrow(tidied(run), "key binary, center binary, similar boolean")


def starred(rows: DataFrame) -> DataFrame:
    """Band rows (band, key) of buckets of several texts, with center: the bucket's text that meets most others over all its bands.

    Of an original and its copies that is the original, even where the copies are not near each other.
    """
    size = rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    open_ = stored(rows.join(size, "band"))
    met = open_.groupBy("key").agg(F.sum("n").alias("met"))
    center = open_.join(met, "key").groupBy("band").agg(F.max_by("key", F.struct("met", "key")).alias("center"))
    return open_.select("band", "key").join(center, "band")


#: Steps of components where labels only tell what need not be verified.
FEW = 2
#: Texts and bytes of a block, about: the blocks of a bucket are compared two by two.
BLOCK, BYTES = 512, 2 << 20


def blocks(both: DataFrame) -> DataFrame:
    """Rows (band, key, label, bands, elements) of buckets, once for each block of the bucket, with i and j, the two blocks, and side, the row's own."""
    size = both.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length("elements")) / BYTES)).cast("int").alias("n"))
    side = F.pmod(F.xxhash64("key"), F.greatest("n", F.lit(1))).cast("int")
    dealt = both.join(size, "band").withColumn("side", side).withColumn("other", F.explode(F.expr("sequence(0, greatest(n, 1) - 1)")))
    return dealt.select("band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "key", "label", "bands", "elements")


def linking(band: int, rows: list[dict], apart: bool, least: float) -> Iterator[tuple[bytes, bytes]]:
    """Links of two blocks (of one, unless they are apart) that join labels: every pair of different labels is compared but for those that earlier links join.

    A pair that shares an earlier band is compared there.
    """
    rows = sorted(rows, key=lambda r: r["side"])
    own = [np.frombuffer(r["elements"], np.uint64) for r in rows]
    size = np.array([len(x) for x in own])
    names: dict[bytes, int] = {}
    label = np.array([names.setdefault(r["label"], len(names)) for r in rows])
    found = np.array([r["bands"] for r in rows], np.int64)
    earlier = found[:, : int(np.flatnonzero(found[0] == band)[0])]
    side = np.array([r["side"] for r in rows])
    first = int((side == side[0]).sum()) if apart else len(rows)
    if apart and first == len(rows):
        return
    value = np.concatenate(own)
    order = np.argsort(value, kind="stable")
    holder = np.repeat(np.arange(len(rows)), size)[order]
    value = value[order]
    at = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    value, at = value[at], np.append(at, len(holder))
    for x in range(first):
        a = first if apart else x + 1
        open_ = np.flatnonzero((label[a:] != label[x]) & (np.minimum(size[a:], size[x]) >= least * np.maximum(size[a:], size[x]))) + a
        open_ = open_[~(earlier[open_] == earlier[x]).any(axis=1)]
        if not len(open_):
            continue
        where = np.searchsorted(value, own[x])
        times = at[where + 1] - at[where]
        ends = np.cumsum(times)
        common = np.bincount(holder[np.arange(ends[-1]) + np.repeat(at[where] - (ends - times), times)], minlength=len(rows))[open_]
        for y in open_[common / np.maximum(1, size[open_] + size[x] - common) >= least]:
            if label[y] != label[x]:
                yield rows[x]["key"], rows[y]["key"]
                label[label == label[y]] = label[x]


def compared(rows: DataFrame, least: float) -> DataFrame:
    """Links (key, center) of rows of `blocks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            links = list(linking(name[0], held, name[1] != name[2], least))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["key", "center"])

        name, held = None, []
        for batch in batches:
            for row in (row for a in range(0, len(batch), 128) for row in batch.slice(a, 128).to_pylist()):
                if (row["band"], row["i"], row["j"]) != name:
                    if held:
                        yield done()
                    name, held = (row["band"], row["i"], row["j"]), []
                held.append(row)
        if held:
            yield done()

    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(tidied(run), "key binary, center binary").distinct()


def only(rows: DataFrame, id_: Column, chosen: DataFrame) -> DataFrame:
    """rows whose (key, id) is a row (key, least_id) of chosen. Copies of a text are dealt by their ids, so that they never meet in one task."""
    named_ = lambda c: [c.isNull().alias("no_id_"), F.coalesce(c, F.lit(0)).alias("id_")]
    of = named_(id_)
    return rows.withColumns({"no_id_": of[0], "id_": of[1]}).join(chosen.select("key", *named_(F.col("least_id"))), ["key", "no_id_", "id_"], "left_semi").drop("no_id_", "id_")


def linked(docs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """key and label of texts with verified links. texts: key, bands and least_id, a row for each text."""
    reps = texts.filter(F.col("bands").isNotNull()).select("key", "bands")
    open_ = stored(starred(reps.select("key", F.explode("bands").alias("band"))))
    nodes = texts.select("key", "least_id").join(open_.select("key").distinct(), "key", "left_semi")
    # The shingle sets of texts that share a bucket with another, from one row of each text (rows can repeat).
    one = only(keyed(docs).filter("key IS NOT NULL"), F.col("doc_id"), nodes)
    sets = stored(elements(one).groupBy("key").agg(F.first("elements").alias("elements")))
    # First each text with the center that it shares most bands with; then with others, but for those of its component by then.
    pairs = open_.filter("key <> center").groupBy("key", "center").agg(F.count("*").alias("n"))
    best = stored(pairs.groupBy("key").agg(F.max_by("center", F.struct("n", "center")).alias("center")))
    first = stored(verified(best, sets, least).filter("similar").select("key", "center"))
    labels = components(first, FEW)
    rest = pairs.select("key", "center").join(best, ["key", "center"], "left_anti").join(labels, "key", "left").withColumnRenamed("label", "own")
    rest = rest.join(labels.withColumnRenamed("key", "center"), "center", "left").filter("coalesce(own, key) <> coalesce(label, center)")
    found = stored(first.union(verified(rest.select("key", "center"), sets, least).filter("similar").select("key", "center")))
    free(best, first, labels)
    labels = components(found)
    # Then all texts of a bucket that still holds several components, with each other.
    rows = open_.join(labels, "key", "left").select("band", "key", "center", F.coalesce("label", "key").alias("label"))
    several = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high AND n > 2").select("band")
    rows = stored(rows.join(several, "band").join(reps, "key").select("band", "key", "label", "bands"))
    free(open_)
    dealt = stored(rows.join(sets, "key"))
    free(sets, rows)
    links = stored(compared(blocks(dealt), least))
    free(dealt)
    if links.isEmpty():
        return labels
    both = stored(found.union(links))
    free(labels, found, links)
    return components(both)


def components(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """key and label, the least key that links lead to, for every key in pairs (key, center).

    After `most` steps, if given, a component can still have several labels; equal labels always mean one component.
    """
    both = stored(pairs.union(pairs.select("center", "key")).distinct().toDF("key", "other"))
    labels = both.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("label"))
    labels = stored(labels)
    for step in count(1):
        near = both.join(labels.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.min("label").alias("near"))
        stepped = labels.join(near, "key").select("key", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("key").alias("next"), F.col("label").alias("far"))
        after = stored(stepped.join(jump, "next", "left").select("key", F.least("next", F.coalesce("far", "next")).alias("label"), "old"))
        free(labels)
        labels = after
        if step == most or after.filter("label <> old").isEmpty():
            free(both)
            labels = after.drop("old")
            labels.stored_at = after.stored_at
            return labels


def named(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """doc_id and key of every row; and of each text key, class_id and class_rows, with first_id and first_key of the row that stands for its class.

    Both are stored. Copies are counted by text before anything else, so that a text of many rows is one row in all that follows.
    """
    sig = stored(signed(docs))
    texts = stored(sig.filter("key IS NOT NULL").groupBy("key").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    labels = linked(docs, texts, least)
    rows = texts.select("key", "least_id", "n").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    # Of texts alone in their class nothing is looked up; a large class is one row on the other side of its join.
    first = F.min(F.struct(F.col("least_id").isNull().alias("without"), F.col("least_id").alias("id"), F.col("key").alias("key")))
    classes_ = rows.groupBy("label").agg(first.alias("first"), F.sum("n").alias("class_rows"))
    out = rows.join(classes_, "label").select("key", F.col("first.id").alias("class_id"), "class_rows", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"))
    out = stored(out)
    free(labels, texts)
    return sig.select("doc_id", "key"), out


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and class_rows of every row."""
    rows, texts = named(docs, least)
    out = rows.filter("key IS NOT NULL").join(texts, "key").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "class_rows")
    return out.union(rows.filter("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long")))


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of its least doc_id, of several such the least text key, of equal ones the least by a hash of its columns.

    Every other row goes, with or without an id; a row without a text is a class of its own and stays.
    """
    _, texts = named(docs, least)
    first = texts.filter(F.col("key") == F.col("first_key")).select("key", F.col("first_id").alias("least_id"))
    row = F.struct(*(F.col(c) for c in docs.columns))
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    rows = docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*plain).alias("rank"), row.alias("row"))
    kept = only(rows.filter("key IS NOT NULL"), F.col("doc_id"), first).groupBy("key", "doc_id").agg(F.min_by("row", "rank").alias("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns)).unionByName(docs.filter(F.col("text").isNull()))
