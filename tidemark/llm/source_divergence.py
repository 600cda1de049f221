"""How sources of a language differ, by exact counts of the terms in whole texts.

A term is a maximal run of letters A to Z and of characters beyond ASCII; only A to Z are lower-cased. Each shard, some
megabytes of texts in one Arrow buffer, is counted without a string for each occurrence: pointers to the starts of all
terms are sorted by a multikey quicksort whose characters are eight bytes wide (at each depth all slices of pointers that
are equal so far are parted by their next eight bytes at once; a slice is done when its term ends). A run of equal
pointers is a term; sorted by document within the run, it yields the document frequency and the count of each source.
Spark adds up the runs of all shards, on the map side first.

A term is kept in a language if at least `LEAST` of its documents hold it. Of kept terms each group (language and
source) and each language gives 1 + floor(10**9 * (count + 5) / (all counts + 5 * kept terms)), in whole numbers throughout.
Groups are compared by blocks of terms: the cells of a block are cogrouped with the totals of all sources of its language,
which fill in zeros, and each block returns its part of every sum and its own best terms. Sums of absolute differences add
up over blocks; the best terms of a group are among the best of its blocks.

Sizes: a block holds about `BLOCK` terms by all sources of a language, compared for `PART` of these sources at a time. Rows of
pairs are the square of the number of sources, as the report wants. A text longer than a shard is cut between terms and
its pieces are added up, so it counts as one document.

Defined cases: a null text, language or source is ''; repeated rows are documents of their own, ids are not read; a
language without kept terms has pairs of value 0 and no terms; a language of one source has no pairs; equal values are
ordered by the UTF-8 bytes of the item; an empty table gives an empty report; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import stored
from tidemark.llm.words import offsets, slices, tidied

LEAST, TOP, SCALE, PRIOR = 30, 50, 10**9, 5
SHARD_BYTES, BLOCK, PART = 8 << 20, 2048, 256
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def term_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the terms of texts that lie in data one after another; at: their offsets."""
    inside = _TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before = np.append(False, inside[:-1])
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.append(inside[1:], False)
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end


def wide_characters(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, the first being the highest. data ends with eight bytes more."""
    return np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))


def pointer_sort(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their terms' bytes, and where runs of equal terms begin.

    data ends with eight bytes more than the terms need. No term holds a zero byte, so the zeros after its end sort it
    before longer ones.
    """
    eight, n = wide_characters(data), len(start)

    def character(which: np.ndarray, depth: int) -> np.ndarray:
        at = start[which] + 8 * depth
        left = np.clip(end[which] - at, 0, 8).astype(np.uint64)
        keep = np.where(left == 8, ~np.uint64(0), ~(~np.uint64(0) >> (left * np.uint64(8))))
        return eight[np.minimum(at, len(eight) - 1)].astype(np.uint64) & keep

    key = character(np.arange(n), 0)
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1]) if n else np.zeros(0, bool)
    depth = 0
    goes_on = (key & np.uint64(255)) != 0
    while True:
        # slices of two pointers or more whose terms go on after this character
        equal = ~new
        equal[:-1] |= ~new[1:]
        open_ = np.flatnonzero(equal & goes_on)
        if not len(open_):
            return order, np.flatnonzero(new)
        depth += 1
        slice_ = np.cumsum(new)[open_]
        key = character(order[open_], depth)
        inner = np.lexsort((key, slice_))
        order[open_] = order[open_][inner]
        key = key[inner]
        goes_on[:] = False
        goes_on[open_] = (key & np.uint64(255)) != 0
        # a slice of equal wide characters lies whole in open_, in place
        new[open_[1:]] |= (key[1:] != key[:-1]) & (slice_[1:] == slice_[:-1])


def counted(column: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a shard by group of rows: the term, its group, its occurrences and the rows that hold it."""
    at = offsets(column)
    raw = column.buffers()[2]
    data = np.zeros(int(at[-1] - at[0]) + 8, np.uint8)
    if raw is not None:
        data[:-8] = _FOLD[np.frombuffer(raw, np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    start, end = term_starts(data[:-8], at)
    order, run = pointer_sort(data, start, end)
    rank = np.argsort(np.argsort(group, kind="stable"), kind="stable").astype(np.uint64)  # rows by group
    of_rank = np.sort(group)
    rows = np.uint64(len(column))
    doc = np.searchsorted(at, start, "right") - 1
    place = np.cumsum(np.bincount(run, minlength=len(order)))[: len(order)] - 1 if len(order) else order
    pair = np.sort(place.astype(np.uint64) * rows + rank[doc[order]])  # occurrences by run, then group, then row
    place, row = (pair // rows).astype(np.int64), (pair % rows).astype(np.int64) if len(pair) else np.zeros(0, np.int64)
    who = of_rank[row]
    cell = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (who[1:] != who[:-1]))) if len(pair) else row
    n = np.diff(np.append(cell, len(pair)))
    held = np.append(True, pair[1:] != pair[:-1]).astype(np.int64) if len(pair) else row
    docs = np.add.reduceat(held, cell) if len(cell) else cell
    one = order[run]  # a pointer of each run
    size = end[one] - start[one]
    begin = np.concatenate([[0], np.cumsum(size)])
    letters = data[np.arange(begin[-1]) - np.repeat(begin[:-1], size) + np.repeat(start[one], size)]
    terms = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(letters))
    return terms.take(pa.array(place[cell])), who[cell], n, docs


def pieces(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """One long text as texts of about `most` bytes, cut where no term is."""
    a, b = offsets(column)
    data = np.frombuffer(column.buffers()[2], np.uint8)[a:b]
    done = 0
    while done < len(data):
        stop = min(done + most, len(data))
        while stop < len(data):
            gap = np.flatnonzero(~_TERM[data[stop : stop + most]])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(stop + most, len(data))
        yield pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, stop - done])), pa.py_buffer(np.ascontiguousarray(data[done:stop])))
        done = stop


def shard_counts(docs: DataFrame, shard: int = SHARD_BYTES) -> DataFrame:
    """lang, source, term, n, df of every shard; a row with term '' and zeros names each group that occurs."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            for a, b in slices(text, shard):
                coded = [batch.column(i).slice(a, b - a).dictionary_encode() for i in (0, 1)]
                wide = max(1, len(coded[1].dictionary))
                group = coded[0].indices.to_numpy().astype(np.int64) * wide + coded[1].indices.to_numpy()
                part = text.slice(a, b - a)
                if b - a == 1 and int(np.diff(offsets(part))[0]) > 2 * shard:
                    table = None  # terms of one text so far
                    for piece in pieces(part, shard):
                        term, _, n, _ = counted(piece, group)
                        more = pa.table({"term": term, "n": n})
                        table = more if table is None else pa.concat_tables([table, more]).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
                    term, n = table.column("term").combine_chunks(), table.column("n").to_numpy()
                    who, df = np.full(len(n), group[0]), np.ones(len(n), np.int64)
                else:
                    term, who, n, df = counted(part, group)
                here = np.unique(group)
                who = np.concatenate([who, here])
                zeros = np.zeros(len(here), np.int64)
                term = pa.concat_arrays([term.cast(pa.string()), pa.array([""] * len(here), pa.string())])
                names = [coded[0].dictionary.take(pa.array(who // wide)), coded[1].dictionary.take(pa.array(who % wide))]
                yield pa.RecordBatch.from_arrays([*names, term, pa.array(np.concatenate([n, zeros])), pa.array(np.concatenate([df, zeros]))], names=["lang", "source", "term", "n", "df"])

    rows = docs.select(blank("lang"), blank("source"), blank("text"))
    return rows.mapInArrow(tidied(run), "lang string, source string, term string, n long, df long")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents) over all texts, and a row with term '' for each group."""
    return shard_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_counts(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n of terms in at least so many documents of the language, their total there, and whether the row is the first of its term."""
    of_term = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    rows = counts.withColumns({"held": F.sum("df").over(of_term), "total": F.sum("n").over(of_term), "lead": F.min("source").over(of_term) == F.col("source")})
    return rows.filter((F.col("held") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n", "total", (F.col("lead") & (F.col("term") != "")).cast("long").alias("lead"))


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / whole), exactly: long division by three digits a step, for wholes below 2**53."""
    rest, out = count + PRIOR, 0
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + step
    return out + 1


assert SCALE == 1000**3


def compared(cells: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
    """Of one block of terms: sums of differences by pair of sources, and the best terms of each source.

    cells: term, source, n, total; frame: every source of the language with mine (whether it is compared here), own (its
    count of kept terms), kept (terms of the language) and whole (their count in the language).
    """
    frame = frame.sort_values("source")
    names = frame["source"].to_numpy()
    code, terms = pd.factorize(cells["term"])
    n = np.zeros((len(terms), len(names)), np.int64)
    n[code, np.searchsorted(names, cells["source"].to_numpy())] = cells["n"]
    total = np.zeros(len(terms), np.int64)
    total[code] = cells["total"]
    prior = PRIOR * frame["kept"].to_numpy()
    p = share(n, frame["own"].to_numpy() + prior) if len(terms) else n
    q = share(total, frame["whole"].to_numpy()[0] + prior[0]) if len(terms) else total
    out = []
    for a in np.flatnonzero(frame["mine"].to_numpy()):
        others = np.arange(len(names)) != a
        apart = np.zeros(len(names), np.int64)
        for i in range(0, len(terms), 256):
            apart += np.abs(p[i : i + 256] - p[i : i + 256, a : a + 1]).sum(0)
        out.append(pd.DataFrame({"part": "pair", "source": names[a], "item": names[others], "value": apart[others]}))
        above = np.flatnonzero((n[:, a] > 0) & (p[:, a] > q))
        best = sorted(zip(-(p[above, a] - q[above]), terms[above], strict=True))[:TOP]
        out.append(pd.DataFrame({"part": "term", "source": names[a], "item": [t for _, t in best], "value": [-int(v) for v, _ in best]}))
    if not out:
        return pd.DataFrame({"lang": [], "part": [], "source": [], "item": [], "value": np.zeros(0, np.int64)})
    rows = pd.concat(out)
    return rows.assign(lang=frame["lang"].iloc[0])[["lang", "part", "source", "item", "value"]]


def audit(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, part, item, value, rank: each source against every other of its language, and its own terms."""
    kept = stored(kept_counts(term_counts(docs), least))
    of_lang = Window.partitionBy("lang")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.sum("lead").alias("lead"), F.sum(F.col("lead") * F.col("total")).alias("led"))
    groups = groups.select("lang", "source", "own", F.sum("lead").over(of_lang).alias("kept"), F.sum("led").over(of_lang).alias("whole"), F.count("*").over(of_lang).alias("sources"))
    groups = stored(groups)
    size = groups.agg(F.coalesce(F.max("kept"), F.lit(0)).alias("terms"), F.coalesce(F.max("sources"), F.lit(0)).alias("sources")).first()
    blocks, parts = max(1, -(-size["terms"] // BLOCK)), max(1, -(-size["sources"] // PART))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = kept.filter("term <> ''").select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), each(parts).alias("piece"), "term", "source", "n", "total")
    mine = F.pmod(F.xxhash64("source"), F.lit(parts)) == F.col("piece")
    frame = groups.withColumn("block", each(blocks)).withColumn("piece", each(parts)).select("lang", "block", "piece", "source", mine.alias("mine"), "own", "kept", "whole")
    keys = ("lang", "block", "piece")
    found = cells.groupBy(*keys).cogroup(frame.groupBy(*keys)).applyInPandas(compared, "lang string, part string, source string, item string, value long")
    found = stored(found)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    of_group = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(of_group))
    terms = ranked(found.filter("part = 'term'").select("lang", "source", "part", "item", "value")).filter(F.col("rank") <= TOP)
    return ranked(pairs).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
