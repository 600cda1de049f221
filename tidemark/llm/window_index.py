"""Repeated passages by a log-structured index of window fingerprints.

A window is 35 consecutive words of one text. Every window names one of its eight-word grams, the one of
least hash (the leftmost of equals), so equal windows name equal grams at equal places. Consecutive windows
that name the same gram at the same position form a segment, at most 28 windows; its fingerprint is the
gram's hash and the hash of all words that it covers.

Each batch of texts becomes an immutable run of distinct fingerprints with their counts and the place of one example,
dealt and sorted by gram. A new run is merged with the runs before it by gram, in one shuffle of the runs. A segment
whose fingerprint is found twice, in the batch or in history, holds repeated windows only. A segment of its own whose
gram others name too is verified window by window, by 96 bits of the words, against one segment of each other fingerprint
of that gram; texts of history that hold these are read again. What a batch shows is kept as marks of the
batch's texts and of texts of history. Where there are too many runs they are compacted into one. Counts add up, so
compaction loses nothing, and marks after any number of batches are those of one batch of all texts.

Runs, packed texts and marks lie under the index's path; an index that is opened there later goes on with them. A run
names the batches that it holds, and one that another covers is left out, so a compaction that was broken off does no harm.

Defined cases: a null text has no words; texts shorter than a window lose nothing; windows of one text may
repeat each other; repeated rows repeat each other's windows and all stay; rows without an id are told apart by 64 bits
of their texts; an empty table or batch gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import folder, free, stored
from tidemark.llm.words import SLICE_BYTES, Ranges, Words, covered, mix, slices, tidied, window_starts, words_of

WINDOW, GRAM = 35, 8
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def segments(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window (word numbers), gram hash and hash of the covered words of each segment."""
    values = words.hashes()
    ranges = Ranges(values)
    none = np.zeros(0, np.int64)
    starts = window_starts(words.first, WINDOW)
    if not len(starts):
        return none, none, none, none
    n = len(values) - GRAM + 1
    at = np.arange(n)
    grams = ranges.hashes(at, at + GRAM)
    # Least of each span of windows: hash and place in one number, places in the low bits.
    low = np.uint64((1 << 28) - 1)
    least = (grams & ~low) | at.astype(np.uint64)
    span, have = WINDOW - GRAM + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    place = (least[starts] & low).astype(np.int64)
    new = np.append(True, (np.diff(place) != 0) | (np.diff(starts) != 1))
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
    gram = grams[place[new]]
    # The gram's place in the segment counts too: equal words with another place are another segment.
    whole = ranges.hashes(first, last + WINDOW) ^ mix((place[new] - first).astype(np.uint64) + _SECOND)
    return first, last, gram.view(np.int64), whole.view(np.int64)


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), text; the first two name a row, or rows that are alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def scanned(rows: DataFrame) -> DataFrame:
    """doc_id, h and for each segment: gram, whole, and at, its first window times 32 plus the windows that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            for a, b in slices(text):
                words = words_of(text.slice(a, b - a))
                first, last, gram, whole = segments(words)
                doc = words.doc[first] if len(first) else first
                take = pa.array(doc)
                at = ((first - words.first[doc]) << 5) | (last - first) if len(first) else first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(take), batch.column(1).slice(a, b - a).take(take), pa.array(gram), pa.array(whole), pa.array(at)], names=["doc_id", "h", "gram", "whole", "at"])

    return rows.mapInArrow(tidied(run), "doc_id long, h long, gram long, whole long, at long")


def combined(scan: DataFrame) -> DataFrame:
    """gram, whole, n and an example's doc_id, h and at: segments of one fingerprint in one Arrow batch are one row, so that a passage of very many texts is few rows of a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, whole = (batch.column(i).to_numpy() for i in (2, 3))
            order = np.lexsort((whole, gram))
            gram, whole = gram[order], whole[order]
            at = np.flatnonzero(np.append(True, (np.diff(gram) != 0) | (np.diff(whole) != 0))) if len(order) else order
            n = np.diff(np.append(at, len(order)))
            one = pa.array(order[at])
            yield pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(whole[at]), pa.array(n), *(batch.column(i).take(one) for i in (0, 1, 4))], names=["gram", "whole", "n", "doc_id", "h", "at"])

    return scan.select("doc_id", "h", "gram", "whole", "at").mapInArrow(tidied(run), "gram long, whole long, n long, doc_id long, h long, at long")


EXAMPLE = "struct<h: bigint, at: bigint, doc_id: bigint>"
IDENTITY = ["doc_id", "h"]


class WindowIndex:
    """Runs (gram, whole, n, example), packed texts and marks under a path; `add` takes batches of rows of `narrow`."""

    def __init__(self, spark: SparkSession, path: str, most_runs: int = 4) -> None:
        self.spark, self.path, self.most_runs = spark, path.rstrip("/"), most_runs
        self.files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, kind: str) -> list[str]:
        """Complete parts of a kind, in order."""
        if not self.files.exists(self._at("")):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(self._at(""))]
        return sorted(n for n in names if n.startswith(kind + "-") and self.files.exists(self._at(f"{n}/_SUCCESS")))

    def runs(self) -> list[str]:
        """Runs that no other covers; a name tells its first and last batch."""
        spans = {n: tuple(map(int, re.findall("[0-9]+", n))) for n in self._names("run")}
        return [n for n, (a, b) in spans.items() if not any(m != n and c <= a and b <= d for m, (c, d) in spans.items())]

    def _runs_of(self, names: list[str]) -> DataFrame:
        """gram, whole, n, example and run of some runs."""
        rows = (self.spark.read.schema(f"gram long, whole long, n long, example {EXAMPLE}").parquet(f"{self.path}/{n}").withColumn("run", F.lit(n)) for n in names)
        return reduce(DataFrame.union, rows)

    def _write(self, entries: DataFrame, first: int, last: int) -> str:
        run = f"run-{first:06d}-{last:06d}"
        # Rows of one fingerprint meet where their gram is dealt to: one shuffle.
        rows = entries.select("gram", "whole", "n", F.col("example").cast(EXAMPLE).alias("example")).repartition("gram")
        self._keep(rows.groupBy("gram", "whole").agg(F.sum("n").alias("n"), F.min("example").alias("example")).sortWithinPartitions("gram"), run)
        return run

    def _keep(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")

    def _read(self, kind: str, schema: str) -> DataFrame:
        names = self._names(kind)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def texts(self) -> DataFrame:
        """doc_id, h, z of every row of every batch."""
        return self._read("texts", "doc_id long, h long, z binary")

    def marks(self) -> DataFrame:
        """doc_id, h of texts with repeated windows; sure: repeated segments; found: single windows."""
        rows = self._read("marks", "doc_id long, h long, sure array<long>, found array<int>")
        flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        return rows.groupBy(*IDENTITY).agg(flat("sure"), flat("found"))

    def entries(self, runs: list[str] | None = None) -> DataFrame:
        """Runs merged: one row for each fingerprint."""
        rows = self._runs_of(self.runs() if runs is None else runs)
        return rows.repartition("gram").groupBy("gram", "whole").agg(F.sum("n").alias("n"), F.min("example").alias("example"))

    def add(self, rows: DataFrame) -> None:
        """Joins a batch with history, marks the texts of both that hold what the other or itself repeats, and keeps its run."""
        old, number = self.runs(), len(self._names("marks"))
        self._keep(packed(rows), f"texts-{number:06d}")
        scan = stored(scanned(rows))
        run = self._write(combined(scan).select("gram", "whole", "n", F.struct("h", "at", "doc_id").alias("example")), number, number)
        mine, past = F.col("run") == run, F.col("run") != run
        both = self._runs_of([run, *old]).repartition("gram").groupBy("gram", "whole").agg(
            F.sum(F.when(mine, F.col("n")).otherwise(0)).alias("own"),
            F.sum(F.when(past, F.col("n")).otherwise(0)).alias("old"),
            F.min(F.when(mine, F.col("example"))).alias("own_at"),
            F.min(F.when(past, F.col("example"))).alias("old_at"),
        )
        gram = Window.partitionBy("gram")  # the fingerprints of a gram, each once
        both = both.withColumns({"fresh": F.sum("own").over(gram), "total": F.sum(F.col("own") + F.col("old")).over(gram), "kinds": F.count("*").over(gram)})
        hit = stored(both.filter("fresh > 0 AND total > 1").drop("fresh", "total"))
        segment = lambda c, sure: [F.col(f"{c}.doc_id").alias("doc_id"), F.col(f"{c}.h").alias("h"), F.col(f"{c}.at").alias("at"), F.lit(sure).alias("is_sure")]
        # Of a fingerprint with one segment its example is the segment; only those with more in the batch are looked up there.
        several = hit.filter("own > 1").select("gram", "whole")
        sure = hit.filter("own > 0 AND old = 1").select(segment("old_at", True)).union(hit.filter("own = 1 AND old > 0").select(segment("own_at", True)))
        sure = sure.union(scan.join(several, ["gram", "whole"], "left_semi").select("doc_id", "h", "at", F.lit(True)))
        open_ = hit.filter("kinds > 1").withColumn("any_at", F.coalesce("old_at", "own_at")).select(segment("any_at", False))
        seen = stored(sure.union(open_).groupBy(*IDENTITY).agg(F.collect_set(F.when(F.col("is_sure"), F.col("at"))).alias("sure"), F.collect_set(F.when(~F.col("is_sure"), F.col("at"))).alias("open")))
        asked, texts = seen.filter(F.size("open") > 0), self.texts()
        windows = stored(open_windows(texts.join(asked.select(*IDENTITY, "open"), alike(texts, asked)).select(texts["doc_id"], texts["h"], "z", "open")))
        twice = windows.groupBy("a", "b").count().filter("count > 1").select("a", "b")
        found = windows.join(twice, ["a", "b"], "left_semi").groupBy(*IDENTITY).agg(F.collect_set("at").alias("found"))
        none = lambda kind, name: F.array().cast(kind).alias(name)
        marks = seen.filter(F.size("sure") > 0).select(*IDENTITY, "sure", none("array<int>", "found")).union(found.select(*IDENTITY, none("array<long>", "sure"), "found"))
        self._keep(marks, f"marks-{number:06d}")
        free(scan, hit, seen, windows)
        if len(old) + 1 > self.most_runs:
            self.compact()

    def compact(self) -> None:
        """One run of all; the old ones go."""
        old = self.runs()
        if len(old) > 1:
            spans = [tuple(map(int, re.findall("[0-9]+", n))) for n in old]
            self._write(self._runs_of(old), min(a for a, _ in spans), max(b for _, b in spans))
            for run in old:
                self.files.delete(self._at(run), True)

    def drop(self) -> None:
        """All files go."""
        self.files.delete(self._at(""), True)


def alike(x: DataFrame, y: DataFrame) -> F.Column:
    return (x["h"] == y["h"]) & x["doc_id"].eqNullSafe(y["doc_id"])


def packed(rows: DataFrame) -> DataFrame:
    """rows with their text compressed as z, for a cheaper shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                z = [squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z, pa.binary())], names=["doc_id", "h", "z"])

    return rows.select("doc_id", "h", "text").mapInArrow(tidied(run), "doc_id long, h long, z binary")


def _unpacked(z: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """Row ranges of about a megabyte and their texts."""
    unsqueeze, start, size, texts = zstandard.ZstdDecompressor(), 0, 0, []
    for i, x in enumerate(z.to_pylist()):
        texts.append(unsqueeze.decompress(x))
        size += len(texts[-1])
        if size > SLICE_BYTES or i + 1 == len(z):
            yield start, i + 1, pa.array(texts, pa.binary()).cast(pa.string())
            start, size, texts = i + 1, 0, []


def _windows(words: Words, column: pa.Array) -> np.ndarray:
    """Word numbers of all windows of a column of lists of packed segments."""
    counts = _lengths(column)
    at = column.flatten().to_numpy(zero_copy_only=False)
    first = (at >> 5) + np.repeat(words.first[:-1], counts)
    count = (at & 31) + 1
    begin = np.cumsum(count) - count
    return np.arange(count.sum()) - np.repeat(begin, count) + np.repeat(first, count)


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)


def open_windows(hits: DataFrame) -> DataFrame:
    """a, b (96 bits of its words), doc_id, h and at of each window of open segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, text in _unpacked(batch.column(2)):
                words = words_of(text)
                start = _windows(words, batch.column(3).slice(i, j - i))
                if not len(start):
                    continue
                values = words.hashes()
                a = Ranges(values).hashes(start, start + WINDOW)
                b = Ranges(mix(values ^ _SECOND)).hashes(start, start + WINDOW) >> np.uint64(33)
                doc = words.doc[start]
                ids = [batch.column(k).slice(i, j - i).take(pa.array(doc)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.astype(np.int32)), *ids, pa.array((start - words.first[doc]).astype(np.int32))], names=["a", "b", "doc_id", "h", "at"])

    return hits.select("doc_id", "h", "z", "open").mapInArrow(tidied(run), "a long, b int, doc_id long, h long, at int")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, h, n_words and the digest of all words, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                words = [t.encode("utf-8", "surrogatepass").split() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])], names=["doc_id", "h", "n_words", "kept_sha256"])

    return rows.select("doc_id", "h", "text").mapInArrow(tidied(run), "doc_id long, h long, n_words long, kept_sha256 string")


def removed(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of rows (doc_id, z, sure, found) with repeated segments and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, text in _unpacked(batch.column(1)):
                words = words_of(text)
                found = batch.column(3).slice(i, j - i)
                more = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.first[:-1], _lengths(found))
                gone = covered(np.concatenate([_windows(words, batch.column(2).slice(i, j - i)), more]), WINDOW, len(words.start))
                raw, kept = words.data.tobytes(), []
                for d in range(j - i):
                    a, b = words.first[d], words.first[d + 1]
                    stay = np.flatnonzero(~gone[a:b]) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words.counts), pa.array(words.per_doc_words(gone)), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return hits.select("doc_id", "z", "sure", "found").mapInArrow(tidied(run), "doc_id long, n_words long, n_removed long, kept_text string")


def remove_repeated(docs: DataFrame, batches: int = 3, path: str | None = None, most_runs: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: words in windows that start anywhere else are removed.

    Texts are added to an index batch by batch; the marks after the last are those of all texts. Texts without marks go
    through no shuffle but that which finds out. With a path the index stays there, and texts that it held before count too.
    """
    spark, rows = docs.sparkSession, narrow(docs)
    index = WindowIndex(spark, path or f"{folder(spark).rstrip('/')}/windows-{uuid.uuid4().hex}", most_runs)
    for b in range(batches):
        index.add(rows.filter(F.pmod(F.xxhash64("doc_id", "h"), F.lit(batches)) == b))
    marks = stored(index.marks())
    z = packed(rows)
    changed = removed(z.join(marks, alike(z, marks)).select(z["doc_id"], "z", "sure", "found"))
    changed = stored(changed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")))
    if path is None:
        index.drop()
    base = digests(rows)
    rest = base.join(marks.select(*IDENTITY), alike(base, marks), "left_anti")
    return changed.unionByName(rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256"))
