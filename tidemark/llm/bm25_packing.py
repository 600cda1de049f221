"""Packing documents into token windows by lexical retrieval.

Documents become token ids with an end mark. Whole windows of a document are sequences of their own; its
tail is packed with others. Tails lie in shards of a bounded number of documents, each with an inverted
index that scores by BM25 over the token ids of whole documents, not of tails alone; document frequencies and
the mean length are counted over all documents, in tables bounded by the vocabulary. A seed's most telling tokens fetch
its unused neighbours, and the best of them fill its window greedily; the last is cut where the window ends and its
rest is the next seed. Only the last window of a shard can hold padding.

Documents are brought to shards by what they are about: each draws three of its token ids, the first arrivals among
exponential times that are the same for all documents and run faster for a higher BM25 weight, so that two documents
draw alike about as often as their weighted tokens agree. Documents of one first draw are neighbours in order, then those
of one second and third. How many share a first draw is counted (a table bounded by the vocabulary), and a draw of more than
a part's documents is dealt to several parts by their ids, so that no token and no group of copies makes a large task.

Defined cases: a null or empty text is its end mark alone; repeated rows are packed each; a null doc_id
stays null; a document of exactly some windows has no tail; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import stored
from tidemark.llm.words import REMEMBERED, mix, slices, tidied

WINDOW, END = 2048, 1
#: Documents of a shard, telling tokens of a seed, and the two parameters of BM25.
SHARD, TELLING, K1, B = 2048, 24, 1.2, 0.75
#: Documents of a part, about, and draws of a document.
PART, DRAWS = 4 * SHARD, 3


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, word by word: white space ends every unit that the tokenizer looks at.

    Words of Latin letters go straight to the tokenizer's model, unit by unit; all others through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.unit = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.plain = regex.compile("[!-~¡-įı-ɏ]*")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        self.units: dict[str, bytes] = {}

    def one(self, u: str) -> bytes:
        """Ids of a unit, packed: the bytes of one word without case."""
        ids = self.units.get(u)
        if ids is None:
            s = u if u.isascii() else u.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(s)], np.uint16).tobytes()
            if len(self.units) < 5 * REMEMBERED:
                self.units[u] = ids
        return ids

    def word(self, w: str) -> bytes:
        """Ids of a word, packed. In the plain range case folding and composition look at single letters."""
        if not (w.isascii() and w.isprintable() or self.plain.fullmatch(w)) or "<|" in w:
            return np.array(self.whole.encode(w, add_special_tokens=False).ids, np.uint16).tobytes()
        w = w.lower()
        if w.isalpha():
            return self.one(w)
        if w[:-1].isalpha() and w[-1] in ".,;:!?":
            return self.one(w[:-1]) + self.one(w[-1])
        return b"".join(map(self.one, self.unit.findall(w)))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end mark, and where each begins."""
        split = pc.ascii_split_whitespace(column.fill_null(""))
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        packs = []
        for w in coded.dictionary.to_pylist():
            ids = self.units.get(w)
            packs.append(self.word(w) if ids is None else ids)
        packs.append(np.array([END], np.uint16).tobytes())
        size = np.fromiter(map(len, packs), np.int64, len(packs)) // 2
        pool = np.frombuffer(b"".join(packs), np.uint16)
        begin = np.cumsum(size) - size
        order = np.insert(coded.indices.to_numpy(zero_copy_only=False), np.cumsum(counts), len(packs) - 1)
        each = size[order]
        stop = np.cumsum(each)
        ids = pool[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin[order] - (stop - each), each)]
        ends = stop[np.cumsum(counts + 1) - 1] if len(counts) else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], ends])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """doc_id, n (ids), checks (of its whole windows), tail (ids), terms and times (distinct ids of the whole document and their counts); all packed as 16 bits, times as 32."""
    schema = "doc_id long, n long, checks array<long>, tail binary, terms binary, times binary" + (", heads binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            text = batch.column(1)
            for a, b in slices(text, 2 << 20):
                ids, at = own.texts(text.slice(a, b - a))
                n = np.diff(at)
                whole = n // window * window
                doc = np.repeat(np.arange(b - a, dtype=np.int64), n)
                key, times = np.unique(doc << 16 | ids, return_counts=True)
                cut = np.searchsorted(key >> 16, np.arange(b - a + 1))
                term, times = (key & 0xFFFF).astype(np.uint16), times.astype(np.uint32)
                columns: list = [[], [], [], [], []]
                for d in range(b - a):
                    s, m, e = at[d], at[d] + whole[d], at[d + 1]
                    columns[0].append([crc(ids[i : i + window]) for i in range(s, m, window)])
                    columns[1].append(ids[m:e].tobytes())
                    columns[2].append(term[cut[d] : cut[d + 1]].tobytes())
                    columns[3].append(times[cut[d] : cut[d + 1]].tobytes())
                    if with_ids:
                        columns[4].append(ids[s:m].tobytes())
                arrays = [batch.column(0).slice(a, b - a), pa.array(n), pa.array(columns[0], pa.list_(pa.int64())), *(pa.array(c, pa.binary()) for c in columns[1 : 4 + with_ids])]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "checks", "tail", "terms", "times", "heads"][: 6 + with_ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), schema)


def frequencies(tails: DataFrame) -> tuple[np.ndarray, int, float]:
    """Documents that hold each id, the number of documents and their mean length. At most a number for each id leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            raw = batch.column(0).cast(pa.binary())
            total += np.bincount(np.frombuffer(b"".join(raw.to_pylist()), np.uint16), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    rows = tails.select("terms").mapInArrow(tidied(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # no more rows than the vocabulary has ids
    df = np.zeros(1 << 16, np.int64)
    df[[r["id"] for r in rows]] = [r["n"] for r in rows]
    n, mean = tails.select(F.count("*"), F.avg("n")).first()
    return df, n, mean or 1.0


def bm25(weight: np.ndarray, term: np.ndarray, times: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    """Scores of terms that occur so often in documents of such sizes."""
    tf = times.astype(np.float32)
    return weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size.astype(np.float32) / mean))


def arrivals() -> np.ndarray:
    """Exponential times of all ids, for each draw."""
    ids = np.arange(DRAWS << 16, dtype=np.uint64).reshape(DRAWS, -1)
    return -np.log(((mix(ids + np.uint64(0x51ED2701)) >> np.uint64(11)).astype(float) + 1) * 2.0**-53)


def draws(terms: list[np.ndarray], times: list[np.ndarray], size: np.ndarray, weight: np.ndarray, mean: float, race: np.ndarray) -> np.ndarray:
    """DRAWS ids of each document: documents by draws; every document has an id."""
    doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    term = np.concatenate(terms).astype(np.int64)
    speed = np.maximum(bm25(weight, term, np.concatenate(times), size[doc], mean), 1e-6)
    begin = np.cumsum([0] + [len(t) for t in terms[:-1]])
    out = np.empty((len(terms), DRAWS), np.int32)
    for k in range(DRAWS):
        time = race[k, term] / speed
        first = np.flatnonzero(time == np.minimum.reduceat(time, begin)[doc])
        at = first[np.append(True, doc[first[1:]] != doc[first[:-1]])]
        out[:, k] = term[at]
    return out


class Shard:
    """Tails of a shard, and the inverted index of their documents (of the tails themselves without lengths)."""

    def __init__(self, tails: list[np.ndarray], terms: list[np.ndarray], times: list[np.ndarray], weight: np.ndarray, mean: float, lengths: list[int] | None = None) -> None:
        self.tails = tails
        doc = np.repeat(np.arange(len(tails)), [len(t) for t in terms])
        term = np.concatenate(terms).astype(np.int64)
        size = np.array([len(t) for t in tails] if lengths is None else lengths)
        score = bm25(weight, term, np.concatenate(times), size[doc], mean)
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
        self.term, self.told = term, score
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_score = doc[order], score[order].astype(np.float32)
        self.post_at = np.searchsorted(term[order], np.arange((1 << 16) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the most telling ids of the seed."""
        a, b = self.begin[seed], self.begin[seed + 1]
        told = self.told[a:b]
        best = np.argpartition(-told, TELLING)[:TELLING] if b - a > TELLING else np.arange(b - a)
        out = np.zeros(len(self.tails), np.float32)
        for t in self.term[a:b][best]:
            p, q = self.post_at[t], self.post_at[t + 1]
            out[self.post_doc[p:q]] += self.post_score[p:q]
        return out

    def pack(self, window: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Sequence (from 0), offset there, tail, start in it, length."""
        n = len(self.tails)
        size = np.array([len(t) for t in self.tails])
        used = np.zeros(n, np.int64)  # ids of each tail that are placed
        free = size > 0
        sequence, rest, following = 0, -1, 0
        while True:
            if rest < 0:
                while following < n and not free[following]:
                    following += 1
                if following == n:
                    return
            seed, rest = (rest if rest >= 0 else following), -1
            room, offset, scores, at = window, 0, None, seed
            while True:
                take = int(min(room, size[at] - used[at]))
                yield sequence, offset, at, int(used[at]), take
                used[at] += take
                free[at] = used[at] < size[at]
                room, offset = room - take, offset + take
                if free[at]:
                    rest = at
                if not room or not free.any():
                    break
                if scores is None:
                    scores = self.scores(seed)
                at = int(np.argmax(np.where(free, scores, -1)))
            sequence += 1


def _arrays(batch: pa.RecordBatch, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) if len(x.as_buffer()) else np.zeros(0, kind) for x in batch.column(batch.schema.get_field_index(name))]


def parted(tails: DataFrame, weight: np.ndarray, mean: float, part: int = PART) -> DataFrame:
    """tails with part and d0, d1, ..., their draws, in the order of these within partitions."""
    race = arrivals()
    names = [f"d{k}" for k in range(DRAWS)]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                rows = batch.slice(a, 1024)
                found = draws(_arrays(rows, "terms", np.uint16), _arrays(rows, "times", np.uint32), rows.column(rows.schema.get_field_index("n")).to_numpy(), weight, mean, race)
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(found[:, k]) for k in range(DRAWS))], names=[*rows.schema.names, *names])

    def add(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(tidied(drawn), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {n} int" for n in names))

    shared = add(tails.select("n", "terms", "times")).groupBy("d0").count().orderBy("d0").collect()  # no more rows than the vocabulary has ids
    # Draws in order fill parts; one that fills more than a part has parts of its own.
    at = np.zeros((1 << 16, 2), np.int64)
    following, room = 0, part
    for r in shared:
        many = -(-r["count"] // part)
        if many > 1 or r["count"] > room:
            following, room = following + 1, part
        at[r["d0"]] = following, many
        room -= r["count"]
        if many > 1:
            following, room = following + many - 1, 0
    table = tails.sparkSession.createDataFrame(pa.table({"d0": pa.array([r["d0"] for r in shared], pa.int32()), "first_": pa.array([int(at[r["d0"], 0]) for r in shared], pa.int64()), "many_": pa.array([int(at[r["d0"], 1]) for r in shared], pa.int64())}))
    rows = add(tails).join(F.broadcast(table), "d0")
    rows = rows.withColumn("part", F.col("first_") + F.pmod(F.xxhash64("doc_id", "tail"), F.col("many_"))).drop("first_", "many_")
    return rows.repartition("part").sortWithinPartitions("part", *names, F.xxhash64("doc_id", "tail"))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard: int = SHARD, with_ids: bool = True, part: int = PART) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of every piece."""
    whole = stored(encoded(docs, tokenizer or default_tokenizer(), window, with_ids))
    df, n, mean = frequencies(whole)
    weight = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{x} long" for x in names[:7]) + ", ids array<int>" * with_ids

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:7]]
        if with_ids:
            arrays.append(pa.array([x[7].astype(np.int32) for x in out], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = (1 << 61) + (TaskContext.get().partitionId() << 33)
        for batch in batches:
            for r in (r for a in range(0, len(batch), 64) for r in batch.slice(a, 64).to_pylist()):
                ids = np.frombuffer(r["heads"], np.uint16) if with_ids else None
                yield batch_of([(r["doc_id"], i * window, window, c, r["n"], following + i, 0, ids[i * window : (i + 1) * window] if with_ids else None) for i, c in enumerate(r["checks"])])
                following += len(r["checks"])

    def run_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following, held = TaskContext.get().partitionId() << 33, []

        def done() -> pa.RecordBatch:
            nonlocal following, held
            tails, terms, times = ([np.frombuffer(r[k], kind) for r in held] for k, kind in (("tail", np.uint16), ("terms", np.uint16), ("times", np.uint32)))
            out, last = [], following - 1
            for sequence, offset, at, start, take in Shard(tails, terms, times, weight, mean, [r["n"] for r in held]).pack(window):
                r, ids = held[at], tails[at][start : start + take]
                last = following + sequence
                out.append((r["doc_id"], r["whole"] * window + start, take, crc(ids), r["n"], last, offset, ids))
            following, held = last + 1, []
            return batch_of(out)

        for batch in batches:
            for row in (r for a in range(0, len(batch), 256) for r in batch.slice(a, 256).to_pylist()):
                held.append(row)
                if len(held) == shard:
                    yield done()
        if held:
            yield done()

    heads = whole.filter(F.size("checks") > 0).select("doc_id", "n", "checks", *["heads"] * with_ids).mapInArrow(tidied(run_heads), schema)
    tails = whole.filter(F.length("tail") > 0).select("doc_id", "n", F.size("checks").cast("long").alias("whole"), "tail", "terms", "times")
    placed = parted(tails, weight, mean, part).select("doc_id", "n", "whole", "tail", "terms", "times").mapInArrow(tidied(run_tails), schema)
    return heads.unionByName(placed)
