"""Packing against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import bm25_packing

SF = "/root/testdata/sf0.001"


def ids_of(text):
    t = Tokenizer.from_file(bm25_packing.default_tokenizer())
    return [*t.encode(text or "", add_special_tokens=False).ids, bm25_packing.END]


def check(pieces, rows, shards):
    got, placed = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p["doc_id"]].append(p)
        placed[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, text in rows:
        want = ids_of(text)
        at = 0
        for p in sorted(got[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want)
            part = np.array(want[at : at + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            assert "ids" not in p.__fields__ or p["ids"] == part.tolist()
            at += p["length"]
        assert at == len(want)
    short = 0
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= bm25_packing.WINDOW
        short += at < bm25_packing.WINDOW
    assert short <= shards


def test_pieces_hold_every_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(bm25_packing.pack(docs, shard=70).collect(), rows, 3 * 4)


def test_odd_rows(spark, odd, nothing):
    found = bm25_packing.pack(odd, with_ids=False)
    assert found.filter("doc_id = 0").count() == 2 and found.filter("doc_id IS NULL").count() >= 1
    assert found.filter("doc_id = 1").first()["doc_tokens"] == 1
    assert bm25_packing.pack(nothing).count() == 0


def test_words_as_the_tokenizer_splits_them():
    texts = ["Hello WORLD's <|endoftext|> foo<|endoftext|>bar it's!! é ½ ² x²", "İstanbul Σας 日本語 \x1c a\x0bb 123", "Å ﬁ Å ǅ ŉ ſ don't can'T a-b.c", "", "  "]
    ids, at = bm25_packing.encoder(bm25_packing.default_tokenizer()).texts(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(t) for t in texts]


def test_neighbours_share_words():
    tails = [np.array(x, np.uint16) for x in ([1, 2, 3], [7, 8, 9], [2, 3, 4])]
    terms = [np.unique(t) for t in tails]
    shard = bm25_packing.Shard(tails, terms, [np.ones(len(t), np.uint16) for t in terms], np.ones(1 << 16, np.float32), 3.0)
    assert shard.scores(0)[2] > 0 and shard.scores(0)[1] == 0
    assert [(s, at) for s, _, at, _, _ in shard.pack(6)] == [(0, 0), (0, 2), (1, 1)]


def test_whole_documents_find_neighbours(spark):
    """Only the whole windows of the first document name what the third is about."""
    rows = [(0, " ".join(["river"] * 64 + ["seven"] * 10)), (1, " ".join(["metal"] * 20)), (2, " ".join(["river"] * 20))]
    assert [len(ids_of(t)) for _, t in rows] == [75, 21, 21]
    found = bm25_packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=32).collect()
    tail = next(p["sequence_id"] for p in found if p["doc_id"] == 0 and p["start"] == 64)
    assert {p["doc_id"] for p in found if p["sequence_id"] == tail} == {0, 2}


def test_close_documents_meet_in_a_shard(spark):
    """The best neighbour of a document by BM25 over all documents lies in its part far more often than by chance; equal texts always do, or are dealt by id."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = bm25_packing.stored(bm25_packing.encoded(docs, bm25_packing.default_tokenizer()))
    df, n, mean = bm25_packing.frequencies(rows)
    weight = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    part = 100
    placed = bm25_packing.parted(rows, weight, mean, part).select("doc_id", "n", "part", "terms", "times").collect()
    counts = defaultdict(int)
    for r in placed:
        counts[r["part"]] += 1
    assert len(placed) == n and len(counts) >= n / part / 1.5 and max(counts.values()) <= 2 * part
    terms, times = ([np.frombuffer(r[k], kind) for r in placed] for k, kind in (("terms", np.uint16), ("times", np.uint32)))
    every = bm25_packing.Shard([t for t in terms], terms, times, weight, mean, [r["n"] for r in placed])
    hits = 0
    asked = [i for i, r in enumerate(placed) if r["doc_id"] % 20 == 0]
    for i in asked:
        scores = every.scores(i)
        scores[i] = -1
        hits += placed[int(np.argmax(scores))]["part"] == placed[i]["part"]
    assert hits / len(asked) >= 2.5 * part / n


def test_large_groups_of_copies_fill_several_parts(spark):
    docs = spark.createDataFrame([(i, "one text that many rows hold") for i in range(500)] + [(1000 + i, f"word{i} other{i}") for i in range(50)], "doc_id long, text string")
    rows = bm25_packing.stored(bm25_packing.encoded(docs, bm25_packing.default_tokenizer()))
    df, n, mean = bm25_packing.frequencies(rows)
    placed = bm25_packing.parted(rows, np.ones(1 << 16, np.float32), mean, 40).groupBy("part").count().collect()
    assert max(r["count"] for r in placed) <= 80 and sum(r["count"] for r in placed) == 550
    check(bm25_packing.pack(docs, shard=30, part=40).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 40)
