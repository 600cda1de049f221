"""Bounded samples of labelled documents, and folds by document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0).cast("long"))


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """doc_id, text, y of `most` labelled documents at the most, evenly by a hash of the id.

    train tells which doc_ids may be learned from. Of several labels of a document the greatest counts, and of several
    rows of an id the text of the least MD5 (a null comes first), so the sample has one row an id, however often an id is
    repeated. Ids are at most `most`, so they can be broadcast; only their texts are shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").filter(train)
    ids = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(label)), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id", "y").agg(F.min_by(F.struct("text"), F.coalesce(F.md5("text"), F.lit(""))).alias("row_"))
    return one.select("doc_id", F.col("row_.text").alias("text"), "y")
