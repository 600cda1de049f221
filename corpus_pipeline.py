"""A training corpus from raw documents: five stages, each by one operator of tidemark.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.

Defined cases, of all stages: an empty table gives an empty one; columns that a stage doesn't need pass through, whatever their names;
a null text counts as empty for a score, a size and tokens, and stays null; rows without a doc_id, language or source are rows like
others. What a stage does to texts that are equal, and to repeated rows, its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bm25_packing, crf_pii, dart_minhash, source_mix, toxicity_fst
from tidemark.llm.scratch import stored


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.7 or more for toxicity go. The grammar is learned from the labelled rows of docs.

    Equal texts score alike, so they go or stay together; empty and null texts stay; a very long text is scored whole.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_fst.filtered(docs, toxicity_fst.learned(docs, labels), 0.7)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: that of the least doc_id, then of the least text key, then by a hash of its columns.

    Equal texts, empty ones too, and repeated rows are one class; a row without a text is a class of its own and stays.
    """
    return dart_minhash.deduplicated(docs)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text becomes the name of its kind in brackets; n_chars follows.

    Every row stays; equal texts become equal texts; null and empty texts stay as they are.
    """
    out = crf_pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: whole for each whole epoch, and their first words where the budget cuts them.

    Rows without words stay once where an epoch of their source is whole; of alike rows a hash of all columns tells which is cut.
    """
    return source_mix.taken_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with ids. A null or empty text is the closing id alone; repeated rows are pieces of their own."""
    return bm25_packing.pack(docs)


STAGES = [("toxicity", clean_speech), ("near_dedup", one_of_each), ("pii", no_personal_data), ("mixing", mixed), ("packing", packed)]

#: Fitted scores, the field's decoding and retrieval order have no SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
