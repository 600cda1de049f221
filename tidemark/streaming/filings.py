"""Filings as a stream: an extension, as facts are append-only.

A file source of flat facts becomes stored facts without repeats of a key; restatements are new rows with a later day, so
only exact repeats of a key go. Nothing is too late: a backfill of old filings is compared with all stored keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import FACTS, KEYS, load_facts


def read(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Flat facts that arrive as Parquet files."""
    return spark.readStream.schema(FACTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_of_each(batch: DataFrame) -> DataFrame:
    """Facts of a batch, one row for each key: the least by its other columns."""
    facts = load_facts(batch)
    rest = [c for c in facts.columns if c not in KEYS["facts"]]
    one = facts.groupBy(*KEYS["facts"]).agg(F.min(F.struct(*rest)).alias("row_"))
    return one.select(*(F.col(c) if c in KEYS["facts"] else F.col(f"row_.{c}").alias(c) for c in facts.columns))


def write(facts: DataFrame, path: str, checkpoint: str):
    """Appends what is there now, once, but for keys that are stored; a restart goes on where the last one ended.

    Each batch is a folder of its own number, written anew if it is repeated, so that a batch that was broken off leaves no half.
    Only stored facts of the years that the batch has are looked at: year is a folder, too.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = first_of_each(batch).withColumn("year", F.year("filed"))
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            known = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in FACTS)}, batch int, year int").parquet(path).filter(F.col("batch") != number)
            years = new.select("year").distinct()
            known = known.join(F.broadcast(years), "year", "left_semi")
            same = [known[k].eqNullSafe(new[k]) for k in KEYS["facts"]]
            new = new.join(known, same, "left_anti")
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "year").parquet(path)

    return facts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
