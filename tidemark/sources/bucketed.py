"""Stored tables that prune by year and meet by key without a shuffle.

A table is written in buckets of its key, sorted within, and in a folder for each year of its day. A scan of some days opens the
folders of their years only. Two tables in as many buckets of one key are joined, and grouped by it, where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def write_bucketed(df: DataFrame, name: str, path: str, key: str, day: str, buckets: int = BUCKETS) -> None:
    """Stores df as a table of the catalog with its files under path; a row without a day is in the year null."""
    dealt = df.withColumn("year", F.year(day)).repartition(buckets, key)  # a file for each bucket and year
    dealt.write.mode("overwrite").partitionBy("year").bucketBy(buckets, key).sortBy(key, day).option("path", path).saveAsTable(name)


def scan_days(spark: SparkSession, name: str, day: str, first, last) -> DataFrame:
    """Rows of a stored table from a first to a last day, without the year; other years' folders are not opened."""
    first, last = F.lit(first).cast("date"), F.lit(last).cast("date")
    rows = spark.table(name).filter(F.col("year").between(F.year(first), F.year(last)) & F.col(day).between(first, last))
    return rows.drop("year")


def join_asof_stored(probes: DataFrame, build: DataFrame, key: str, probe_on: str, build_on: str, columns: list[str]) -> DataFrame:
    """probes with the columns of the newest row of build at or before each probe's day, null without one; of one day the greatest counts.

    Both come from tables in buckets of the key: the rows of a key are gathered in order and searched, for keys with some thousand rows
    to search. Without such tables, or with longer keys, `asof.join_asof` is the way.
    """
    lists = build.filter(F.col(build_on).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(build_on).alias("at_"), *columns))).alias("all_"))
    seen = F.try_element_at(F.filter("all_", lambda x: x["at_"] <= F.col(probe_on)), F.lit(-1))
    found = probes.join(lists.hint("merge"), key, "left").withColumn("seen_", seen)
    return found.select(*probes.columns, *(F.col(f"seen_.{c}").alias(c) for c in columns))
