"""What differs between two large results, found through a tree of hashes.

Rows are dealt to buckets by a hash of their keys; the rows of a bucket add up to two hashes, the buckets of a branch to one
more pair. Branches that are alike on both sides are done. Only rows of buckets that differ are joined, so two results of 10**9 rows
with a handful of changes cost two scans, two aggregates on the map side, and a join of a few buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRANCHES, BUCKETS = 64, 64


def _leaves(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with its bucket and two hashes of the whole row; a null hashes as a word of its own."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(c)
    at = F.pmod(F.xxhash64(*(text(k) for k in keys)), F.lit(BRANCHES * BUCKETS)).cast("int")
    whole = [text(c) for c in sorted(df.columns)]
    return df.withColumns({"bucket_": at, "a_": F.xxhash64(*whole, F.lit(1)).cast("decimal(20,0)"), "b_": F.xxhash64(*whole, F.lit(2)).cast("decimal(20,0)")})


def _summed(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.sum("n_").alias("n_"), F.sum("a_").alias("a_"), F.sum("b_").alias("b_"))


def differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """bucket_ of the buckets that differ: some thousand rows at most."""
    level = [_summed(_leaves(df, keys).withColumn("n_", F.lit(1).cast("long")), "bucket_") for df in (left, right)]
    branch = F.floor(F.col("bucket_") / BUCKETS).cast("int")
    tops = [_summed(x.withColumn("branch_", branch), "branch_") for x in level]

    def unlike(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
        b = b.select(by, *(F.col(c).alias(f"r{c}") for c in ("n_", "a_", "b_")))
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"r{c}")) for c in ("n_", "a_", "b_")))
        return a.join(b, by, "full_outer").filter(~same).select(by)

    open_ = unlike(*tops, "branch_")
    within = [x.withColumn("branch_", branch).join(F.broadcast(open_), "branch_", "left_semi") for x in level]
    return unlike(*within, "bucket_")


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change (added, removed or changed) and columns (those that differ, in order) of every row that isn't alike on both sides.

    Both sides have the same columns and known keys, one row each; a null equals a null.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("both sides have the same columns")
    buckets = F.broadcast(differing(left, right, keys))
    rest = sorted(c for c in left.columns if c not in keys)
    l, r = (_leaves(df, keys).join(buckets, "bucket_", "left_semi").select(*keys, F.struct(*rest).alias(name), F.lit(True).alias(f"in_{name}")) for df, name in ((left, "l"), (right, "r")))
    both = l.join(r, keys, "full_outer")
    changed = F.filter(F.array(*(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in rest)), lambda c: c.isNotNull())
    kind = F.when(F.col("in_l").isNull(), "added").when(F.col("in_r").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return both.select(*keys, kind.alias("change"), F.when(kind == "changed", F.array_join(changed, "+")).otherwise("").alias("columns")).filter("change IS NOT NULL")


def summary(found: DataFrame) -> DataFrame:
    """change, columns and n_rows."""
    return found.groupBy("change", "columns").agg(F.count("*").alias("n_rows"))
