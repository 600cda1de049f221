"""Exact order statistics by group, without a task that sorts a whole group.

Values are dealt to ranges whose bounds are the same for every group: the sign, the power of two and the first eight bits after
it, so the order of ranges is the order of values. Rows of each range are counted, on the map side first; prefix sums of
the counts tell how many values lie before a range. A rank is that number and the rank within the range; for a quantile only
the ranges that hold an edge are sorted. A range of a group is one task's at most, so a group of 10**7 values is many tasks.

Rows are read twice: keep them first (`tidemark.sources.kept`) where they are dear. Nulls come before all values, NaN after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 8


def range_of(value: Column) -> tuple[Column, Column]:
    """Power and step: whole numbers that together don't fall as the value rises."""
    v = value.cast("double")
    size, sign = F.abs(v), F.signum(v).cast("long")
    power = F.floor(F.log2(size)).cast("long")  # may be off next to a power of two, but never falls
    step = F.floor(size / F.pow(F.lit(2.0), power) * (1 << BITS)).cast("long")
    infinite = size == float("inf")
    high = F.when(v.isNull(), -9999).when(F.isnan(v), 9999).when(infinite, sign * 9998).when(v == 0, 0).otherwise(sign * (power + 2000))
    return high.cast("long"), F.when(v.isNull() | F.isnan(v) | infinite | (v == 0), 0).otherwise(sign * step).cast("long")


def ranged(rows: DataFrame, column: str) -> DataFrame:
    """rows with power_ and step_ of a column."""
    power, step = range_of(F.col(column))
    return rows.withColumns({"power_": power, "step_": step})


def counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, power_, step_, in_ (rows there), before_ (rows of the group in ranges before), total_ (rows of the group) of ranged rows."""
    steps = rows.groupBy(*by, "power_", "step_").agg(F.count("*").alias("in_"))
    powers = steps.groupBy(*by, "power_").agg(F.sum("in_").alias("all_"))  # some 4,000 rows a group at most
    before = Window.partitionBy(*by).orderBy("power_").rowsBetween(Window.unboundedPreceding, -1)
    powers = powers.select(*by, "power_", F.coalesce(F.sum("all_").over(before), F.lit(0)).alias("far_"), F.sum("all_").over(Window.partitionBy(*by)).alias("total_"))
    near = Window.partitionBy(*by, "power_").orderBy("step_").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("near_", F.coalesce(F.sum("in_").over(near), F.lit(0)))
    return steps.join(powers, [*by, "power_"]).select(*by, "power_", "step_", "in_", (F.col("far_") + F.col("near_")).alias("before_"), "total_")


def ranks(rows: DataFrame, column: str, by: list[str], counts_of: DataFrame | None = None) -> DataFrame:
    """rows with r_<column>: ranks within by from 1, ties share their mean. counts_of: the same values, where those are cheaper to read."""
    split = ranged(rows, column)
    offsets = counted(split if counts_of is None else ranged(counts_of, column), by).select(*by, "power_", "step_", "before_")
    part = [*by, "power_", "step_"]
    within = F.rank().over(Window.partitionBy(*part).orderBy(column)) + (F.count("*").over(Window.partitionBy(*part, column)) - 1) / 2
    out = split.withColumn("within_", within).join(offsets, part)
    return out.select(*rows.columns, (F.col("before_") + F.col("within_")).alias(f"r_{column}"))


def quantiles(rows: DataFrame, column: str, by: list[str], shares: list[float]) -> DataFrame:
    """by, n and edges: the linear quantiles of a column at each share. Rows have known values; there is a row for each group."""
    split = ranged(rows, column)
    ranges = counted(split, by)
    at = F.array(*(F.struct(F.lit(i).alias("i_"), F.lit(float(q)).alias("q_")) for i, q in enumerate(shares)))
    asked = ranges.withColumn("ask_", F.explode(at)).select("*", "ask_.*").withColumn("at_", F.col("q_") * (F.col("total_") - 1))
    asked = asked.withColumn("k_", F.explode(F.array_distinct(F.array(F.floor("at_"), F.ceil("at_"))))).filter("k_ >= before_ AND k_ < before_ + in_")
    asked = asked.select(*by, "power_", "step_", "i_", "at_", "k_", "before_", "total_")  # two rows for each group and share
    part = [*by, "power_", "step_"]
    held = split.join(F.broadcast(asked.select(*part).distinct()), part, "left_semi").groupBy(*part, column).agg(F.count("*").alias("n_"))
    upto = F.sum("n_").over(Window.partitionBy(*part).orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    found = held.withColumn("upto_", upto).join(F.broadcast(asked), part)
    found = found.filter((F.col("k_") < F.col("before_") + F.col("upto_")) & (F.col("k_") >= F.col("before_") + F.col("upto_") - F.col("n_")))
    value = F.sum(F.when(F.col("k_") == F.col("at_"), F.col(column)).otherwise(F.col(column) * (1 - F.abs(F.col("k_") - F.col("at_")))))
    edges = found.groupBy(*by, "i_").agg(value.alias("edge_"), F.first("total_").alias("n"))
    return edges.groupBy(*by, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i_", "edge_"))), lambda e: e["edge_"]).alias("edges"))
