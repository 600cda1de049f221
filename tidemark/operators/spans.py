"""Stages that nest: events of entering and leaving, matched by depth, with the time of each stage and of it alone.

A running depth tells which leave ends which enter: within a key and depth they take turns. A leave without an enter is set aside,
as is an enter that is never left; both are counted. All is windows over a key's events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import join_asof


def matched(events: DataFrame) -> DataFrame:
    """key, depth (1 is outermost), stage, begin, end, seconds, own_seconds (without stages inside) and left_as of every enter (key, at, place, stage, enters).

    place orders events of one moment. end is null where a stage is never left; left_as is the name that the leave told.
    """
    order = Window.partitionBy("key").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("sum", F.sum(F.when(F.col("enters"), 1).otherwise(-1)).over(order))
    # The lowest sum so far, 0 at first: a leave that goes below has nothing to leave.
    rows = rows.withColumn("floor", F.least(F.lit(0), F.min("sum").over(order)))
    depth = (F.col("sum") - F.col("floor")).cast("long")
    turn = Window.partitionBy("key", "depth").orderBy("at", "place")
    before = F.coalesce(F.lag("floor").over(Window.partitionBy("key").orderBy("at", "place")), F.lit(0))
    rows = rows.withColumn("lost", ~F.col("enters") & (F.col("floor") < before)).withColumn("depth", F.when(F.col("enters"), depth).otherwise(depth + 1))
    rows = rows.filter("NOT lost").withColumns({"end": F.lead("at").over(turn), "left_as": F.lead("stage").over(turn), "ends": ~F.lead("enters").over(turn)})
    spans = rows.filter("enters").select("key", "depth", "stage", F.col("at").alias("begin"), "place", F.when(F.col("ends"), F.col("end")).alias("end"), F.when(F.col("ends"), F.col("left_as")).alias("left_as"))
    spans = spans.withColumn("seconds", F.unix_micros(F.col("end").cast("timestamp")) / 1e6 - F.unix_micros(F.col("begin").cast("timestamp")) / 1e6)
    # The stage around: the last enter one depth further out.
    spans = spans.withColumn("moment", F.struct("begin", "place"))
    around = spans.select("key", F.col("depth").alias("outer"), "moment", F.col("moment").alias("parent"))
    inner = join_asof(spans.filter("depth > 1").select("key", (F.col("depth") - 1).alias("outer"), "moment", "seconds"), around, ["key", "outer"], "moment", "moment", ["parent"])
    inside = inner.groupBy("key", F.col("outer").alias("depth"), F.col("parent").alias("moment")).agg(F.sum("seconds").alias("inside"))
    out = spans.join(inside, ["key", "depth", "moment"], "left")
    return out.select("key", "depth", "stage", "begin", "place", "end", "seconds", (F.col("seconds") - F.coalesce("inside", F.lit(0.0))).alias("own_seconds"), "left_as")


def by_stage(spans: DataFrame) -> DataFrame:
    """stage, calls, open_calls (never left), misnamed (left under another name), seconds and own_seconds of all, and the greatest depth."""
    n = lambda c: F.count(F.when(c, 1))
    return spans.groupBy("stage").agg(F.count("*").alias("calls"), n(F.col("end").isNull()).alias("open_calls"), n(F.col("left_as") != F.col("stage")).alias("misnamed"), F.sum("seconds").alias("seconds"), F.sum("own_seconds").alias("own_seconds"), F.max("depth").alias("deepest"))
