"""Why a key has no value: as-of reads that name the first reason, over a whole domain of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import finite, month_anchor
from tidemark.operators.asof import join_asof

ORDER = ("no_history", "warm_up", "stale", "not_positive")


def seen_at(series: DataFrame, keys: DataFrame, at: str, name: str) -> DataFrame:
    """keys with <name>_value and <name>_day: the last known value of series (ticker, trade_date, value) at a day of each key."""
    rows = series.filter(finite(F.col("value"))).select("ticker", "trade_date", F.col("value").alias(f"{name}_value"), F.col("trade_date").alias(f"{name}_day"))
    return join_asof(keys, rows, ["ticker"], at, "trade_date", [f"{name}_value", f"{name}_day"])


def return_reasons(series: DataFrame, keys: DataFrame, recent: int, base: int, days: int = 10) -> DataFrame:
    """ticker, signal_date, value and reason of every key: the return between two calendar month ends, or why there is none.

    no_history: no known value by the signal date; warm_up: the first one is later than the older month end; stale: one is
    older than so many days there; not_positive: the older one is not above 0. One of value and reason is null.
    """
    first = series.filter(finite(F.col("value"))).groupBy("ticker").agg(F.min("trade_date").alias("first_"))
    rows = keys.select("ticker", "signal_date", month_anchor(F.col("signal_date"), recent).alias("new_at"), month_anchor(F.col("signal_date"), base).alias("old_at"))
    rows = seen_at(series, seen_at(series, rows, "new_at", "new"), "old_at", "old").join(first, "ticker", "left")
    old = F.datediff("old_at", "old_day") > days
    reason = (
        F.when(F.col("first_").isNull() | (F.col("first_") > F.col("signal_date")), "no_history")
        .when(F.col("first_") > F.col("old_at"), "warm_up")
        .when(old | (F.datediff("new_at", "new_day") > days), "stale")
        .when(F.col("old_value") <= 0, "not_positive")
    )
    return rows.select("ticker", "signal_date", F.when(reason.isNull(), F.col("new_value") / F.col("old_value") - 1).alias("value"), reason.alias("reason"))


def level_reasons(series: DataFrame, keys: DataFrame, days: int = 10) -> DataFrame:
    """ticker, signal_date, value and reason of every key: the last known value at the signal date, or why there is none that is recent and above 0."""
    rows = seen_at(series, keys.select("ticker", "signal_date"), "signal_date", "now")
    reason = F.when(F.col("now_day").isNull(), "no_history").when(F.datediff("signal_date", "now_day") > days, "stale").when(F.col("now_value") <= 0, "not_positive")
    return rows.select("ticker", "signal_date", F.when(reason.isNull(), F.col("now_value")).alias("value"), reason.alias("reason"))


def reason_counts(found: DataFrame) -> DataFrame:
    """year, reason (null: there is a value) and n_keys."""
    return found.groupBy(F.year("signal_date").alias("year"), "reason").agg(F.count("*").alias("n_keys"))
