"""Checks that stop a run where its input can't give a result, and say what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUES = ("ticker", "signal_date", "value")


class EmptyFactorError(ValueError):
    """A signal without any value."""


class ImplausibleMagnitudeError(ValueError):
    """Values outside what a signal declares; `detail` holds the counts and the worst rows."""

    def __init__(self, message: str, detail: dict) -> None:
        super().__init__(message)
        self.detail = detail


#: How reasons begin that mean a signal without any value.
BLANK, NOTHING = "no price row has a value of", "no value to clean"


def stopped_by(df: DataFrame, findings: DataFrame) -> DataFrame:
    """df; a query on it fails where findings (why: string, null where all is well) has a row that says why.

    The check is a branch of the same plan that gives no rows, so it costs no job of its own and can't be forgotten. All its
    columns raise, so that a condition on any of them, which the optimiser pushes into the branch, raises too. It belongs around
    a result: inside one, a plan that proves its result empty leaves it out.
    """
    why = F.col("why")
    none = findings.filter(F.when(why.isNotNull(), F.raise_error(why).cast("boolean")).otherwise(F.lit(False)))
    return df.unionByName(none.select(*(F.when(why.isNotNull(), F.raise_error(why)).cast(f.dataType).alias(f.name) for f in df.schema.fields)))


def with_rows(df: DataFrame, why: str, of: DataFrame | None = None) -> DataFrame:
    """df, of which a query fails where it is empty, or where that of which it is made is."""
    return stopped_by(df, (df if of is None else of).agg(F.when(F.count("*") == 0, F.lit(why)).alias("why")))


def with_unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, of which a query fails where a key is null or repeated."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    said = F.concat(F.lit(f"keys {', '.join(keys)} are null or repeated: "), F.to_json(F.struct(*keys)))
    return stopped_by(df, df.groupBy(*keys).agg(F.count("*").alias("n_")).select(F.when((F.col("n_") > 1) | null, said).alias("why")))


def price_column(prices: DataFrame, *columns: str, result: DataFrame | None = None) -> DataFrame:
    """prices, or a result of them, for a signal that reads some columns: one that isn't there stops at once, one without any value stops the query."""
    for c in columns:
        if c not in prices.columns:
            raise ValueError(f"the signal reads {c}, and prices have only {', '.join(prices.columns)}")
    some = prices.agg(*(F.count(c).alias(c) for c in columns))
    blank = F.filter(F.array(*(F.when(F.col(c) == 0, F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    said = F.concat(F.lit(f"{BLANK} "), F.array_join(blank, ", "))
    return stopped_by(prices if result is None else result, some.select(F.when(F.size(blank) > 0, said).alias("why")))


def required(df: DataFrame, columns: tuple[str, ...] = VALUES) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {', '.join(missing)} are missing")
    return df


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, if its keys are known and differ."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    bad = df.groupBy(*keys).agg(F.count("*").alias("n_")).filter((F.col("n_") > 1) | null).limit(1).collect()
    if bad:
        raise ValueError(f"keys {', '.join(keys)} are null or repeated: {bad[0].asDict()}")
    return df


def not_empty(values: DataFrame) -> DataFrame:
    if required(values).isEmpty():
        raise EmptyFactorError("the signal has no values: look at its computation before the cleaning")
    return values


def share(most: float) -> float:
    if not 0 <= most <= 1:
        raise ValueError("a share lies between 0 and 1")
    return most
