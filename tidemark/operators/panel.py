"""Membership, cross-section cleaning, forward returns and their attrition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions import finite, ratio
from tidemark.operators.factors import sessions
from tidemark.operators.guards import NOTHING, EmptyFactorError
from tidemark.operators.order import quantiles
from tidemark.sources.kept import kept

KEY = ("ticker", "signal_date")


def membership(securities: DataFrame, dates: DataFrame) -> DataFrame:
    """Distinct (ticker, signal_date) of securities that were filing on the date; an unknown bound is open."""
    inside = (F.col("first_filing").isNull() | (F.col("first_filing") <= F.col("signal_date"))) & (F.col("last_filing").isNull() | (F.col("last_filing") >= F.col("signal_date")))
    return securities.join(F.broadcast(dates), inside).select(*KEY).distinct()


def gate(values: DataFrame, members: DataFrame) -> DataFrame:
    """Values of members."""
    return values.join(members, list(KEY), "left_semi")


def gate_report(values: DataFrame, members: DataFrame) -> DataFrame:
    """signal_date, n_in, n_out, n_excluded."""
    marked = values.join(members.withColumn("in_", F.lit(1)), list(KEY), "left")
    return marked.groupBy("signal_date").agg(F.count("*").alias("n_in"), F.count("in_").alias("n_out"), (F.count("*") - F.count("in_")).alias("n_excluded"))


def cleaned(values: DataFrame, securities: DataFrame | None = None, least: int = 10, tails: tuple[float, float] = (0.01, 0.99), counts: Observation | None = None) -> DataFrame:
    """ticker, signal_date, value (winsorised, group-neutral, standardised) and was_clipped.

    An empty input is an error. Non-finite values go, then dates with fewer than `least` names. Then, by date: values are clipped at linear
    quantiles, if there are three at least; group means are subtracted (a name without a group has no value from
    here on, but stays); and what is left is standardised by the sample deviation, 0 where nothing varies.
    counts observes n_input and n_finite while values flow. Dates are split over tasks: quantiles by ranges of values, means and deviations on the map side first.
    """
    if counts is not None:
        ok = finite(F.col("value"))
        values = values.observe(counts, F.count("*").alias("n_input"), F.count(F.when(ok, 1)).alias("n_finite"))
    whole = kept(values.select(*KEY, "value"))
    if whole.isEmpty():
        raise EmptyFactorError(f"{NOTHING}: the signal is empty")
    rows = whole.filter(finite(F.col("value")))
    edges = quantiles(rows, "value", ["signal_date"], list(tails)).filter(F.col("n") >= least)
    rows = rows.join(F.broadcast(edges), "signal_date")  # a row for each date
    clip = F.when(F.col("n") < 3, F.col("value")).when(F.col("value") < F.col("edges")[0], F.col("edges")[0]).when(F.col("value") > F.col("edges")[1], F.col("edges")[1]).otherwise(F.col("value"))
    rows = rows.select(*KEY, clip.alias("clip"), (clip != F.col("value")).alias("was_clipped"))
    if securities is None:
        moments = rows.groupBy("signal_date").agg(F.stddev_samp("clip").alias("sd"), F.avg("clip").alias("mu"))
    else:
        groups = securities.groupBy("ticker").agg(F.max("sic").alias("grp"))
        rows = rows.join(groups, "ticker", "left")
        each = rows.filter("grp IS NOT NULL").groupBy("signal_date", "grp").agg(F.count("*").alias("n_"), F.avg("clip").alias("mean_"), F.var_pop("clip").alias("var_"))
        # What is left of groups varies around 0, by the variances within them.
        moments = each.groupBy("signal_date").agg(F.sqrt(F.try_divide(F.sum(F.col("n_") * F.col("var_")), F.sum("n_") - 1)).alias("sd"), F.lit(0.0).alias("mu"))
        rows = rows.join(each.select("signal_date", "grp", "mean_"), ["signal_date", "grp"], "left").withColumn("clip", F.col("clip") - F.col("mean_"))
    rows = rows.join(F.broadcast(moments), "signal_date", "left")
    z = F.when(F.col("clip").isNull(), F.lit(None)).when(F.col("sd") > 1e-12, (F.col("clip") - F.col("mu")) / F.col("sd")).otherwise(F.lit(0.0))
    return rows.select(*KEY, z.alias("value"), "was_clipped")


def cleaning_report(values: DataFrame, clean: DataFrame, least: int = 10) -> DataFrame:
    """One row: values in, not finite, on small dates, out, clipped, dates in and out."""
    per = values.groupBy("signal_date").agg(F.count("*").alias("n"), F.count(F.when(finite(F.col("value")), 1)).alias("ok"))
    before = per.agg(F.sum("n").alias("n_input"), F.sum(F.col("n") - F.col("ok")).alias("n_not_finite"), F.sum(F.when(F.col("ok") < least, F.col("ok")).otherwise(0)).alias("n_small_dates"), F.count("*").alias("dates_in"), F.count(F.when(F.col("ok") < least, 1)).alias("small_dates"))
    after = clean.agg(F.count("*").alias("n_output"), F.count(F.when(F.col("was_clipped"), 1)).alias("n_winsorised"), F.count_distinct("signal_date").alias("dates_out"))
    return before.crossJoin(after)  # one row each


def schedule(prices: DataFrame, dates: DataFrame, lag: int = 1, horizon: int = 1) -> DataFrame:
    """signal_date with its formation, entry and exit sessions, null where the calendar has none."""
    if horizon < 1 or lag < 0:
        raise ValueError("horizon must be 1 or more and lag 0 or more")
    days = sessions(prices)
    formed = dates.join(F.broadcast(days), F.col("trade_date") <= F.col("signal_date"), "left").groupBy("signal_date").agg(F.max("session_idx").alias("f"), F.max("trade_date").alias("formation_session"))
    at = lambda name: days.select(F.col("session_idx").alias(f"{name}_i"), F.col("trade_date").alias(f"{name}_date"))
    out = formed.join(at("entry"), F.col("entry_i") == F.col("f") + lag, "left").join(at("exit"), F.col("exit_i") == F.col("f") + lag + horizon, "left")
    return out.select("signal_date", "formation_session", "entry_date", "exit_date")


def labelled(values: DataFrame, prices: DataFrame, lag: int = 1, horizon: int = 1) -> DataFrame:
    """values (as prediction) with label and outcome: matched, or why there is no label."""
    plan = schedule(prices, values.select("signal_date").distinct(), lag, horizon)
    rows = values.select(*KEY, F.col("value").alias("prediction")).join(F.broadcast(plan), "signal_date")
    price = lambda name: prices.select("ticker", F.col("trade_date").alias(f"{name}_date"), F.col("close_adj").alias(f"{name}_price"))
    rows = rows.join(price("entry"), ["ticker", "entry_date"], "left").join(price("exit"), ["ticker", "exit_date"], "left")
    rows = rows.join(prices.select("ticker").distinct().withColumn("has_prices", F.lit(True)), "ticker", "left")
    label = ratio(F.col("exit_price"), F.col("entry_price")) - 1
    no_entry, no_exit = F.col("entry_price").isNull(), F.col("exit_price").isNull()
    outcome = (
        F.when(F.col("formation_session").isNull(), "no_formation_session")
        .when(F.col("exit_date").isNull(), "no_full_horizon")
        .when(F.col("has_prices").isNull(), "no_price_history")
        .when(no_entry & no_exit, "missing_entry_and_exit_price")
        .when(no_entry, "missing_entry_price")
        .when(no_exit, "missing_exit_price")
        .when(~finite(label), "nonfinite_return")
        .otherwise("matched")
    )
    return rows.withColumn("outcome", outcome).select(*KEY, "prediction", F.when(F.col("outcome") == "matched", label).alias("label"), "formation_session", "entry_date", "exit_date", "outcome")


def attrition(panel: DataFrame) -> DataFrame:
    """outcome and n_rows."""
    return panel.groupBy("outcome").agg(F.count("*").alias("n_rows"))


def dropped_by_date(panel: DataFrame) -> DataFrame:
    """signal_date, outcome and n_rows of rows without a label."""
    return panel.filter("outcome <> 'matched'").groupBy("signal_date", "outcome").agg(F.count("*").alias("n_rows"))


def scored(panel: DataFrame) -> DataFrame:
    """Rows that can be scored."""
    return panel.filter((F.col("outcome") == "matched") & finite(F.col("prediction"))).drop("outcome")
