"""The scoring protocol over a panel (ticker, signal_date, prediction, label)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import correlation, finite, ratio, weighted_mean
from tidemark.operators.order import quantiles, ranks
from tidemark.sources.kept import kept


def average_rank(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """df with r_<column>: ranks within by, ties share their mean. For short groups (a row a bin); `order.ranks` splits long ones."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2
    return df.withColumn(f"r_{column}", rank)


def _edged(panel: DataFrame, bins: int) -> DataFrame:
    """panel with bin, of dates with enough names; a bin may be empty."""
    edges = quantiles(panel.select("signal_date", "prediction"), "prediction", ["signal_date"], [i / bins for i in range(1, bins)]).filter(F.col("n") >= bins * 3)
    rows = panel.join(F.broadcast(edges.select("signal_date", "edges")), "signal_date")  # a row for each date
    return rows.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("prediction")))).drop("edges")


def binned(panel: DataFrame, bins: int = 5) -> DataFrame:
    """panel with bin from 0: edges are linear quantiles, right ends belong to the lower bin; dates with too few names or an empty bin go."""
    rows = _edged(kept(panel), bins)
    full = rows.groupBy("signal_date").agg(F.count_distinct("bin").alias("full")).filter(F.col("full") == bins)
    return rows.join(F.broadcast(full.select("signal_date")), "signal_date", "left_semi")


def quantile_returns(panel: DataFrame, bins: int = 5, weight: str | None = None) -> DataFrame:
    """signal_date, bin, mean_label, n of `binned`."""
    mean = weighted_mean(F.col("label"), F.col(weight)) if weight else F.avg("label")
    found = _edged(kept(panel), bins).groupBy("signal_date", "bin").agg(mean.alias("mean_label"), F.count("*").alias("n"))
    return found.withColumn("full", F.count("*").over(Window.partitionBy("signal_date"))).filter(F.col("full") == bins).drop("full")  # a row for each bin


def long_short(quantiles: DataFrame, bins: int = 5) -> DataFrame:
    """signal_date, spread of the top bin over the bottom one."""
    top, low = (F.max(F.when(F.col("bin") == b, F.col("mean_label"))) for b in (bins - 1, 0))
    return quantiles.groupBy("signal_date").agg((top - low).alias("spread")).filter("spread IS NOT NULL")


def information_coefficient(panel: DataFrame, least: int = 5) -> DataFrame:
    """signal_date, ic (rank correlation), n; dates on which either side is constant go."""
    rows = kept(panel.select("signal_date", "prediction", "label"))
    ranked = ranks(ranks(rows, "prediction", ["signal_date"]), "label", ["signal_date"], rows)
    per = ranked.groupBy("signal_date").agg(F.count("*").alias("n"), correlation(F.col("r_prediction"), F.col("r_label")).alias("ic"))
    return per.filter((F.col("n") >= least) & F.col("ic").isNotNull()).select("signal_date", "ic", "n")


def t_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of a t statistic with a whole number of degrees of freedom: a finite sum of so many terms, about half."""
    angle = F.atan(F.abs(t) / F.sqrt(freedom))
    sin, cos = F.sin(angle), F.cos(angle)
    # Powers of the cosine below the degrees: 1, 3, ... of odd ones, 0, 2, ... of even ones.
    first = (freedom % 2).cast("long")
    powers = F.when(freedom - 2 >= first, F.sequence(first, (freedom - 2).cast("long"), F.lit(2).cast("long"))).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("factor"))
    step = lambda s, k: F.struct((s["sum"] + s["factor"] * F.pow(cos, k)).alias("sum"), (s["factor"] * (k + 1) / (k + 2)).alias("factor"))
    terms = F.aggregate(powers, start, step)["sum"]
    inside = F.when(first == 1, 2 / math.pi * (angle + sin * terms)).otherwise(sin * terms)
    return F.greatest(F.lit(0.0), 1 - inside)


def monotonicity(quantiles: DataFrame) -> DataFrame:
    """One row: rank correlation of bin numbers and their mean returns, its p-value from a t statistic, and the number of bins."""
    means = quantiles.groupBy("bin").agg(F.avg("mean_label").alias("m")).withColumn("all_", F.lit(1))
    ranked = average_rank(average_rank(means, "bin", ["all_"]), "m", ["all_"])
    out = ranked.agg(F.count("*").alias("n_bins"), correlation(F.col("r_bin"), F.col("r_m")).alias("rho"))
    out = out.select("n_bins", F.when(F.col("n_bins") >= 3, F.col("rho")).alias("rho"))
    left = (1 + F.col("rho")) * (1 - F.col("rho"))
    t = F.col("rho") * F.sqrt((F.col("n_bins") - 2) / F.greatest(left, F.lit(1e-300)))
    return out.withColumn("p", F.when(F.col("rho").isNotNull(), t_p(t, F.col("n_bins") - 2)))


def slopes(panel: DataFrame, least: int = 10) -> DataFrame:
    """signal_date, slope of label on prediction, n; dates on which the prediction is constant go."""
    per = panel.groupBy("signal_date").agg(F.count("*").alias("n"), F.regr_slope("label", "prediction").alias("slope"), F.stddev_pop("prediction").alias("sd"))
    return per.filter((F.col("n") >= least) & (F.col("sd") > 0) & F.col("slope").isNotNull()).select("signal_date", "slope", "n")


#: More lags than any series of fewer than 10**11 dates takes.
MOST_LAGS = 512


def newey_west(series: DataFrame, value: str, least: int = 5) -> DataFrame:
    """One row for a series by signal_date: n, mean, naive_t and nw_t of its mean (null with fewer than `least`).

    Bartlett weights up to max(1, floor(4 (n / 100)^(2/9))) lags, and the factor n / (n - 1). A series has one row a date.
    """
    order = Window.orderBy("signal_date")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = series.select("signal_date", F.col(value).alias("v")).withColumns({"i": F.row_number().over(order), "n": F.count("*").over(whole), "mu": F.avg("v").over(whole)})
    x = x.withColumns({"u": F.col("v") - F.col("mu"), "lags": F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9)))).cast("int")})
    past = F.collect_list("u").over(order.rowsBetween(-MOST_LAGS, 0))  # the row itself is the last
    lagged = F.aggregate(
        F.sequence(F.lit(1), F.col("lags")),
        F.lit(0.0),
        lambda s, k: s + F.when(k < F.col("i"), 2 * (1 - k / (F.col("lags") + 1)) * F.col("u") * F.try_element_at(F.col("past"), (-1 - k).cast("int"))).otherwise(0.0),
    )
    sums = x.withColumn("past", past).withColumn("term", F.col("u") * F.col("u") + lagged)
    out = sums.agg(F.max("n").alias("n"), F.max("mu").alias("mean"), F.sum("term").alias("s"), F.sum(F.col("u") * F.col("u")).alias("ss"))
    n = F.col("n").cast("double")
    nw = F.sqrt(F.greatest(F.col("s"), F.lit(0.0)) / (n * n) * ratio(n, n - 1))
    naive = F.sqrt(ratio(F.col("ss"), n - 1) / n)
    enough = F.col("n") >= least
    return out.select("n", "mean", F.when(enough, ratio(F.col("mean"), naive)).alias("naive_t"), F.when(enough, ratio(F.col("mean"), nw)).alias("nw_t"))


def two_sided(t: Column) -> Column:
    """Two-sided p-value of a normal statistic, to double precision: a series near 0, a continued fraction farther out."""
    x = F.abs(t) / math.sqrt(2)
    near = F.least(x, F.lit(3.0))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))
    step = lambda s, n: F.struct((s["sum"] + s["term"] * 2 * near * near / (2 * n + 1)).alias("sum"), (s["term"] * 2 * near * near / (2 * n + 1)).alias("term"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, step)["sum"]
    inside = 1 - 2 / math.sqrt(math.pi) * near * F.exp(-near * near) * series
    far = F.greatest(x, F.lit(1.0))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, n: 1 + n / (2 * far * far) / s)
    return F.when(x < 3, inside).otherwise(F.exp(-far * far) / (far * math.sqrt(math.pi)) / fraction)


def with_p(slope: DataFrame) -> DataFrame:
    """The row of `newey_west` with nw_p, null where it has no statistic."""
    return slope.withColumn("nw_p", F.when(finite(F.col("nw_t")), two_sided(F.col("nw_t"))))


def normal_p(t: float | None) -> float | None:
    """Two-sided p-value of a normal statistic."""
    return None if t is None or math.isnan(t) else math.erfc(abs(t) / math.sqrt(2))


def controlled_slopes(panel: DataFrame, controls: list[str], least: int = 10) -> DataFrame:
    """signal_date, slope of label on prediction beside controls, n; a control with any unknown value on a date is left out there.

    A date's names are summed to covariances, on the map side first; the small system of each date is solved from its one row.
    """
    import numpy as np
    import pandas as pd

    names = ["prediction", *controls]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    value = [F.col(c).cast("double") for c in names]
    ok = [finite(v) for v in value]
    sums = panel.groupBy("signal_date").agg(
        F.count("*").alias("n"),
        *(F.count(F.when(o, 1)).alias(f"n{i}") for i, o in enumerate(ok)),
        *(F.covar_pop(F.when(ok[i], value[i]), F.when(ok[j], value[j])).alias(f"c{i}_{j}") for i, j in pairs),
        *(F.covar_pop(F.when(o, v), F.col("label").cast("double")).alias(f"y{i}") for i, (v, o) in enumerate(zip(value, ok, strict=True))),
    )

    def solve(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                used = [i for i in range(len(names)) if r[f"n{i}"] == r["n"]]
                if r["n"] < least or 0 not in used:
                    continue
                cov = np.array([[r[f"c{max(i, j)}_{min(i, j)}"] for j in used] for i in used])
                scale = np.sqrt(np.diag(cov))
                if (scale <= 0).any() or np.linalg.matrix_rank(cov / np.outer(scale, scale), tol=1e-12) < len(used):
                    continue
                beta = np.linalg.solve(cov / np.outer(scale, scale), np.array([r[f"y{i}"] for i in used]) / scale) / scale
                out.append((r["signal_date"], float(beta[0]), int(r["n"])))
            yield pd.DataFrame(out, columns=["signal_date", "slope", "n"])

    return sums.mapInPandas(solve, "signal_date date, slope double, n long")


def subperiods(series: DataFrame, value: str, parts: int = 3) -> DataFrame:
    """part, start_date, end_date, n, mean, mean over sample deviation, share above 0; parts differ by one date at most."""
    rows = series.withColumn("part", F.ntile(parts).over(Window.orderBy("signal_date")))
    v = F.col(value)
    return rows.groupBy("part").agg(F.min("signal_date").alias("start_date"), F.max("signal_date").alias("end_date"), F.count("*").alias("n"), F.avg(v).alias("mean"), ratio(F.avg(v), F.stddev_samp(v)).alias("ratio"), F.avg((v > 0).cast("double")).alias("hit_rate"))


def breadth(quantiles: DataFrame) -> DataFrame:
    """One row: names per quantile and date: average, least, tenth percentile, median, ninetieth, most; dates; and a flag for least <= 3."""
    p = F.percentile("n", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = quantiles.agg(F.avg("n").alias("avg_n"), F.min("n").alias("min_n"), p.alias("p"), F.max("n").alias("max_n"), F.count_distinct("signal_date").alias("n_dates"))
    return out.select("avg_n", "min_n", F.col("p")[0].alias("p10_n"), F.col("p")[1].alias("median_n"), F.col("p")[2].alias("p90_n"), "max_n", "n_dates", (F.col("min_n") <= 3).alias("thin"))


def summary(ic: DataFrame, spread: DataFrame) -> DataFrame:
    """One row: mean, deviation and hit rate of the coefficients, mean, ratio and hit rate of the spreads (not annualised)."""
    a = ic.agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("ic_hit"), F.count("*").alias("n_ic"))
    b = spread.agg(F.avg("spread").alias("ls_mean"), ratio(F.avg("spread"), F.stddev_samp("spread")).alias("ls_ratio"), F.avg((F.col("spread") > 0).cast("double")).alias("ls_hit"), F.count("*").alias("n_ls"))
    return a.crossJoin(b)  # one row each


def run_protocol(panel: DataFrame, bins: int = 5, weights: DataFrame | None = None, controls: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every score of a panel: quantiles, long_short, ic, monotonicity, slope, subperiods, breadth and summary.

    weights (ticker, weight) and controls (ticker, ...) are looked up by ticker; a name without a weight has none, and so its bin
    has no mean. The panel is read eight times, and so are the bins: both are written once to the shared folder.
    """
    if weights is not None:
        panel = panel.join(weights.select("ticker", F.col("weight").alias("weight_")), "ticker", "left")
    names = [c for c in controls.columns if c != "ticker"] if controls is not None else []
    if names:
        panel = panel.join(controls, "ticker", "left")
    panel = kept(panel)
    by_bin = kept(quantile_returns(panel, bins, "weight_" if weights is not None else None))
    spread, ic = long_short(by_bin, bins), information_coefficient(panel)
    dates = panel.agg(F.count_distinct("signal_date").alias("n_dates"), F.count("*").alias("n_observations"))
    whole = summary(ic, spread).crossJoin(breadth(by_bin).withColumnRenamed("n_dates", "n_quantile_dates")).crossJoin(dates)  # one row each
    return {
        "panel": panel,
        "quantiles": by_bin,
        "long_short": spread,
        "ic": ic,
        "monotonicity": monotonicity(by_bin),
        "slope": with_p(newey_west(controlled_slopes(panel, names) if names else slopes(panel), "slope")),
        "subperiods": subperiods(spread, "spread"),
        "summary": whole.withColumn("n_dates_dropped", F.col("n_dates") - F.col("n_quantile_dates")),
    }
