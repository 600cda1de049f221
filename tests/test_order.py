"""Ranks and quantiles by ranges of values, against numpy and pandas; plans that split a group."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import order, panel, protocol


def odd_values(seed, n):
    rng = random.Random(seed)
    pick = lambda: rng.choice((rng.gauss(0, 1), rng.gauss(0, 1) * 10 ** rng.randrange(-300, 300), float(rng.randrange(-3, 4)), 0.0, -0.0, 2.0**rng.randrange(-5, 5), 1 + rng.random() * 1e-12, 5e-324, -1.5))
    return [("ab"[i % 2], pick()) for i in range(n)]


def test_ranges_keep_the_order(spark):
    values = sorted({v for _, v in odd_values(1, 3000)} | {math.inf, -math.inf, math.nextafter(8, 0), 8.0, math.nextafter(8, 9)})
    power, step = order.range_of(F.col("v"))
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", power.alias("p"), step.alias("s")).orderBy("v").collect()
    places = [(r["p"], r["s"]) for r in rows]
    assert places == sorted(places) and len(set(places)) > 500
    ends = spark.createDataFrame([(None,), (math.nan,)], "v double").select(power.alias("p")).collect()
    assert ends[0]["p"] < min(p for p, _ in places) and ends[1]["p"] > max(p for p, _ in places)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_equal_pandas(spark, seed):
    rows = odd_values(seed, 2000)
    found = order.ranks(spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g string, v double, i int"), "v", ["g"]).toPandas().sort_values("i")
    frame = pd.DataFrame(rows, columns=["g", "v"])
    assert (found["r_v"].to_numpy() == frame.groupby("g")["v"].rank().to_numpy()).all()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1501])
def test_quantiles_equal_numpy(spark, n):
    rng = random.Random(n)
    rows = [(g, rng.choice((rng.gauss(0, 5), float(rng.randrange(4))))) for g in "abc" for _ in range(n)]
    shares = [0.0, 0.01, 0.2, 0.5, 0.99, 1.0]
    found = order.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], shares).collect()
    assert {r["g"]: r["n"] for r in found} == {g: n for g in "abc"}
    for r in found:
        assert np.allclose(r["edges"], np.quantile([v for g, v in rows if g == r["g"]], shares), rtol=1e-12, atol=1e-12)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_window_takes_a_whole_date(spark):
    """Windows run over ranges of a date, or over the counts of its ranges; rows of one date are many tasks' work."""
    rows = spark.range(60000).selectExpr("DATE'2020-01-31' AS signal_date", "CONCAT('T', id) AS ticker", "SIN(id) AS value", "SIN(id) AS prediction", "COS(id) AS label")
    for df in (panel.cleaned(rows.select("signal_date", "ticker", "value")), protocol.quantile_returns(rows.select("signal_date", "ticker", "prediction", "label")), protocol.information_coefficient(rows.select("signal_date", "ticker", "prediction", "label"))):
        for line in plan_of(df).splitlines():
            if "Window [" in line and "[signal_date" in line.split("], [")[1]:
                parts = line.split("], [")[1]
                assert "power_" in parts or "power_" in line.split("], [")[2] or "all_" in line or "AS full" in line
    split = order.ranged(rows, "value")
    sizes = [r["count"] for r in split.groupBy("power_", "step_").count().collect()]
    assert max(sizes) < 3000 and len(sizes) > 500


def test_p_values_of_many_degrees(spark):
    """Against the integral of Student's density."""
    rows = [(t, f) for t in (0.1, 1.0, 2.0, 5.0) for f in (1, 2, 3, 8, 29, 30, 31, 38, 99, 400)]
    found = spark.createDataFrame(rows, "t double, f long").select("t", "f", protocol.t_p(F.col("t"), F.col("f")).alias("p")).collect()
    for r in found:
        x = np.linspace(0, r["t"], 20001)
        density = np.exp(math.lgamma((r["f"] + 1) / 2) - math.lgamma(r["f"] / 2)) / math.sqrt(r["f"] * math.pi) * (1 + x * x / r["f"]) ** (-(r["f"] + 1) / 2)
        assert r["p"] == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-6)


def test_normal_p_values(spark):
    rows = [(t,) for t in (0.0, 0.3, -1.96, 2.5, 4.2, 4.25, 6.0, 12.0, -30.0)]
    for r in spark.createDataFrame(rows, "t double").select("t", protocol.two_sided(F.col("t")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["t"]) / math.sqrt(2)), rel=1e-11)
