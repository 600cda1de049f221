"""Membership, cleaning, labels and scores on small inputs with known answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import panel, protocol
from tidemark.sources import tables

D = dt.date.fromisoformat
VALUES = "ticker string, signal_date date, value double"


def test_membership_bounds_and_gate(spark):
    s = spark.createDataFrame([("1", "A", D("2020-01-01"), D("2020-06-30")), ("2", "B", None, None), ("2", "B", None, None)], "cik string, ticker string, first_filing date, last_filing date")
    dates = spark.createDataFrame([(D("2020-01-31"),), (D("2020-07-31"),)], "signal_date date")
    members = panel.membership(s, dates)
    assert sorted((r["ticker"], str(r["signal_date"])) for r in members.collect()) == [("A", "2020-01-31"), ("B", "2020-01-31"), ("B", "2020-07-31")]
    values = spark.createDataFrame([("A", D("2020-07-31"), 1.0), ("B", D("2020-07-31"), 1.0)], VALUES)
    assert panel.gate(values, members).count() == 1
    assert tuple(panel.gate_report(values, members).first())[1:] == (2, 1, 1)


def test_cleaning(spark):
    rows = [(f"T{i:02}", D("2020-01-31"), float(i)) for i in range(11)] + [("T11", D("2020-01-31"), 1000.0), ("T12", D("2020-01-31"), float("nan")), ("Z", D("2020-02-29"), 1.0)]
    values = spark.createDataFrame(rows, VALUES)
    out = panel.cleaned(values)
    z = {r["ticker"]: r for r in out.collect()}
    assert len(z) == 12 and z["T11"]["was_clipped"] and z["T00"]["was_clipped"]
    assert sum(r["value"] for r in z.values()) == pytest.approx(0, abs=1e-9)
    report = panel.cleaning_report(values, out).first()
    assert report["n_input"] == report["n_output"] + report["n_not_finite"] + report["n_small_dates"] and report["small_dates"] == 1
    flat = spark.createDataFrame([(f"T{i}", D("2020-01-31"), 5.0) for i in range(10)], VALUES)
    assert {r["value"] for r in panel.cleaned(flat).collect()} == {0.0}
    groups = spark.createDataFrame([(f"T{i}", "a" if i < 5 else None if i == 5 else str(i)) for i in range(10)], "ticker string, sic string")
    n = {r["ticker"]: r["value"] for r in panel.cleaned(flat, groups).collect()}
    assert n["T5"] is None and n["T0"] == 0.0 and len(n) == 10


def test_outcomes(spark):
    sessions = ("2023-12-29", "2024-01-02", "2024-01-03")
    price = {"A": (1, 2, 3), "B": (1, 2, None), "D": (1, 0, 3), "E": (1, None, 3), "F": (1, None, None)}
    rows = [(t, D(d), None if p is None else float(p)) for t, ps in price.items() for d, p in zip(sessions, ps) if p is not None]
    prices = tables.load_prices(spark.createDataFrame(rows, "ticker string, trade_date date, close_adj double"))
    values = spark.createDataFrame([(t, D("2023-12-31"), 1.0) for t in "ABCDEF"], VALUES)
    found = panel.labelled(values, prices)
    got = {r["ticker"]: r["outcome"] for r in found.collect()}
    assert got == {"A": "matched", "B": "missing_exit_price", "C": "no_price_history", "D": "nonfinite_return", "E": "missing_entry_price", "F": "missing_entry_and_exit_price"}
    a = found.filter("ticker = 'A'").first()
    assert (str(a["formation_session"]), str(a["entry_date"]), str(a["exit_date"]), a["label"]) == ("2023-12-29", "2024-01-02", "2024-01-03", 0.5)
    late = panel.labelled(values.withColumn("signal_date", F.lit("2024-01-03").cast("date")), prices)
    assert {r["outcome"] for r in late.collect()} == {"no_full_horizon"}
    early = panel.labelled(values.withColumn("signal_date", F.lit("2020-01-03").cast("date")), prices)
    assert {r["outcome"] for r in early.collect()} == {"no_formation_session"}
    with pytest.raises(ValueError):
        panel.schedule(prices, values.select("signal_date"), horizon=0)


def scored(spark, dates=12, names=50, label=lambda x, rng: x):
    rng = random.Random(3)
    rows = []
    for k in range(dates):
        for i in range(names):
            x = rng.random()
            rows.append((f"T{i}", dt.date(2020, 1, 28) + dt.timedelta(days=30 * k), x, label(x, rng)))
    return spark.createDataFrame(rows, "ticker string, signal_date date, prediction double, label double")


def test_perfect_and_idle_signals(spark):
    p = scored(spark)
    ic = protocol.information_coefficient(p)
    assert all(r["ic"] == pytest.approx(1) for r in ic.collect())
    q = protocol.quantile_returns(p)
    assert protocol.monotonicity(q).first()["rho"] == pytest.approx(1)
    assert all(r["spread"] > 0.5 for r in protocol.long_short(q).collect())
    idle = scored(spark, dates=24, label=lambda x, rng: rng.random())
    s = protocol.summary(protocol.information_coefficient(idle), protocol.long_short(protocol.quantile_returns(idle))).first()
    assert abs(s["ic_mean"]) < 0.1
    assert protocol.information_coefficient(p.withColumn("prediction", F.lit(1.0))).count() == 0


def test_breadth(spark):
    p = scored(spark, dates=1, names=20).unionByName(scored(spark, 1, 25).withColumn("signal_date", F.lit("2021-01-31").cast("date"))).unionByName(scored(spark, 1, 30).withColumn("signal_date", F.lit("2021-02-28").cast("date")))
    b = protocol.breadth(protocol.quantile_returns(p)).first()
    assert (b["avg_n"], b["min_n"], b["median_n"], b["max_n"], b["n_dates"], b["thin"]) == (5.0, 4, 5.0, 6, 3, False)
    assert protocol.quantile_returns(scored(spark, 1, 14)).count() == 0


def test_weighted_quantiles(spark):
    p = scored(spark, 1, 20).withColumn("w", F.lit(2.0))
    plain = {r["bin"]: r["mean_label"] for r in protocol.quantile_returns(p).collect()}
    assert {r["bin"]: r["mean_label"] for r in protocol.quantile_returns(p, weight="w").collect()} == pytest.approx(plain)
    assert {r["mean_label"] for r in protocol.quantile_returns(p.withColumn("w", F.lit(float("nan"))), weight="w").collect()} == {None}


def test_newey_west_by_hand(spark):
    v = [0.3, -0.1, 0.4, 0.2, 0.0, 0.5, 0.1, 0.2]
    s = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), x) for i, x in enumerate(v)], "signal_date date, v double")
    n, mean = len(v), sum(v) / len(v)
    u = [x - mean for x in v]
    lags = max(1, int(4 * (n / 100) ** (2 / 9)))
    total = sum(x * x for x in u) + 2 * sum((1 - k / (lags + 1)) * sum(a * b for a, b in zip(u[k:], u)) for k in range(1, lags + 1))
    r = protocol.newey_west(s, "v").first()
    assert r["mean"] == pytest.approx(mean) and r["nw_t"] == pytest.approx(mean / (total / n**2 * n / (n - 1)) ** 0.5)
    assert protocol.newey_west(s.limit(3), "v").first()["nw_t"] is None
    assert protocol.normal_p(1.959964) == pytest.approx(0.05, abs=1e-5)


def test_slopes_and_controls(spark):
    p = scored(spark, 3, 12, lambda x, rng: 2 * x + 1)
    assert all(r["slope"] == pytest.approx(2) for r in protocol.slopes(p).collect())
    c = p.withColumn("c", F.hash("ticker") % 7 * F.lit(1.0)).withColumn("label", F.col("label") + F.col("c") * 3)
    assert all(r["slope"] == pytest.approx(2) for r in protocol.controlled_slopes(c, ["c"]).collect())


def test_subperiods(spark):
    s = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(7)], "signal_date date, v double")
    assert [r["n"] for r in protocol.subperiods(s, "v").orderBy("part").collect()] == [3, 2, 2]
