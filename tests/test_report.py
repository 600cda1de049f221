"""Vintage layers, bundle and text, and the stream of filings."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import factors, panel, vintage
from tidemark.plans import report
from tidemark.sources import tables
from tidemark.sources.tables import Tables
from tidemark.streaming import filings


def market(spark, names=12, months=8):
    """Month-end prices that follow book values, and one revision for each security."""
    rng = random.Random(1)
    ends = [dt.date(2020, 1, 31)]
    while len(ends) < months:
        first = (ends[-1].replace(day=1) + dt.timedelta(days=62)).replace(day=1)
        ends.append(first - dt.timedelta(days=1))
    securities = [(str(i), f"T{i:010}", "g") for i in range(names)]
    prices, facts = [], []
    for i in range(names):
        p = 10.0 + i
        for d in ends:
            p *= 1 + rng.uniform(-0.1, 0.1)
            prices.append((f"T{i:010}", d, p, p, 1000.0 + i))
        facts.append((str(i), "E", dt.date(2019, 12, 31), dt.date(2019, 12, 31), dt.date(2020, 1, 5), 500.0 + rng.random() * 100))
        facts.append((str(i), "E", dt.date(2019, 12, 31), dt.date(2019, 12, 31), dt.date(2020, 5, 5), 500.0 + rng.random() * 100))
    s = tables.load_securities(spark.createDataFrame(securities, "cik string, ticker string, sic string"))
    p = tables.load_prices(spark.createDataFrame(prices, "ticker string, trade_date date, close double, close_adj double, shares_out double"))
    f = tables.load_facts(spark.createDataFrame(facts, "cik string, tag string, period_start date, period_end date, filed date, value double")).withColumn("unit", F.lit("USD"))
    return Tables(s, p, f), spark.createDataFrame([(d,) for d in ends], "signal_date date")


def test_layers_and_bundle(spark, tmp_path):
    from tidemark.operators.factors import Tags

    t, dates = market(spark)
    found = vintage.compare(t, dates, "bm_ratio", t.prices, tags=Tags(equity="E"))
    assert [x.name for x in found["layers"]] == ["original_process", "common_observation", "common_support"] and found["verdict"] in ("PASS", "FAIL")
    assert vintage.compare(t, dates, "rev_1m", t.prices)["verdict"] == "NOT APPLICABLE"
    b = report.bundle(t, dates, t.prices, ["bm_ratio", "rev_1m", "turnover"], {"bins": 3}, tags=Tags(equity="E"))
    assert [f["status"] for f in b["factors"]] == ["OK", "OK", "EMPTY"]  # no volume
    assert b["factors"][0]["outcomes"]["no_full_horizon"] == 24
    report.write(b, str(tmp_path))
    text = report.render(b)
    assert report.replay(str(tmp_path)) == text == (tmp_path / "report.txt").read_text() and all(len(x) <= report.WIDTH for x in text.splitlines())


def test_outcome_identity(spark):
    row = [("A", dt.date(2020, 1, 31), 0.1, dt.date(2020, 1, 31), dt.date(2020, 2, 29), dt.date(2020, 3, 31))]
    p = spark.createDataFrame(row, "ticker string, signal_date date, label double, formation_session date, entry_date date, exit_date date")
    assert tuple(vintage.outcome_identity(p, p).first()) == (1, 1, 0)
    assert tuple(vintage.outcome_identity(p, p.withColumn("label", F.lit(0.2))).first()) == (1, 0, 0)


def test_stream_drops_repeats_only(spark, tmp_path):
    """A second start takes the files that came since: repeats of stored keys go, and a backfill of years before stays."""
    row = lambda tag, filed, v: ("1", tag, dt.date(2010, 3, 31), filed, v)

    def arrive(*rows):
        df = spark.createDataFrame(rows, "cik string, tag string, period_end date, filed date, value double")
        tables.load_facts(df).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        filings.write(filings.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        return sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    new, later = dt.date(2020, 5, 1), dt.date(2020, 9, 1)
    assert arrive(row("E", new, 1.0), row("E", new, 1.0), row("E", later, 2.0)) == [1.0, 2.0]
    assert arrive(row("E", later, 2.0), row("E", dt.date(2011, 1, 1), 3.0), row("F", new, 4.0)) == [1.0, 2.0, 3.0, 4.0]


def test_empty_and_implausible_signals_are_recorded(spark):
    from tidemark.operators.factors import Tags

    t, dates = market(spark)
    huge = Tables(t.securities, t.prices, t.facts.withColumn("value", F.col("value") * 1e9))
    found = [report.factor_report("bm_ratio", x, dates, t.prices, report.panel.membership(t.securities, dates), tags=Tags(equity=e))["status"] for x, e in ((t, "E"), (t, "none"), (huge, "E"))]
    assert found == ["OK", "EMPTY", "IMPLAUSIBLE"]


def test_signals_are_made_once_for_all_layers(spark, monkeypatch):
    day, made = dt.date.fromisoformat, spark.sparkContext.accumulator(0)

    def seen(value):
        made.add(1)
        return value

    counted = F.udf(seen, "double").asNondeterministic()
    ends = [day(f"2020-{m:02}-28") for m in range(1, 7)]
    bars = spark.createDataFrame([(f"T{i}", d, float(10 + i * k % 7 + k)) for i in range(12) for k, d in enumerate(ends)], "ticker string, trade_date date, close_adj double")
    rows = spark.createDataFrame([(f"T{i}", d, float(i * 5 % 12)) for i in range(12) for d in ends[:3]], "ticker string, signal_date date, value double")
    values = rows.withColumn("value", counted("value"))
    panel.cleaned(values).count()
    assert made.value == 36
    one = factors.Factor("once", lambda t, dates, arm="pit": values, uses_facts=True)
    monkeypatch.setitem(factors.REGISTRY, "once", one)
    made.value = 0
    securities = spark.createDataFrame([(f"T{i}", f"g{i % 2}") for i in range(12)], "ticker string, sic string")
    found = vintage.layers(Tables(securities, bars, None), rows.select("signal_date").distinct(), "once", bars)
    assert [x.gap for x in found] == [0.0, 0.0, 0.0] and made.value == 72
