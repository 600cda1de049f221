"""Point-in-time reads, signals and audits on small inputs with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, audit, factors
from tidemark.sources import ingest, tables
from tidemark.sources.tables import Tables

D = dt.date.fromisoformat


def facts_of(spark, rows):
    """rows: cik, tag, start, end, filed, value and optionally fiscal year and period."""
    full = [(c, t, D(s), D(e), D(f), float(v), *(more or (None, None))) for c, t, s, e, f, v, *more in rows]
    df = spark.createDataFrame(full, "cik string, tag string, period_start date, period_end date, filed date, value double, fiscal_year int, fiscal_period string")
    return tables.load_facts(df.withColumns({"unit": F.lit("USD"), "fact_type": F.lit("duration")}))


def dates_of(spark, *days):
    return spark.createDataFrame([(D(d),) for d in days], "signal_date date")


def prices_of(spark, rows):
    df = spark.createDataFrame([(t, D(d), None if p is None else float(p), None if p is None else float(p), 100.0, 1000.0) for t, d, p in rows], "ticker string, trade_date date, close double, close_adj double, volume double, shares_out double")
    return tables.load_prices(df)


def securities_of(spark, *ciks):
    return tables.load_securities(spark.createDataFrame([(c, f"T{c}", "g") for c in ciks], "cik string, ticker string, sic string"))


QUARTERS = [("1", "I", "2023-01-01", "2023-03-31", "2023-05-01", 10), ("1", "I", "2023-01-01", "2023-06-30", "2023-08-01", 25), ("1", "I", "2023-01-01", "2023-09-30", "2023-11-01", 45), ("1", "I", "2023-01-01", "2023-12-31", "2024-02-01", 70), ("1", "I", "2024-01-01", "2024-03-31", "2024-05-01", 12), ("1", "I", "2024-01-01", "2024-06-30", "2024-08-01", 30)]


def test_twelve_months_from_cumulative_reports(spark):
    facts = facts_of(spark, QUARTERS)
    got = {str(r["signal_date"]): r["value"] for r in factors.ttm(facts, dates_of(spark, "2023-12-31", "2024-03-31", "2024-12-31")).collect()}
    assert got == {"2024-03-31": 70.0, "2024-12-31": 75.0}


def test_annual_report_counts_without_quarters(spark):
    facts = facts_of(spark, [("1", "I", "2022-01-01", "2022-12-31", "2023-02-01", 40)])
    assert [r["value"] for r in factors.ttm(facts, dates_of(spark, "2023-06-30")).collect()] == [40.0]


@pytest.mark.parametrize("years,want", [([(2022, 100), (2023, 110)], [-0.1]), ([(2021, 100), (2023, 120)], []), ([(2022, -5), (2023, 110)], [])])
def test_asset_growth(spark, years, want):
    rows = [("1", "A", f"{y}-12-31", f"{y}-12-31", f"{y + 1}-02-01", v, y, "FY") for y, v in years] + [("1", "A", "2024-03-31", "2024-03-31", "2024-05-01", 990, 2024, "Q1")]
    t = Tables(securities_of(spark, "1"), None, facts_of(spark, rows))
    got = [r["value"] for r in factors.asset_growth(t, dates_of(spark, "2024-06-30"), factors.Tags(assets="A")).collect()]
    assert got == pytest.approx(want)


def test_latest_known_waits_for_the_filing(spark):
    rows = [("1", "E", "2020-03-31", "2020-03-31", "2020-05-10", 5), ("1", "E", "2020-03-31", "2020-03-31", "2020-11-01", 3), ("1", "E", "2019-12-31", "2019-12-31", "2020-06-01", 9)]
    facts, dates = facts_of(spark, rows), dates_of(spark, "2020-04-30", "2020-05-11", "2020-05-12", "2020-10-31", "2020-11-30")
    pit = {str(r["signal_date"]): r["value"] for r in asof.latest_known(facts, dates).collect()}
    assert pit == {"2020-05-12": 5.0, "2020-10-31": 5.0, "2020-11-30": 3.0}
    late = {str(r["signal_date"]): r["value"] for r in asof.latest_known(facts, dates, arm="restated").collect()}
    assert late == {d: 3.0 for d in ("2020-04-30", "2020-05-11", "2020-05-12", "2020-10-31", "2020-11-30")}


def test_latest_known_equals_a_plain_join(spark):
    import random

    rng = random.Random(7)
    rows = []
    for i in range(300):
        end = dt.date(2018, 1, 1) + dt.timedelta(days=91 * rng.randrange(12))
        rows.append((str(rng.randrange(4)), rng.choice("EI"), str(end - dt.timedelta(days=rng.choice([90, 180]))), str(end), str(end + dt.timedelta(days=rng.randrange(400))), rng.randrange(50)))
    facts, dates = facts_of(spark, rows), dates_of(spark, *(f"20{y}-{m:02}-28" for y in (18, 19, 20, 21) for m in (2, 6, 9)))
    for arm in ("pit", "restated"):
        one = asof.latest_known(facts, dates, arm=arm).select("cik", "tag", "signal_date", "period_end", "filed", "value")
        seen = asof.visible_on(asof.restated(facts) if arm == "restated" else facts, dates, arm=arm)
        two = asof.latest(seen, ("cik", "tag", "signal_date"), ("period_end", "filed", *asof.TIES)).select(one.columns)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_sampling_has_a_bound(spark):
    series = spark.createDataFrame([("A", D("2020-02-28"), 1.0), ("A", D("2020-03-01"), 2.0), ("A", D("2020-03-02"), None)], "ticker string, trade_date date, value double")
    got = {str(r["signal_date"]): r["value"] for r in asof.sampled(series, dates_of(spark, "2020-02-27", "2020-03-05", "2020-03-11", "2020-03-12", "2020-06-30")).collect()}
    assert got == {"2020-03-05": 2.0, "2020-03-11": 2.0}


def test_sampling_leaves_other_days_out_before_it_shuffles(spark):
    lines = spark.createDataFrame([(t, D(f"2020-{m:02}-{d:02}"), float(m * d)) for t in "AB" for m in (1, 2, 3) for d in range(1, 29)], "ticker string, trade_date date, x double")
    bars = lines.repartition(3).groupBy("ticker", "trade_date").agg(F.sum("x").alias("value"))
    found = asof.sampled(bars, dates_of(spark, "2020-01-31", "2020-03-20"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") > plan.rindex("Aggregate [ticker") and plan.count("Aggregate [ticker") == 2
    got = {(r["ticker"], str(r["signal_date"]), str(r["observed"])): r["value"] for r in found.collect()}
    assert got == {(t, *k): v for t in "AB" for k, v in {("2020-01-31", "2020-01-28"): 28.0, ("2020-03-20", "2020-03-20"): 60.0}.items()}


def test_sides_of_a_comparison_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(value):
        made.add(1)
        return value

    counted = F.udf(seen, "string").asNondeterministic()
    side = lambda n: spark.createDataFrame([(f"T{i}", D("2020-01-31")) for i in range(n)], "ticker string, signal_date date").withColumn("ticker", counted("ticker"))
    row = audit.sample_comparison(side(4), side(6)).first()
    assert (row["n_both"], row["n_pit_only"], row["n_restated_only"]) == (4, 0, 2) and row["pit_hash"] == row["shared_hash"]
    assert made.value == 10


def test_calendar_returns(spark):
    days = {"2019-12-31": 100, "2020-01-31": 200, "2020-11-30": 200, "2020-12-31": 300}
    prices = prices_of(spark, [("X", d, p) for d, p in days.items()] + [("Y", d, 100 if d < "2020-07" else 150) for d in [*days, "2020-05-31"]])
    t = Tables(None, prices, None)
    dates = dates_of(spark, "2020-12-31")
    value = lambda f: {r["ticker"]: round(r["value"], 9) for r in factors.REGISTRY[f].compute(t, dates).collect()}
    assert value("mom_12_1") == {"X": 1.0, "Y": 0.5} and value("mom_6_1") == {"Y": 0.5} and value("rev_1m") == {"X": -0.5, "Y": 0.0}


def test_rolling_counts_market_sessions(spark):
    rows = [(t, f"2020-01-0{i}", 100 + i * i) for i in range(1, 6) for t in "AB" if (t, i) != ("A", 3)]
    grid = factors.on_sessions(prices_of(spark, rows), "close_adj")
    roll = {(r["ticker"], r["session_idx"]): r["value"] for r in factors.rolling(grid, F.avg, 2, 2).collect()}
    assert roll["A", 3] is None and roll["A", 4] is None and roll["A", 5] is not None and roll["B", 3] is not None


def test_rounds_as_sql_does(spark):
    from tidemark.plans.catalog import rounded

    below = 2.4999999999999998e-06  # times 10**6 it is 2.5
    rows = [(below, 3e-06), (-below, -3e-06), (2.4e-06, 2e-06), (1e308, 1e308), (float("inf"), float("inf")), (None, None)]
    got = rounded(spark.createDataFrame(rows, "value double, want double"), "value")
    assert [r["value"] for r in got.collect()] == [w for _, w in rows]


def test_market_cap_signals(spark):
    t = Tables(securities_of(spark, "1", "2"), prices_of(spark, [("T1", "2020-06-30", 10), ("T2", "2020-06-30", 20)]).withColumn("ticker", F.concat(F.lit("T000000000"), F.substring("ticker", 2, 1))), facts_of(spark, [("1", "E", "2020-03-31", "2020-03-31", "2020-05-01", 500), ("2", "E", "2020-03-31", "2020-03-31", "2020-05-01", -5)]))
    t = Tables(t.securities.withColumn("ticker", F.concat(F.lit("T"), "cik")), t.prices, t.facts)
    dates = dates_of(spark, "2020-06-30")
    got = factors.bm_ratio(t, dates, factors.Tags(equity="E")).collect()
    assert [(r["ticker"], r["value"]) for r in got] == [("T0000000001", 0.05)]
    assert factors.log_mktcap(t, dates).count() == 2


def test_roe_tells_what_it_leaves_out(spark):
    rows = [(str(i), "E", "2023-12-31", "2023-12-31", "2024-02-01", v) for i, v in ((1, 100), (2, 0), (3, -50))]
    rows += [(str(i), "I", "2023-01-01", "2023-12-31", "2024-02-01", v) for i, v in ((1, 10), (2, 20), (3, 30))]
    t, dates = Tables(securities_of(spark, "1", "2", "3"), None, facts_of(spark, rows)), dates_of(spark, "2024-03-31")
    tags = factors.Tags(equity="E", income="I")
    assert [r["value"] for r in factors.roe(t, dates, tags).collect()] == [0.1]
    assert sorted(r["equity"] for r in factors.roe_excluded(t, dates, tags).collect()) == [-50.0, 0.0]


def test_splits_undo_from_later_rows(spark):
    rows = [("A", D(f"2020-01-0{i}"), 10.0, 100.0, r) for i, r in ((1, None), (2, 2.0), (3, 0.0), (4, 3.0))]
    out = asof.unadjusted(spark.createDataFrame(rows, "ticker string, trade_date date, close double, volume double, split_ratio double"))
    assert [(r["cumulative"], r["close"], r["volume"]) for r in out.orderBy("trade_date").collect()] == [(6.0, 60.0, 100 / 6), (3.0, 30.0, 100 / 3), (3.0, 30.0, 100 / 3), (1.0, 10.0, 100.0)]


def test_restatement_view(spark):
    facts = facts_of(spark, [("1", "E", "2020-03-31", "2020-03-31", "2020-05-01", 100), ("1", "E", "2020-03-31", "2020-03-31", "2020-10-28", 60), ("2", "E", "2020-03-31", "2020-03-31", "2020-05-01", 7)])
    r = audit.restatements(facts).collect()
    assert len(r) == 1 and r[0]["revision_pct"] == pytest.approx(-0.4) and r[0]["revision_lag_days"] == 180


def test_disclosures_partition_repeated_keys(spark):
    s = ("2020-03-31", "2020-03-31")
    rows = [("1", "E", *s, "2020-05-01", 1), ("1", "E", *s, "2020-06-01", 2), ("2", "E", *s, "2020-05-01", 1), ("2", "E", *s, "2020-06-01", 1), ("3", "E", *s, "2020-05-01", 1), ("4", "E", *s, "2020-05-01", 1), ("4", "E", *s, "2020-05-01", 2), ("4", "E", *s, "2020-06-01", 2), ("5", "E", *s, "2020-05-01", float("nan")), ("5", "E", *s, "2020-06-01", 2)]
    facts = facts_of(spark, rows)
    assert tuple(audit.disclosure_summary(facts).first()) == (5, 4, 1, 1, 2)
    reasons = {r["reason"]: r["n_keys"] for r in audit.uncomparable_reasons(facts).collect()}
    assert reasons["same_date_conflict"] == 1 and reasons["nonfinite_or_missing_value"] == 1 and reasons["any_reason"] == 2


def test_trap_and_reads(spark):
    facts = facts_of(spark, [("1", "E", "2020-03-31", "2020-03-31", "2020-05-15", 1)])
    values = spark.createDataFrame([("T1", D("2020-04-30"), 1.0), ("T1", D("2020-05-31"), 1.0)], "ticker string, signal_date date, value double")
    securities = spark.createDataFrame([("0000000001", "T1")], "cik string, ticker string")
    assert audit.naive_trap(values, securities, facts).count() == 1 and audit.naive_trap(values, securities, facts, 20).count() == 0
    log = audit.read_log(asof.latest_known(facts, dates_of(spark, "2020-05-31")))
    assert tuple(audit.read_check(log).first()) == (1, 0, False)
    assert audit.read_check(log.limit(0)).first()["vacuous"]


def test_plausibility_states(spark):
    values = spark.createDataFrame([("A", D("2020-01-31"), v) for v in (0.5, 2.0, float("nan"))], "ticker string, signal_date date, value double")
    status = lambda *a, **k: audit.plausibility(values, *a, **k).first()["status"]
    assert status(None, None) == "DECLARED_UNBOUNDED" and status(0.0, 2.0) == "WITHIN_TOLERANCE" and status(0.0, 1.0) == "VIOLATION" and status(0.0, 1.0, tolerance=0.5) == "WITHIN_TOLERANCE"
    assert audit.plausibility(values.limit(0), 0.0, 1.0).first()["status"] == "NO_FINITE_VALUES"
    assert audit.most_implausible(values, 0.0, 1.0).count() == 1
    assert [audit.verdict(False, 5, False, 0.0), audit.verdict(True, 0, False, 0.0), audit.verdict(True, 5, False, None), audit.verdict(True, 5, False, 0.01), audit.verdict(True, 5, False, 0.001)] == ["NOT APPLICABLE", "NO SHARED DATES", "NOT FINITE", "FAIL", "PASS"]


PAYLOAD = """{"cik": 320193, "entityName": "X", "facts": {"us-gaap": {"Assets": {"units": {"USD": [
 {"end": "2020-03-31", "val": 1, "fy": 2020, "fp": "Q1", "form": "10-Q", "filed": "2020-05-01", "accn": "a"},
 {"end": "2020-03-31", "val": 1, "fy": 2020, "fp": "Q1", "form": "10-Q", "filed": "2020-05-01", "accn": "a"},
 {"end": "2020-03-31", "val": 2, "fy": 2020, "fp": "Q1", "form": "8-K", "filed": "2020-05-01", "accn": "b"},
 {"end": "2020-03-31", "val": 2, "fy": 2020, "fp": "Q1", "form": "10-Q", "accn": "c"},
 {"end": "2020-03-31", "val": 2, "fy": 2020, "fp": "Q1", "form": "10-Q", "filed": "2020-01-01", "accn": "d"}],
 "EUR": [{"end": "2020-03-31", "val": 3, "form": "10-Q", "filed": "2020-05-01", "accn": "e"}]}},
 "NetIncomeLoss": {"units": {"USD": [{"start": "2020-01-01", "end": "2020-03-31", "val": 4, "form": "10-Q", "filed": "2020-05-01", "accn": "a"}, {"end": "2020-06-30", "val": 5, "form": "10-Q", "filed": "2020-08-01", "accn": "f"}]}}},
 "dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [{"end": "2020-04-20", "val": 9, "form": "10-Q", "filed": "2020-05-01", "accn": "a"}]}}},
 "custom": {"Thing": {"units": {"USD": [{"end": "2020-03-31", "val": 6, "form": "10-Q", "filed": "2020-05-01", "accn": "a"}]}}}}}"""


def test_company_facts(spark):
    texts = spark.createDataFrame([(PAYLOAD,), ("not json",), (None,)], "value string")
    assert ingest.parsed(texts).filter("bad").count() == 2
    raw = ingest.flattened(texts)
    classed = ingest.classified(raw)
    counts = {r["reason"]: r["n_rows"] for r in ingest.drop_counts(classed).collect()}
    assert counts == {"accepted": 5, "form": 1, "no_filing_day": 1, "filed_before_period_end": 1, "unit": 1, "out_of_scope": 1}
    facts = ingest.facts_of(classed)
    kinds = {(r["tag"], r["fact_type"], r["duration_days"]) for r in facts.collect()}
    assert facts.count() == 4 and kinds == {("Assets", "instant", 0), ("NetIncomeLoss", "duration", 90), ("NetIncomeLoss", "unknown", None), ("CommonStockSharesOutstanding", "instant", 0)}
    assert facts.select("cik").first()[0] == "0000320193"
    assert ingest.accounting_standard(raw).first()["accounting_standard"] == "us-gaap"


def test_price_texts_and_sources(spark):
    texts = spark.createDataFrame([("aa", "Date,Open,High,Low,Close,Volume\r\n2020-01-02,1,2,0.5,1.5,10\r\nbad,1,1,1,1,1\r\n"), ("bb", "No data"), ("cc", "<html>x</html>")], "ticker string, value string")
    got = ingest.price_text(texts).collect()
    assert [(r["ticker"], r["close"], r["close_adj"], r["volume"]) for r in got] == [("AA", 1.5, 1.5, 10.0)]
    p = lambda *t: spark.createDataFrame([(x, 1.0) for x in t], "ticker string, close double")
    out = ingest.first_source([("one", p("A")), ("two", p("A", "B"))], ("one", "two"))
    assert sorted((r["ticker"], r["source"]) for r in out.collect()) == [("A", "one"), ("B", "two")]
    assert ingest.source_share(out, "two", ("one",)).first()["share"] == 0.5
    with pytest.raises(ValueError):
        ingest.first_source([("three", p("A"))], ("one", "two"))


def test_tables_conform_and_break_rules(spark, tmp_path):
    df = spark.createDataFrame([("7", "X", "2020-01-01", "2019-01-01", "extra")], "cik string, ticker string, first_filing string, last_filing string, other string")
    s = tables.load_securities(df)
    row = s.first()
    assert row["cik"] == "0000000007" and row["accounting_standard"] == "unknown" and "other" not in s.columns
    assert {r["rule"]: r["n_rows"] for r in tables.violations(s.union(s), "securities").collect()} == {"last filing before first": 2, "key": 2}
    legacy = spark.createDataFrame([("7", "E", D("2020-03-31"), D("2020-05-01"), 1.0)], "cik string, tag string, period_end date, filed date, value double")
    assert tables.migrated(legacy).first()["period_start"] == D("2020-03-31") and tables.migrated(legacy).first()["fact_type"] == "unknown"
    values = spark.createDataFrame([("A", D("2020-01-31"), 1.0)], "ticker string, signal_date date, value double")
    tables.write_factor_values(values, str(tmp_path / "v"), "f", "pit")
    tables.write_factor_values(values, str(tmp_path / "v"), "f", "restated")
    assert tables.factor_values(spark, str(tmp_path / "v"), "f").count() == 1
    assert tables.coverage(values.withColumn("gap", F.lit(None).cast("int"))).first()["column"] == "gap"


def test_registry(spark):
    assert len(factors.REGISTRY) >= 10 and "bm_ratio" in factors.by_category()["value"]
    assert [r["factor_id"] for r in factors.summary()] == sorted(factors.REGISTRY)
    card = factors.REGISTRY["roe"].card
    with pytest.raises(ValueError, match="registered already"):
        factors.register(card)(lambda t, d: None)
    for broken in ({"name": ""}, {"category": "luck"}, {"timing": {}}, {"falsification": "none"}, {"references": [{"citation": "x"}]}, {"economic_rationale": "it works"}, {"published_anomaly_eligibility": {"status": "PENDING"}}):
        with pytest.raises(ValueError):
            factors.register(card | {"factor_id": "x"} | broken)(lambda t, d: None)
    assert "x" not in factors.REGISTRY


def test_history_equals_every_fact_on_every_date(spark):
    """Against facts by dates in plain Python: refilings on one day, filings before their period ends, gaps, both arms."""
    import random

    rng = random.Random(3)
    rows = []
    for _ in range(250):
        end = D("2018-03-31") + dt.timedelta(days=rng.choice([0, 91, 183, 275, 366]))
        start = end - dt.timedelta(days=rng.choice([90, 180]))
        rows.append((str(rng.randrange(3)), rng.choice("EI"), str(start), str(end), str(end + dt.timedelta(days=rng.randrange(-20, 300))), rng.randrange(40)))
    facts, days = facts_of(spark, rows), [D(f"20{y}-{m:02}-28") for y in (18, 19, 20) for m in (1, 4, 5, 9, 12)]
    dates = spark.createDataFrame([(d,) for d in days], "signal_date date")
    for arm in ("pit", "restated"):
        best = {}
        for cik, tag, start, end, filed, value in rows:
            key, order = (cik.zfill(10), tag, D(start), D(end)), (D(filed), float(value))
            for d in days if arm == "pit" else [None]:
                asof_ = d and d - dt.timedelta(days=2)
                if d is None or order[0] <= asof_ and key[3] <= asof_:
                    best[d, key] = max(best.get((d, key), order), order)
        if arm == "restated":
            best = {(d, key): order for (_, key), order in best.items() for d in days if key[3] <= d - dt.timedelta(days=2)}
        got = {(r["signal_date"], (r["cik"], r["tag"], r["period_start"], r["period_end"])): (r["filed"], r["value"]) for r in asof.history(facts, dates, arm=arm).collect()}
        assert got == best


@pytest.mark.parametrize("width,least", [(5, 2), (3, 3)])
def test_probes_give_what_a_grid_gives(spark, width, least):
    """Sparse tickers: the rolling value at a date from rows and probes, and from every session of a grid."""
    import random

    rng = random.Random(width)
    start = D("2020-01-01")
    rows = [(t, str(start + dt.timedelta(days=i)), None if rng.random() < 0.1 else rng.randrange(1, 99)) for t in "ABCD" for i in range(90) if t == "A" or rng.random() < 0.25]
    prices = prices_of(spark, rows)
    dates = dates_of(spark, *(str(start + dt.timedelta(days=i)) for i in (0, 9, 30, 33, 47, 60, 88, 95, 101)))
    days = factors.sessions(prices)
    grid = factors.rolling(factors.on_sessions(prices, "close_adj"), F.avg, width, least)
    probes = factors.rolled(factors.observed(prices, "close_adj", days), days, dates, F.avg, width, least)
    want, got = (sorted((r["ticker"], r["signal_date"], r["value"]) for r in asof.sampled(x.select("ticker", "trade_date", "value"), dates).collect()) for x in (grid, probes))
    assert got == want and len(got) >= 8
