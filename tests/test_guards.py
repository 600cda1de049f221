"""Guards, rules, the protocol's parts and share counts on small inputs."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, audit, guards, protocol, shares
from tidemark.sources import ingest, tables

D = dt.date.fromisoformat


def values_of(spark, rows):
    return spark.createDataFrame([(t, D(d), v) for t, d, v in rows], "ticker string, signal_date date, value double")


def test_guards_say_what_is_wrong(spark):
    values = values_of(spark, [("A", "2020-01-31", 1.0), ("B", "2020-01-31", None)])
    assert guards.not_empty(values) is values and guards.unique_keys(values, ["ticker", "signal_date"]) is values
    with pytest.raises(guards.EmptyFactorError):
        guards.not_empty(values.limit(0))
    with pytest.raises(ValueError, match="signal_date"):
        guards.required(values.drop("signal_date"))
    for bad in (values.union(values), values.withColumn("ticker", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="null or repeated"):
            guards.unique_keys(bad, ["ticker", "signal_date"])
    with pytest.raises(ValueError, match="close"):
        guards.price_column(values, "close")
    blank = values.withColumns({"close": F.lit(None).cast("double"), "volume": F.col("value")})
    for empty in (blank, blank.limit(0)):
        with pytest.raises(Exception, match="no price row has a value of .*close"):
            guards.price_column(empty, "volume", "close").count()
    assert guards.price_column(blank, "volume").count() == 2
    with pytest.raises(ValueError):
        guards.share(1.5)


def test_rules_block_by_kind_and_severity(spark):
    values = values_of(spark, [(f"T{i:03}", "2020-01-31", 0.5) for i in range(199)] + [("Z", "2020-01-31", 9.0), ("Y", "2020-01-31", float("nan"))])
    rule = lambda kind, severity, low=0.0, high=1.0: audit.Rule("r", kind, severity, low, high, "why")
    status = lambda r: [(x["status"], x["blocking"], x["n_outside"]) for x in audit.evaluated(values, [r]).collect()]
    assert status(rule("economic", "error")) == [("WITHIN_TOLERANCE", False, 1)]
    assert status(rule("domain", "error")) == [("VIOLATION", True, 1)] and status(rule("construction", "warning")) == [("VIOLATION", False, 1)]
    assert status(rule("economic", "error", None, None)) == [("DECLARED_UNBOUNDED", False, None)]
    assert audit.evaluated(values.limit(0), [rule("domain", "error")]).first()["status"] == "NO_FINITE_VALUES"
    assert len(audit.enforced(values, [rule("economic", "error"), rule("domain", "warning")])) == 2
    with pytest.raises(guards.ImplausibleMagnitudeError) as e:
        audit.enforced(values, [rule("economic", "error"), rule("domain", "error")])
    assert e.value.detail["worst"] == [("Z", "2020-01-31", 9.0)] and len(e.value.detail["rules"]) == 2
    for broken in ({"kind": "odd"}, {"severity": "odd"}, {"low": math.inf}, {"low": 2.0}, {"rationale": " "}):
        with pytest.raises(ValueError):
            audit.Rule(**({"rule_id": "r", "kind": "domain", "severity": "error", "low": 0.0, "high": 1.0, "rationale": "w"} | broken))


def test_p_values_of_t(spark):
    """Known two-sided values."""
    known = [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.776, 4, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (9.925, 2, 0.01), (0.0, 5, 1.0)]
    df = spark.createDataFrame(known, "t double, freedom int, p double")
    for r in df.withColumn("got", protocol.t_p(F.col("t"), F.col("freedom"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-4)


def test_controls_with_gaps_are_left_out_by_date(spark):
    rows = [(f"T{i}", D(d), float(i), 2.0 * i + 5.0 * c + 1, c if d < "2020-02" or i else None) for d in ("2020-01-31", "2020-02-29") for i in range(12) for c in [float(i * i % 7)]]
    df = spark.createDataFrame(rows, "ticker string, signal_date date, prediction double, label double, c double")
    got = {str(r["signal_date"]): r["slope"] for r in protocol.controlled_slopes(df, ["c"]).collect()}
    assert got["2020-01-31"] == pytest.approx(2.0)
    plain = protocol.slopes(df).filter("signal_date = '2020-02-29'").first()["slope"]
    assert got["2020-02-29"] == pytest.approx(plain) and plain != pytest.approx(2.0)
    assert protocol.controlled_slopes(df.withColumn("c", F.col("prediction") * 3), ["c"]).count() == 0  # not of full rank


def test_restated_reads_leave_a_trace(spark):
    facts = tables.load_facts(spark.createDataFrame([("1", "E", D("2020-03-31"), D("2020-05-01"), 1.0)], "cik string, tag string, period_end date, filed date, value double"))
    before = asof.RESTATED_READS.get("me", 0)
    assert asof.restated(facts, "me").count() == 1 and asof.RESTATED_READS["me"] == before + 1


def test_fixed_lists_take_cash_and_capital_expenditure(spark):
    text = '{"cik": "1", "facts": {"us-gaap": {"CashAndCashEquivalentsAtCarryingValue": {"units": {"USD": [{"end": "2020-03-31", "val": 5, "form": "10-Q", "filed": "2020-05-01", "accn": "a"}]}}, "PaymentsToAcquirePropertyPlantAndEquipment": {"units": {"USD": [{"end": "2020-03-31", "val": 6, "form": "10-Q", "filed": "2020-05-01", "accn": "a"}]}}, "AssetsCurrent": {"units": {"USD": [{"end": "2020-03-31", "val": 7, "form": "10-Q", "filed": "2020-05-01", "accn": "a"}]}}}}}'
    rows = ingest.classified(ingest.flattened(spark.createDataFrame([(text,)], "value string"))).collect()
    assert {r["value"]: (r["drop"], r["fact_type"]) for r in rows} == {5.0: (None, "instant"), 6.0: (None, "unknown"), 7.0: ("out_of_scope", "instant")}


def test_share_groups_of_one_day(spark):
    row = lambda end, v, acc: ("1", "N", D(end), D(end), D("2020-05-01"), v, acc, "10-Q", "us-gaap")
    df = spark.createDataFrame([row("2020-03-31", 100.0, "a"), row("2020-03-31", 110.0, "b"), row("2019-12-31", 90.0, "a"), row("2020-03-31", None, "c")], "cik string, tag string, period_start date, period_end date, filed date, value double, accession string, form string, source_namespace string")
    g = shares.filings(df).first()
    assert (g["counts"], g["unknown"], g["candidates"], g["newest"], g["torn"], g["documents"], g["forms"]) == (4, 1, [90.0, 100.0, 110.0], [100.0, 110.0], 1, 3, ["10-Q"])
    assert g["spread"] == pytest.approx(110 / 90)
    found = {r["measure"]: r["n"] for r in shares.disagreements(shares.filings(df)).collect()}
    assert {k for k, n in found.items() if n} == {"all", "disagree", "companies", "across_periods", "inside_a_fact", "newest_differs", "spread_from_1.1"}
    assert all(r["passed"] for r in shares.balanced(shares.disagreements(shares.filings(df))).filter("check LIKE 'bands%' OR check LIKE 'newest%'").collect())
