"""Twelve-month flows by states, latest facts and keyless probes, against plain versions."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, shares, states

D = dt.date.fromisoformat
FACT = "cik string, tag string, period_start date, period_end date, filed date, value double, unit string, form string, accession string, frame string"


def some_facts(spark, seed, n=400, early=True):
    """Quarters, cumulative and annual reports of three companies: refiled, filed early, with gaps and without values."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        year, q = rng.randrange(2016, 2020), rng.randrange(1, 5)
        end = D(f"{year}-{3 * q:02}-{30 if q in (2, 3) else 31}")
        start = rng.choice((D(f"{year}-01-01"), D(f"{year}-{3 * q - 2:02}-01"), D(f"{year}-01-01"), end - dt.timedelta(days=rng.choice((20, 130, 364, 430)))))
        filed = end + dt.timedelta(days=rng.choice((rng.randrange(20, 90), rng.randrange(300), -30 if early else 40)))
        value = rng.choice((None, float("nan"), *([float(rng.randrange(100))] * 12)))
        rows.append((rng.choice("abc"), rng.choice("EI"), start, end, None if rng.random() < 0.02 else filed, value, "USD", "10-Q", f"{i:04}", str(rng.randrange(3))))
    return spark.createDataFrame(rows, FACT)


def grid(spark):
    days = [dt.date(2016 + m // 12, m % 12 + 1, 28) for m in range(60)]
    return spark.createDataFrame([(d,) for d in days], "signal_date date")


def plain_flow(seen):
    """seen: (start, end, filed, value) of visible reports with values."""
    quarters, years = {}, []
    for start, end, filed, value in seen:
        days = (end - start).days
        before = max((e for s, e, _, _ in seen if s == start and e < end), default=None)
        span = (end - (before or start)).days
        if 45 <= span <= 130:
            base = next(v for s, e, _, v in seen if (s, e) == (start, before)) if before else 0.0
            quarters.setdefault(end, []).append((0 if days <= 130 else 1, filed, start, value - base))
        if 300 <= days <= 430:
            years.append((end, filed, start, value))
    last = sorted(quarters)[-4:]
    if len(last) == 4 and all(60 <= (b - a).days <= 130 for a, b in zip(last, last[1:])):
        return sum(min(quarters[e])[3] for e in last)
    return max(years)[3] if years else None


@pytest.mark.parametrize("arm", ["pit", "restated"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_flows_equal_flows_of_histories(spark, seed, arm):
    facts, dates = some_facts(spark, seed), grid(spark)
    seen = {}
    for r in asof.history(facts, dates, arm=arm).collect():
        if r["value"] is not None and r["value"] == r["value"] and r["period_end"] >= r["period_start"]:
            seen.setdefault((r["cik"], r["tag"], r["signal_date"]), []).append((r["period_start"], r["period_end"], r["filed"], r["value"]))
    want = {k: v for k, rows in seen.items() if (v := plain_flow(rows)) is not None}
    got = {(r["cik"], r["tag"], r["signal_date"]): r["value"] for r in states.ttm(facts, dates, arm=arm).collect()}
    assert got == pytest.approx(want) and len(want) > 150


def test_a_flow_changes_on_days_of_filings_only(spark):
    facts = some_facts(spark, 9)
    found = states.flow_states(facts).orderBy("cik", "tag", "day").collect()
    days = {(r["cik"], r["tag"], max(r["filed"], r["period_end"])) for r in facts.filter("filed IS NOT NULL").collect()}
    assert all((r["cik"], r["tag"], r["day"]) in days for r in found)
    for a, b in zip(found, found[1:]):
        if (a["cik"], a["tag"]) == (b["cik"], b["tag"]):
            assert a["until"] == b["day"] and a["value"] != b["value"]
        else:
            assert a["until"] is None
    assert states.flow_states(facts.limit(0)).count() == 0


def test_dates_shuffle_nothing(spark):
    """One exchange, of facts; dates meet states where they are."""
    facts = some_facts(spark, 4)
    for found in (states.ttm(facts, grid(spark)), asof.latest_known(facts, grid(spark))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        plan = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert any("cik" in x and "tag" in x for x in shuffles) and not any("signal_date" in x and "cik" in x for x in shuffles)
        assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("arm", ["pit", "restated"])
def test_latest_known_of_facts_filed_early(spark, arm):
    """A fact is not known before its period is over, though it was filed."""
    facts, dates = some_facts(spark, 5), grid(spark)
    one = asof.latest_known(facts, dates, arm=arm).select("cik", "tag", "signal_date", "period_end", "filed", F.coalesce("value", F.lit(-1.0)).alias("value"))
    assert one.filter("period_end > signal_date - INTERVAL 2 DAYS").count() == 0
    best = {}
    rows = asof.restated(facts).collect() if arm == "restated" else facts.collect()
    for d in (r["signal_date"] for r in dates.collect()):
        for r in rows:
            day = d - dt.timedelta(days=2)
            if r["period_end"] <= day and (arm == "restated" or r["filed"] is not None and r["filed"] <= day):
                order = (r["period_end"], r["filed"] or dt.date.min, r["period_start"], r["accession"])
                key = r["cik"], r["tag"], d
                if key not in best or order > best[key][0]:
                    best[key] = order, r
    nan = lambda v: "nan" if v != v else v
    want = {k: (r["period_end"], r["filed"], nan(-1.0 if r["value"] is None else r["value"])) for k, (_, r) in best.items()}
    assert {(r["cik"], r["tag"], r["signal_date"]): (r["period_end"], r["filed"], nan(r["value"])) for r in one.collect()} == want
    one_fact = facts.limit(1).select("cik", "tag", "period_start", F.lit("2020-12-31").cast("date").alias("period_end"), F.lit("2020-01-15").cast("date").alias("filed"), *FACT_REST)
    days = spark.createDataFrame([(D("2020-02-29"),), (D("2021-01-31"),)], "signal_date date")
    assert [r["signal_date"] for r in asof.latest_known(one_fact, days, arm=arm).collect()] == [D("2021-01-31")]


FACT_REST = ("value", "unit", "form", "accession", "frame")


def test_restated_reads_are_counted(spark):
    facts, dates = some_facts(spark, 6, 20), grid(spark)
    before = dict(asof.RESTATED_READS)
    asof.latest_known(facts, dates, arm="restated")
    asof.history(facts, dates, arm="restated", caller="audit of mine")
    states.ttm(facts, dates, arm="restated")
    asof.latest_known(facts, dates)
    more = {k: n - before.get(k, 0) for k, n in asof.RESTATED_READS.items() if n != before.get(k, 0)}
    assert more == {"latest_known": 1, "audit of mine": 1, "ttm": 1}


def test_probes_without_a_key_are_dealt(spark):
    """A third of the probes has no key: all stay, find nothing, and go to many parts."""
    probes = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, CAST(id % 7 AS STRING)) AS k", "DATE'2020-01-01' + CAST(id % 50 AS INT) AS day", "id")
    build = spark.createDataFrame([("1", D("2020-01-10"), 5), (None, D("2020-01-01"), 9), ("1", None, 7)], "k string, day date, v int")
    found = asof.join_asof(probes, build, ["k"], "day", "day", ["v"])
    rows = found.collect()
    assert len(rows) == 3000 and {r["v"] for r in rows if r["k"] is None} == {None}
    assert all((r["v"] == 5) == (r["k"] == "1" and r["day"] >= D("2020-01-10")) for r in rows)
    sizes = [r["n"] for r in found.withColumn("p", F.spark_partition_id()).filter("k IS NULL").groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert found.rdd.getNumPartitions() == 1 or len(sizes) > 1


@pytest.mark.parametrize("arm", ["pit", "restated"])
def test_history_is_grouped_where_its_facts_lie(spark, arm):
    """Rows that are handed out to dates are not shuffled again by a count over cik, tag and date."""
    day = dt.date.fromisoformat
    rows = [(f"{i % 3}", "I", day("2020-01-01"), day(f"2020-0{3 + i % 4}-28"), day(f"2020-0{7 + i % 2}-0{1 + i % 5}"), "a", "f", "1", float(i)) for i in range(24)]
    facts = spark.createDataFrame(rows, "cik string, tag string, period_start date, period_end date, filed date, accession string, form string, frame string, value double")
    dates = spark.createDataFrame([(day(f"2020-{m:02}-28"),) for m in (8, 9, 10)], "signal_date date")
    found = asof.history(facts, dates, arm=arm).groupBy("cik", "tag", "signal_date").agg(F.count("*").alias("n"))
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*cik[^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert [re.sub(r"#\d+|, \d+$", "", keys) for keys in dealt] == ["cik, tag"]
    want = {(c, m): len({r[3] for r in rows if r[0] == c and (arm == "restated" or r[4] <= day(f"2020-{m:02}-26"))}) for c in "012" for m in (8, 9, 10)}
    assert {(r["cik"], r["signal_date"].month): r["n"] for r in found.collect()} == {k: n for k, n in want.items() if n}


def test_latest_facts_carry_no_column_twice(spark):
    facts = some_facts(spark, 3, 60).select(*asof.CHOICE)
    found = asof.latest_known(facts, spark.createDataFrame([(D("2019-06-30"),)], "signal_date date"), arm="restated")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "max_by" not in plan and "struct(none_, 0) AS row" in plan
    assert found.columns[:3] == ["cik", "tag", "signal_date"] and found.filter("value IS NOT NULL").count() > 0


def test_ties_are_not_counted_by_different_values(spark):
    rows = [("1", "N", D(s), D("2020-03-31"), D("2020-05-01"), v) for s, v in (("2020-01-01", 1.0), ("2020-01-01", 2.0), ("2019-10-01", float("nan")), ("2020-01-01", None))]
    rows += [("2", "N", D("2020-01-01"), D("2020-03-31"), D("2020-05-01"), 0.0), ("2", "N", D("2020-01-01"), D("2020-03-31"), D("2020-05-01"), -0.0)]
    facts = spark.createDataFrame(rows, "cik string, tag string, period_start date, period_end date, filed date, value double")
    found = shares.interval_ties(facts, facts.filter("cik = '2'"))
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["read"]: tuple(r)[2:] for r in found.collect()} == {"pit": (2, 2, 1, 1), "restated": (1, 1, 0, 0)}
