"""Keyed and bucketed tables, differences, nested stages, reasons, declared tags and guards inside plans."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import asof, difference, factors, guards, panel, reasons, spans
from tidemark.sources import bucketed, ingest, tables
from tidemark.sources.kept import scratch
from tidemark.sources.keyed import KeyedTable, RepeatedKeysError
from tidemark.sources.tables import Tables

D = dt.date.fromisoformat


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Keyed tables


@pytest.fixture
def keyed(spark):
    schema = spark.createDataFrame([], "k string, d date, v double").schema
    return KeyedTable(spark, scratch(spark, "keyed"), schema, ["k", "d"])


def rows_of(spark, *rows):
    return spark.createDataFrame([(k, D(d), float(v)) for k, d, v in rows], "k string, d date, v double")


def test_batches_count_once(spark, keyed):
    one = rows_of(spark, ("a", "2020-01-01", 1), ("b", "2020-01-01", 2))
    assert keyed.read().count() == 0 and keyed.append(one, "one") and keyed.append(rows_of(spark, ("a", "2020-01-02", 3)), "two")
    before = keyed.manifest()
    assert not keyed.append(one.orderBy(F.desc("v")), "one") and keyed.manifest() == before
    assert sorted(map(tuple, keyed.read().collect())) == [("a", D("2020-01-01"), 1.0), ("a", D("2020-01-02"), 3.0), ("b", D("2020-01-01"), 2.0)]
    assert KeyedTable(spark, keyed.path, keyed.schema, keyed.keys).read().count() == 3


@pytest.mark.parametrize("rows,batch,why", [([("c", "2020-01-01", 1), ("a", "2020-01-01", 9)], "new", "stored already"), ([("c", "2020-01-01", 1), ("c", "2020-01-01", 1)], "new", "repeated"), ([("a", "2020-01-01", 5)], "one", "other rows")])
def test_a_refused_batch_leaves_the_table_as_it_was(spark, keyed, rows, batch, why):
    keyed.append(rows_of(spark, ("a", "2020-01-01", 1)), "one")
    before, parts = keyed.manifest(), len(keyed.files.listStatus(keyed._at("")))
    with pytest.raises(RepeatedKeysError, match=why):
        keyed.append(rows_of(spark, *rows), batch)
    with pytest.raises(RepeatedKeysError, match="null"):
        keyed.append(rows_of(spark, ("x", "2020-01-01", 1)).withColumn("k", F.lit(None).cast("string")), "null key")
    assert keyed.manifest() == before and keyed.read().count() == 1 and len(keyed.files.listStatus(keyed._at(""))) == parts


def test_two_writers_and_a_broken_one(spark, keyed):
    """The one that is late looks again; parts without a manifest are never read."""
    keyed.append(rows_of(spark, ("a", "2020-01-01", 1)), "one")
    rows_of(spark, ("z", "2020-01-01", 1)).write.parquet(f"{keyed.path}/part-left-over")
    commit, raced = keyed._commit, []

    def late(number, batches):
        if not raced:
            raced.append(1)
            KeyedTable(spark, keyed.path, keyed.schema, keyed.keys).append(rows_of(spark, ("b", "2020-01-01", 2)), "other")
        return commit(number, batches)

    keyed._commit = late
    assert keyed.append(rows_of(spark, ("c", "2020-01-01", 3)), "mine")
    assert sorted(r["k"] for r in keyed.read().collect()) == ["a", "b", "c"] and keyed.manifest()[0] == 3
    raced.clear()

    def clash(number, batches):
        if not raced:
            raced.append(1)
            KeyedTable(spark, keyed.path, keyed.schema, keyed.keys).append(rows_of(spark, ("d", "2020-01-01", 4)), "fourth")
        return commit(number, batches)

    keyed._commit = clash
    with pytest.raises(RepeatedKeysError, match="stored already"):
        keyed.append(rows_of(spark, ("d", "2020-01-01", 5)), "fifth")
    assert keyed.read().count() == 4


# Bucketed tables


def test_stored_tables_prune_and_meet_without_a_shuffle(spark):
    rng = random.Random(1)
    prices = spark.createDataFrame([(f"c{rng.randrange(30)}", dt.date(2015 + i % 6, 1 + i % 12, 1 + i % 28), float(i)) for i in range(600)], "cik string, day date, v double")
    counts = spark.createDataFrame([(f"c{rng.randrange(30)}", dt.date(2015 + i % 6, 1 + i % 12, 3), float(i)) for i in range(200)], "cik string, filed date, n double")
    names = [f"t_{uuid.uuid4().hex}" for _ in range(2)]
    bucketed.write_bucketed(prices, names[0], scratch(spark, "p"), "cik", "day", 4)
    bucketed.write_bucketed(counts, names[1], scratch(spark, "c"), "cik", "filed", 4)
    scan = bucketed.scan_days(spark, names[0], "day", "2016-03-01", "2017-02-28")
    plan = plan_of(scan)
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan and "2016" in plan
    assert {f.split("year=")[1][:4] for f in scan.inputFiles()} == {"2016", "2017"}
    found = bucketed.join_asof_stored(scan, spark.table(names[1]).drop("year"), "cik", "day", "filed", ["n"])
    assert "Exchange" not in plan_of(found) and "SortMergeJoin" in plan_of(found)
    want = asof.join_asof(prices.filter("day BETWEEN DATE'2016-03-01' AND DATE'2017-02-28'"), counts, ["cik"], "day", "filed", ["n"])
    key = lambda r: (r["cik"], r["day"], r["v"], r["n"] is None, r["n"])
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))
    for n in names:
        spark.sql(f"DROP TABLE {n}")


# Differences


def test_differences_equal_a_plain_join(spark):
    rng = random.Random(4)
    left = {(f"k{i}", i % 3): (rng.choice((None, 1.5, float("nan"))), rng.choice((None, "x"))) for i in range(3000)}
    right = dict(left)
    for k in rng.sample(sorted(left), 9):
        del right[k]
    for k in rng.sample(sorted(right), 9):
        right[k] = (7.0, right[k][1])
    for k in rng.sample(sorted(right), 3):
        right[k] = (right[k][0], "y")
    right |= {("new", i): (None, None) for i in range(4)}
    frame = lambda rows: spark.createDataFrame([(*k, *v) for k, v in rows.items()], "k string, i int, v double, w string")
    found = {(r["k"], r["i"]): (r["change"], r["columns"]) for r in difference.differences(frame(left), frame(right), ["k", "i"]).collect()}
    same = lambda a, b: a == b or a is not None and b is not None and a != a and b != b
    want = {}
    for k in left.keys() | right.keys():
        if k not in left or k not in right:
            want[k] = ("added" if k not in left else "removed", "")
        elif changed := [c for c, a, b in zip("vw", left[k], right[k]) if not same(a, b)]:
            want[k] = ("changed", "+".join(changed))
    assert found == want and len(want) >= 20
    assert difference.differing(frame(left), frame(left).repartition(7), ["k", "i"]).count() == 0
    open_ = difference.differing(frame(left), frame(right), ["k", "i"]).count()
    assert 0 < open_ <= len(want)
    with pytest.raises(ValueError):
        difference.differences(frame(left), frame(left).drop("v"), ["k", "i"])


# Nested stages


def plain_spans(events):
    """By a stack: depth, stage, begin, end, seconds, own seconds and the name of the leave."""
    out, stack = [], []
    for at, stage, enters in events:
        if enters:
            stack.append([len(stack) + 1, stage, at, None, None, 0.0, None])
            out.append(stack[-1])
        elif stack:
            span = stack.pop()
            span[3:5], span[6] = [at, (at - span[2]).total_seconds()], stage
            if stack:
                stack[-1][5] += span[4]
    return [(d, s, b, e, t, None if t is None else t - inside, left) for d, s, b, e, t, inside, left in out]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_equal_a_stack(spark, seed):
    rng, rows = random.Random(seed), []
    for key in "abc":
        at = dt.datetime(2024, 1, 1)
        for i in range(120):
            at += dt.timedelta(seconds=rng.choice((0, 1, 7, 0.5)))
            rows.append((key, at, i, rng.choice("xyz"), rng.random() < 0.5))
    found = spans.matched(spark.createDataFrame(rows, "key string, at timestamp, place int, stage string, enters boolean")).orderBy("key", "begin", "place").collect()
    for key in "abc":
        want = plain_spans([r[1:2] + r[3:] for r in rows if r[0] == key])
        got = [(r["depth"], r["stage"], r["begin"], r["end"], r["seconds"], r["own_seconds"], r["left_as"]) for r in found if r["key"] == key]
        assert [g[:4] + g[6:] for g in got] == [w[:4] + w[6:] for w in want]
        assert [g[4:6] for g in got] == [pytest.approx(w[4:6]) if w[4] is not None else w[4:6] for w in want]
    assert spans.by_stage(spans.matched(spark.createDataFrame([], "key string, at timestamp, place int, stage string, enters boolean"))).count() == 0


# Reasons


def test_every_key_has_a_value_or_one_reason(spark):
    series = spark.createDataFrame([("A", D("2020-01-30"), 10.0), ("A", D("2020-02-28"), 12.0), ("B", D("2020-01-10"), 5.0), ("B", D("2020-02-28"), 6.0), ("C", D("2020-02-20"), 3.0), ("Z", D("2020-01-31"), 0.0), ("Z", D("2020-02-28"), 4.0), ("N", D("2020-02-28"), None)], "ticker string, trade_date date, value double")
    keys = spark.createDataFrame([(t, D("2020-02-29")) for t in "ABCZNX"], "ticker string, signal_date date")
    found = {r["ticker"]: (r["value"], r["reason"]) for r in reasons.return_reasons(series, keys, 0, 1).collect()}
    assert found == {"A": (pytest.approx(0.2), None), "B": (None, "stale"), "C": (None, "warm_up"), "Z": (None, "not_positive"), "N": (None, "no_history"), "X": (None, "no_history")}
    level = {r["ticker"]: (r["value"], r["reason"]) for r in reasons.level_reasons(series.filter("ticker <> 'A'"), keys).collect()}
    assert level["B"] == (6.0, None) and level["A"] == (None, "no_history") and level["Z"] == (4.0, None)
    assert sum(r["n_keys"] for r in reasons.reason_counts(reasons.return_reasons(series, keys, 0, 1)).collect()) == 6


# Guards, counts and tags


def values_of(spark, n=40):
    return spark.createDataFrame([(f"T{i:02}", D("2020-01-31"), float(i)) for i in range(n)], "ticker string, signal_date date, value double")


def test_guards_stop_the_query_itself(spark):
    values = values_of(spark)
    assert guards.with_rows(values, "none").count() == 40 and guards.with_unique_keys(values, ["ticker"]).count() == 40
    for broken, why in ((guards.with_rows(values.limit(0), "there are none"), "there are none"), (guards.with_unique_keys(values.unionByName(values), ["ticker", "signal_date"]), "null or repeated"), (guards.with_unique_keys(values.withColumn("ticker", F.lit(None).cast("string")), ["ticker"]), "null or repeated")):
        with pytest.raises(Exception, match=why):
            broken.count()
    with pytest.raises(Exception, match="no value to clean"):
        panel.cleaned(values.limit(0)).collect()


@pytest.mark.parametrize("factor_id,column", [("mom_12_1", "close_adj"), ("rev_1m", "close_adj"), ("log_mktcap", "shares_out"), ("log_mktcap", "close"), ("total_vol_60d", "close_adj"), ("turnover", "volume"), ("turnover", "shares_out")])
def test_each_price_signal_names_a_blank_column(spark, factor_id, column):
    prices = tables.load_prices(spark.createDataFrame([("A", D("2020-01-30"), 1.0, 1.0, 1.0, 1.0)], "ticker string, trade_date date, close double, close_adj double, volume double, shares_out double"))
    dates = spark.createDataFrame([(D("2020-01-31"),)], "signal_date date")
    f = factors.REGISTRY[factor_id]
    with pytest.raises(ValueError, match=column):
        f.compute(Tables(None, prices.drop(column), None), dates)
    with pytest.raises(Exception, match=f"no price row has a value of .*{column}"):
        f.compute(Tables(None, prices.withColumn(column, F.lit(None).cast("double")), None), dates).collect()


def test_counts_flow_with_the_rows(spark):
    raw = spark.createDataFrame([(n, t, u, f, fl, e, v) for n, t, u, f, fl, e, v in [("us-gaap", "Assets", "USD", "10-K", "2020-02-01", "2019-12-31", 1.0), ("us-gaap", "Other", "USD", "10-K", "2020-02-01", "2019-12-31", 1.0), ("us-gaap", "Assets", "EUR", "10-K", "2020-02-01", "2019-12-31", 1.0), ("us-gaap", "Assets", "USD", "8-K", "2020-02-01", "2019-12-31", 1.0), ("us-gaap", "Assets", "USD", "10-K", None, "2019-12-31", 1.0), ("us-gaap", "Assets", "USD", "10-K", "2020-02-01", None, 1.0), ("us-gaap", "Assets", "USD", "10-K", "2019-02-01", "2019-12-31", 1.0), ("us-gaap", "Assets", "USD", "10-K", "2020-02-01", "2019-12-31", 1.0)]], "namespace string, raw_tag string, unit string, form string, filed string, end string, val double")
    raw = raw.withColumns({"cik": F.lit("1"), "start": F.lit(None).cast("string"), "fy": F.lit(1), "fp": F.lit("FY"), "accn": F.lit("a"), "frame": F.lit(""), "position": F.lit(0)})
    classed = ingest.classified(raw)
    facts, counts = ingest.facts_counted(classed, f"c {uuid.uuid4().hex}")
    assert facts.count() == 1 and plan_of(facts).count("Scan ExistingRDD") == 1
    assert {k: n for k, n in counts.get.items() if n} == {r["reason"]: r["n_rows"] for r in ingest.drop_counts(classed).collect()}
    assert set(counts.get) == {"accepted", *ingest.REASONS}
    seen = Observation(f"v {uuid.uuid4().hex}")
    values = values_of(spark).unionByName(values_of(spark, 3).withColumn("value", F.lit(float("nan"))))
    clean = panel.cleaned(values, counts=seen)
    report = panel.cleaning_report(values, clean).first()
    assert seen.get == {"n_input": report["n_input"], "n_finite": report["n_input"] - report["n_not_finite"]}


def test_a_signal_that_reads_what_it_does_not_tell(spark):
    facts = tables.load_facts(spark.createDataFrame([("1", "E", D("2019-12-31"), D("2020-02-01"), 1.0)], "cik string, tag string, period_end date, filed date, value double"))
    securities = tables.load_securities(spark.createDataFrame([("1", "A")], "cik string, ticker string"))
    prices = tables.load_prices(spark.createDataFrame([("A", D("2020-01-30"), 1.0)], "ticker string, trade_date date, close double"))
    t, dates = Tables(securities, prices, facts), spark.createDataFrame([(D("2020-02-29"),)], "signal_date date")
    tags = factors.Tags("E", "I", "A")
    assert {f: factors.verified_tags(f, t, dates, tags) for f in ("bm_ratio", "ep_ratio", "roe", "asset_growth", "log_mktcap")} == {"bm_ratio": {"E"}, "ep_ratio": {"I"}, "roe": {"E", "I"}, "asset_growth": {"A"}, "log_mktcap": set()}
    both = lambda x: x.facts.filter(F.col("tag").isin("E", "X")).groupBy("cik").count()
    assert factors.tags_read(t, both) == {"E", "X"} and factors.tags_read(t, lambda x: x.facts.groupBy("tag").count()) == {"*"}
    told = factors.REGISTRY["bm_ratio"]
    try:
        factors.REGISTRY["bm_ratio"] = factors.Factor("bm_ratio", factors.roe, uses_facts=True, tags=("equity",), card=told.card)
        with pytest.raises(ValueError, match="reads I"):
            factors.verified_tags("bm_ratio", t, dates, tags)
    finally:
        factors.REGISTRY["bm_ratio"] = told
    card = told.card | {"factor_id": "mine"}
    with pytest.raises(ValueError, match="name of another"):
        factors.register(card, rules=told.rules)(factors.roe)
    with pytest.raises(ValueError, match="tells its tags"):
        factors.register(card, uses_facts=True)(factors.roe)


def test_cards_tell_where_a_definition_comes_from():
    plain = factors.REGISTRY["roe"].card
    assert factors.lineage(plain) == "UNVERIFIED" and factors.checked(plain) is plain
    origin = plain["references"][0]
    found = origin | {"verification": "VERIFIED", "locator": "p. 7"}
    status = lambda s: plain["published_anomaly_eligibility"] | {"status": s}
    exact = plain | {"references": [origin, found], "published_anomaly_eligibility": status("INCLUDED")}
    assert factors.lineage(factors.checked(exact)) == "EXACT_REPLICATION"
    assert factors.lineage(factors.checked(exact | {"documented_variants": ["other lag"]})) == "DOCUMENTED_VARIANT"
    assert factors.lineage(factors.checked(plain | {"references": [origin | {"role": "mechanism"}], "published_anomaly_eligibility": status("EXCLUDED")})) == "UNSUPPORTED_LINEAGE"
    for broken, why in (({"references": [origin | {"role": "rumour"}]}, "role"), ({"published_anomaly_eligibility": status("INCLUDED")}, "status is PENDING"), ({"references": [found | {"locator": " "}]}, "some place"), ({"references": ["a book"]}, "a reference tells"), ({"timing": {"signal_computed": "x"}}, "timing"), ({"name": ""}, "name is empty"), ({"category": "luck"}, "category"), ({"economic_rationale": "too short"}, "ten words")):
        with pytest.raises(ValueError, match=why):
            factors.checked(plain | broken)


def test_new_and_stored_keys_are_shuffled_once(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])
    table = KeyedTable(spark, f"file://{tmp_path}/once", schema, ["k"])
    rows = lambda *keys: spark.createDataFrame([(k, 1) for k in keys], schema)
    found = table._repeated(rows("a", "b", "b", None, "c"), rows("a", "d"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {(r["what"], r["key"]) for r in found.collect()} == {("stored already", '{"k":"a"}'), ("null or repeated", '{"k":"b"}'), ("null or repeated", '{"k":null}')}
