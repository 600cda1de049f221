"""Registered queries of keyed and bucketed tables, differences, nested stages, reasons and observed counts, with SQL for each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import round_to
from tidemark.operators import asof, difference, factors, panel, reasons, spans, vintage
from tidemark.plans import catalog as c
from tidemark.plans import mapping as m
from tidemark.plans.catalog import query, rounded
from tidemark.plans.mapping import with_sql
from tidemark.sources import bucketed, ingest, tables
from tidemark.sources.kept import kept, scratch
from tidemark.sources.keyed import KeyedTable, RepeatedKeysError

SHORT = tables.PRICES.fields[:2] + [f for f in tables.PRICES.fields if f.name in ("close", "volume")]


# Keyed appends


@query(f"{with_sql('prices')}, p AS (SELECT * FROM prices WHERE month(trade_date) <> 13) SELECT year(trade_date) AS year, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, round(sum(volume), 2) AS volume, 0 AS n_refused_stored, 1 AS n_refused_batches, 1 AS n_retried FROM p GROUP BY 1")
def keyed_append(spark, d):
    """Prices in three batches by month; then one batch again, which changes nothing, and one with stored keys, which is refused whole."""
    prices = kept(m.prices(spark, d).select(*(f.name for f in SHORT)))
    schema = type(tables.PRICES)(SHORT)
    table = KeyedTable(spark, scratch(spark, "keyed"), schema, ["ticker", "trade_date"])
    batch = lambda i: prices.filter(F.month("trade_date") % 3 == i)
    for i in range(3):
        table.append(batch(i), f"months {i}")
    retried = 1 - int(table.append(batch(1), "months 1"))
    refused = 0
    try:
        table.append(batch(2).withColumn("close", F.lit(0.0)).unionByName(batch(2).withColumns({"ticker": F.lit("new"), "close": F.lit(1.0)}).limit(1)), "late")
    except RepeatedKeysError:
        refused = 1
    rows = table.read().groupBy(F.year("trade_date").alias("year")).agg(F.count("*").alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"), round_to(F.sum("volume"), 2).alias("volume"), F.count(F.when(F.col("ticker") == "new", 1)).alias("n_refused_stored"))
    return rows.withColumns({"n_refused_batches": F.lit(refused), "n_retried": F.lit(retried)})


# Bucketed tables


def _stored(spark, d) -> tuple[str, str]:
    """Prices with their cik, and filed counts of the tag N, in buckets of cik."""
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("prices", "counts")]
    prices = m.prices(spark, d).withColumn("cik", F.expr("substring(ticker, 2)")).select("cik", "ticker", "trade_date", "close")
    counts = m.facts(spark, d).filter("tag = 'N'").groupBy("cik", "filed").agg(F.max("value").alias("shares"))
    for name, df, day in zip(names, (prices, counts), ("trade_date", "filed"), strict=True):
        bucketed.write_bucketed(df, name, scratch(spark, name), "cik", day, 8)
    return names[0], names[1]


@query(f"{with_sql('facts', 'prices')}, n AS (SELECT cik AS c, filed, max(value) AS shares FROM facts WHERE tag = 'N' GROUP BY ALL), p AS (SELECT ticker, substr(ticker, 2) AS cik, trade_date, close FROM prices WHERE trade_date BETWEEN DATE '1995-06-15' AND DATE '1996-03-31') SELECT ticker, trade_date, round(close, 6) AS close, shares, filed AS counted_on FROM p ASOF LEFT JOIN n ON c = cik AND filed <= trade_date")
def stored_asof(spark, d):
    """Two stored tables: prices of ten months, which open two years' folders, with the share count filed last, joined in their buckets."""
    prices, counts = _stored(spark, d)
    found = bucketed.join_asof_stored(bucketed.scan_days(spark, prices, "trade_date", "1995-06-15", "1996-03-31"), spark.table(counts).withColumn("counted_on", F.col("filed")), "cik", "trade_date", "filed", ["counted_on", "shares"])
    return rounded(found.select("ticker", "trade_date", "close", "shares", "counted_on"), "close")


# Differences of two results


DIFF_SQL = f"""{with_sql('facts', 'dates')}, {c.LATEST}, {c.RESTATED}, {c.LATEST_RESTATED},
l AS (SELECT cik, tag, signal_date, period_end, filed, value FROM known), r AS (SELECT cik, tag, signal_date, period_end, filed, value FROM late),
j AS (SELECT l.cik IS NULL AS added, r.cik IS NULL AS removed, l.filed IS DISTINCT FROM r.filed AS f, l.period_end IS DISTINCT FROM r.period_end AS p, l.value IS DISTINCT FROM r.value AS v FROM l FULL JOIN r ON l.cik = r.cik AND l.tag = r.tag AND l.signal_date = r.signal_date)
SELECT CASE WHEN added THEN 'added' WHEN removed THEN 'removed' ELSE 'changed' END AS change, CASE WHEN added OR removed THEN '' ELSE concat_ws('+', CASE WHEN f THEN 'filed' END, CASE WHEN p THEN 'period_end' END, CASE WHEN v THEN 'value' END) END AS columns, count(*) AS n_rows
FROM j WHERE added OR removed OR f OR p OR v GROUP BY 1, 2"""


@query(DIFF_SQL)
def result_differences(spark, d):
    """What the restated read of the latest facts changes in the one of that time."""
    facts, dates = m.facts(spark, d).select(*asof.CHOICE), m.dates(spark, d)
    sides = [kept(asof.latest_known(facts, dates, arm=arm, caller="result_differences").select("cik", "tag", "signal_date", "period_end", "filed", "value")) for arm in ("pit", "restated")]
    return difference.summary(difference.differences(*sides, ["cik", "tag", "signal_date"]))


@query(f"{with_sql('prices')}, p AS (SELECT ticker, trade_date, CAST(day(trade_date) AS INTEGER) AS d, CAST(right(ticker, 2) AS INTEGER) AS k FROM prices) SELECT ticker, trade_date, CASE WHEN d = 1 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN d = 1 THEN '' ELSE 'volume' END AS columns FROM p WHERE k = 7 AND d IN (1, 2)")
def planted_differences(spark, d):
    """A few changes planted in one ticker of many: the rows of their buckets alone are joined."""
    prices = kept(m.prices(spark, d))
    mine = F.substring("ticker", -2, 2) == "07"
    other = prices.filter(~(mine & (F.dayofmonth("trade_date") == 1))).withColumn("volume", F.when(mine & (F.dayofmonth("trade_date") == 2), -F.col("volume")).otherwise(F.col("volume")))
    return difference.differences(prices, other, ["ticker", "trade_date"])


# Nested stages

#: signup and purchase enter a stage, click and error leave one; the stage is named by the last digit of the value.
ENTERS, LEAVES = ("signup", "purchase"), ("click", "error")


def _steps(spark, d) -> DataFrame:
    e = m.table(spark, d, "events").filter(F.col("event_type").isin(*ENTERS, *LEAVES))
    stage = F.concat(F.lit("s"), F.pmod(F.floor("value"), F.lit(3)).cast("string"))
    return e.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("place"), stage.alias("stage"), F.col("event_type").isin(*ENTERS).alias("enters"))


#: Each enter is left by the first later leave before which as many stages were left as were entered since.
SPANS_SQL = """WITH e AS (SELECT user_id AS key, ts AS at, 's' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS stage, CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE -1 END AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('signup', 'purchase', 'click', 'error')),
s AS (SELECT *, sum(step) OVER (PARTITION BY key ORDER BY i) AS h FROM e),
pair AS (SELECT a.key, a.i, a.at, a.stage, a.h, min(b.i) AS j FROM s a LEFT JOIN s b ON b.key = a.key AND b.i > a.i AND b.step = -1 AND b.h = a.h - 1 WHERE a.step = 1 GROUP BY ALL),
span AS (SELECT p.key, p.i, p.j, p.stage, b.stage AS left_as, epoch_us(b.at) / 1e6 - epoch_us(p.at) / 1e6 AS seconds,
  (SELECT count(*) FROM pair o WHERE o.key = p.key AND o.i < p.i AND (o.j IS NULL OR o.j > p.i)) + 1 AS depth FROM pair p LEFT JOIN s b ON b.key = p.key AND b.i = p.j),
own AS (SELECT x.*, x.seconds - coalesce((SELECT sum(y.seconds) FROM span y WHERE y.key = x.key AND y.i > x.i AND y.j < x.j AND y.depth = x.depth + 1), 0) AS own_seconds FROM span x)
SELECT stage, count(*) AS calls, count(*) FILTER (j IS NULL) AS open_calls, count(*) FILTER (left_as <> stage) AS misnamed, round(sum(seconds), 3) AS seconds, round(sum(own_seconds), 3) AS own_seconds, max(depth) AS deepest FROM own GROUP BY 1"""


@query(SPANS_SQL)
def nested_stages(spark, d):
    out = spans.by_stage(spans.matched(_steps(spark, d)))
    return out.withColumns({k: round_to(F.col(k), 3) for k in ("seconds", "own_seconds")})


# Reasons for absent keys


def _reasons_sql() -> str:
    a, b = ("last_day(CAST(signal_date - to_months(1) AS DATE))", "last_day(CAST(signal_date - to_months(12) AS DATE))")
    return f"""{with_sql('facts', 'securities', 'prices', 'dates')}, {c.MEMBERS}, first AS (SELECT ticker, min(trade_date) AS f FROM prices WHERE close IS NOT NULL GROUP BY 1), k AS (SELECT *, {a} AS na, {b} AS oa FROM members),
n AS (SELECT k.*, p.close AS nv, p.trade_date AS nd FROM k ASOF LEFT JOIN prices p ON p.ticker = k.ticker AND p.trade_date <= k.na), o AS (SELECT n.*, p.close AS ov, p.trade_date AS od FROM n ASOF LEFT JOIN prices p ON p.ticker = n.ticker AND p.trade_date <= n.oa),
w AS (SELECT o.ticker, signal_date, CASE WHEN f IS NULL OR f > signal_date THEN 'no_history' WHEN f > oa THEN 'warm_up' WHEN oa - od > 10 OR na - nd > 10 THEN 'stale' WHEN ov <= 0 THEN 'not_positive' END AS reason, nv / ov - 1 AS v FROM o LEFT JOIN first USING (ticker))"""


@query(f"{_reasons_sql()} SELECT ticker, signal_date, round(CASE WHEN reason IS NULL THEN v END, 6) AS value, reason FROM w")
def absent_returns(spark, d):
    """Every member on every date has a twelve-month return, or one reason why not."""
    t = m.tables(spark, d)
    keys = panel.membership(t.securities, m.dates(spark, d))
    series = kept(t.prices.select("ticker", "trade_date", F.col("close_adj").alias("value")))
    return rounded(reasons.return_reasons(series, keys, 1, 12), "value")


@query(f"{_reasons_sql()} SELECT year(signal_date) AS year, reason, count(*) AS n_keys FROM w GROUP BY 1, 2")
def absent_return_counts(spark, d):
    return reasons.reason_counts(absent_returns(spark, d))


@query(f"""{with_sql('facts', 'securities', 'bars', 'dates')}, {c.MEMBERS}, p AS (SELECT ticker, trade_date, CASE WHEN month(trade_date) = 6 THEN 0 ELSE close * shares_out END AS v FROM prices),
w AS (SELECT m.ticker, signal_date, CASE WHEN trade_date IS NULL THEN 'no_history' WHEN signal_date - trade_date > 10 THEN 'stale' WHEN v <= 0 THEN 'not_positive' END AS reason FROM members m ASOF LEFT JOIN p ON p.ticker = m.ticker AND p.trade_date <= m.signal_date) SELECT year(signal_date) AS year, reason, count(*) AS n_keys FROM w GROUP BY 1, 2""")
def absent_market_values(spark, d):
    """Month-end bars whose value is 0 every June."""
    t = m.tables(spark, d, by_month=True)
    value = F.when(F.month("trade_date") == 6, 0.0).otherwise(F.col("close") * F.col("shares_out"))
    series = t.prices.select("ticker", "trade_date", value.alias("value"))
    return reasons.reason_counts(reasons.level_reasons(series, panel.membership(t.securities, m.dates(spark, d))))


# Counts that are taken while rows flow


@query(f"{c.CLASSED} SELECT coalesce(drop, 'accepted') AS reason, count(*) AS n_rows FROM c GROUP BY 1")
def ingest_observed_counts(spark, d):
    """The reasons against raw facts, observed in the one pass that stores the accepted ones."""
    facts, counts = ingest.facts_counted(c.classed_facts(spark, d), f"facts {uuid.uuid4().hex}")
    kept(facts)
    found = counts.get
    return spark.createDataFrame([(k, n) for k, n in found.items() if n], "reason string, n_rows long")


# Declared tags


@query(f"{with_sql('facts')} SELECT factor_id, tag, count(*) AS n_facts FROM (VALUES ('asset_growth', 'A'), ('bm_ratio', 'N'), ('ep_ratio', 'R'), ('roe', 'N'), ('roe', 'R')) v(factor_id, tag) JOIN facts USING (tag) GROUP BY ALL")
def declared_tags(spark, d):
    """The tags that plans of fact signals ask for, which are those that they tell of, and how many facts each has."""
    t, dates = m.tables(spark, d), m.dates(spark, d)
    read = [(f.factor_id, tag) for f in factors.REGISTRY.values() if f.uses_facts for tag in sorted(factors.verified_tags(f.factor_id, t, dates, c.TAGS))]
    return spark.createDataFrame(read, "factor_id string, tag string").join(t.facts.groupBy("tag").agg(F.count("*").alias("n_facts")), "tag").select("factor_id", "tag", "n_facts")


# What a construction leaves out

#: The tag N of every fifth company is negative.
SIGNED = with_sql("facts", "dates").replace("facts AS (", "plain AS (", 1).replace("dates AS (", "facts AS (SELECT * REPLACE (CASE WHEN tag = 'N' AND CAST(cik AS BIGINT) % 5 = 0 THEN -value ELSE value END AS value) FROM plain), dates AS (", 1)


def _signed(spark, d):
    t = m.tables(spark, d)
    negative = (F.col("tag") == "N") & (F.col("cik").cast("long") % 5 == 0)
    return tables.Tables(t.securities, t.prices, t.facts.withColumn("value", F.when(negative, -F.col("value")).otherwise(F.col("value"))))


@query(f"{SIGNED}, {c.HISTORY}, {c.TTM}, {c.LATEST} SELECT 'latest_equity_must_be_positive' AS filter_id, i.signal_date, count(*) AS n_input, count(*) FILTER (e.value > 0) AS n_output, count(*) FILTER (e.value <= 0) AS n_excluded FROM ttm i JOIN known e ON i.cik = e.cik AND i.signal_date = e.signal_date WHERE i.tag = 'R' AND e.tag = 'N' AND i.value IS NOT NULL GROUP BY 2")
def roe_filter(spark, d):
    return factors.roe_filter(_signed(spark, d), m.dates(spark, d), c.TAGS)


@query(f"{with_sql('facts', 'prices', 'dates')}, {c.CAP}, {c.LATEST}, a AS (SELECT DISTINCT ticker, signal_date FROM cap WHERE cap > 0), b AS (SELECT DISTINCT 'T' || cik AS ticker, signal_date FROM known WHERE tag = 'A'), u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT year(signal_date) AS year, CASE WHEN (ticker, signal_date) NOT IN (SELECT (ticker, signal_date) FROM b) THEN 'first' WHEN (ticker, signal_date) NOT IN (SELECT (ticker, signal_date) FROM a) THEN 'second' ELSE 'both' END AS side, count(*) AS n_keys FROM u GROUP BY 1, 2")
def key_sets(spark, d):
    """Keys with a market value, and keys with assets: union, intersection and both differences."""
    t, dates = m.tables(spark, d), m.dates(spark, d)
    assets = factors.named(asof.latest_known(t.facts.filter("tag = 'A'"), dates), t.securities)
    found = vintage.key_sets(factors.market_cap(t, dates), assets)
    return found.groupBy(F.year("signal_date").alias("year"), "side").agg(F.count("*").alias("n_keys"))
