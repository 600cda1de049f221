"""Registered queries: every operator on the driver's tables, with SQL that states the same result another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import round_to
from tidemark.operators import asof, audit, factors, panel, protocol, shares
from tidemark.plans import mapping as m
from tidemark.plans.mapping import with_sql
from tidemark.sources import ingest, tables
from tidemark.sources.kept import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TAGS = factors.Tags(equity="N", income="R", assets="A")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return round_to(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# Bitemporal reads

LATEST = f"""known AS (
  SELECT cik, tag, signal_date, period_start, period_end, filed, value FROM facts JOIN dates ON filed <= signal_date - 2 AND period_end <= signal_date - 2
  QUALIFY row_number() OVER (PARTITION BY cik, tag, signal_date ORDER BY period_end DESC, filed DESC, period_start DESC, accession DESC, form DESC, frame DESC, value DESC) = 1)"""
RESTATED = f"""restated AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY cik, tag, period_start, period_end ORDER BY {m.ORDER}) = 1)"""
LATEST_RESTATED = LATEST.replace("known AS", "late AS").replace("FROM facts", "FROM restated").replace("filed <= signal_date - 2 AND ", "")
HISTORY = f"""seen AS (
  SELECT * FROM facts JOIN dates ON filed <= signal_date - 2 AND period_end <= signal_date - 2
  QUALIFY row_number() OVER (PARTITION BY signal_date, cik, tag, period_start, period_end ORDER BY {m.ORDER}) = 1)"""
COLUMNS = "cik, tag, signal_date, period_start, period_end, filed, value"


@query(f"{with_sql('facts', 'dates')}, {LATEST} SELECT {COLUMNS} FROM known")
def pit_latest(spark, d):
    return asof.latest_known(m.facts(spark, d).select(*asof.CHOICE), m.dates(spark, d)).select(*COLUMNS.split(", "))


@query(f"{with_sql('all_facts', 'dates')}, {LATEST} SELECT {COLUMNS} FROM known")
def pit_latest_early(spark, d):
    """Facts that are filed before their periods end are known when these end."""
    return asof.latest_known(m.facts(spark, d, early=True).select(*asof.CHOICE), m.dates(spark, d)).select(*COLUMNS.split(", "))


@query(f"{with_sql('all_facts', 'dates')}, {HISTORY} SELECT signal_date, cik, tag, count(*) AS n, max(period_end) AS last_end, max(filed) AS last_filed FROM seen GROUP BY ALL")
def pit_history_early(spark, d):
    rows = asof.history(m.facts(spark, d, early=True), m.dates(spark, d))
    return rows.groupBy("signal_date", "cik", "tag").agg(F.count("*").alias("n"), F.max("period_end").alias("last_end"), F.max("filed").alias("last_filed"))


@query(f"{with_sql('facts', 'dates')}, {RESTATED}, {LATEST_RESTATED} SELECT {COLUMNS} FROM late")
def restated_latest(spark, d):
    return asof.latest_known(m.facts(spark, d).select(*asof.CHOICE), m.dates(spark, d), arm="restated").select(*COLUMNS.split(", "))


@query(f"{with_sql('facts', 'dates')}, {HISTORY} SELECT signal_date, cik, tag, count(*) AS n, min(period_start) AS first_start, max(filed) AS last_filed, round(sum(value), 2) AS total FROM seen GROUP BY ALL")
def pit_history(spark, d):
    rows = asof.history(m.facts(spark, d), m.dates(spark, d))
    return rows.groupBy("signal_date", "cik", "tag").agg(F.count("*").alias("n"), F.min("period_start").alias("first_start"), F.max("filed").alias("last_filed"), round_to(F.sum("value"), 2).alias("total"))


@query(f"{with_sql('facts')}, {RESTATED} SELECT cik, tag, period_start, period_end, filed, value, accession, frame FROM restated")
def restated_view(spark, d):
    return asof.restated(m.facts(spark, d).select(*asof.CHOICE)).select("cik", "tag", "period_start", "period_end", "filed", "value", "accession", "frame")


@query(
    f"""{with_sql('facts')}, f AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY cik, tag, period_start, period_end ORDER BY filed, accession, form, frame, value) = 1), {RESTATED}
SELECT f.cik, f.tag, f.period_start, f.period_end, f.filed AS first_filed, l.filed AS last_filed, f.value AS first_value, l.value AS last_value, l.value - f.value AS revision,
  round((l.value - f.value) / nullif(abs(f.value), 0), 6) AS revision_pct, date_diff('day', f.filed, l.filed) AS revision_lag_days
FROM f JOIN restated l USING (cik, tag, period_start, period_end) WHERE f.filed <> l.filed"""
)
def restatements(spark, d):
    return rounded(audit.restatements(m.facts(spark, d)), "revision_pct")


FLAGS = """days AS (SELECT cik, tag, period_start, period_end, filed, count(DISTINCT value) > 1 AS conflict FROM facts GROUP BY ALL),
k AS (SELECT count(DISTINCT f.filed) > 1 AS repeated, count(DISTINCT value) > 1 AS changed, bool_or(value IS NULL OR NOT isfinite(value)) AS nonfinite_or_missing_value, bool_or(unit IS NULL) AS missing_unit,
  count(DISTINCT unit) > 1 AS mixed_units, count(DISTINCT fact_type) > 1 AS mixed_fact_types, bool_or(fact_type = 'unknown') AS unknown_fact_type, bool_or(conflict) AS same_date_conflict
  FROM facts f JOIN days USING (cik, tag, period_start, period_end, filed) GROUP BY cik, tag, period_start, period_end)"""
BAD = " OR ".join(audit.REASONS)


@query(f"{with_sql('facts')}, {FLAGS} SELECT count(*) AS fact_keys, count(*) FILTER (repeated) AS repeated_keys, count(*) FILTER (repeated AND NOT ({BAD}) AND changed) AS changed_keys, count(*) FILTER (repeated AND NOT ({BAD}) AND NOT changed) AS unchanged_keys, count(*) FILTER (repeated AND ({BAD})) AS uncomparable_keys FROM k")
def disclosure_summary(spark, d):
    return audit.disclosure_summary(m.facts(spark, d))


@query(f"{with_sql('facts')}, {FLAGS} " + " UNION ALL ".join(f"SELECT '{r if r != BAD else 'any_reason'}' AS reason, count(*) FILTER ({r}) AS n_keys FROM k WHERE repeated" for r in (*audit.REASONS, BAD)))
def uncomparable_reasons(spark, d):
    return audit.uncomparable_reasons(m.facts(spark, d))


# Membership and audits

MEMBERS = """members AS (SELECT DISTINCT ticker, signal_date FROM dates JOIN securities ON (first_filing IS NULL OR first_filing <= signal_date) AND (last_filing IS NULL OR last_filing >= signal_date))"""


@query(f"{with_sql('facts', 'securities', 'dates')}, {MEMBERS} SELECT * FROM members")
def universe_membership(spark, d):
    return panel.membership(m.securities(spark, d), m.dates(spark, d))


CAP = """cap AS (SELECT ticker, signal_date, close * shares_out AS cap FROM (SELECT * FROM (SELECT DISTINCT ticker FROM prices) CROSS JOIN dates) q ASOF JOIN prices p ON q.ticker = p.ticker AND q.signal_date >= p.trade_date WHERE signal_date - trade_date <= 10)""".replace("SELECT ticker, signal_date, close", "SELECT q.ticker, signal_date, close")


@query(f"{with_sql('facts', 'securities', 'prices', 'dates')}, {MEMBERS}, {CAP} SELECT signal_date, count(*) AS n_in, count(m.ticker) AS n_out, count(*) - count(m.ticker) AS n_excluded FROM cap c LEFT JOIN members m USING (ticker, signal_date) GROUP BY signal_date")
def universe_gate(spark, d):
    t, dates = m.tables(spark, d), m.dates(spark, d)
    return panel.gate_report(factors.log_mktcap(t, dates), panel.membership(t.securities, dates))


@query(f"{with_sql('dates')} SELECT signal_date, CASE WHEN k = 0 THEN signal_date ELSE last_day(CAST(signal_date - to_months(k) AS DATE)) END AS anchor, k FROM dates CROSS JOIN (VALUES (0), (1), (7), (12)) v(k)")
def calendar_anchors(spark, d):
    from tidemark.functions import month_anchor

    each = [F.struct(month_anchor(F.col("signal_date"), k).alias("anchor"), F.lit(k).alias("k")) for k in (0, 1, 7, 12)]
    return m.dates(spark, d).select("signal_date", F.explode(F.array(*each)).alias("x")).select("signal_date", "x.*")


TRAP = """last AS (SELECT cik, tag, period_end, max(filed) AS filed FROM facts GROUP BY ALL),
trap AS (SELECT ticker, signal_date, tag, period_end, l.filed FROM members JOIN securities s USING (ticker) JOIN last l ON l.cik = s.cik AND period_end <= signal_date AND l.filed > signal_date + {grace})"""


@query(f"{with_sql('facts', 'securities', 'dates')}, {MEMBERS}, {TRAP.format(grace=0)} SELECT * FROM trap")
def naive_trap(spark, d):
    t, dates = m.tables(spark, d), m.dates(spark, d)
    return audit.naive_trap(panel.membership(t.securities, dates), t.securities, t.facts)


@query(f"{with_sql('facts', 'securities', 'dates')}, {MEMBERS}, {TRAP.format(grace=20)} SELECT count(DISTINCT signal_date) AS n_signal_dates, (SELECT count(DISTINCT signal_date) FROM trap) AS n_dates_exposed, (SELECT count(*) FROM trap) AS n_trap_rows, round((SELECT count(DISTINCT signal_date) FROM trap) / count(DISTINCT signal_date), 6) AS exposure_rate FROM members")
def trap_report(spark, d):
    t, dates = m.tables(spark, d), m.dates(spark, d)
    members = panel.membership(t.securities, dates)
    return rounded(audit.trap_report(members, t.securities, t.facts, 20), "exposure_rate")


@query(f"{with_sql('facts', 'securities', 'dates')}, {MEMBERS}, {TRAP.format(grace=20)} SELECT m.ticker, m.signal_date, count(trap.tag) AS n_early FROM members m LEFT JOIN trap ON trap.ticker = m.ticker AND trap.signal_date = m.signal_date GROUP BY ALL")
def trap_exposure(spark, d):
    t, dates = m.tables(spark, d), m.dates(spark, d)
    return audit.exposure(panel.membership(t.securities, dates), t.securities, t.facts, 20)


@query(f"{with_sql('facts', 'dates')}, {LATEST} SELECT signal_date, signal_date - 2 AS requested_asof, max(filed) AS max_filed, count(*) AS n_rows, string_agg(DISTINCT tag, '+' ORDER BY tag) AS tags FROM known GROUP BY signal_date")
def read_log(spark, d):
    return audit.read_log(asof.latest_known(m.facts(spark, d), m.dates(spark, d)))


@query(f"{with_sql('facts', 'dates')}, {RESTATED}, {LATEST_RESTATED}, g AS (SELECT signal_date, max(filed) AS f FROM late GROUP BY 1) SELECT count(*) AS n_reads, count(*) FILTER (f > signal_date) AS n_violations, count(*) = 0 AS vacuous FROM g")
def read_check_restated(spark, d):
    return audit.read_check(audit.read_log(asof.latest_known(m.facts(spark, d), m.dates(spark, d), arm="restated")))


@query(f"{with_sql('facts')} SELECT column_name AS column, n_rows, n_known, round(n_known / n_rows, 6) AS share FROM (SELECT count(*) AS n_rows, " + "UNNEST([" + ", ".join(f"{{'column_name': '{c}', 'n_known': count({c})}}" for c in ("cik", "tag", "period_start", "unit", "value", "frame")) + "], recursive := true) FROM facts)")
def column_coverage(spark, d):
    return rounded(tables.coverage(m.facts(spark, d).select("cik", "tag", "period_start", "unit", "value", "frame")), "share")


@query(f"{with_sql('facts')}, k AS (SELECT count(*) AS n FROM facts GROUP BY cik, tag, period_start, period_end, filed, form, accession, frame HAVING count(*) > 1) SELECT 'key' AS rule, CAST(sum(n) AS BIGINT) AS n_rows FROM k HAVING sum(n) > 0")
def key_violations(spark, d):
    return tables.violations(m.facts(spark, d), "facts")


@query(f"{with_sql('prices')} SELECT ticker, trade_date, close, volume FROM prices WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def price_scan(spark, d):
    return tables.price_scan(m.prices(spark, d), "1997-01-01", "1997-12-31").select("ticker", "trade_date", "close", "volume")


@query(f"{with_sql('facts')}, g AS (SELECT cik, filed, count(*) AS n_rows, count(DISTINCT value) AS n_values, string_agg(DISTINCT form, '+' ORDER BY form) AS forms, min(value) AS low, max(value) AS high FROM facts WHERE tag = 'N' GROUP BY ALL) SELECT cik, filed, n_rows, n_values, forms, round(high / nullif(low, 0), 6) AS spread, n_values > 1 AS ambiguous FROM g")
def share_groups(spark, d):
    n = F.size("candidates").cast("long")
    found = shares.filings(m.facts(spark, d).filter("tag = 'N'"))
    return rounded(found.select("cik", "filed", F.col("counts").alias("n_rows"), n.alias("n_values"), F.array_join("forms", "+").alias("forms"), "spread", (n > 1).alias("ambiguous")), "spread")


HALF = "CAST(coalesce(sum(CAST(('0x' || substr(h, {at}, 16)) AS UBIGINT)::HUGEINT), 0) AS VARCHAR)"


@query(f"{with_sql('facts')}, k AS (SELECT md5(cik || '|' || tag || '|' || CAST(filed AS VARCHAR)) AS h FROM facts) SELECT count(*) AS n_rows, {HALF.format(at=1)} || ':' || {HALF.format(at=17)} AS key_hash FROM k")
def frame_hash(spark, d):
    return audit.frame_hash(m.facts(spark, d), ["cik", "tag", "filed"])


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(value), 2) AS total, round(quantile_cont(value, 0.5), 6) AS median_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1")
def stage_summary(spark, d):
    out = audit.stage_summary(m.table(spark, d, "events").withColumnRenamed("event_type", "stage"))
    return rounded(out.withColumn("total", round_to(F.col("total"), 2)), "median_value")


@query(
    """WITH e AS (SELECT user_id AS key, date_trunc('second', ts) AS b, date_trunc('second', lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS e FROM events),
w AS (SELECT DISTINCT user_id AS key, user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS window_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS wb, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS we FROM events)
SELECT window_id, CAST(coalesce(sum(greatest(0, epoch(least(e.e, we))::BIGINT - epoch(greatest(b, wb))::BIGINT)), 0) AS BIGINT) AS seconds FROM w LEFT JOIN e ON w.key = e.key AND e.e IS NOT NULL GROUP BY 1"""
)
def interval_overlap(spark, d):
    e = m.table(spark, d, "events")
    gaps = e.select(F.col("user_id").alias("key"), F.date_trunc("second", "ts").alias("begin"), F.date_trunc("second", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("end")).filter("end IS NOT NULL")
    day = F.col("ts").cast("date")
    half = e.select(F.col("user_id").alias("key"), F.concat_ws(":", "user_id", day.cast("string")).alias("window_id"), day.cast("timestamp").alias("begin"), (day.cast("timestamp") + F.expr("interval 12 hours")).alias("end")).distinct()
    return audit.overlap_seconds(gaps, half)


# As-of values


@query(f"{with_sql('facts', 'securities', 'prices')}, s AS (SELECT cik, filed, max(value) AS v FROM facts WHERE tag = 'N' AND value > 0 GROUP BY ALL) SELECT p.ticker, p.trade_date, CASE WHEN p.trade_date - s.filed <= 400 THEN s.v END AS shares_out FROM prices p JOIN securities c USING (ticker) ASOF LEFT JOIN s ON s.cik = c.cik AND p.trade_date >= s.filed")
def attach_shares(spark, d):
    t = m.tables(spark, d)
    blank = t.prices.withColumn("shares_out", F.lit(None).cast("double"))
    return asof.attach_shares(blank, t.facts.filter("tag = 'N'"), t.securities).select("ticker", "trade_date", "shares_out")


@query(
    f"""{with_sql('prices')}, r AS (SELECT *, CASE WHEN dayofyear(trade_date) < 9 THEN 2.0::DOUBLE WHEN day(trade_date) = 20 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS q FROM prices),
c AS (SELECT *, pow(2.0::DOUBLE, coalesce(sum(CASE WHEN q = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS f FROM r)
SELECT ticker, trade_date, f AS cumulative, close * f AS close, volume / f AS volume FROM c"""
)
def unadjusted_prices(spark, d):
    ratio = F.when(F.dayofyear("trade_date") < 9, 2.0).when(F.dayofmonth("trade_date") == 20, 0.0).otherwise(1.0)
    out = asof.unadjusted(m.prices(spark, d).withColumn("split_ratio", ratio))
    return out.select("ticker", "trade_date", "cumulative", "close", "volume")


# Signals

PRICE_AT = """days AS (SELECT DISTINCT day FROM (SELECT signal_date AS day FROM dates UNION ALL SELECT last_day(CAST(signal_date - to_months(k) AS DATE)) FROM dates CROSS JOIN (VALUES (1), (7), (12)) v(k))),
price_at AS (SELECT q.ticker, q.day, close FROM (SELECT * FROM (SELECT DISTINCT ticker FROM prices) CROSS JOIN days) q ASOF JOIN prices p ON q.ticker = p.ticker AND q.day >= p.trade_date WHERE q.day - trade_date <= 10)"""


def _return_sql(recent: int, base: int, sign: int) -> str:
    anchor = lambda k: "signal_date" if not k else f"last_day(CAST(signal_date - to_months({k}) AS DATE))"
    return f"{with_sql('prices', 'dates')}, {PRICE_AT} SELECT a.ticker, signal_date, round({sign} * (a.close / b.close - 1), 6) AS value FROM dates JOIN price_at a ON a.day = {anchor(recent)} JOIN price_at b ON b.ticker = a.ticker AND b.day = {anchor(base)}"


def _signal(name: str, sql: str | None, **about) -> None:
    def run(spark, d):
        f = factors.REGISTRY[name]
        t, dates = m.tables(spark, d), m.dates(spark, d)
        if name not in ("roe", "asset_growth"):  # the others read the daily bars several times
            t = tables.Tables(t.securities, kept(t.prices), t.facts)
        out = f.compute(t, dates, tags=TAGS) if f.uses_facts and name != "log_mktcap" else f.compute(t, dates)
        return rounded(out, "value")

    run.__name__ = f"signal_{name}"
    query(sql)(run)


SESSIONS = """sess AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM prices)),
grid AS (SELECT t.ticker, s.trade_date, s.i, p.close, p.volume, p.shares_out FROM (SELECT DISTINCT ticker FROM prices) t CROSS JOIN sess s LEFT JOIN prices p ON p.ticker = t.ticker AND p.trade_date = s.trade_date)"""


def _derived_sql(value: str, raw: str) -> str:
    """The rolling value at most ten days old, and a raw value at most ten days old."""
    return f"""v AS (SELECT q.ticker, q.signal_date, value FROM (SELECT * FROM (SELECT DISTINCT ticker FROM prices) CROSS JOIN dates) q ASOF JOIN (SELECT ticker, trade_date, value FROM {value} WHERE value IS NOT NULL) r ON q.ticker = r.ticker AND q.signal_date >= r.trade_date WHERE signal_date - trade_date <= 10),
w AS (SELECT q.ticker, q.signal_date FROM (SELECT * FROM (SELECT DISTINCT ticker FROM prices) CROSS JOIN dates) q ASOF JOIN (SELECT ticker, trade_date FROM prices WHERE {raw} IS NOT NULL) r ON q.ticker = r.ticker AND q.signal_date >= r.trade_date WHERE signal_date - trade_date <= 10)"""


TTM = """z AS (SELECT *, period_end - period_start AS od, value - coalesce(lag(value) OVER p, 0) AS delta, period_end - coalesce(lag(period_end) OVER p, period_start) AS span FROM seen WINDOW p AS (PARTITION BY cik, tag, signal_date, period_start ORDER BY period_end)),
k AS (SELECT * FROM z WHERE span BETWEEN 45 AND 130 QUALIFY row_number() OVER (PARTITION BY cik, tag, signal_date, period_end ORDER BY CASE WHEN od <= 130 THEN 0 ELSE 1 END, filed, period_start) = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY cik, tag, signal_date ORDER BY period_end DESC) AS r, period_end - lag(period_end) OVER (PARTITION BY cik, tag, signal_date ORDER BY period_end) AS gap FROM k),
four AS (SELECT cik, tag, signal_date, count(*) AS n, sum(delta) AS total, min(CASE WHEN r < 4 THEN gap END) AS low, max(CASE WHEN r < 4 THEN gap END) AS high FROM l WHERE r <= 4 GROUP BY ALL),
year AS (SELECT cik, tag, signal_date, arg_max(value, (period_end, filed, period_start)) AS total FROM seen WHERE period_end - period_start BETWEEN 300 AND 430 GROUP BY ALL),
ttm AS (SELECT coalesce(f.cik, y.cik) AS cik, coalesce(f.tag, y.tag) AS tag, coalesce(f.signal_date, y.signal_date) AS signal_date, CASE WHEN n = 4 AND low >= 60 AND high <= 130 THEN f.total ELSE y.total END AS value FROM four f FULL JOIN year y ON f.cik = y.cik AND f.tag = y.tag AND f.signal_date = y.signal_date)"""

for _name, _recent, _base, _sign in (("mom_12_1", 1, 12, 1), ("mom_6_1", 1, 7, 1), ("rev_1m", 0, 1, -1)):
    _signal(_name, _return_sql(_recent, _base, _sign))
_signal("log_mktcap", f"{with_sql('prices', 'dates')}, {CAP} SELECT ticker, signal_date, round(-ln(cap), 6) AS value FROM cap WHERE cap > 0")
_signal(
    "total_vol_60d",
    f"{with_sql('prices', 'dates')}, {SESSIONS}, ret AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY i) - 1 AS r FROM grid), roll AS (SELECT ticker, trade_date, CASE WHEN count(r) OVER x >= 30 THEN stddev_samp(r) OVER x END AS value FROM ret WINDOW x AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), {_derived_sql('roll', 'close')} SELECT ticker, signal_date, round(-value, 6) AS value FROM v SEMI JOIN w USING (ticker, signal_date)",
)
_signal(
    "turnover",
    f"{with_sql('prices', 'dates')}, {SESSIONS}, roll AS (SELECT ticker, trade_date, CASE WHEN count(volume) OVER x >= 10 THEN avg(volume) OVER x END AS value FROM grid WINDOW x AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)), {_derived_sql('roll', 'volume')}, s AS (SELECT q.ticker, q.signal_date, shares_out FROM (SELECT * FROM (SELECT DISTINCT ticker FROM prices) CROSS JOIN dates) q ASOF JOIN prices p ON q.ticker = p.ticker AND q.signal_date >= p.trade_date WHERE signal_date - trade_date <= 10) SELECT ticker, signal_date, round(-value / shares_out, 6) AS value FROM v SEMI JOIN w USING (ticker, signal_date) JOIN s USING (ticker, signal_date) WHERE shares_out > 0",
)
_signal("bm_ratio", f"{with_sql('facts', 'prices', 'dates')}, {LATEST}, {CAP} SELECT ticker, signal_date, round(value / cap, 6) AS value FROM known JOIN cap ON ticker = 'T' || cik AND known.signal_date = cap.signal_date WHERE tag = 'N' AND value > 0 AND cap > 0".replace("SELECT ticker, signal_date, round(value / cap", "SELECT ticker, known.signal_date, round(value / cap"))
_signal("ep_ratio", f"{with_sql('facts', 'prices', 'dates')}, {HISTORY}, {TTM}, {CAP} SELECT ticker, ttm.signal_date, round(value / cap, 6) AS value FROM ttm JOIN cap ON ticker = 'T' || cik AND ttm.signal_date = cap.signal_date WHERE tag = 'R' AND value > 0 AND cap > 0")
_signal("roe", f"{with_sql('facts', 'dates')}, {HISTORY}, {TTM}, {LATEST} SELECT 'T' || i.cik AS ticker, i.signal_date, round(i.value / e.value, 6) AS value FROM ttm i JOIN known e ON i.cik = e.cik AND i.signal_date = e.signal_date WHERE i.tag = 'R' AND e.tag = 'N' AND e.value > 0 AND i.value IS NOT NULL")
_signal(
    "asset_growth",
    f"{with_sql('facts', 'dates')}, {HISTORY}, y AS (SELECT * FROM seen WHERE tag = 'A' AND fiscal_period = 'FY' QUALIFY row_number() OVER (PARTITION BY cik, signal_date, fiscal_year ORDER BY period_end DESC, filed DESC, period_start DESC, value DESC) = 1), g AS (SELECT *, lag(value) OVER w AS old, lag(fiscal_year) OVER w AS old_year, lag(period_end) OVER w AS old_end FROM y WINDOW w AS (PARTITION BY cik, signal_date ORDER BY fiscal_year) QUALIFY row_number() OVER (PARTITION BY cik, signal_date ORDER BY fiscal_year DESC) = 1) SELECT 'T' || cik AS ticker, signal_date, round(-(value / old - 1), 6) AS value FROM g WHERE old_year = fiscal_year - 1 AND period_end - old_end BETWEEN 300 AND 430 AND old > 0",
)


@query(f"{with_sql('bars', 'dates')}, {SESSIONS}, ret AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY i) - 1 AS r FROM grid), roll AS (SELECT ticker, trade_date, CASE WHEN count(r) OVER x >= 6 THEN stddev_samp(r) OVER x END AS value FROM ret WINDOW x AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), {_derived_sql('roll', 'close')} SELECT ticker, signal_date, round(-value, 6) AS value FROM v SEMI JOIN w USING (ticker, signal_date)")
def total_vol_monthly(spark, d):
    """The volatility of twelve month-end bars, six returns at least: days are too sparse for sixty."""
    t = m.tables(spark, d, by_month=True)
    t = tables.Tables(t.securities, kept(t.prices), t.facts)
    return rounded(factors.total_vol_60d(t, m.dates(spark, d), 12, 6), "value")


@query(f"{with_sql('bars', 'dates')}, {SESSIONS}, ret AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY i) - 1 AS r FROM grid) SELECT ticker, trade_date, CASE WHEN count(r) OVER x >= 6 THEN round(stddev_samp(r) OVER x, 6) END AS value FROM ret WINDOW x AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling_deviation(spark, d):
    """Twelve sessions of month-end bars, six returns at least."""
    grid = factors.on_sessions(m.monthly(spark, d), "close_adj")
    before = F.lag("value").over(Window.partitionBy("ticker").orderBy("session_idx"))
    out = factors.rolling(grid.withColumn("value", F.try_divide("value", before) - 1), F.stddev_samp, 12, 6)
    return rounded(out.select("ticker", "trade_date", "value"), "value")


@query(f"{with_sql('facts', 'dates')}, {HISTORY}, {TTM} SELECT cik, tag, signal_date, round(value, 4) AS value FROM ttm WHERE value IS NOT NULL")
def ttm_panel(spark, d):
    return factors.ttm(m.facts(spark, d), m.dates(spark, d)).withColumn("value", round_to(F.col("value"), 4))


@query(
    f"""{with_sql('facts', 'prices', 'dates')}, {LATEST}, {RESTATED}, {LATEST_RESTATED}, {CAP},
p AS (SELECT ticker, known.signal_date, value / cap AS value FROM known JOIN cap ON ticker = 'T' || cik AND known.signal_date = cap.signal_date WHERE tag = 'N' AND value > 0 AND cap > 0),
r AS (SELECT ticker, late.signal_date, value / cap AS value FROM late JOIN cap ON ticker = 'T' || cik AND late.signal_date = cap.signal_date WHERE tag = 'N' AND value > 0 AND cap > 0)
SELECT coalesce(p.signal_date, r.signal_date) AS signal_date, count(*) FILTER (p.value IS NOT NULL AND r.value IS NOT NULL) AS n_both, count(*) FILTER (r.value IS NULL) AS n_pit_only, count(*) FILTER (p.value IS NULL) AS n_restated_only, count(*) FILTER (p.value = r.value) AS n_equal, round(avg(r.value - p.value), 6) AS mean_gap
FROM p FULL JOIN r ON p.ticker = r.ticker AND p.signal_date = r.signal_date GROUP BY 1"""
)
def vintage_comparison(spark, d):
    t, dates = m.tables(spark, d), m.dates(spark, d)
    cap = factors.caps(t, dates)
    return rounded(audit.compare_vintages(factors.bm_ratio(t, dates, TAGS, cap=cap), factors.bm_ratio(t, dates, TAGS, "restated", cap=cap)), "mean_gap")


@query(f"{with_sql('facts', 'prices', 'dates')}, {LATEST}, {CAP}, v AS (SELECT value / cap AS value FROM known JOIN cap ON ticker = 'T' || cik AND known.signal_date = cap.signal_date WHERE tag = 'N' AND value > 0 AND cap > 0) SELECT count(*) AS n_finite, count(*) FILTER (value > 0.00003) AS n_outside, round(count(*) FILTER (value > 0.00003) / count(*), 6) AS share_outside, CASE WHEN count(*) FILTER (value > 0.00003) / count(*) > 0.01 THEN 'VIOLATION' ELSE 'WITHIN_TOLERANCE' END AS status FROM v")
def plausibility(spark, d):
    values = factors.bm_ratio(m.tables(spark, d), m.dates(spark, d), TAGS)
    return rounded(audit.plausibility(values, 0.0, 0.00003), "share_outside")


# Cross-sections, labels and scores on month-end bars

MOM = f"""{with_sql('bars', 'dates')}, a AS (SELECT p.ticker, signal_date, p.close / q.close - 1 AS value FROM dates JOIN prices p ON p.trade_date = signal_date JOIN prices q ON q.ticker = p.ticker AND q.trade_date = last_day(CAST(signal_date - to_months(1) AS DATE)))"""
CLEAN = """e AS (SELECT signal_date, count(*) AS n, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM a GROUP BY 1 HAVING count(*) >= 10),
c AS (SELECT ticker, signal_date, value, greatest(lo, least(hi, value)) AS w FROM a JOIN e USING (signal_date)),
g AS (SELECT ticker, signal_date, value <> w AS was_clipped, w - avg(w) OVER (PARTITION BY signal_date, s_nationkey) AS v FROM c JOIN supplier ON ticker = 'T' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0')),
z AS (SELECT ticker, signal_date, was_clipped, CASE WHEN stddev_samp(v) OVER x > 1e-12 THEN (v - avg(v) OVER x) / stddev_samp(v) OVER x ELSE 0 END AS value FROM g WINDOW x AS (PARTITION BY signal_date))"""


def momentum(spark, d, bars: DataFrame | None = None) -> DataFrame:
    """One-month returns of bars: no carry over a missing month."""
    bars = (m.monthly(spark, d) if bars is None else bars).select("ticker", "trade_date", "close")
    old = bars.select("ticker", F.last_day(F.add_months("trade_date", 1)).alias("trade_date"), F.col("close").alias("old"))
    rows = bars.join(old, ["ticker", "trade_date"]).join(F.broadcast(m.dates(spark, d)), F.col("trade_date") == F.col("signal_date"))
    return rows.select("ticker", "signal_date", (F.try_divide("close", "old") - 1).alias("value"))


def clean_momentum(spark, d, bars: DataFrame | None = None) -> DataFrame:
    return panel.cleaned(momentum(spark, d, bars), m.securities(spark, d))


def scored_panel(spark, d) -> DataFrame:
    bars = kept(m.monthly(spark, d))  # read for returns, sessions, and both ends of a label
    return panel.scored(panel.labelled(clean_momentum(spark, d, bars).select("ticker", "signal_date", "value"), bars))


PANEL = f"""{MOM}, {CLEAN}, sess AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM prices)),
plan AS (SELECT signal_date, max(i) AS f FROM dates LEFT JOIN sess ON trade_date <= signal_date GROUP BY 1),
lab AS (SELECT z.ticker, z.signal_date, z.value AS prediction, x.close / n.close - 1 AS label,
  CASE WHEN f IS NULL THEN 'no_formation_session' WHEN t.i IS NULL THEN 'no_full_horizon' WHEN n.close IS NULL AND x.close IS NULL THEN 'missing_entry_and_exit_price' WHEN n.close IS NULL THEN 'missing_entry_price' WHEN x.close IS NULL THEN 'missing_exit_price' ELSE 'matched' END AS outcome
  FROM z JOIN plan USING (signal_date) LEFT JOIN sess s ON s.i = f + 1 LEFT JOIN sess t ON t.i = f + 2 LEFT JOIN prices n ON n.ticker = z.ticker AND n.trade_date = s.trade_date LEFT JOIN prices x ON x.ticker = z.ticker AND x.trade_date = t.trade_date),
panel AS (SELECT ticker, signal_date, prediction, label FROM lab WHERE outcome = 'matched')"""


@query(f"{MOM}, {CLEAN} SELECT ticker, signal_date, round(value, 6) AS value, was_clipped FROM z")
def clean_cross_section(spark, d):
    return rounded(clean_momentum(spark, d), "value")


@query(f"{MOM}, n AS (SELECT signal_date, count(*) AS n FROM a GROUP BY 1), {CLEAN} SELECT (SELECT CAST(sum(n) AS BIGINT) FROM n) AS n_input, 0 AS n_not_finite, CAST(coalesce((SELECT sum(n) FROM n WHERE n < 10), 0) AS BIGINT) AS n_small_dates, (SELECT count(*) FROM n) AS dates_in, (SELECT count(*) FROM n WHERE n < 10) AS small_dates, count(*) AS n_output, count(*) FILTER (was_clipped) AS n_winsorised, count(DISTINCT signal_date) AS dates_out FROM z")
def cleaning_report(spark, d):
    return panel.cleaning_report(momentum(spark, d), clean_momentum(spark, d))


@query(f"{PANEL} SELECT ticker, signal_date, round(prediction, 6) AS prediction, round(label, 6) AS label FROM panel")
def labelled_panel(spark, d):
    return rounded(scored_panel(spark, d).select("ticker", "signal_date", "prediction", "label"), "prediction", "label")


@query(f"{PANEL} SELECT outcome, count(*) AS n_rows FROM lab GROUP BY 1")
def label_attrition(spark, d):
    return panel.attrition(panel.labelled(clean_momentum(spark, d).select("ticker", "signal_date", "value"), m.monthly(spark, d)))


QUANTILES = """b AS (SELECT p.*, (p.prediction > e[1])::INT + (p.prediction > e[2])::INT + (p.prediction > e[3])::INT + (p.prediction > e[4])::INT AS bin FROM panel p JOIN (SELECT signal_date, quantile_cont(prediction, [0.2, 0.4, 0.6, 0.8]) AS e FROM panel GROUP BY 1 HAVING count(*) >= 15) USING (signal_date)),
q AS (SELECT signal_date, bin, avg(label) AS mean_label, count(*) AS n FROM b WHERE signal_date IN (SELECT signal_date FROM b GROUP BY 1 HAVING count(DISTINCT bin) = 5) GROUP BY ALL)"""
SPREAD = "s AS (SELECT signal_date, max(mean_label) FILTER (bin = 4) - max(mean_label) FILTER (bin = 0) AS spread FROM q GROUP BY 1)"
IC = """rk AS (SELECT signal_date, rank() OVER (PARTITION BY signal_date ORDER BY prediction) + (count(*) OVER (PARTITION BY signal_date, prediction) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY signal_date ORDER BY label) + (count(*) OVER (PARTITION BY signal_date, label) - 1) / 2.0::DOUBLE AS b FROM panel),
ic AS (SELECT signal_date, corr(a, b) AS ic, count(*) AS n FROM rk GROUP BY 1 HAVING count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0)"""


@query(f"{PANEL}, {QUANTILES} SELECT signal_date, bin, round(mean_label, 6) AS mean_label, n FROM q")
def quantile_returns(spark, d):
    return rounded(protocol.quantile_returns(scored_panel(spark, d)), "mean_label")


@query(f"{PANEL}, {QUANTILES}, {SPREAD} SELECT signal_date, round(spread, 6) AS spread FROM s")
def long_short(spark, d):
    return rounded(protocol.long_short(protocol.quantile_returns(scored_panel(spark, d))), "spread")


@query(f"{PANEL}, {IC} SELECT signal_date, round(ic, 6) AS ic, n FROM ic")
def information_coefficient(spark, d):
    return rounded(protocol.information_coefficient(scored_panel(spark, d)), "ic")


@query(f"{PANEL}, {QUANTILES}, mm AS (SELECT bin, avg(mean_label) AS v FROM q GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY bin) AS a, rank() OVER (ORDER BY v) AS b FROM mm) SELECT count(*) AS n_bins, CASE WHEN count(*) >= 3 THEN round(corr(a, b), 6) END AS rho, round(CASE WHEN count(*) = 5 THEN 1 - 2 / pi() * (atan(t) + sin(atan(t)) * cos(atan(t))) END, 6) AS p FROM r, (SELECT CASE WHEN abs(corr(a, b)) < 1 THEN abs(corr(a, b)) * sqrt(3 / ((1 + corr(a, b)) * (1 - corr(a, b)))) / sqrt(3) ELSE 1e150 END AS t FROM r) GROUP BY t")
def monotonicity(spark, d):
    return rounded(protocol.monotonicity(protocol.quantile_returns(scored_panel(spark, d))), "rho", "p")


@query(
    f"""{PANEL}, sl AS (SELECT signal_date, regr_slope(label, prediction) AS v FROM panel GROUP BY 1 HAVING count(*) >= 10 AND stddev_pop(prediction) > 0),
x AS (SELECT *, row_number() OVER (ORDER BY signal_date) AS i, count(*) OVER () AS n, avg(v) OVER () AS mu, greatest(1, floor(4 * pow(count(*) OVER () / 100, 2 / 9.0::DOUBLE)))::INT AS lags FROM sl),
gg AS (SELECT a.i - b.i AS k, any_value(a.lags) AS lags, sum((a.v - a.mu) * (b.v - b.mu)) AS g FROM x a JOIN x b ON b.i <= a.i AND a.i - b.i <= a.lags GROUP BY 1),
s AS (SELECT sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (lags + 1)) * g END) AS s, max(CASE WHEN k = 0 THEN g END) AS ss FROM gg)
SELECT any_value(n) AS n, round(any_value(mu), 6) AS mean, round(any_value(mu) / sqrt(any_value(ss) / (any_value(n) - 1) / any_value(n)), 6) AS naive_t, round(any_value(mu) / sqrt(any_value(s) / any_value(n) / any_value(n) * any_value(n) / (any_value(n) - 1)), 6) AS nw_t FROM x CROSS JOIN s"""
)
def fama_macbeth(spark, d):
    return rounded(protocol.newey_west(protocol.slopes(scored_panel(spark, d)), "slope"), "mean", "naive_t", "nw_t")


SLOPE_SQL = ORACLE_SQL["fama_macbeth"].replace("round(any_value(mu) / sqrt(any_value(s)", "(any_value(mu) / sqrt(any_value(s)").replace("(any_value(n) - 1)), 6) AS nw_t", "(any_value(n) - 1))) AS nw_t")


@query(f"WITH t AS ({SLOPE_SQL}), k AS (SELECT n, nw_t, i, abs(nw_t) + i * 0.002::DOUBLE AS x, CASE WHEN i IN (0, 6000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM t, range(6001) r(i)) SELECT any_value(n) AS n, round(any_value(nw_t), 6) AS nw_t, round(2 * sum(w * exp(-x * x / 2)) * 0.002 / 3 / sqrt(2 * pi()), 6) AS nw_p FROM k")
def fama_macbeth_p(spark, d):
    """The p-value of the mean slope; in SQL the integral of the normal density by Simpson's rule."""
    found = protocol.with_p(protocol.newey_west(protocol.slopes(scored_panel(spark, d)), "slope"))
    return rounded(found.select("n", "nw_t", "nw_p"), "nw_t", "nw_p")


@query(f"{PANEL}, {IC}, t AS (SELECT *, ntile(3) OVER (ORDER BY signal_date) AS part FROM ic) SELECT CAST(part AS INTEGER) AS part, min(signal_date) AS start_date, max(signal_date) AS end_date, count(*) AS n, round(avg(ic), 6) AS mean, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS ratio, round(avg((ic > 0)::INT), 6) AS hit_rate FROM t GROUP BY part")
def subperiods(spark, d):
    return rounded(protocol.subperiods(protocol.information_coefficient(scored_panel(spark, d)), "ic"), "mean", "ratio", "hit_rate")


@query(f"{PANEL}, {QUANTILES} SELECT round(avg(n), 6) AS avg_n, min(n) AS min_n, round(quantile_cont(n, 0.1), 6) AS p10_n, round(quantile_cont(n, 0.5), 6) AS median_n, round(quantile_cont(n, 0.9), 6) AS p90_n, max(n) AS max_n, count(DISTINCT signal_date) AS n_dates, min(n) <= 3 AS thin FROM q")
def quantile_breadth(spark, d):
    return rounded(protocol.breadth(protocol.quantile_returns(scored_panel(spark, d))), "avg_n", "p10_n", "median_n", "p90_n")


@query(f"{PANEL}, {QUANTILES}, {SPREAD}, {IC} SELECT round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg((ic > 0)::INT), 6) AS ic_hit, count(*) AS n_ic, round((SELECT avg(spread) FROM s), 6) AS ls_mean, round((SELECT avg(spread) / nullif(stddev_samp(spread), 0) FROM s), 6) AS ls_ratio, round((SELECT avg((spread > 0)::INT) FROM s), 6) AS ls_hit, (SELECT count(*) FROM s) AS n_ls FROM ic")
def protocol_summary(spark, d):
    p = scored_panel(spark, d)
    out = protocol.summary(protocol.information_coefficient(p), protocol.long_short(protocol.quantile_returns(p)))
    return rounded(out, "ic_mean", "ic_std", "ic_hit", "ls_mean", "ls_ratio", "ls_hit")


@query(f"{PANEL}, sz AS (SELECT ticker, trade_date, CASE WHEN volume > 0 THEN ln(volume) END AS size FROM prices), j AS (SELECT signal_date, label AS y, prediction AS x, size AS c FROM panel JOIN sz USING (ticker) WHERE trade_date = signal_date), k AS (SELECT signal_date, count(*) AS n, covar_pop(x, y) AS xy, covar_pop(c, y) AS cy, covar_pop(x, c) AS xc, var_pop(x) AS xx, var_pop(c) AS cc FROM j GROUP BY 1 HAVING count(*) >= 10) SELECT signal_date, round((xy * cc - cy * xc) / (xx * cc - xc * xc), 4) AS slope, n FROM k WHERE xx * cc - xc * xc > 1e-12")
def controlled_slopes(spark, d):
    size = m.monthly(spark, d).select("ticker", F.col("trade_date").alias("signal_date"), F.log("volume").alias("size"))
    out = protocol.controlled_slopes(scored_panel(spark, d).join(size, ["ticker", "signal_date"]), ["size"])
    return out.withColumn("slope", round_to(F.col("slope"), 4))


# Ingest: payloads that Spark derives from the facts, one nested text for each company


def payloads(spark, d, twice: bool = False, texts: int = 8) -> DataFrame:
    """Company-facts texts: namespace, tag, unit, list; twice: behind each fact another of its key, with a greater value.

    A company's filings are dealt to so many texts, so that a large company is no single value. Lines of odd suppliers' last frames have other units, forms or no filing day."""
    f = m.facts(spark, d)
    k = F.col("frame").cast("int")
    start = F.when(F.col("form") == "10-K", F.col("period_start").cast("string"))
    fact = F.struct(
        start.alias("start"), F.col("period_end").cast("string").alias("end"), F.col("value").alias("val"), F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"),
        F.when(k == 5, "8-K").otherwise(F.col("form")).alias("form"), F.when(k != 6, F.col("filed").cast("string")).alias("filed"), F.col("accession").alias("accn"), F.col("frame").alias("frame"),
    )
    more = F.struct(*(fact[n].alias(n) if n != "val" else (fact[n] + 1e9).alias(n) for n in ("start", "end", "val", "fy", "fp", "form", "filed", "accn", "frame")))
    each = f.withColumn("unit", F.coalesce("unit", F.lit("EUR"))).withColumns({"part": F.pmod(F.xxhash64("accession"), F.lit(texts)), "fact": F.explode(F.array(fact, more) if twice else F.array(fact))})
    lists = each.groupBy("cik", "part", "tag", "unit").agg(F.sort_array(F.collect_list("fact")).alias("facts"))
    units = lists.groupBy("cik", "part", "tag").agg(F.map_from_entries(F.collect_list(F.struct("unit", "facts"))).alias("units"))
    tags = units.groupBy("cik", "part").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("units")))).alias("tags"))
    return tags.select(F.to_json(F.struct("cik", F.create_map(F.lit("us-gaap"), F.col("tags")).alias("facts"))).alias("value"))


CLASSED = f"""{with_sql('facts')}, c AS (SELECT *, CASE WHEN unit IS NULL THEN 'unit' WHEN frame = '5' THEN 'form' WHEN frame = '6' THEN 'no_filing_day' END AS drop FROM facts)"""


def classed_facts(spark, d) -> DataFrame:
    return ingest.classified(ingest.flattened(payloads(spark, d)), ("A", "N", "R"), ("R",))


@query(f"{CLASSED} SELECT coalesce(drop, 'accepted') AS reason, count(*) AS n_rows FROM c GROUP BY 1")
def ingest_drop_counts(spark, d):
    return ingest.drop_counts(classed_facts(spark, d))


@query(
    f"""{CLASSED}, k AS (SELECT cik, tag, CASE WHEN form = '10-K' THEN period_start ELSE period_end END AS period_start, period_end, filed, form, accession, frame, value, unit,
  CASE WHEN form = '10-K' THEN 'duration' WHEN tag = 'R' THEN 'unknown' ELSE 'instant' END AS fact_type, fiscal_year, fiscal_period FROM c WHERE drop IS NULL)
SELECT cik, tag, period_start, period_end, filed, form, accession, frame, fact_type, fiscal_year, fiscal_period, min(value) AS value, any_value(unit) AS unit FROM k GROUP BY ALL"""
)
def ingest_facts(spark, d):
    """Of facts of one key the first in the text counts; texts are in order, so that it holds the least value. Every key comes twice, with a greater value behind."""
    out = ingest.facts_of(ingest.classified(ingest.flattened(payloads(spark, d, twice=True)), ("A", "N", "R"), ("R",)))
    return out.select("cik", "tag", "period_start", "period_end", "filed", "form", "accession", "frame", "fact_type", "fiscal_year", "fiscal_period", "value", "unit")


@query(f"{CLASSED} SELECT cik, min(filed) AS first_filing, max(filed) AS last_filing FROM c WHERE drop IS NULL GROUP BY 1")
def ingest_filing_history(spark, d):
    return ingest.filing_history(ingest.facts_of(classed_facts(spark, d)))


@query(f"{with_sql('facts')} SELECT tag, count(DISTINCT cik) AS n_with, (SELECT count(*) FROM supplier) AS n_companies, round(count(DISTINCT cik) / (SELECT count(*) FROM supplier), 6) AS share FROM facts GROUP BY 1")
def ingest_coverage(spark, d):
    return rounded(ingest.fact_coverage(m.facts(spark, d), m.securities(spark, d)), "share")


@query("SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, upper(s_name) AS ticker, s_name AS name FROM supplier")
def ingest_ticker_map(spark, d):
    s = m.table(spark, d, "supplier").withColumn("part", F.col("s_suppkey") % 50)
    row = F.struct(F.col("s_suppkey").cast("string").alias("cik_str"), F.col("s_name").alias("ticker"), F.col("s_name").alias("title"))
    texts = s.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), row)))).alias("value"))
    return ingest.ticker_map(texts)


@query(f"{with_sql('bars')} SELECT ticker, trade_date, round(close, 8) AS close, volume FROM prices")
def ingest_price_text(spark, d):
    bars = m.monthly(spark, d)
    line = F.concat_ws(",", F.col("trade_date").cast("string"), F.lit(""), F.lit(""), F.lit(""), F.col("close").cast("string"), F.col("volume").cast("long").cast("string"))
    texts = bars.groupBy("ticker").agg(F.concat(F.lit("Date,Open,High,Low,Close,Volume\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("value"))
    notice = texts.select(F.concat(F.lit("X"), "ticker").alias("ticker"), F.lit("No data").alias("value"))
    return ingest.price_text(texts.union(notice)).select("ticker", "trade_date", round_to(F.col("close"), 8).alias("close"), "volume")


@query(f"{with_sql('bars')}, s AS (SELECT DISTINCT ticker, CASE WHEN CAST(right(ticker, 1) AS INTEGER) % 2 = 0 THEN 'first' ELSE 'second' END AS source FROM prices) SELECT source, count(DISTINCT ticker) AS n_tickers, count(*) AS n_rows FROM prices JOIN s USING (ticker) GROUP BY 1")
def ingest_first_source(spark, d):
    bars = m.monthly(spark, d)
    even = bars.filter(F.substring("ticker", -1, 1).cast("int") % 2 == 0)
    out = ingest.first_source([("first", even), ("second", bars)], ("first", "second"))
    return out.groupBy("source").agg(F.count_distinct("ticker").alias("n_tickers"), F.count("*").alias("n_rows"))
