"""Registered queries of loads, ingest rates, share counts, rules, vintages and the whole protocol, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import round_to
from tidemark.operators import asof, audit, factors, panel, protocol, shares, vintage
from tidemark.plans import catalog as c
from tidemark.plans import mapping as m
from tidemark.plans.catalog import query, rounded
from tidemark.plans.mapping import with_sql
from tidemark.sources import ingest, tables
from tidemark.sources.kept import kept, scratch

# Loads


@query("SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, 'T' || s_suppkey AS ticker, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN DATE '1995-01-01' END AS first_filing, CASE WHEN s_suppkey % 3 = 0 THEN 'ifrs' ELSE 'unknown' END AS accounting_standard FROM supplier")
def load_securities(spark, d):
    """Short ids, dates as texts of which odd ones are no dates, and a standard that is mostly absent."""
    s, key = m.table(spark, d, "supplier"), F.col("s_suppkey")
    raw = s.select(key.cast("string").alias("cik"), F.concat(F.lit("T"), key).alias("ticker"), F.col("s_name").alias("name"), F.when(key % 2 == 0, "1995-01-01").otherwise("soon").alias("first_filing"), F.when(key % 3 == 0, "ifrs").alias("accounting_standard"), F.lit(1).alias("other"))
    return tables.load_securities(raw).select("cik", "ticker", "name", "first_filing", "accounting_standard")


@query("SELECT 'T' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS trade_date, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS close, NULL::DOUBLE AS volume FROM lineitem")
def load_prices(spark, d):
    """Prices as texts, of which some are no numbers; a column that is absent is null."""
    li = m.table(spark, d, "lineitem")
    raw = li.select(F.concat(F.lit("T"), "l_suppkey").alias("ticker"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("trade_date"), F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("close"))
    return tables.load_prices(raw).select("ticker", "trade_date", "close", "volume")


SPARSE = "CASE WHEN frame = '2' THEN NULL ELSE {} END"


@query(f"{with_sql('facts')} SELECT cik, tag, coalesce({SPARSE.format('period_start')}, period_end) AS period_start, period_end, filed, value, coalesce({SPARSE.format('form')}, '') AS form, coalesce({SPARSE.format('frame')}, '') AS frame, coalesce({SPARSE.format('fact_type')}, 'unknown') AS fact_type, 'us-gaap' AS source_namespace FROM facts")
def load_facts(spark, d):
    """Facts with gaps: every default of the load."""
    f = m.facts(spark, d)
    gap = F.col("frame") == "2"
    raw = f.withColumns({x: F.when(~gap, F.col(x)) for x in ("period_start", "form", "fact_type")}).withColumn("frame", F.when(~gap, F.col("frame"))).drop("source_namespace")
    return tables.load_facts(raw).select("cik", "tag", "period_start", "period_end", "filed", "value", "form", "frame", "fact_type", "source_namespace")


@query(f"{with_sql('facts')} SELECT cik, tag, period_end AS period_start, period_end, filed, value, 'unknown' AS fact_type FROM facts")
def migrate_facts(spark, d):
    """A table from before period starts were stored."""
    return tables.migrated(m.facts(spark, d)).select("cik", "tag", "period_start", "period_end", "filed", "value", "fact_type")


@query(f"{with_sql('prices', 'dates')}, {c.CAP} SELECT ticker, signal_date, round(-ln(cap), 6) AS value FROM cap WHERE cap > 0")
def stored_factor_values(spark, d):
    """A signal written to a table by factor and vintage, beside another vintage, and read back."""
    path = scratch(spark, "factor-values")
    values = rounded(factors.log_mktcap(m.tables(spark, d), m.dates(spark, d)), "value")
    tables.write_factor_values(values, path, "log_mktcap")
    tables.write_factor_values(values.withColumn("value", F.lit(0.0)), path, "log_mktcap", "restated")
    return tables.factor_values(spark, path, "log_mktcap")


@query(f"{with_sql('facts', 'securities')}, r AS (SELECT cik, ticker FROM securities ORDER BY ticker, cik LIMIT 20) SELECT f.cik, ticker, count(*) AS n_facts FROM facts f JOIN r USING (cik) GROUP BY ALL")
def roster_facts(spark, d):
    """Facts of the first 20 securities of a standard: the limit is the feature."""
    t = m.tables(spark, d)
    chosen = tables.roster(t.securities, 20)
    return tables.subset(t, chosen).facts.join(chosen.select("cik", "ticker"), "cik").groupBy("cik", "ticker").agg(F.count("*").alias("n_facts"))


@query(f"{with_sql('facts', 'dates')}, {c.LATEST} SELECT 'T' || cik AS ticker, signal_date, max(value) FILTER (tag = 'A') AS A, max(value) FILTER (tag = 'N') AS N, max(value) FILTER (tag = 'R') AS R FROM known GROUP BY ALL")
def pivoted_tags(spark, d):
    rows = factors.named(asof.latest_known(m.facts(spark, d), m.dates(spark, d)), m.securities(spark, d))
    return tables.pivoted(rows, ["A", "N", "R"])


@query(f"{with_sql('facts')} SELECT cik, tag, period_end, filed, value FROM facts WHERE filed <= DATE '1996-06-30' AND period_end <= DATE '1996-06-30' QUALIFY row_number() OVER (PARTITION BY cik, tag ORDER BY period_end DESC, filed DESC, period_start DESC, accession DESC, form DESC, frame DESC, value DESC) = 1")
def table_function_latest(spark, d):
    """A SQL table function of a day."""
    tables.register_macros(m.tables(spark, d))
    return spark.sql("SELECT cik, tag, period_end, filed, value FROM latest_asof(DATE '1996-06-30')")


@query(f"{with_sql('facts')} SELECT cik, tag, count(*) AS n, max(filed) AS last_filed FROM (SELECT * FROM facts WHERE filed <= DATE '1996-06-30' AND period_end <= DATE '1996-06-30' QUALIFY row_number() OVER (PARTITION BY cik, tag, period_start, period_end ORDER BY {m.ORDER}) = 1) GROUP BY ALL")
def table_function_facts(spark, d):
    tables.register_macros(m.tables(spark, d))
    return spark.sql("SELECT cik, tag, count(*) AS n, max(filed) AS last_filed FROM facts_asof(DATE '1996-06-30') GROUP BY ALL")


@query(f"{with_sql('facts', 'securities')} SELECT cik, ticker, name, sic FROM securities WHERE (first_filing IS NULL OR first_filing <= DATE '1996-06-30') AND (last_filing IS NULL OR last_filing >= DATE '1996-06-30')")
def table_function_universe(spark, d):
    tables.register_macros(m.tables(spark, d))
    return spark.sql("SELECT * FROM universe_asof(DATE '1996-06-30')")


@query(f"{with_sql('dates')}, n AS (SELECT signal_date, row_number() OVER (ORDER BY signal_date) - 1 AS i, count(*) OVER () AS n FROM dates) SELECT signal_date FROM n WHERE i % greatest(1, CAST(ceil(n / 12) AS BIGINT)) = 0")
def strided_dates(spark, d):
    return asof.strided(m.dates(spark, d), 12)


# Ingest


@query(f"{c.CLASSED} SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, CASE WHEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') IN (SELECT cik FROM facts WHERE tag = 'A') THEN 'us-gaap' ELSE 'unknown' END AS accounting_standard FROM supplier WHERE lpad(CAST(s_suppkey AS VARCHAR), 10, '0') IN (SELECT cik FROM facts)")
def ingest_accounting_standard(spark, d):
    return ingest.accounting_standard(ingest.flattened(c.payloads(spark, d)), ("A",))


BROKEN = "CAST(cik AS BIGINT) % 5 = 0"


@query(f"{c.CLASSED}, ok AS (SELECT * FROM c WHERE NOT ({BROKEN})) SELECT cik, count(*) AS n_facts FROM ok GROUP BY 1")
def ingest_broken_payloads(spark, d):
    """Every fifth company answers with a page or a torn text: the others go on."""
    torn = F.when(F.col("cik").cast("long") % 10 == 0, "<html>busy</html>").when(F.col("cik").cast("long") % 5 == 0, F.expr("left(value, length(value) DIV 2)")).otherwise(F.col("value"))
    texts = c.payloads(spark, d).withColumn("cik", F.get_json_object("value", "$.cik")).select(torn.alias("value"))
    return ingest.flattened(texts).groupBy("cik").agg(F.count("*").alias("n_facts"))


RATES = f"""{c.CLASSED}, a AS (SELECT cik, count(*) FILTER (tag <> 'N') AS k FROM c WHERE drop IS NULL GROUP BY 1), q AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier),
r AS (SELECT count(*) AS n_requested, count(*) FILTER (cik IN (SELECT cik FROM facts)) AS n_answered, count(*) FILTER (cik IN (SELECT cik FROM a)) AS n_with_rows, count(*) FILTER (cik IN (SELECT cik FROM a WHERE k > 0)) AS n_with_accounting FROM q)"""


@query(f"{RATES} SELECT *, round(n_answered / n_requested, 6) AS request_rate, round(n_with_rows / n_requested, 6) AS data_rate, round(n_with_accounting / n_requested, 6) AS accounting_rate FROM r")
def ingest_rates(spark, d):
    texts = c.payloads(spark, d).withColumn("cik", F.get_json_object("value", "$.cik"))
    facts = ingest.facts_of(c.classed_facts(spark, d))
    return rounded(ingest.rates(m.securities(spark, d), texts, facts, ("N",)), "request_rate", "data_rate", "accounting_rate")


@query(f"{with_sql('facts', 'securities')}, n AS (SELECT * FROM securities WHERE cik NOT IN (SELECT cik FROM facts WHERE tag <> 'N' AND frame = '1' AND filed < DATE '1995-06-30')) SELECT 'us-gaap' AS accounting_standard, count(*) AS n, string_agg(ticker, ',' ORDER BY ticker) AS tickers FROM n HAVING count(*) > 0")
def ingest_gap_warning(spark, d):
    t = m.tables(spark, d)
    return ingest.gap_warning(t.facts.filter("frame = '1' AND filed < DATE'1995-06-30'"), t.securities, ("N",))


GAPS = f"{with_sql('facts', 'securities')}, f AS (SELECT * FROM facts WHERE frame = '1' AND filed < DATE '1995-06-30'), n AS (SELECT ticker, CASE WHEN CAST(cik AS BIGINT) % 3 = 0 THEN 'ifrs' ELSE 'us-gaap' END AS accounting_standard, (SELECT count(*) FROM f WHERE f.cik = s.cik) AS n_rows, (SELECT count(*) FROM f WHERE f.cik = s.cik AND tag <> 'N') AS n_accounting FROM securities s)"


def _gap_inputs(spark, d):
    """First lines filed by the middle of 1995, and every third company under another standard."""
    t = m.tables(spark, d)
    standard = F.when(F.col("cik").cast("long") % 3 == 0, "ifrs").otherwise("us-gaap")
    return t.facts.filter("frame = '1' AND filed < DATE'1995-06-30'"), t.securities.withColumn("accounting_standard", standard)


@query(f"{GAPS} SELECT ticker, accounting_standard, CASE WHEN n_rows = 0 THEN 'no_rows' ELSE 'share_counts_only' END AS reason FROM n WHERE n_accounting = 0")
def ingest_gap_reasons(spark, d):
    return ingest.gap_reasons(*_gap_inputs(spark, d), ("N",))


@query(f"{GAPS} SELECT accounting_standard, count(*) AS n_securities, count(*) FILTER (n_accounting = 0) AS n_without, round(count(*) FILTER (n_accounting = 0) / count(*), 6) AS share, count(*) FILTER (n_accounting = 0) / count(*) > 0.02 AS warns FROM n GROUP BY 1")
def ingest_gap_shares(spark, d):
    return rounded(ingest.gap_shares(*_gap_inputs(spark, d), 0.02, ("N",)), "share")


#: Breaches of every rule of facts, planted by the number of the order.
PLANTED = f"{with_sql('facts')}, k AS (SELECT *, CAST(accession AS BIGINT) % 97 AS p, date_diff('day', period_start, period_end) AS days FROM facts)"


@query(
    f"""{PLANTED}, b AS (SELECT CASE WHEN p = 1 THEN NULL ELSE cik END AS cik, tag, CASE WHEN p = 2 THEN period_end + 1 ELSE period_start END AS s, period_end AS e, CASE WHEN p = 3 THEN period_end - 1 ELSE filed END AS f, CASE WHEN p = 4 THEN -1 ELSE days END AS days, CASE WHEN p = 5 THEN 'odd' ELSE fact_type END AS kind, form, accession, frame FROM k),
r AS (SELECT 'filed before the period ended' AS rule, count(*) AS n_rows FROM b WHERE f < e UNION ALL SELECT 'period ends before it starts', count(*) FROM b WHERE e < s UNION ALL SELECT 'negative duration', count(*) FROM b WHERE days < 0 UNION ALL SELECT 'fact type', count(*) FROM b WHERE kind = 'odd'
  UNION ALL SELECT 'key', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n, cik FROM b GROUP BY cik, tag, s, e, f, form, accession, frame HAVING count(*) > 1 OR cik IS NULL)) SELECT * FROM r WHERE n_rows > 0"""
)
def table_violations(spark, d):
    p = F.col("accession").cast("long") % 97
    planted = {"cik": F.when(p != 1, F.col("cik")), "period_start": F.when(p == 2, F.date_add("period_end", 1)).otherwise(F.col("period_start")), "filed": F.when(p == 3, F.date_sub("period_end", 1)).otherwise(F.col("filed")), "duration_days": F.when(p == 4, -1).otherwise(F.col("duration_days")), "fact_type": F.when(p == 5, "odd").otherwise(F.col("fact_type"))}
    return tables.violations(m.facts(spark, d).withColumns(planted), "facts")


@query(f"{with_sql('bars')}, s AS (SELECT DISTINCT ticker, CAST(right(ticker, 1) AS INTEGER) % 3 AS k FROM prices) SELECT count(*) FILTER (k = 0) AS n_prone, count(*) FILTER (k < 2) AS n_all, round(count(*) FILTER (k = 0) / count(*) FILTER (k < 2), 6) AS share FROM s")
def ingest_source_share(spark, d):
    k = F.substring("ticker", -1, 1).cast("int") % 3
    rows = m.monthly(spark, d).withColumn("source", F.when(k == 0, "first").when(k == 1, "second").otherwise("third"))
    return rounded(ingest.source_share(rows, "first", ("second",)), "share")


@query(f"{c.CLASSED}, n AS (SELECT cik, tag, coalesce(unit, 'EUR') AS unit, least(count(*), 2) AS n FROM c WHERE tag <> 'A' GROUP BY ALL) SELECT cik, tag AS raw_tag, unit, n FROM n")
def ingest_trimmed(spark, d):
    """Two adopted tags, at most two facts of each list: the cut is the feature."""
    rows = ingest.flattened(ingest.trimmed(c.payloads(spark, d, texts=1), 2, ("N", "R")))
    return rows.groupBy("cik", "raw_tag", "unit").agg(F.count("*").alias("n"))


# Share counts: the tag N stands for them

FILINGS = f"""{with_sql('facts', 'securities', 'bars', 'dates')}, n AS (SELECT *, period_end = max(period_end) OVER (PARTITION BY cik, filed) AS at_end FROM facts WHERE tag = 'N'),
torn AS (SELECT cik, filed, count(*) AS torn FROM (SELECT cik, filed FROM n GROUP BY cik, filed, tag, period_start, period_end HAVING count(DISTINCT value) > 1) GROUP BY ALL),
filing AS (SELECT n.cik, n.filed, count(*) AS counts, count(*) - count(value) AS unknown, list_sort(list_distinct(list(value))) AS candidates, list_sort(list_distinct(list(CASE WHEN at_end THEN value END))) AS newest,
  CASE WHEN min(value) > 0 THEN max(value) / min(value) END AS spread, coalesce(any_value(torn), 0) AS torn, count(DISTINCT accession) AS documents, string_agg(DISTINCT form, '+' ORDER BY form) AS forms, count(DISTINCT form) AS n_forms, count(DISTINCT period_end) AS periods
  FROM n LEFT JOIN torn ON torn.cik = n.cik AND torn.filed = n.filed GROUP BY n.cik, n.filed)"""
#: Month-end bars hold the greatest count filed last, and 0 at the end of January.
READS = f"""{FILINGS}, bar AS (SELECT ticker, cik, trade_date, close FROM prices JOIN securities USING (ticker)),
held AS (SELECT bar.*, CASE WHEN strftime(trade_date, '%m-%d') = '01-31' THEN 0 ELSE candidates[-1] END AS shares_out FROM bar ASOF LEFT JOIN (SELECT cik AS c, filed, candidates FROM filing WHERE candidates[-1] > 0) ON c = cik AND filed <= trade_date),
price AS (SELECT held.*, f.filed AS read_day, f.candidates, f.newest, f.spread, coalesce(date_diff('day', f.filed, trade_date) <= 400, false) AS reads FROM held ASOF LEFT JOIN filing f ON f.cik = held.cik AND f.filed <= trade_date)"""
KEYS = f"""{READS}, {c.MEMBERS}, signal AS (SELECT m.ticker, m.signal_date, v.* EXCLUDE (ticker), coalesce(date_diff('day', trade_date, signal_date) <= 10, false) AS valued FROM members m ASOF LEFT JOIN (SELECT * FROM price WHERE shares_out IS NOT NULL AND close IS NOT NULL) v ON v.ticker = m.ticker AND v.trade_date <= m.signal_date)"""


def _long(scope: str, rows: str, conditions: dict[str, str], different: dict[str, tuple[str, str]]) -> str:
    """A tally in SQL: conditions are counted; different: a column's values where a condition holds."""
    cells = [f"count(*) FILTER ({w}) AS \"{k}\"" for k, w in conditions.items()] + [f'count(DISTINCT {col}) FILTER ({w}) AS "{k}"' for k, (col, w) in different.items()]
    return f"SELECT '{scope}' AS scope, measure, n FROM (UNPIVOT (SELECT {', '.join(cells)} FROM {rows}) ON COLUMNS(*) INTO NAME measure VALUE n)"


def _bands(within: str) -> dict[str, str]:
    low, mid, high = shares.BANDS
    return {"spread_lower": f"{within} AND spread < {low}", f"spread_from_{low}": f"{within} AND spread >= {low} AND spread < {mid}", f"spread_from_{mid}": f"{within} AND spread >= {mid} AND spread < {high}", f"spread_from_{high}": f"{within} AND spread >= {high}", "spread_unknown": f"{within} AND spread IS NULL"}


_D, _P = "len(candidates) > 1", "reads AND len(candidates) > 1"
_H = f"{_P} AND shares_out IS NOT NULL"
FILING_TALLY = _long("filings", "filing", {"all": "true", "disagree": _D, "in_one_document": f"{_D} AND documents = 1", "across_forms": f"{_D} AND n_forms > 1", "across_periods": f"{_D} AND periods > 1", "inside_a_fact": f"{_D} AND torn > 0", "newest_settles": f"{_D} AND len(newest) = 1", "newest_differs": f"{_D} AND len(newest) > 1", "newest_unknown": f"{_D} AND len(newest) = 0"} | _bands(_D), {"companies": ("cik", _D)})
PRICE_TALLY = _long("prices", "price", {"all": "true", "of_a_company": "cik IS NOT NULL", "reading": "reads", "reading_several": _P, "with_count": "shares_out IS NOT NULL", "with_zero": "shares_out = 0", "count_beside_several": _H, "count_is_none_of_them": f"{_H} AND NOT list_contains(candidates, shares_out)", "count_is_the_newest": f"{_H} AND len(newest) = 1 AND shares_out = newest[1]", "count_is_an_older_one": f"{_H} AND len(newest) = 1 AND shares_out <> newest[1]", "newest_is_open": f"{_H} AND len(newest) <> 1"}, {"tickers": ("ticker", _P)})
SIGNAL_TALLY = _long("signals", "signal", {"all": "true", "valued": "valued", "reading_several": f"valued AND {_P}", "valued_by_zero": "valued AND shares_out = 0"} | _bands(f"valued AND {_P}"), {"tickers": ("ticker", f"valued AND {_P}"), "dates": ("signal_date", f"valued AND {_P}")})


def share_rows(spark, d):
    """Tables, filings of counts, and month-end bars with what they hold and read."""
    t = m.tables(spark, d, by_month=True)
    counts = t.facts.filter("tag = 'N'")
    blank = t.prices.withColumn("shares_out", F.lit(None).cast("double"))
    best = counts.filter("value > 0").groupBy("cik", "filed").agg(F.max("value").alias("value"))
    held = asof.attach_shares(blank, best, t.securities, 100_000)
    january = F.date_format("trade_date", "MM-dd") == "01-31"
    held = held.select("ticker", "trade_date", "close", F.when(january, 0.0).otherwise(F.col("shares_out")).alias("shares_out"))
    found = shares.filings(counts)
    return t, found, shares.read_by(held, t.securities, found)


@query(f"{FILINGS} SELECT cik, filed, counts, unknown, len(candidates) AS n_values, candidates[1] AS lowest, round(spread, 6) AS spread, torn, documents, forms, periods, len(newest) AS n_newest, newest[1] AS newest_value FROM filing")
def share_candidate_groups(spark, d):
    found = shares.filings(m.facts(spark, d).filter("tag = 'N'"))
    size = lambda c: F.size(c).cast("long")
    return rounded(found.select("cik", "filed", "counts", "unknown", size("candidates").alias("n_values"), F.get("candidates", F.lit(0)).alias("lowest"), "spread", "torn", F.col("documents").cast("long").alias("documents"), F.array_join("forms", "+").alias("forms"), "periods", size("newest").alias("n_newest"), F.get("newest", F.lit(0)).alias("newest_value")), "spread")


@query(f"{FILINGS} {FILING_TALLY}")
def share_candidate_context(spark, d):
    return shares.disagreements(shares.filings(m.facts(spark, d).filter("tag = 'N'")))


@query(f"{READS} {PRICE_TALLY}")
def share_price_exposure(spark, d):
    return shares.price_tally(share_rows(spark, d)[2])


@query(f"{KEYS} {SIGNAL_TALLY}")
def share_signal_exposure(spark, d):
    t, _, rows = share_rows(spark, d)
    return shares.signal_tally(rows, panel.membership(t.securities, m.dates(spark, d)))


def _sum(side: tuple[str, ...]) -> str:
    return "sum(n) FILTER (scope || '.' || measure IN (" + ", ".join(f"'{x}'" for x in side) + "))"


@query(f"{KEYS}, tally AS ({FILING_TALLY} UNION ALL {PRICE_TALLY} UNION ALL {SIGNAL_TALLY}) " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", CAST({_sum(a)} AS BIGINT) AS \"left\", CAST({_sum(b)} AS BIGINT) AS \"right\", {_sum(a)} {'=' if how == '=' else '<='} {_sum(b)} AS passed FROM tally" for k, (a, how, b) in shares.RULES.items()))
def share_checks(spark, d):
    t, found, rows = share_rows(spark, d)
    members = panel.membership(t.securities, m.dates(spark, d))
    return shares.balanced(shares.disagreements(found).unionByName(shares.price_tally(rows)).unionByName(shares.signal_tally(rows, members)))


@query(
    f"""{READS}, chosen AS (SELECT cik, filed, len(candidates) AS n_values FROM filing WHERE len(candidates) > 1 QUALIFY filed = max(filed) OVER (PARTITION BY cik)),
after AS (SELECT chosen.cik, ticker, chosen.filed, n_values, 'us-gaap' AS namespaces, trade_date, reads AND read_day = chosen.filed AS reads_the_group, list_contains(candidates, shares_out) AS holds FROM chosen JOIN price ON price.cik = chosen.cik AND trade_date >= chosen.filed QUALIFY trade_date = min(trade_date) OVER (PARTITION BY chosen.cik, ticker))
SELECT cik, ticker, filed, CAST(n_values AS INTEGER) AS n_values, namespaces, trade_date, reads_the_group, reads_the_group AND coalesce(holds, false) AS attributed FROM after"""
)
def share_samples(spark, d):
    t, found, rows = share_rows(spark, d)
    return shares.attributed(found, rows, t.securities)


@query(
    f"""{with_sql('facts')}, {c.RESTATED}, a AS (SELECT tag, count(*) AS n, count(DISTINCT period_start) AS starts, count(DISTINCT value) AS vals FROM restated GROUP BY tag, cik, period_end), b AS (SELECT tag, count(*) AS n, count(DISTINCT period_start) AS starts, count(DISTINCT value) AS vals FROM facts GROUP BY tag, cik, period_end, filed)
SELECT tag, 'restated' AS read, count(*) AS groups, count(*) FILTER (n > 1) AS several_rows, count(*) FILTER (starts > 1) AS several_starts, count(*) FILTER (n > 1 AND vals > 1) AS different_values FROM a GROUP BY 1
UNION ALL SELECT tag, 'pit', count(*), count(*) FILTER (n > 1), count(*) FILTER (starts > 1), count(*) FILTER (n > 1 AND vals > 1) FROM b GROUP BY 1"""
)
def interval_ties(spark, d):
    facts = m.facts(spark, d).select(*asof.CHOICE)
    return shares.interval_ties(facts, asof.restated(facts, "interval_ties"))


# Audits


@query(f"{with_sql('facts', 'securities', 'dates')}, {c.MEMBERS}, {c.TRAP.format(grace=0)} SELECT * FROM (SELECT * FROM trap ORDER BY signal_date, ticker, tag, period_end, filed LIMIT 5)")
def trap_samples(spark, d):
    """The first five early rows: the limit is the feature."""
    t, dates = m.tables(spark, d), m.dates(spark, d)
    return audit.trap_samples(audit.naive_trap(panel.membership(t.securities, dates), t.securities, t.facts))


RULES = [audit.Rule("scale", "economic", "error", 0.0, 0.00003, "bounds of these tables"), audit.Rule("sign", "domain", "error", 0.0, None, "both sides are positive"), audit.Rule("least", "construction", "warning", 0.000001, None, "close to nothing"), audit.Rule("open", "economic", "warning", None, None, "no bound is known")]
BM = f"{with_sql('facts', 'prices', 'dates')}, {c.LATEST}, {c.CAP}, v AS (SELECT ticker, known.signal_date, value / cap AS value FROM known JOIN cap ON ticker = 'T' || cik AND known.signal_date = cap.signal_date WHERE tag = 'N' AND value > 0 AND cap > 0)"


def _rules_sql() -> str:
    rows = []
    for r in RULES:
        tests = [f"value < {r.low!r}::DOUBLE"] * (r.low is not None) + [f"value > {r.high!r}::DOUBLE"] * (r.high is not None)
        head = f"SELECT '{r.rule_id}' AS rule_id, '{r.kind}' AS kind, '{r.severity}' AS severity, count(*) AS n_rows, count(*) AS n_finite"
        tolerance = 0.01 if r.kind == "economic" else 0.0
        if not tests:
            rows.append(f"{head}, 0 AS n_outside, 0.0::DOUBLE AS share_outside, {tolerance}::DOUBLE AS tolerance, 'DECLARED_UNBOUNDED' AS status, false AS blocking FROM v")
            continue
        out = f"count(*) FILTER ({' OR '.join(tests)})"
        bad = f"{out} / count(*) > {tolerance}"
        rows.append(f"{head}, {out} AS n_outside, round({out} / count(*), 6) AS share_outside, {tolerance}::DOUBLE AS tolerance, CASE WHEN {bad} THEN 'VIOLATION' ELSE 'WITHIN_TOLERANCE' END AS status, {bad} AND '{r.severity}' = 'error' AS blocking FROM v")
    return f"{BM} " + " UNION ALL ".join(rows)


@query(_rules_sql())
def plausibility_rules(spark, d):
    found = audit.evaluated(factors.bm_ratio(m.tables(spark, d), m.dates(spark, d), c.TAGS), RULES)
    return rounded(found.fillna(0, ["n_outside", "share_outside"]), "share_outside")  # of the rule without bounds


@query(f"{BM} SELECT ticker, signal_date, round(value, 9) AS value FROM (SELECT * FROM v WHERE value > 0.00003 ORDER BY abs(value - 0.000015) DESC, ticker, signal_date LIMIT 5)")
def most_implausible(spark, d):
    """The five values farthest out: the limit is the feature."""
    worst = audit.most_implausible(factors.bm_ratio(m.tables(spark, d), m.dates(spark, d), c.TAGS), 0.0, 0.00003)
    return worst.withColumn("value", round_to(F.col("value"), 9))


@query(
    f"""{with_sql('facts')}, {c.FLAGS}, n AS (SELECT count(*) FILTER (repeated) AS repeated, count(*) FILTER (repeated AND ({c.BAD})) AS bad, count(*) FILTER (repeated AND NOT ({c.BAD}) AND changed) AS changed, count(*) FILTER (repeated AND NOT ({c.BAD}) AND NOT changed) AS same FROM k),
u AS (SELECT count(*) AS n FROM k WHERE repeated AND list_bool_or([{', '.join(audit.REASONS)}])), z AS (SELECT count(*) AS n FROM facts WHERE cik IS NULL OR tag IS NULL OR period_start IS NULL OR period_end IS NULL OR filed IS NULL OR fact_type IS NULL)
SELECT 'keys are known' AS "check", z.n = 0 AS passed FROM z UNION ALL SELECT 'union matches summary', u.n = n.bad FROM u, n UNION ALL SELECT 'parts match repeated keys', n.changed + n.same + n.bad = n.repeated FROM n"""
)
def disclosure_check(spark, d):
    return audit.disclosure_check(m.facts(spark, d))


KEYS_SQL = "SELECT count(*) AS n, {a} || ':' || {b} AS h FROM (SELECT md5(ticker || '|' || CAST(signal_date AS VARCHAR)) AS h FROM {t})"


def _hash(t: str) -> str:
    return "(SELECT h FROM (" + KEYS_SQL.format(a=c.HALF.format(at=1), b=c.HALF.format(at=17), t=t) + "))"


@query(
    f"""{with_sql('facts', 'prices', 'dates')}, {c.LATEST}, {c.RESTATED}, {c.LATEST_RESTATED}, {c.CAP},
p AS (SELECT ticker, known.signal_date FROM known JOIN cap ON ticker = 'T' || cik AND known.signal_date = cap.signal_date WHERE tag = 'N' AND value > 0 AND cap > 0),
r AS (SELECT ticker, late.signal_date FROM late JOIN cap ON ticker = 'T' || cik AND late.signal_date = cap.signal_date WHERE tag = 'N' AND value > 0 AND cap > 0), s AS (SELECT * FROM p SEMI JOIN r USING (ticker, signal_date))
SELECT (SELECT count(*) FROM s) AS n_both, (SELECT count(*) FROM p) - (SELECT count(*) FROM s) AS n_pit_only, (SELECT count(*) FROM r) - (SELECT count(*) FROM s) AS n_restated_only, {_hash('p')} AS pit_hash, {_hash('r')} AS restated_hash, {_hash('s')} AS shared_hash"""
)
def sample_comparison(spark, d):
    t, dates = m.tables(spark, d), m.dates(spark, d)
    cap = factors.caps(t, dates)
    return audit.sample_comparison(factors.bm_ratio(t, dates, c.TAGS, cap=cap), factors.bm_ratio(t, dates, c.TAGS, "restated", cap=cap))


GHOST = "CAST(right(ticker, 1) AS INTEGER) = 7"
CLEAN2 = c.CLEAN.replace("FROM a", "FROM b").replace("e AS", "e2 AS").replace("c AS", "c2 AS").replace("g AS", "g2 AS").replace("z AS", "z2 AS").replace("JOIN e USING", "JOIN e2 USING").replace("FROM c JOIN", "FROM c2 JOIN").replace("FROM g WINDOW", "FROM g2 WINDOW")


@query(f"{c.MOM}, b AS (SELECT * FROM a WHERE NOT ({GHOST})), {c.CLEAN}, {CLEAN2}, j AS (SELECT abs(z.value - z2.value) AS moved FROM z JOIN z2 USING (ticker, signal_date) WHERE signal_date > DATE '1995-01-01') SELECT count(*) AS n_keys, count(*) FILTER (moved > 1e-12) AS n_moved, round(max(moved), 6) AS max_move FROM j")
def universe_gap(spark, d):
    """What names that ended in 1995, but stay in the table, do to the others."""
    rows, securities = c.momentum(spark, d), m.securities(spark, d)
    ghost = F.substring("ticker", -1, 1) == "7"
    gone = securities.filter(ghost).select("ticker", F.lit("1995-01-01").cast("date").alias("exit_date"))
    return rounded(audit.universe_gap(panel.cleaned(rows, securities), panel.cleaned(rows.filter(~ghost), securities), gone), "max_move")


# Vintages


def arms(spark, d) -> list[DataFrame]:
    """Prices of value at month ends of both arms, scored on the same bars, which are written once, as the caps are: both have the same labels."""
    t, dates = m.tables(spark, d, by_month=True), m.dates(spark, d)
    t = tables.Tables(t.securities, kept(t.prices), t.facts)
    cap = factors.caps(t, dates)
    values = (factors.bm_ratio(t, dates, c.TAGS, name, cap=cap) for name in ("pit", "restated"))
    return [panel.scored(panel.labelled(panel.cleaned(v, t.securities).select("ticker", "signal_date", "value"), t.prices)) for v in values]


def _arm_sql(known: str, suffix: str) -> str:
    """Cleaned, labelled and scored values of an arm."""
    x = suffix
    clean = c.CLEAN.replace("FROM a", f"FROM a{x}").replace("FROM c JOIN", f"FROM c{x} JOIN").replace("FROM g WINDOW", f"FROM g{x} WINDOW").replace("JOIN e USING", f"JOIN e{x} USING")
    for n in "ecgz":
        clean = clean.replace(f"{n} AS (SELECT", f"{n}{x} AS (SELECT")
    label = f"""lab{x} AS (SELECT z{x}.ticker, z{x}.signal_date, z{x}.value AS prediction, b.close / n.close - 1 AS label, f.trade_date AS formation_session, s.trade_date AS entry_date, t.trade_date AS exit_date
  FROM z{x} JOIN plan USING (signal_date) JOIN sess f ON f.i = plan.f JOIN sess s ON s.i = plan.f + 1 JOIN sess t ON t.i = plan.f + 2 JOIN prices n ON n.ticker = z{x}.ticker AND n.trade_date = s.trade_date JOIN prices b ON b.ticker = z{x}.ticker AND b.trade_date = t.trade_date)"""
    return f"a{x} AS (SELECT ticker, k.signal_date, k.value / cap AS value FROM {known} k JOIN cap ON ticker = 'T' || cik AND k.signal_date = cap.signal_date WHERE tag = 'N' AND k.value > 0 AND cap > 0), {clean}, {label}"


VINTAGES = f"""{with_sql('facts', 'bars', 'dates')}, {c.LATEST}, {c.RESTATED}, {c.LATEST_RESTATED}, {c.CAP},
sess AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM prices)), plan AS (SELECT signal_date, max(i) AS f FROM dates LEFT JOIN sess ON trade_date <= signal_date GROUP BY 1), {_arm_sql('known', '1')}, {_arm_sql('late', '2')}"""


@query(f"{VINTAGES} SELECT count(*) AS n_common, count(*) FILTER (p.label = r.label AND p.formation_session = r.formation_session AND p.entry_date = r.entry_date AND p.exit_date = r.exit_date) AS n_identical, count(*) FILTER (NOT (p.formation_session <= p.entry_date AND p.entry_date < p.exit_date)) AS n_wrong_order FROM lab1 p JOIN lab2 r USING (ticker, signal_date)")
def outcome_identity(spark, d):
    return vintage.outcome_identity(*arms(spark, d))


def _mean_ic(t: str) -> str:
    ranked = f"(SELECT signal_date, rank() OVER (PARTITION BY signal_date ORDER BY prediction) + (count(*) OVER (PARTITION BY signal_date, prediction) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY signal_date ORDER BY label) + (count(*) OVER (PARTITION BY signal_date, label) - 1) / 2.0::DOUBLE AS b FROM {t})"
    return f"(SELECT avg(ic) FROM (SELECT corr(a, b) AS ic FROM {ranked} GROUP BY signal_date HAVING count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0))"


def _support_sql(suffix: str, one: str, other: str) -> str:
    """An arm cut to the keys of both before it is cleaned."""
    body = _arm_sql("known", suffix)
    return f"a{suffix} AS (SELECT * FROM a{one} SEMI JOIN a{other} USING (ticker, signal_date))" + body[body.index(f", e{suffix} AS (") :]


@query(
    f"""{VINTAGES}, s1 AS (SELECT * FROM lab1 SEMI JOIN lab2 USING (ticker, signal_date)), s2 AS (SELECT * FROM lab2 SEMI JOIN lab1 USING (ticker, signal_date)), {_support_sql('3', '1', '2')}, {_support_sql('4', '2', '1')},
l AS (SELECT 'original_process' AS layer, {_mean_ic('lab1')} AS p, {_mean_ic('lab2')} AS r UNION ALL SELECT 'common_observation', {_mean_ic('s1')}, {_mean_ic('s2')} UNION ALL SELECT 'common_support', {_mean_ic('lab3')}, {_mean_ic('lab4')})
SELECT layer, round(p, 6) AS pit_ic, round(r, 6) AS restated_ic, CASE WHEN abs(r - p) > 0.005 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM l"""
)
def vintage_layers(spark, d):
    """Both arms rescored as they are, on the keys that they share, and cleaned anew on these, with the verdict on each gap."""
    t = m.tables(spark, d, by_month=True)
    t, dates = tables.Tables(t.securities, kept(t.prices), t.facts), m.dates(spark, d)
    found = vintage.layers(t, dates, "bm_ratio", t.prices, tags=c.TAGS, cap=factors.caps(t, dates))
    rows = [(x.name, x.pit_ic, x.restated_ic, audit.verdict(True, x.n_dates, False, x.gap)) for x in found]
    return rounded(spark.createDataFrame(rows, "layer string, pit_ic double, restated_ic double, verdict string"), "pit_ic", "restated_ic")


# The protocol

WEIGHTED = c.QUANTILES.replace("avg(label) AS mean_label", "CASE WHEN bool_and(weight IS NOT NULL) AND sum(weight) > 0 THEN sum(label * weight) / sum(weight) END AS mean_label").replace("FROM panel p JOIN", "FROM pw p JOIN")


@query(f"{c.PANEL}, pw AS (SELECT panel.*, CASE WHEN s_suppkey % 40 <> 0 THEN 1.0::DOUBLE + s_suppkey % 7 END AS weight FROM panel JOIN supplier ON ticker = 'T' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0')), {WEIGHTED} SELECT signal_date, bin, round(mean_label, 6) AS mean_label, n FROM q")
def weighted_quantiles(spark, d):
    """Weights by ticker; a bin with a name that has none has no mean."""
    s = m.table(spark, d, "supplier")
    weights = s.select(F.concat(F.lit("T"), m.cik(F.col("s_suppkey"))).alias("ticker"), F.when(F.col("s_suppkey") % 40 != 0, 1.0 + F.col("s_suppkey") % 7).alias("weight"))
    return rounded(protocol.run_protocol(c.scored_panel(spark, d), weights=weights)["quantiles"], "mean_label")


@query(
    f"""{c.PANEL}, {c.QUANTILES}, {c.SPREAD}, {c.IC} SELECT round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg((ic > 0)::INT), 6) AS ic_hit, count(*) AS n_ic, round((SELECT avg(spread) FROM s), 6) AS ls_mean, (SELECT count(*) FROM s) AS n_ls,
(SELECT min(n) FROM q) AS min_n, (SELECT max(n) FROM q) AS max_n, (SELECT count(DISTINCT signal_date) FROM q) AS n_quantile_dates, (SELECT count(DISTINCT signal_date) FROM panel) AS n_dates, (SELECT count(*) FROM panel) AS n_observations, (SELECT count(DISTINCT signal_date) FROM panel) - (SELECT count(DISTINCT signal_date) FROM q) AS n_dates_dropped FROM ic"""
)
def run_protocol(spark, d):
    out = protocol.run_protocol(c.scored_panel(spark, d))["summary"]
    return rounded(out, "ic_mean", "ic_std", "ic_hit", "ls_mean").select("ic_mean", "ic_std", "ic_hit", "n_ic", "ls_mean", "n_ls", "min_n", "max_n", "n_quantile_dates", "n_dates", "n_observations", "n_dates_dropped")


@query(f"{c.PANEL} SELECT signal_date, outcome, count(*) AS n_rows FROM lab WHERE outcome <> 'matched' GROUP BY ALL")
def dropped_by_date(spark, d):
    """Rows without a label by date and reason."""
    rows = panel.labelled(c.clean_momentum(spark, d).select("ticker", "signal_date", "value"), m.monthly(spark, d))
    return panel.dropped_by_date(rows)


CALENDAR = f"{with_sql('bars', 'dates')}, p AS (SELECT ticker, trade_date, close, lag(trade_date) OVER w AS before FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date))"


@query(f"{CALENDAR} SELECT year(trade_date) AS year, count(*) AS n_bars, count(*) FILTER (close IS NULL OR close <= 0) AS n_not_positive, count(before) AS n_steps, count(*) FILTER (before = last_day(CAST(trade_date - INTERVAL 1 MONTH AS DATE))) AS n_of_one_month FROM p GROUP BY 1")
def calendar_windows(spark, d):
    """By year: month-end anchors, those that are not positive, steps to the anchor before, and those that span one month."""
    bars = m.monthly(spark, d)
    before = F.lag("trade_date").over(Window.partitionBy("ticker").orderBy("trade_date"))
    return audit.calendar_windows(bars.withColumn("before", before))
