"""The stored tables as they follow from the driver's tables, in Spark and in SQL.

A fact is a line item of a supplier: tag is its return flag, the period is the quarter of the order (from the start of
the year for open lines, so reports accumulate), it is filed when shipped, and lines shipped before the period ended
are left out. Prices are money per unit by supplier and shipping day; bars are the same by month end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import signal_grid
from tidemark.sources.tables import Tables

START_MONTHS = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cik(c):
    return F.lpad(c.cast("string"), 10, "0")


def facts(spark: SparkSession, sf_dir: str, early: bool = False) -> DataFrame:
    """early: with the lines that were shipped before their quarter ended."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("day"))
    rows = lines.join(orders, "l_orderkey")
    quarter = F.trunc("day", "quarter")
    open_ = F.col("l_linestatus") == "O"
    start = F.when(open_, F.trunc("day", "year")).otherwise(quarter)
    end = F.last_day(F.add_months(quarter, 2))
    out = rows.select(
        cik(F.col("l_suppkey")).alias("cik"),
        F.col("l_returnflag").alias("tag"),
        start.alias("period_start"),
        end.alias("period_end"),
        F.year("day").alias("fiscal_year"),
        F.when(open_ & (F.quarter("day") == 4), F.lit("FY")).otherwise(F.concat(F.lit("Q"), F.quarter("day").cast("string"))).alias("fiscal_period"),
        F.col("l_shipdate").cast("date").alias("filed"),
        F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_linenumber") < 7, "USD").alias("unit"),
        F.when(open_, "10-K").otherwise("10-Q").alias("form"),
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("accession"),
        F.lit("us-gaap").alias("source_namespace"),
        F.col("l_linenumber").cast("string").alias("frame"),
        F.when(open_ | (F.col("l_linenumber") < 6), "duration").otherwise("unknown").alias("fact_type"),
        F.datediff(end, start).alias("duration_days"),
    )
    return out if early else out.filter("filed >= period_end")


def _bars(spark: SparkSession, sf_dir: str, day) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    g = lines.groupBy(cik(F.col("l_suppkey")).alias("key"), day.alias("trade_date"), (1e6 * (1 + F.col("l_suppkey") % 4 * 0.5)).alias("shares_out"))
    out = g.agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("units"))
    close = F.try_divide(F.col("cents") / 100.0, F.col("units"))
    return out.select(F.concat(F.lit("T"), "key").alias("ticker"), "trade_date", close.alias("close"), close.alias("close_adj"), F.col("units").cast("double").alias("volume"), "shares_out")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir, F.col("l_shipdate").cast("date"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir, F.last_day(F.col("l_shipdate").cast("date")))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = facts(spark, sf_dir).groupBy("cik").agg(F.min("filed").alias("first_filing"), F.max("filed").alias("last_filing"))
    s = table(spark, sf_dir, "supplier").select(cik(F.col("s_suppkey")).alias("cik"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("sic"))
    return s.join(filed, "cik", "left").select("cik", F.concat(F.lit("T"), "cik").alias("ticker"), "name", "sic", "first_filing", "last_filing", F.lit("us-gaap").alias("accounting_standard"))


def tables(spark: SparkSession, sf_dir: str, by_month: bool = False) -> Tables:
    return Tables(securities(spark, sf_dir), (monthly if by_month else prices)(spark, sf_dir), facts(spark, sf_dir))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    return signal_grid(days, "day", START_MONTHS)


ORDER = "filed DESC, accession DESC, form DESC, frame DESC, value DESC"
SQL = {
    "facts": """facts AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS cik, l_returnflag AS tag,
         CAST(CASE WHEN l_linestatus = 'O' THEN date_trunc('year', o_orderdate) ELSE date_trunc('quarter', o_orderdate) END AS DATE) AS period_start,
         CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
         CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
         CASE WHEN l_linestatus = 'O' AND quarter(o_orderdate) = 4 THEN 'FY' ELSE 'Q' || quarter(o_orderdate) END AS fiscal_period,
         CAST(l_shipdate AS DATE) AS filed, l_extendedprice AS value, CASE WHEN l_linenumber < 7 THEN 'USD' END AS unit,
         CASE WHEN l_linestatus = 'O' THEN '10-K' ELSE '10-Q' END AS form, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS accession,
         CAST(l_linenumber AS VARCHAR) AS frame, CASE WHEN l_linestatus = 'O' OR l_linenumber < 6 THEN 'duration' ELSE 'unknown' END AS fact_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE CAST(l_shipdate AS DATE) >= CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE))""",
    "prices": """prices AS (
  SELECT 'T' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS ticker, CAST(l_shipdate AS DATE) AS trade_date,
         (sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE) / sum(CAST(l_quantity AS BIGINT)) AS close, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume,
         1e6 * (1 + l_suppkey % 4 * 0.5::DOUBLE) AS shares_out
  FROM lineitem GROUP BY ALL)""",
    "bars": """prices AS (
  SELECT 'T' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS ticker, last_day(CAST(l_shipdate AS DATE)) AS trade_date,
         (sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE) / sum(CAST(l_quantity AS BIGINT)) AS close, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume,
         1e6 * (1 + l_suppkey % 4 * 0.5::DOUBLE) AS shares_out
  FROM lineitem GROUP BY ALL)""",
    "securities": """securities AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, 'T' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS ticker, s_name AS name, CAST(s_nationkey AS VARCHAR) AS sic, first_filing, last_filing
  FROM supplier LEFT JOIN (SELECT cik AS c, min(filed) AS first_filing, max(filed) AS last_filing FROM facts GROUP BY cik) ON c = lpad(CAST(s_suppkey AS VARCHAR), 10, '0'))""",
    "dates": """dates AS (
  SELECT signal_date FROM (SELECT DISTINCT last_day(CAST(l_shipdate AS DATE) - CAST(0 AS INTEGER)) AS signal_date FROM lineitem)
  WHERE signal_date >= (SELECT CAST(min(CAST(l_shipdate AS DATE)) + INTERVAL 15 MONTH AS DATE) FROM lineitem) AND signal_date <= (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem))""",
}
SQL["all_facts"] = SQL["facts"][: SQL["facts"].rindex("WHERE")].rstrip() + ")"


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
