"""Stored tables: schemas, loads and rules that rows must satisfy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import padded_cik

_KINDS = {"string": T.StringType(), "date": T.DateType(), "double": T.DoubleType(), "int": T.IntegerType()}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


SECURITIES = _schema("cik string, ticker string, name string, sic string, first_filing date, last_filing date, accounting_standard string")
PRICES = _schema("ticker string, trade_date date, open double, high double, low double, close double, close_adj double, volume double, shares_out double")
FACTS = _schema(
    "cik string, tag string, period_start date, period_end date, fiscal_year int, fiscal_period string, filed date, value double, unit string, "
    "form string, accession string, source_namespace string, frame string, fact_type string, duration_days int"
)
FACTOR_VALUES = _schema("factor_id string, ticker string, signal_date date, value double, vintage string")
KEYS = {
    "securities": ["cik", "ticker"],
    "prices": ["ticker", "trade_date"],
    "facts": ["cik", "tag", "period_start", "period_end", "filed", "form", "accession", "frame"],
    "factor_values": ["factor_id", "ticker", "signal_date", "vintage"],
}
#: Rows for which a condition is false break it; null is allowed.
RULES = {
    "securities": {"last filing before first": "last_filing >= first_filing"},
    "prices": {"high below low": "high >= low"},
    "facts": {"filed before the period ended": "filed >= period_end", "period ends before it starts": "period_end >= period_start", "negative duration": "duration_days >= 0", "fact type": "fact_type IN ('instant', 'duration', 'unknown')"},
    "factor_values": {"vintage": "vintage IN ('pit', 'restated')"},
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order: missing ones are null, others are dropped, values are cast or null."""
    have = set(df.columns)
    return df.select(*((F.try_to_date(F.col(f.name).cast("string")) if isinstance(f.dataType, T.DateType) and df.schema[f.name].dataType == T.StringType() else F.col(f.name).try_cast(f.dataType)).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def load_securities(df: DataFrame) -> DataFrame:
    out = conform(df, SECURITIES)
    return out.withColumns({"cik": padded_cik(F.col("cik")), "accounting_standard": F.coalesce("accounting_standard", F.lit("unknown"))})


def load_prices(df: DataFrame) -> DataFrame:
    return conform(df, PRICES)


def load_facts(df: DataFrame) -> DataFrame:
    """Facts with defaults: an instant starts where it ends, namespace us-gaap, empty form, accession and frame, type unknown."""
    out = conform(df, FACTS)
    return out.withColumns(
        {
            "cik": padded_cik(F.col("cik")),
            "period_start": F.coalesce("period_start", "period_end"),
            "source_namespace": F.coalesce("source_namespace", F.lit("us-gaap")),
            "form": F.coalesce("form", F.lit("")),
            "accession": F.coalesce("accession", F.lit("")),
            "frame": F.coalesce("frame", F.lit("")),
            "fact_type": F.coalesce("fact_type", F.lit("unknown")),
        }
    )


def migrated(legacy: DataFrame) -> DataFrame:
    """Facts of a table without period starts: the start is the end and the type unknown."""
    return load_facts(legacy.drop("period_start", "fact_type").withColumn("period_start", F.col("period_end")))


def violations(df: DataFrame, name: str) -> DataFrame:
    """rule and rows: how many rows break each rule of a table; repeated or null keys are the rule `key`."""
    keys = KEYS[name]
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    broken = df.select(F.explode(F.array(*(F.when(~F.expr(c), F.lit(rule)) for rule, c in RULES[name].items()))).alias("rule")).filter("rule IS NOT NULL")
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | null).select(F.lit("key").alias("rule"), "n")
    return broken.select("rule", F.lit(1).cast("long").alias("n")).unionByName(repeated).groupBy("rule").agg(F.sum("n").alias("n_rows"))


def price_scan(prices: DataFrame, start=None, end=None, tickers: list[str] | None = None) -> DataFrame:
    """Prices of a date range and some tickers; both conditions reach the files."""
    if start is not None:
        prices = prices.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        prices = prices.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    return prices.filter(F.col("ticker").isin(tickers)) if tickers is not None else prices


def _factor_table(spark: SparkSession, path: str, factor_id: str, vintage: str):
    from tidemark.sources.keyed import KeyedTable

    return KeyedTable(spark, f"{path}/{factor_id}/{vintage}", T.StructType([f for f in FACTOR_VALUES.fields if f.name in ("ticker", "signal_date", "value")]), ["ticker", "signal_date"])


def write_factor_values(values: DataFrame, path: str, factor_id: str, vintage: str = "pit", batch: str = "all") -> bool:
    """Stores a batch of values of a factor and vintage; a batch that is stored already changes nothing, a stored key raises."""
    return _factor_table(values.sparkSession, path, factor_id, vintage).append(values, batch)


def factor_values(spark: SparkSession, path: str, factor_id: str, vintage: str = "pit") -> DataFrame:
    """ticker, signal_date, value of a factor and vintage; those of others are not read."""
    return _factor_table(spark, path, factor_id, vintage).read().orderBy("signal_date", "ticker")


def coverage(df: DataFrame) -> DataFrame:
    """column, n_rows, n_known and share of every column, in one pass, the least known first."""
    counts = df.agg(F.count("*").alias("n_rows"), *(F.count(F.col(c)).alias(f"c_{c}") for c in df.columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c_{c}").alias("n_known")) for c in df.columns)))
    out = counts.select("n_rows", pairs.alias("p")).select("p.column", "n_rows", "p.n_known", F.try_divide(F.col("p.n_known"), F.col("n_rows")).alias("share"))
    return out.orderBy(F.asc_nulls_last("share"), "column")


@dataclass(frozen=True)
class Tables:
    """The three stored tables."""

    securities: DataFrame
    prices: DataFrame
    facts: DataFrame


def roster(securities: DataFrame, most: int, standard: str = "us-gaap") -> DataFrame:
    """The first so many securities of a standard by ticker and cik: a feature of small runs."""
    return securities.filter(F.col("accounting_standard") == standard).orderBy("ticker", "cik").limit(most)


def subset(t: Tables, chosen: DataFrame) -> Tables:
    """The tables of chosen securities."""
    return Tables(chosen, t.prices.join(chosen.select("ticker"), "ticker", "left_semi"), t.facts.join(chosen.select("cik"), "cik", "left_semi"))


def pivoted(panel: DataFrame, tags: list[str]) -> DataFrame:
    """ticker, signal_date and a column for each tag: the value of its newest period end."""
    return panel.groupBy("ticker", "signal_date").pivot("tag", tags).agg(F.max_by("value", F.struct("period_end", "filed", "value")))


#: Table functions of a day over the views facts and securities.
MACROS = {
    "facts_asof": """TABLE(cik STRING, tag STRING, period_start DATE, period_end DATE, filed DATE, value DOUBLE)
        RETURN SELECT cik, tag, period_start, period_end, r.filed, r.value FROM (
          SELECT cik, tag, period_start, period_end, max_by(struct(filed, value), struct(filed, accession, form, frame, value)) AS r
          FROM facts WHERE filed <= day AND period_end <= day GROUP BY cik, tag, period_start, period_end)""",
    "latest_asof": """TABLE(cik STRING, tag STRING, period_start DATE, period_end DATE, filed DATE, value DOUBLE)
        RETURN SELECT cik, tag, r.period_start, r.period_end, r.filed, r.value FROM (
          SELECT cik, tag, max_by(struct(period_start, period_end, filed, value), struct(period_end, filed, period_start, accession, form, frame, value)) AS r
          FROM facts WHERE filed <= day AND period_end <= day GROUP BY cik, tag)""",
    "universe_asof": """TABLE(cik STRING, ticker STRING, name STRING, sic STRING)
        RETURN SELECT cik, ticker, name, sic FROM securities WHERE (first_filing IS NULL OR first_filing <= day) AND (last_filing IS NULL OR last_filing >= day)""",
}


def register_macros(t: Tables) -> None:
    """Temporary SQL table functions facts_asof(day), latest_asof(day) and universe_asof(day), over views of these tables."""
    spark = t.facts.sparkSession
    t.facts.createOrReplaceTempView("facts")
    t.securities.createOrReplaceTempView("securities")
    for name, body in MACROS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(day DATE) RETURNS {body}")
