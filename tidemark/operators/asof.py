"""As-of reads: what was known on a day.

All as-of joins are one union, one shuffle on the key and one running window. Rows of the build side sort before
probes of the same day, so a row counts on its own day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of facts that agree in period end and filing day: one total order wherever a latest row is taken.
TIES = ("period_start", "accession", "form", "frame", "value")
INTERVAL = ("cik", "tag", "period_start", "period_end")
#: What the choice of a latest fact reads: a read of these columns alone carries no others along.
CHOICE = (*INTERVAL, "filed", *TIES[1:])
#: Into so many parts rows without a key are dealt.
KEYLESS = 1 << 20


def join_asof(probes: DataFrame, build: DataFrame, keys: list[str], probe_on: str, build_on: str, columns: list[str], prefer: list[str] | None = None) -> DataFrame:
    """probes with the columns of the newest row of build at or before each probe's day, null without one.

    Of build rows of one day the greatest by `prefer` (default: columns, in order) counts. Every probe row stays; one with a
    null key finds nothing. Such probes are dealt by a hash of the whole row, so that they don't meet in one task.
    """
    order = prefer or columns
    value = F.struct(*(F.col(c).alias(f"o_{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"v_{i}") for i, c in enumerate(columns)))
    kept, keyed = probes.columns, reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    spread = F.when(keyed, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("*"), F.lit(KEYLESS))).cast("long").alias("spread_")
    rows = build.filter(F.col(build_on).isNotNull() & keyed).select(*keys, F.lit(0).cast("long").alias("spread_"), F.col(build_on).alias("at_"), F.lit(0).alias("side_"), value.alias("found_"), F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("probe_"))
    asks = probes.select(*keys, spread, F.col(probe_on).alias("at_"), F.lit(1).alias("side_"), F.lit(None).cast(rows.schema["found_"].dataType).alias("found_"), F.struct("*").alias("probe_"))
    order_by = Window.partitionBy(*keys, "spread_").orderBy("at_", "side_", "found_").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.unionByName(asks).withColumn("last_", F.last("found_", ignorenulls=True).over(order_by)).filter("side_ = 1")
    return seen.select(*(F.col(f"probe_.{c}").alias(c) for c in kept), *(F.col(f"last_.v_{i}").alias(c) for i, c in enumerate(columns)))


def latest(facts: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The whole row that is greatest by order, for each key, as one aggregate without a sort of whole rows."""
    rest = [c for c in facts.columns if c not in keys]
    row = F.max(F.struct(*order)) if set(rest) == set(order) else F.max_by(F.struct(*rest), F.struct(*order))
    best = facts.groupBy(*keys).agg(row.alias("row_"))
    return best.select(*keys, *(F.col(f"row_.{c}").alias(c) for c in rest)).select(facts.columns)


#: Who asked for restated facts, and how often: a read that looks ahead leaves a trace.
RESTATED_READS: dict[str, int] = {}


def restated(facts: DataFrame, caller: str = "") -> DataFrame:
    """The last filing of each interval, whatever day it is. A named caller is counted in RESTATED_READS."""
    if caller:
        RESTATED_READS[caller] = RESTATED_READS.get(caller, 0) + 1
    return latest(facts, INTERVAL, ("filed", *TIES[1:]))


def known_on(arm: str = "pit") -> Column:
    """The day from which a fact can be seen: it was filed and its period is over; the restated arm asks for the latter alone. Null: never."""
    return F.when(F.col("filed").isNotNull(), F.greatest("period_end", "filed")) if arm == "pit" else F.col("period_end")


def signal_grid(days: DataFrame, column: str, months: int = 15) -> DataFrame:
    """Month ends from so many months after the first day of a column up to its last."""
    ends = days.agg(F.add_months(F.min(column), months).alias("first"), F.max(column).alias("last"))
    months_ = ends.select("first", "last", F.explode(F.sequence(F.trunc("first", "month"), F.col("last"), F.expr("interval 1 month"))).alias("m"))
    return months_.withColumn("signal_date", F.last_day("m")).filter("signal_date BETWEEN first AND last").select("signal_date").distinct()


def strided(grid: DataFrame, most: int) -> DataFrame:
    """At most so many dates of a grid, evenly taken in order."""
    n = grid.count()
    step = max(1, -(-n // most))
    return grid.withColumn("i_", F.row_number().over(Window.orderBy("signal_date")) - 1).filter(F.col("i_") % step == 0).drop("i_")


def handed_out(rows: DataFrame, dates: DataFrame, lag: int, from_: str | Column, until: str | Column | None = None) -> DataFrame:
    """rows for every signal date whose day, `lag` days before, is in [from_, until); a null until is open, a null from_ is never.

    A row goes only to the months of its own range, and meets the dates of each by a hash join, so rows are not shuffled.
    dates is a grid of months, small enough to broadcast.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    asof = dates.select("signal_date", F.date_sub("signal_date", lag).alias("asof_")).distinct().withColumn("month_", F.trunc("asof_", "month"))
    last = asof.agg(F.max("asof_")).scalar()
    ranged = rows.withColumns({"from_": as_column(from_), "to_": F.least(F.date_sub(as_column(until), 1), last) if until is not None else last}).filter("from_ <= to_")
    months = F.sequence(F.trunc("from_", "month"), F.trunc("to_", "month"), F.expr("interval 1 month"))
    each = ranged.withColumn("month_", F.explode(months)).join(F.broadcast(asof), "month_").filter("asof_ BETWEEN from_ AND to_")
    return each.select(*rows.columns, "signal_date")


def visible_on(facts: DataFrame, dates: DataFrame, lag: int = 2, arm: str = "pit", until: str | None = None) -> DataFrame:
    """facts for every signal date on which they can be seen (`known_on`); `until` names a column with the day from which a fact is no longer asked for."""
    return handed_out(facts, dates, lag, known_on(arm), until)


def history(facts: DataFrame, dates: DataFrame, lag: int = 2, arm: str = "pit", caller: str = "history") -> DataFrame:
    """For each signal date, the newest visible filing of every exact interval.

    Facts are shuffled once by cik and tag: each filing counts from its day up to the next one of its interval, and is
    handed out to the dates between only then, where it lies. So what is grouped by cik, tag and more afterwards, such as
    counts by date, needs no shuffle of handed-out rows, of which there are many times as many. Of filings of one day the
    greatest by TIES counts.
    """
    facts = facts.repartition("cik", "tag")
    if arm == "restated":
        return visible_on(restated(facts.filter("filed IS NOT NULL"), caller), dates, lag, arm).select(*facts.columns, "signal_date")
    order = Window.partitionBy(*INTERVAL).orderBy("filed", *TIES[1:])
    rows = facts.filter("filed IS NOT NULL").withColumn("next_", F.lead("filed").over(order))
    return visible_on(rows, dates, lag, arm, until="next_").drop("next_")


def latest_known(facts: DataFrame, dates: DataFrame, lag: int = 2, arm: str = "pit", caller: str = "latest_known") -> DataFrame:
    """For each signal date, cik and tag: the newest period end that was visible, in its newest filing.

    A running best row by the day on which each fact can be seen, valid up to the next such day, is handed out to dates:
    one shuffle of facts, whatever the number of dates. A restated read is counted under its caller.
    """
    rows = restated(facts, caller) if arm == "restated" else facts
    keep = [c for c in facts.columns if c not in ("cik", "tag")]
    at = {"period_end": "period_end", "filed": "filed_"} | {c: f"t_{c}" for c in TIES}  # what the order holds is not held again
    rest = [c for c in keep if c not in at]
    order = F.struct("period_end", F.col("filed").alias("filed_"), *(F.col(c).alias(f"t_{c}") for c in TIES))
    by_day = Window.partitionBy("cik", "tag").orderBy("day", "order")
    state = rows.select("cik", "tag", known_on(arm).alias("day"), order.alias("order"), F.struct(*rest, F.lit(0).alias("none_")).alias("row")).filter("day IS NOT NULL")
    best = F.max(F.struct("order", "row")).over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    state = state.select("cik", "tag", "day", best.alias("best"), F.lead("day").over(by_day).alias("next_"))
    found = handed_out(state, dates, lag, "day", "next_")
    return found.select("cik", "tag", "signal_date", *(F.col(f"best.order.{at[c]}" if c in at else f"best.row.{c}").alias(c) for c in keep))


def sampled(series: DataFrame, dates: DataFrame, days: int = 10) -> DataFrame:
    """ticker, signal_date, value, observed: the last known value of (ticker, trade_date, value) at each date, if it is not too old; of one day the greatest.

    Only rows of the days before a date can be the last of it, and go to the dates that they lie before: the others are left out
    before anything is shuffled. dates is small enough to broadcast.
    """
    near = dates.select("signal_date", F.explode(F.sequence(F.date_sub("signal_date", days), F.col("signal_date"))).alias("trade_date")).distinct()
    # The days alone are asked for first: that condition goes below an aggregate by day, but not past a condition on its values.
    rows = series.join(F.broadcast(near.select("trade_date").distinct()), "trade_date", "left_semi").join(F.broadcast(near), "trade_date")
    known = F.col("value").isNotNull() & ~F.isnan("value")
    last = rows.filter("ticker IS NOT NULL").groupBy("ticker", "signal_date").agg(F.max(F.when(known, F.struct("trade_date", "value"))).alias("last_"))
    return last.filter("last_ IS NOT NULL").select("ticker", "signal_date", F.col("last_.value").alias("value"), F.col("last_.trade_date").alias("observed"))


def attach_shares(prices: DataFrame, shares: DataFrame, securities: DataFrame, days: int = 400) -> DataFrame:
    """prices with null shares_out filled from the newest filing (cik, filed, value) not older than so many days."""
    cik = securities.groupBy("ticker").agg(F.max("cik").alias("cik"))
    probes = prices.join(cik, "ticker", "left")
    build = shares.filter("value > 0").select("cik", "filed", F.col("value").alias("filed_shares"), F.col("filed").alias("shares_day"))
    found = join_asof(probes, build, ["cik"], "trade_date", "filed", ["filed_shares", "shares_day"])
    filled = F.when(F.datediff("trade_date", "shares_day") <= days, F.col("filed_shares"))
    return found.withColumn("shares_out", F.coalesce("shares_out", filled)).select(prices.columns)


def split_factor(bars: DataFrame) -> DataFrame:
    """bars with cumulative: the product of all split ratios strictly after each row; 0, null and NaN count as 1.

    A ticker's true splits are few: their suffix products are made once, and a bar looks for the next split after it.
    """
    ratio: Column = F.col("split_ratio")
    true = bars.filter((ratio != 0) & (ratio != 1) & ~F.isnan(ratio)).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("trade_date", "split_ratio"))).alias("splits_"))
    after = F.filter("splits_", lambda s: s["trade_date"] > F.col("trade_date"))
    product = F.aggregate(after, F.lit(1.0), lambda a, s: a * s["split_ratio"])
    return bars.join(true, "ticker", "left").withColumn("cumulative", F.coalesce(product, F.lit(1.0))).drop("splits_")


def unadjusted(bars: DataFrame) -> DataFrame:
    """Prices as they were traded: times the splits that came later; volume is divided; close_adj stays."""
    out = split_factor(bars)
    prices = {c: F.col(c) * F.col("cumulative") for c in ("open", "high", "low", "close") if c in bars.columns}
    return out.withColumns(prices | {"volume": F.col("volume") / F.col("cumulative")})
