"""What repeated disclosure, early reading and vintages amount to."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import finite, ratio
from tidemark.operators.asof import INTERVAL, TIES, handed_out
from tidemark.operators.guards import ImplausibleMagnitudeError, required, share, unique_keys
from tidemark.sources.kept import kept

REASONS = ("nonfinite_or_missing_value", "missing_unit", "mixed_units", "mixed_fact_types", "unknown_fact_type", "same_date_conflict")


def restatements(facts: DataFrame) -> DataFrame:
    """Intervals whose first and last filing days differ, with both values, the revision and its lag. One aggregate."""
    order = F.struct("filed", *TIES[1:])
    g = facts.groupBy(*INTERVAL).agg(F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"), F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"))
    revision = F.col("last_value") - F.col("first_value")
    return g.filter("first_filed <> last_filed").select("*", revision.alias("revision"), ratio(revision, F.abs("first_value")).alias("revision_pct"), F.datediff("last_filed", "first_filed").cast("long").alias("revision_lag_days"))


def disclosed(facts: DataFrame) -> DataFrame:
    """For each interval: repeated, changed, and the reasons against comparing it. Two aggregates on one key."""
    ok = finite(F.col("value"))
    days = facts.groupBy(*INTERVAL, "filed").agg(
        F.count("*").alias("rows"),
        F.count(F.when(ok, 1)).alias("ok"),
        F.collect_set(F.when(ok, F.col("value"))).alias("values"),
        F.count("unit").alias("with_unit"),
        F.collect_set("unit").alias("units"),
        F.collect_set("fact_type").alias("types"),
    )
    g = days.groupBy(*INTERVAL).agg(
        F.count("*").alias("n_days"),
        F.sum("rows").alias("rows"),
        F.sum("ok").alias("ok"),
        F.sum("with_unit").alias("with_unit"),
        F.size(F.array_distinct(F.flatten(F.collect_list("values")))).alias("n_values"),
        F.array_distinct(F.flatten(F.collect_list("units"))).alias("units"),
        F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"),
        F.bool_or(F.size("values") > 1).alias("same_date_conflict"),
    )
    return g.select(
        *INTERVAL,
        (F.col("n_days") > 1).alias("repeated"),
        (F.col("n_values") > 1).alias("changed"),
        (F.col("ok") < F.col("rows")).alias(REASONS[0]),
        (F.col("with_unit") < F.col("rows")).alias(REASONS[1]),
        (F.size("units") > 1).alias(REASONS[2]),
        (F.size("types") > 1).alias(REASONS[3]),
        F.array_contains("types", "unknown").alias(REASONS[4]),
        F.col(REASONS[5]),
    )


def disclosure_summary(facts: DataFrame) -> DataFrame:
    """One row: intervals, repeated ones, and these as changed, unchanged and uncomparable."""
    bad = F.expr(" OR ".join(REASONS))
    rep = F.col("repeated")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return disclosed(facts).agg(F.count("*").alias("fact_keys"), count(rep, "repeated_keys"), count(rep & ~bad & F.col("changed"), "changed_keys"), count(rep & ~bad & ~F.col("changed"), "unchanged_keys"), count(rep & bad, "uncomparable_keys"))


def uncomparable_reasons(facts: DataFrame) -> DataFrame:
    """reason and n_keys among repeated intervals; reasons overlap, any_reason is their union."""
    rep = disclosed(facts).filter("repeated")
    counts = rep.agg(*(F.count(F.when(F.col(r), 1)).alias(r) for r in REASONS), F.count(F.when(F.expr(" OR ".join(REASONS)), 1)).alias("any_reason"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r).alias("reason"), F.col(r).alias("n_keys")) for r in (*REASONS, "any_reason")))).alias("x")).select("x.*")


def _last_filed(facts: DataFrame, grace: int) -> DataFrame:
    """cik, tag, period_end, filed (the last), over_: the day from which a date is no longer exposed to it."""
    last = facts.groupBy("cik", "tag", "period_end").agg(F.max("filed").alias("filed"))
    return last.withColumn("over_", F.date_sub("filed", grace)).filter("over_ > period_end")


def naive_trap(values: DataFrame, securities: DataFrame, facts: DataFrame, grace: int = 0) -> DataFrame:
    """ticker, signal_date, tag, period_end, filed: what a reader that ignores filing days would see early.

    A fact goes to the dates between the end of its period and its filing only, and meets names there by company and date.
    """
    keys = values.select("ticker", "signal_date").distinct().join(securities.select("cik", "ticker").distinct(), "ticker")
    early = handed_out(_last_filed(facts, grace), values.select("signal_date").distinct(), 0, "period_end", "over_")
    return keys.join(early, ["cik", "signal_date"]).select("ticker", "signal_date", "tag", "period_end", "filed")


def exposure(values: DataFrame, securities: DataFrame, facts: DataFrame, grace: int = 0) -> DataFrame:
    """ticker, signal_date, n_early: how many facts a reader that ignores filing days would see early, by a sweep over each company's days.

    A fact opens when its period ends and closes when it is filed; the running sum of both meets the dates in order, so no
    date is paired with a fact.
    """
    last = _last_filed(facts, grace)
    steps = last.select("cik", F.col("period_end").alias("day"), F.lit(1).alias("step")).unionByName(last.select("cik", F.col("over_").alias("day"), F.lit(-1).alias("step")))
    steps = steps.groupBy("cik", "day").agg(F.sum("step").alias("step"))
    keys = values.select("ticker", "signal_date").distinct().join(securities.select("cik", "ticker").distinct(), "ticker")
    asks = keys.select("cik", F.col("signal_date").alias("day"), F.lit(0).cast("long").alias("step"), "ticker")
    sweep = Window.partitionBy("cik").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)  # a day's own steps count
    both = steps.withColumn("ticker", F.lit(None).cast("string")).unionByName(asks).withColumn("n_early", F.sum("step").over(sweep))
    return both.filter("ticker IS NOT NULL").select("ticker", F.col("day").alias("signal_date"), "n_early")


def trap_report(values: DataFrame, securities: DataFrame, facts: DataFrame, grace: int = 0) -> DataFrame:
    """One row: signal dates, exposed ones, early rows and the exposure rate; counted by `exposure`, without the rows themselves."""
    days = exposure(values, securities, facts, grace).groupBy("signal_date").agg(F.sum("n_early").alias("n"))
    b = days.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n_dates_exposed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_trap_rows"))
    a = values.agg(F.count_distinct("signal_date").alias("n_signal_dates"))
    return a.crossJoin(b).withColumn("exposure_rate", ratio(F.col("n_dates_exposed"), F.col("n_signal_dates")))  # one row each


def read_log(reads: DataFrame, lag: int = 2) -> DataFrame:
    """For each signal date of a read: the day asked for, the newest filing seen, rows and tags."""
    g = reads.groupBy("signal_date").agg(F.max("filed").alias("max_filed"), F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("tag")), "+").alias("tags"))
    return g.select("signal_date", F.date_sub("signal_date", lag).alias("requested_asof"), "max_filed", "n_rows", "tags")


def read_check(log: DataFrame, grace: int = 0) -> DataFrame:
    """One row: reads, those that saw a filing later than allowed, and whether there was any read to check."""
    late = F.col("max_filed") > F.date_sub("signal_date", grace)
    return log.agg(F.count("*").alias("n_reads"), F.count(F.when(late, 1)).alias("n_violations"), (F.count("*") == 0).alias("vacuous"))


def plausibility(values: DataFrame, low: float | None, high: float | None, tolerance: float = 0.01) -> DataFrame:
    """One row: finite values, those outside the inclusive bounds, their share and the status."""
    v = F.col("value")
    out = F.lit(False)
    if low is not None:
        out = out | (v < low)
    if high is not None:
        out = out | (v > high)
    g = values.agg(F.count(F.when(finite(v), 1)).alias("n_finite"), F.count(F.when(finite(v) & out, 1)).alias("n_outside"))
    share = ratio(F.col("n_outside"), F.col("n_finite"))
    unbounded = low is None and high is None
    status = F.when(F.lit(unbounded), "DECLARED_UNBOUNDED").when(F.col("n_finite") == 0, "NO_FINITE_VALUES").when(share > tolerance, "VIOLATION").otherwise("WITHIN_TOLERANCE")
    return g.select("n_finite", "n_outside", share.alias("share_outside"), status.alias("status"))


KINDS = {"domain": False, "construction": False, "economic": True}  # whether a share of values may lie outside
SEVERITIES = ("error", "warning")


@dataclass(frozen=True)
class Rule:
    """Inclusive bounds of a signal's raw values. Rules of domain or construction allow no breach, economic ones a share; only errors block."""

    rule_id: str
    kind: str
    severity: str
    low: float | None
    high: float | None
    rationale: str

    def __post_init__(self) -> None:
        broken = [text for text, holds in DEMANDS.items() if not holds(self)]
        if broken:
            raise ValueError(f"rule {self.rule_id!r}: " + "; ".join(broken))

    @property
    def bounds(self) -> tuple[float, float]:
        """With open sides as infinite."""
        return (-math.inf if self.low is None else self.low), (math.inf if self.high is None else self.high)

    def tolerance(self, most: float) -> float:
        return most if KINDS[self.kind] else 0.0


#: What every rule must meet.
DEMANDS = {
    "its name and its reason are words": lambda r: bool(r.rule_id.split() and r.rationale.split()),
    f"its kind is {' or '.join(KINDS)}": lambda r: r.kind in KINDS,
    f"its severity is {' or '.join(SEVERITIES)}": lambda r: r.severity in SEVERITIES,
    "its bounds are numbers, and None where a side is open": lambda r: all(b is None or math.isfinite(b) for b in (r.low, r.high)),
    "its bounds are in order": lambda r: r.low is None or r.high is None or not r.low > r.high,
}


def evaluated(values: DataFrame, rules: list[Rule], most: float = 0.01) -> DataFrame:
    """A row for each rule: its counts, share, tolerance, status, and whether it blocks. One pass over values.

    Values are counted once for all rules; what a count means is decided on the rows of rules.
    """
    share(most)
    v = F.col("value")
    known = finite(v)
    beyond = [known & ~v.between(*r.bounds) for r in rules]
    counts = values.agg(F.count("*").alias("n_rows"), F.count(F.when(known, 1)).alias("n_finite"), F.array(*(F.count(F.when(b, 1)) for b in beyond)).alias("found"))
    told = [F.struct(F.lit(i).alias("i"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"), F.lit(r.low is None and r.high is None).alias("open"), F.lit(r.tolerance(most)).alias("tolerance")) for i, r in enumerate(rules)]
    rows = counts.withColumn("rule", F.explode(F.array(*told))).select("n_rows", "n_finite", "rule.*", F.get("found", F.col("rule.i")).alias("outside"))
    judged = ~F.col("open") & (F.col("n_finite") > 0)
    rows = rows.withColumns({"n_outside": F.when(judged, F.col("outside")), "share_outside": F.when(judged, F.col("outside") / F.col("n_finite"))})
    status = F.when(F.col("open"), "DECLARED_UNBOUNDED").when(F.col("n_finite") == 0, "NO_FINITE_VALUES").when(F.col("share_outside") > F.col("tolerance"), "VIOLATION").otherwise("WITHIN_TOLERANCE")
    rows = rows.withColumn("status", status).withColumn("blocking", (F.col("status") == "VIOLATION") & (F.col("severity") == "error"))
    return rows.select("rule_id", "kind", "severity", "n_rows", "n_finite", "n_outside", "share_outside", "tolerance", "status", "blocking")


def enforced(values: DataFrame, rules: list[Rule], most: float = 0.01, k: int = 5) -> list[dict]:
    """All rules' rows; if any blocks, an error that holds them all and the k worst values of the first that does."""
    found = [r.asDict() for r in evaluated(values, rules, most).collect()]  # a row for each rule
    blocking = next(((row, rule) for row, rule in zip(found, rules, strict=True) if row["blocking"]), None)
    if blocking:
        row, rule = blocking
        worst = [(w["ticker"], str(w["signal_date"]), w["value"]) for w in most_implausible(values, *rule.bounds, k).collect()]
        raise ImplausibleMagnitudeError(f"{row['n_outside']} of {row['n_finite']} values break {rule.rule_id}", {"rules": found, "rule": row, "worst": worst})
    return found


def trap_samples(trap: DataFrame, k: int = 5) -> DataFrame:
    """The first k early rows in their one order."""
    return trap.orderBy("signal_date", "ticker", "tag", "period_end", "filed").limit(k)


def sample_comparison(pit: DataFrame, restated: DataFrame) -> DataFrame:
    """One row: keys of both sides, shared ones and those of one side, and a hash of each side's keys and of the shared ones. Each side's keys are written once, as they are read four times."""
    keys = ["ticker", "signal_date"]
    pit, restated = (kept(side.select(*keys)) for side in (pit, restated))
    both = unique_keys(pit, keys).select(*keys, F.lit(1).alias("p")).join(unique_keys(restated, keys).select(*keys, F.lit(1).alias("r")), keys, "full_outer")
    p, r = F.col("p").isNotNull(), F.col("r").isNotNull()
    counts = both.agg(F.count(F.when(p & r, 1)).alias("n_both"), F.count(F.when(p & ~r, 1)).alias("n_pit_only"), F.count(F.when(r & ~p, 1)).alias("n_restated_only"))
    hashed = lambda rows, name: frame_hash(rows, keys).select(F.col("key_hash").alias(name))
    return counts.crossJoin(hashed(pit, "pit_hash")).crossJoin(hashed(restated, "restated_hash")).crossJoin(hashed(both.filter(p & r), "shared_hash"))  # one row each


def universe_gap(with_ghosts: DataFrame, without: DataFrame, ghosts: DataFrame) -> DataFrame:
    """One row: what rows of names (ticker, exit_date) that are gone do to the cleaned values of all others after the exit: keys compared, moved, and the greatest move."""
    keys = ["ticker", "signal_date"]
    exit_date = ghosts.agg(F.min("exit_date").alias("exit_date"))
    left = with_ghosts.join(ghosts.select("ticker"), "ticker", "left_anti").select(*keys, F.col("value").alias("a"))
    both = left.join(without.select(*keys, F.col("value").alias("b")), keys).crossJoin(F.broadcast(exit_date)).filter("signal_date > exit_date")  # exit_date is one row
    moved = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count("*").alias("n_keys"), F.count(F.when(moved > 1e-12, 1)).alias("n_moved"), F.max(moved).alias("max_move"))


def calendar_windows(bars: DataFrame) -> DataFrame:
    """Bars (trade_date, close, before: the ticker's bar before) by year: all, not positive ones, steps, and steps of one calendar month."""
    one_month = F.col("before") == F.last_day(F.add_months("trade_date", -1))
    return bars.groupBy(F.year("trade_date").alias("year")).agg(F.count("*").alias("n_bars"), F.count(F.when(F.col("close").isNull() | (F.col("close") <= 0), 1)).alias("n_not_positive"), F.count("before").alias("n_steps"), F.count(F.when(one_month, 1)).alias("n_of_one_month"))


def disclosure_check(facts: DataFrame) -> DataFrame:
    """check and passed: the columns are there, keys are known, the reasons' union and the parts of repeated keys agree with the summary."""
    needed = ("cik", "tag", "period_start", "period_end", "filed", "fact_type", "value", "unit")
    required(facts, needed)
    null = F.coalesce(F.bool_or(F.expr(" OR ".join(f"{c} IS NULL" for c in needed[:6]))), F.lit(False))
    rep, bad = F.col("repeated"), F.expr(" OR ".join(REASONS))
    n = lambda c: F.count(F.when(c, 1))
    one = disclosed(facts).agg(n(rep).alias("repeated"), n(rep & bad).alias("bad"), n(rep & ~bad & F.col("changed")).alias("changed"), n(rep & ~bad & ~F.col("changed")).alias("same"))
    union = uncomparable_reasons(facts).filter("reason = 'any_reason'").select("n_keys")
    row = one.crossJoin(union).crossJoin(facts.agg(null.alias("null_keys")))  # one row each
    named = {"keys are known": ~F.col("null_keys"), "union matches summary": F.col("n_keys") == F.col("bad"), "parts match repeated keys": F.col("changed") + F.col("same") + F.col("bad") == F.col("repeated")}
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in named.items()))).alias("x")).select("x.*")


def most_implausible(values: DataFrame, low: float, high: float, k: int = 5) -> DataFrame:
    """The k finite values outside the range that are farthest from its middle, or from its one end."""
    ends = [b for b in (low, high) if math.isfinite(b)]
    outside = values.filter(finite(F.col("value")) & ~F.col("value").between(low, high))
    return outside.orderBy(F.desc(F.abs(F.col("value") - sum(ends) / max(len(ends), 1))), "ticker", "signal_date").limit(k)


def compare_vintages(pit: DataFrame, restated: DataFrame) -> DataFrame:
    """signal_date, n_both, n_pit_only, n_restated_only, n_equal, mean_gap of two sets of values."""
    both = pit.select("ticker", "signal_date", F.col("value").alias("p")).join(restated.select("ticker", "signal_date", F.col("value").alias("r")), ["ticker", "signal_date"], "full_outer")
    p, r = F.col("p").isNotNull(), F.col("r").isNotNull()
    return both.groupBy("signal_date").agg(F.count(F.when(p & r, 1)).alias("n_both"), F.count(F.when(p & ~r, 1)).alias("n_pit_only"), F.count(F.when(r & ~p, 1)).alias("n_restated_only"), F.count(F.when(F.col("p") == F.col("r"), 1)).alias("n_equal"), F.avg(F.col("r") - F.col("p")).alias("mean_gap"))


def frame_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows and a hash of keys that does not depend on their order; equal sets of rows have equal hashes.

    The hash is the sums of both halves of each row's MD5, so 128 bits of every row count.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys))
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring(F.md5(text.cast("binary")), at, 16), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string")
    return df.agg(F.count("*").alias("n_rows"), F.concat_ws(":", half(1), half(17)).alias("key_hash"))


def verdict(exercised: bool, shared_dates: int, blocked: bool, gap: float | None, tolerance: float = 0.005) -> str:
    """The first rule that applies."""
    if not exercised:
        return "NOT APPLICABLE"
    if not shared_dates:
        return "NO SHARED DATES"
    if blocked:
        return "BLOCKED"
    if gap is None or gap != gap or abs(gap) == float("inf"):
        return "NOT FINITE"
    return "FAIL" if abs(gap) > tolerance else "PASS"


def overlap_seconds(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """window_id and seconds of spans (begin, end) of the same key inside each window (key, window_id, begin, end); 0 where none is inside.

    Both sides are cut at midnight and meet by key and day, so that a key's spans meet only the windows of their days.
    """
    every = windows.groupBy("window_id").agg(F.lit(0).cast("long").alias("seconds")).filter("window_id IS NOT NULL")

    def by_day(rows: DataFrame, *more: str) -> DataFrame:
        last = F.greatest(F.to_date("begin"), F.to_date(F.col("end") - F.expr("interval 1 second")))
        days = rows.filter("begin <= end").withColumn("day", F.explode(F.sequence(F.to_date("begin"), last)))
        midnight = F.col("day").cast("timestamp")
        return days.select("key", "day", *more, F.greatest("begin", midnight).alias("begin"), F.least("end", F.date_add("day", 1).cast("timestamp")).alias("end"))

    w = by_day(windows, "window_id").withColumnsRenamed({"begin": "wb", "end": "we"})
    inside = F.greatest(F.lit(0), F.unix_timestamp(F.least("end", "we")) - F.unix_timestamp(F.greatest("begin", "wb")))
    found = w.join(by_day(spans), ["key", "day"]).groupBy("window_id").agg(F.sum(inside).alias("seconds"))
    return every.unionByName(found).groupBy("window_id").agg(F.sum("seconds").alias("seconds"))


def stage_summary(events: DataFrame) -> DataFrame:
    """stage, calls and total, median, least and greatest of `value`."""
    return events.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("value").alias("total"), F.percentile("value", 0.5).alias("median_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
