"""Signals: each takes tables and a grid of signal dates and gives (ticker, signal_date, value), higher is better."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import known, month_anchor, ratio
from tidemark.operators.asof import CHOICE, history, latest_known, sampled
from tidemark.operators.audit import Rule
from tidemark.operators.guards import price_column
from tidemark.operators.states import ttm
from tidemark.sources.kept import kept
from tidemark.sources.tables import Tables

VALUES = ("ticker", "signal_date", "value")


def finished(df: DataFrame) -> DataFrame:
    """The three columns, rows with a finite value only."""
    return df.select("ticker", "signal_date", known(F.col("value")).alias("value")).filter("value IS NOT NULL")


def named(facts: DataFrame, securities: DataFrame) -> DataFrame:
    """Facts by ticker; of several tickers of a cik the greatest."""
    one = securities.groupBy("cik").agg(F.max("ticker").alias("ticker"))
    return facts.join(one, "cik")


def reads(*columns: str) -> Callable:
    """Decorator: a signal of (tables, dates, ...) that needs columns of prices; its result stops a query where one of them has no value.

    A signal that is given `cap` does not look at prices: `caps` has done so.
    """

    def around(compute: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(compute)
        def guarded(t: Tables, *args, **how) -> DataFrame:
            if how.get("cap") is not None:
                return compute(t, *args, **how)
            price_column(t.prices, *columns)
            return price_column(t.prices, *columns, result=compute(t, *args, **how))

        return guarded

    return around


@reads("close_adj")
def calendar_return(t: Tables, dates: DataFrame, recent: int, base: int, sign: float = 1.0) -> DataFrame:
    """Return between two calendar month ends before the signal date, by prices at most ten days old there."""
    anchors = dates.select("signal_date", month_anchor(F.col("signal_date"), recent).alias("a"), month_anchor(F.col("signal_date"), base).alias("b"))
    days = anchors.select(F.explode(F.array("a", "b")).alias("signal_date")).distinct()
    at = sampled(t.prices.select("ticker", "trade_date", F.col("close_adj").alias("value")), days).select("ticker", F.col("signal_date").alias("day"), F.col("value").alias("price"))
    new = F.broadcast(anchors).join(at, F.col("a") == F.col("day")).select("ticker", "signal_date", F.col("price").alias("p1"))
    old = F.broadcast(anchors).join(at, F.col("b") == F.col("day")).select("ticker", "signal_date", F.col("price").alias("p0"))
    return finished(new.join(old, ["ticker", "signal_date"]).select("ticker", "signal_date", (sign * (ratio(F.col("p1"), F.col("p0")) - 1)).alias("value")))


def market_cap(t: Tables, dates: DataFrame) -> DataFrame:
    """Unadjusted close times shares of one row, the newest at most ten days old; positive ones."""
    product = t.prices.select("ticker", "trade_date", (F.col("close") * F.col("shares_out")).alias("value"))
    return sampled(product, dates).filter("value > 0").select("ticker", "signal_date", F.col("value").alias("cap"))


def caps(t: Tables, dates: DataFrame) -> DataFrame:
    """`market_cap` under the guard of its columns, written once: for several signals over the same caps."""
    return kept(reads("close", "shares_out")(market_cap)(t, dates))


@reads("close", "shares_out")
def log_mktcap(t: Tables, dates: DataFrame) -> DataFrame:
    return finished(market_cap(t, dates).withColumn("value", -F.log("cap")))


def sessions(prices: DataFrame) -> DataFrame:
    """session_idx (from 1) and trade_date: days on which any ticker has a known close_adj."""
    days = prices.filter("close_adj IS NOT NULL").select("trade_date").distinct()
    return days.withColumn("session_idx", F.row_number().over(Window.orderBy("trade_date")))


def on_sessions(prices: DataFrame, column: str) -> DataFrame:
    """Every ticker on every market session, with the value of a column there, or null: (ticker, session_idx, trade_date, value)."""
    days = F.broadcast(sessions(prices))  # one row a trading day
    grid = prices.select("ticker").distinct().crossJoin(days)
    return grid.join(prices.select("ticker", "trade_date", F.col(column).alias("value")), ["ticker", "trade_date"], "left")


def rolling(values: DataFrame, aggregate: Callable[[Column], Column], width: int, least: int) -> DataFrame:
    """An aggregate of the last `width` sessions of each ticker, null with fewer than `least` known values."""
    last = Window.partitionBy("ticker").orderBy("session_idx").rangeBetween(-(width - 1), 0)
    return values.withColumn("value", F.when(F.count("value").over(last) >= least, aggregate(F.col("value")).over(last)))


def observed(prices: DataFrame, column: str, days: DataFrame) -> DataFrame:
    """ticker, session_idx, trade_date, value of the rows there are, with their session; what is not finite is null."""
    rows = prices.select("ticker", "trade_date", known(F.col(column)).alias("value"))
    return rows.join(F.broadcast(days), "trade_date").select("ticker", "session_idx", "trade_date", "value")


def rolled(rows: DataFrame, days: DataFrame, dates: DataFrame, aggregate: Callable[[Column], Column], width: int, least: int, fresh: int = 10) -> DataFrame:
    """ticker, trade_date, value: the rolling aggregate on all sessions that a signal date can ask for, without a row for every session.

    Between two rows that enter, a window only loses rows. So of the sessions up to a date, the last with enough
    values is the date's own last session or the last session that some row is still inside. The windows run over the
    rows and these probes alone; probes too old for every date are left out.
    """
    near = dates.select(F.explode(F.sequence(F.date_sub("signal_date", fresh), F.col("signal_date"))).alias("trade_date")).distinct()
    asked = days.join(F.broadcast(near), "trade_date", "left_semi")  # some days for each date
    own = dates.join(F.broadcast(days), F.col("trade_date") <= F.col("signal_date")).groupBy("signal_date").agg(F.max("session_idx").alias("session_idx")).select("session_idx").distinct()
    leaving = rows.filter("value IS NOT NULL").select("ticker", (F.col("session_idx") + width - 1).alias("session_idx")).join(F.broadcast(asked.select("session_idx")), "session_idx", "left_semi")
    at_dates = rows.select("ticker").distinct().crossJoin(F.broadcast(own)).join(F.broadcast(asked.select("session_idx")), "session_idx", "left_semi")
    probes = leaving.select("ticker", "session_idx").unionByName(at_dates.select("ticker", "session_idx")).withColumns({"value": F.lit(None).cast("double"), "probe": F.lit(True)})
    both = rows.select("ticker", "session_idx", "value", F.lit(False).alias("probe")).unionByName(probes)
    found = rolling(both, aggregate, width, least).filter("probe AND value IS NOT NULL").select("ticker", "session_idx", "value")
    return found.join(F.broadcast(days), "session_idx").select("ticker", "trade_date", "value")


def derived(roll: DataFrame, raw: DataFrame, dates: DataFrame) -> DataFrame:
    """A rolling value at most ten days old, where the observation under it is at most ten days old, too."""
    seen = sampled(raw.select("ticker", "trade_date", "value"), dates).select("ticker", "signal_date")
    return sampled(roll.select("ticker", "trade_date", "value"), dates).select(*VALUES).join(seen, ["ticker", "signal_date"], "left_semi")


@reads("close_adj")
def total_vol_60d(t: Tables, dates: DataFrame, width: int = 60, least: int = 30) -> DataFrame:
    """Minus the sample deviation of 60 one-session returns, 30 at least; of sparser bars width and least may be others."""
    days = sessions(t.prices)
    rows = observed(t.prices, "close_adj", days)
    before = Window.partitionBy("ticker").orderBy("session_idx")
    adjoins = F.col("session_idx") - F.lag("session_idx").over(before) == 1
    returns = rows.withColumn("value", F.when(adjoins, known(ratio(F.col("value"), F.lag("value").over(before)) - 1)))
    out = derived(rolled(returns, days, dates, F.stddev_samp, width, least), rows, dates)
    return finished(out.withColumn("value", -F.col("value")))


@reads("volume", "shares_out")
def turnover(t: Tables, dates: DataFrame) -> DataFrame:
    """Minus the mean volume of 21 sessions, 10 at least, over shares at the date."""
    days = sessions(t.prices)
    rows = observed(t.prices, "volume", days)
    volume = derived(rolled(rows, days, dates, F.avg, 21, 10), rows, dates)
    shares = sampled(t.prices.select("ticker", "trade_date", F.col("shares_out").alias("value")), dates).filter("value > 0").select("ticker", "signal_date", F.col("value").alias("shares"))
    return finished(volume.join(shares, ["ticker", "signal_date"]).withColumn("value", -ratio(F.col("value"), F.col("shares"))))


@dataclass(frozen=True)
class Tags:
    """Names of the concepts that accounting signals read."""

    equity: str = "StockholdersEquity"
    income: str = "NetIncomeLoss"
    assets: str = "Assets"


def latest_value(t: Tables, dates: DataFrame, tag: str, arm: str) -> DataFrame:
    rows = latest_known(t.facts.filter(F.col("tag") == tag).select(*CHOICE), dates, arm=arm)
    return named(rows, t.securities).select(*VALUES)


def ttm_value(t: Tables, dates: DataFrame, tag: str, arm: str) -> DataFrame:
    return named(ttm(t.facts.filter(F.col("tag") == tag), dates, arm=arm), t.securities).select(*VALUES)


def over_cap(value: DataFrame, t: Tables, dates: DataFrame, cap: DataFrame | None = None) -> DataFrame:
    """Positive values over market cap, which may be given (`caps`)."""
    both = value.filter("value > 0").join(market_cap(t, dates) if cap is None else cap, ["ticker", "signal_date"])
    return finished(both.withColumn("value", ratio(F.col("value"), F.col("cap"))))


@reads("close", "shares_out")
def bm_ratio(t: Tables, dates: DataFrame, tags: Tags = Tags(), arm: str = "pit", cap: DataFrame | None = None) -> DataFrame:
    return over_cap(latest_value(t, dates, tags.equity, arm), t, dates, cap)


@reads("close", "shares_out")
def ep_ratio(t: Tables, dates: DataFrame, tags: Tags = Tags(), arm: str = "pit", cap: DataFrame | None = None) -> DataFrame:
    return over_cap(ttm_value(t, dates, tags.income, arm), t, dates, cap)


def roe(t: Tables, dates: DataFrame, tags: Tags = Tags(), arm: str = "pit") -> DataFrame:
    """Income of twelve months over the latest equity, where that is positive."""
    return finished(_roe_inputs(t, dates, tags, arm).filter("equity > 0").withColumn("value", ratio(F.col("value"), F.col("equity"))))


def _roe_inputs(t: Tables, dates: DataFrame, tags: Tags, arm: str) -> DataFrame:
    equity = latest_value(t, dates, tags.equity, arm).withColumnRenamed("value", "equity")
    return ttm_value(t, dates, tags.income, arm).join(equity, ["ticker", "signal_date"])


def roe_excluded(t: Tables, dates: DataFrame, tags: Tags = Tags(), arm: str = "pit") -> DataFrame:
    """ticker, signal_date, equity of the keys that roe leaves out for an equity of 0 or less."""
    return _roe_inputs(t, dates, tags, arm).filter("equity <= 0").select("ticker", "signal_date", "equity")


def roe_filter(t: Tables, dates: DataFrame, tags: Tags = Tags(), arm: str = "pit") -> DataFrame:
    """filter_id, signal_date, n_input, n_output, n_excluded: what the condition on equity does before membership, in one pass."""
    known_ = _roe_inputs(t, dates, tags, arm).filter("equity IS NOT NULL AND NOT isnan(equity)")
    counts = known_.groupBy("signal_date").agg(F.count("*").alias("n_input"), F.count(F.when(F.col("equity") > 0, 1)).alias("n_output"))
    return counts.select(F.lit("latest_equity_must_be_positive").alias("filter_id"), "signal_date", "n_input", "n_output", (F.col("n_input") - F.col("n_output")).alias("n_excluded"))


def asset_growth(t: Tables, dates: DataFrame, tags: Tags = Tags(), arm: str = "pit") -> DataFrame:
    """Minus the growth between the latest fiscal year and the one before, 300 to 430 days apart, the former positive."""
    rows = history(t.facts.filter((F.col("tag") == tags.assets) & (F.upper("fiscal_period") == "FY") & F.col("fiscal_year").isNotNull()), dates, arm=arm)
    rows = rows.filter("value IS NOT NULL AND NOT isnan(value)")
    by = ["cik", "signal_date"]
    years = rows.groupBy(*by, "fiscal_year").agg(F.max_by(F.struct("value", "period_end"), F.struct("period_end", "filed", "period_start", "value")).alias("x"))
    last = Window.partitionBy(*by).orderBy("fiscal_year")
    pairs = years.withColumns({"old": F.lag("x").over(last), "old_year": F.lag("fiscal_year").over(last), "rn": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("fiscal_year")))})
    ok = (F.col("rn") == 1) & (F.col("old_year") == F.col("fiscal_year") - 1) & F.datediff("x.period_end", "old.period_end").between(300, 430) & (F.col("old.value") > 0)
    return finished(named(pairs.filter(ok).withColumn("value", -(ratio(F.col("x.value"), F.col("old.value")) - 1)), t.securities))


@dataclass(frozen=True)
class Factor:
    """A registered signal. uses_facts: it reads the bitemporal table, so vintages can differ; rules bound its raw values.

    tags: the concepts that it says it reads, as names of the fields of Tags; `tags_read` tells those that it does.
    """

    factor_id: str
    compute: Callable[..., DataFrame]
    uses_facts: bool = False
    lag_days: int = 0
    rules: tuple[Rule, ...] = ()
    tags: tuple[str, ...] = ()
    card: dict = field(default_factory=dict)

    @property
    def category(self) -> str:
        return self.card["category"]

    @property
    def plausible(self) -> tuple[float | None, float | None]:
        """The bounds of the first rule."""
        return (self.rules[0].low, self.rules[0].high) if self.rules else (None, None)


REGISTRY: dict[str, Factor] = {}
# What a card must tell.
CARD_FIELDS = ("factor_id", "name", "category", "economic_rationale", "persistence_conditions", "definition", "timing", "falsification", "references", "published_anomaly_eligibility")
TIMING = ("signal_computed", "earliest_execution", "execution_price")
REFERENCE = ("citation", "role", "locator", "verification")
CATEGORIES = ("investment", "liquidity", "momentum", "network", "profitability", "reversal", "risk", "size", "value")
ROLES = ("definition_origin", "mechanism", "robustness", "competing_explanation", "comparator")
VERIFICATION = ("VERIFIED", "UNVERIFIED")
ELIGIBILITY = ("claim_id", "status", "reason")
# The status that each lineage of a definition gives its claim.
STATUS_OF = {"EXACT_REPLICATION": "INCLUDED", "DOCUMENTED_VARIANT": "INCLUDED", "UNVERIFIED": "PENDING", "UNSUPPORTED_LINEAGE": "EXCLUDED"}


def lineage(card: dict) -> str:
    """Where a definition comes from, by the references that it originates in: none, none that was verified, or one, as it is or varied."""
    seen = {r["verification"] for r in card["references"] if r["role"] == "definition_origin"}
    if "VERIFIED" in seen:
        return "DOCUMENTED_VARIANT" if card.get("documented_variants") else "EXACT_REPLICATION"
    return "UNVERIFIED" if seen else "UNSUPPORTED_LINEAGE"


def _holds(fields: tuple[str, ...]) -> Callable[[object], bool]:
    return lambda part: isinstance(part, dict) and set(fields) <= part.keys()


def _full(fields: tuple[str, ...]) -> Callable[[object], bool]:
    return lambda part: isinstance(part, dict) and all(str(part.get(f) or "").split() for f in fields)


def _located(reference: object) -> bool:
    """What was verified was found somewhere."""
    return reference.get("verification") in VERIFICATION and bool(reference["verification"] != "VERIFIED" or str(reference["locator"] or "").split())


#: Each demand: the part of a card, whether it is a list whose items are meant, the test, and what is said where it fails.
CARD_DEMANDS = (
    ("category", False, lambda c: c in CATEGORIES, f"category is one of {', '.join(CATEGORIES)}"),
    ("economic_rationale", False, lambda t: len(str(t).split()) >= 10, "economic_rationale takes ten words or more"),
    ("timing", False, _holds(TIMING), f"timing tells {', '.join(TIMING)}"),
    ("falsification", False, lambda t: isinstance(t, list), "falsification is a list"),
    ("references", True, _holds(REFERENCE), f"a reference tells {', '.join(REFERENCE)}"),
    ("references", True, _located, f"a reference is {' or '.join(VERIFICATION)}, and verified in some place"),
    ("references", True, lambda r: r["role"] in ROLES, f"a reference's role is one of {', '.join(ROLES)}"),
    ("published_anomaly_eligibility", False, _full(ELIGIBILITY), f"published_anomaly_eligibility tells {', '.join(ELIGIBILITY)}"),
)


def checked(card: dict) -> dict:
    """card, if it meets all that a card must; the error names what is empty, or the first demand that isn't met."""
    absent = [f"{f} is empty" for f in CARD_FIELDS if not card.get(f)]
    broken = (says for part, items, test, says in CARD_DEMANDS if not all(map(test, card[part] if items else [card[part]])))
    faults = absent or list(islice(broken, 1))  # later demands build on earlier ones
    if not faults and (due := STATUS_OF[lineage(card)]) != card["published_anomaly_eligibility"]["status"]:
        faults = [f"the lineage is {lineage(card)}, so the status is {due}"]
    if faults:
        raise ValueError(f"card {card.get('factor_id', '')!r}: " + "; ".join(faults))
    return card


def register(card: dict, **about):
    """Decorator: a function of (tables, dates) becomes a factor under its card, which is checked first."""

    def add(compute: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        factor_id = checked(card)["factor_id"]
        if factor_id in REGISTRY:
            raise ValueError(f"{factor_id} is registered already")
        ids = [r.rule_id for f in REGISTRY.values() for r in f.rules] + [r.rule_id for r in about.get("rules", ())]
        if len(set(ids)) < len(ids):
            raise ValueError(f"{factor_id}: a rule has the name of another")
        if bool(about.get("tags")) != bool(about.get("uses_facts")):
            raise ValueError(f"{factor_id}: a signal that uses facts tells its tags, and no other does")
        REGISTRY[factor_id] = Factor(factor_id, compute, card=card, **about)
        return compute

    return add


def tags_read(t: Tables, compute: Callable[[Tables], DataFrame]) -> set[str]:
    """Tags that reach the table of facts in the analysed plan of a signal; `*` where it reads facts of any tag.

    The table goes in under a name of its own, which analysis keeps; conditions on tag between it and the next operator that isn't
    a choice of rows or columns are what the signal asks for.
    """
    name = "facts_that_are_read"
    plan = compute(Tables(t.securities, t.prices, t.facts.alias(name)))._jdf.queryExecution().analyzed()
    found: set[str] = set()

    def walk(node, asked: set[str] | None) -> None:
        kind = node.nodeName()
        if kind == "SubqueryAlias" and node.alias() == name:
            found.update(asked or {"*"})
            return
        if kind == "Filter":
            text = node.condition().toString()
            here = set(re.findall(r"\(tag#\d+ = ([^()]+)\)", text)) | {x.strip() for group in re.findall(r"tag#\d+ IN \(([^()]+)\)", text) for x in group.split(",")}
            asked = here if not asked else asked & here or asked if here else asked
        elif kind not in ("Project", "SubqueryAlias"):
            asked = None
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), asked)

    walk(plan, None)
    return found


def verified_tags(factor_id: str, t: Tables, dates: DataFrame, tags: Tags = Tags()) -> set[str]:
    """The tags that a registered signal reads, if it has told them all; else an error."""
    f = REGISTRY[factor_id]
    told = {getattr(tags, name) for name in f.tags}
    read = tags_read(t, lambda tables: f.compute(tables, dates, tags=tags) if f.uses_facts else f.compute(tables, dates))
    if read - told:
        raise ValueError(f"{factor_id} reads {', '.join(sorted(read - told))} and tells of {', '.join(sorted(told)) or 'none'}")
    return read


def by_category() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for f in REGISTRY.values():
        out.setdefault(f.category, []).append(f.factor_id)
    return {k: sorted(v) for k, v in sorted(out.items())}


def summary() -> list[dict]:
    """A row for each factor, in order."""
    return [{"factor_id": i, "name": f.card["name"], "category": f.category, "uses_facts": f.uses_facts, "lag_days": f.lag_days, "rules": len(f.rules)} for i, f in sorted(REGISTRY.items())]


def clear() -> None:
    REGISTRY.clear()


def _card(factor_id: str, name: str, category: str, rationale: str, definition: str, fails: str) -> dict:
    return {
        "factor_id": factor_id,
        "name": name,
        "category": category,
        "economic_rationale": rationale,
        "persistence_conditions": "costs of trading and limits to arbitrage keep it from being traded away",
        "definition": definition,
        "timing": {"signal_computed": "after the close of the signal date", "earliest_execution": "the next market session", "execution_price": "adjusted close"},
        "falsification": [fails, "the mean rank correlation on later data is not above 0"],
        "references": [{"citation": "own statement of the construction", "role": "definition_origin", "locator": "", "verification": "UNVERIFIED"}],
        "published_anomaly_eligibility": {"claim_id": factor_id, "status": "PENDING", "reason": "no source was checked"},
    }


def _economic(factor_id: str, low: float | None, high: float | None) -> tuple[Rule, ...]:
    return (Rule(f"{factor_id}_scale", "economic", "error", low, high, "values beyond are an error of unit or scale"),)


_UNDER = "investors take in news slowly, so that prices go on in the direction that they have taken for some months"
_CHEAP = "prices that are low against what a firm owns or earns pay for distress risk, or for pessimism that goes too far"
register(_card("mom_12_1", "Momentum of twelve months less one", "momentum", _UNDER, "return from 12 to 1 month ends ago", "winners do not beat losers"), rules=_economic("mom_12_1", -1.0, 50.0))(lambda t, dates: calendar_return(t, dates, 1, 12))
register(_card("mom_6_1", "Momentum of six months after one", "momentum", _UNDER, "return from 7 to 1 month ends ago", "winners do not beat losers"), rules=_economic("mom_6_1", -1.0, 50.0))(lambda t, dates: calendar_return(t, dates, 1, 7))
register(_card("rev_1m", "Reversal of one month", "reversal", "those who must trade at once move prices too far, and these come back when they are done", "minus the return of the last month", "last month's losers do not recover"), rules=_economic("rev_1m", -50.0, 1.0))(lambda t, dates: calendar_return(t, dates, 0, 1, -1.0))
register(_card("log_mktcap", "Size", "size", "small firms are harder to trade and to learn about, and their holders ask a higher return for it", "minus the logarithm of market value", "small firms do not earn more"), rules=_economic("log_mktcap", -40.0, 0.0))(log_mktcap)
register(_card("total_vol_60d", "Total volatility", "risk", "those who can't borrow bid up volatile shares as lotteries, so that calm ones are left too cheap", "minus the deviation of 60 one-session returns", "calm firms do not earn more"), rules=(Rule("total_vol_60d_sign", "construction", "error", None, 0.0, "a deviation is not negative"),))(total_vol_60d)
register(_card("turnover", "Share turnover", "liquidity", "shares that few trade are neglected or illiquid, and their holders are paid for it in return", "minus the mean volume of 21 sessions over shares", "neglected firms do not earn more"), rules=(Rule("turnover_sign", "construction", "error", None, 0.0, "volume is not negative"),))(turnover)
register(_card("bm_ratio", "Book to market", "value", _CHEAP, "latest equity over market value, both positive", "cheap firms do not earn more"), uses_facts=True, tags=("equity",), lag_days=2, rules=_economic("bm_ratio", 0.0, 20.0))(bm_ratio)
register(_card("ep_ratio", "Earnings to price", "value", _CHEAP, "income of twelve months over market value, both positive", "cheap firms do not earn more"), uses_facts=True, tags=("income",), lag_days=2, rules=_economic("ep_ratio", 0.0, 2.0))(ep_ratio)
register(_card("roe", "Return on equity", "profitability", "profits persist for longer than prices allow for, so that profitable firms go on to surprise", "income of twelve months over latest equity, equity positive", "profitable firms do not earn more"), uses_facts=True, tags=("income", "equity"), lag_days=2, rules=_economic("roe", -20.0, 20.0))(roe)
register(_card("asset_growth", "Asset growth", "investment", "firms build when capital is dear and managers are hopeful, and growth disappoints those who paid for it", "minus the growth of assets between two fiscal years", "growing firms do not earn less"), uses_facts=True, tags=("assets",), lag_days=2, rules=_economic("asset_growth", -50.0, 1.0))(asset_growth)
