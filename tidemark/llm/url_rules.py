"""URL filters by indexed pattern rules, with DataFrame functions only.

A rule is a regular expression over an address `//host/path`, with the literal tokens that every match
must hold whole. Each rule is indexed under the token that fewest addresses hold, by counts over all of
them; an address's tokens fetch the rules filed under them, and only those run their expressions. Rules
without a token run on every address.

The rules are counted; up to `MOST` of them are broadcast, so that addresses are not shuffled to meet them. More rules
than that are joined by token. Then one aggregate by page, which sums on the map side first, gives the verdicts.

Defined cases: a null url, or one without `://`, has empty host and path and no rule; repeated rows all
stay; of rules that fit, the longest wins, then block, then the rule that sorts last; an empty table
gives an empty result; columns other than page_id and url are not read; more than `MOST` rules without a token raise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (action, host and path). A rule fits its host and all subdomains where the path begins with its own.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: (action, expression, tokens). Addresses of gambling, pill, advertising and link-farm hosts, and of their campaign paths.
PATTERN_RULES = (
    ("block", r"^//(?:[^/]*[.-])?casino[.-]", ("casino",)),
    ("block", r"^//(?:[^/]*[.-])?bets[.-]", ("bets",)),
    ("block", r"^//(?:[^/]*[.-])?pills[.-]", ("pills",)),
    ("block", r"^//(?:[^/]*[.-])?spam-", ("spam",)),
    ("block", r"^//(?:[^/]*[.-])?ads-", ("ads",)),
    ("block", r"^//(?:[^/]*[.-])?free-[^/]*[.-]win[.-]", ("free", "win")),
    ("block", r"^//[^/]*/(?:[^/]*/)*casino(?:/|$)", ("casino",)),
    ("block", r"^//[^/]*/(?:[^/]*/)*viagra(?:/|$)", ("viagra",)),
    ("block", r"^//[^/]*/(?:[^/]*/)*porn(?:/|$)", ("porn",)),
    ("allow", r"^//(?:[^/]*\.)?gov/", ("gov",)),
    ("allow", r"^//(?:[^/]*\.)?edu/", ("edu",)),
)
#: Rules that may be broadcast, some hundred bytes each.
MOST = 100_000


def host_rule(action: str, rule: str) -> tuple[str, str, bool, str, list[str]]:
    """The pattern and tokens of a host and path. A last path token that may go on is no whole token."""
    whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", rule.lower())
    return rule, action, True, "^//(?:[^/]*\\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", rule), whole


def rules(spark: SparkSession, host_rules: tuple = HOST_RULES, patterns: tuple = PATTERN_RULES) -> DataFrame:
    """rule, action, base, pattern, tokens, as literals of the plan."""
    rows = [host_rule(*x) for x in host_rules] + [(p, a, False, p, list(t)) for a, p, t in patterns]
    row = lambda rule, action, base, pattern, tokens: F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"), F.lit(base).alias("base"), F.lit(pattern).alias("pattern"), F.array(*map(F.lit, tokens)).cast("array<string>").alias("tokens"))
    return spark.range(1).select(F.inline(F.array(*(row(*r) for r in rows))))


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, number sign or the end, A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def addresses(pages: DataFrame) -> DataFrame:
    """page_id, host, path, the address that rules see, and its distinct tokens."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("address", F.concat(F.lit("//"), "host", "path"))
    return rows.withColumn("tokens", F.array_distinct(F.filter(F.split(F.lower("address"), "[^a-z0-9]+"), lambda t: t != "")))


def few(rules_: DataFrame, most: int) -> bool:
    """Whether rules may be broadcast."""
    return rules_.limit(most + 1).count() <= most


def index(ruleset: DataFrame, pages: DataFrame, most: int = MOST) -> DataFrame:
    """Each rule under its rarest token in all of pages (ties: the token that sorts first), or under the empty one."""
    listed = ruleset.select("*", F.explode_outer("tokens").alias("token"))
    named = listed.select("token").filter(F.col("token").isNotNull()).distinct()
    held = addresses(pages).select(F.explode("tokens").alias("token"))
    counts = held.join(F.broadcast(named) if few(named, most) else named, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = listed.join(counts, "token", "left")
    best = ranked.groupBy("rule", "action", "base", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("best"))
    return best.select("rule", "action", "base", "pattern", F.coalesce("best.token", F.lit("")).alias("token"))


def judge(pages: DataFrame, ruleset: DataFrame, most: int = MOST) -> DataFrame:
    """page_id, host, path, rule, verdict and the number of patterns that fit, for every row of pages.

    Each row also brings a null token, which fetches nothing: it keeps rows without a candidate, and its count restores
    repeated rows after grouping.
    """
    entries = index(ruleset, pages, most)
    asked = F.concat(F.array(F.lit(None).cast("string"), F.lit("")), F.col("tokens"))
    asks = addresses(pages).select("page_id", "host", "path", "address", F.explode(asked).alias("asked"))
    on = F.col("asked") == F.col("token")
    if few(ruleset, most):
        fetched = asks.join(F.broadcast(entries), on, "left")
    else:
        everywhere = entries.filter("token = ''")
        if not few(everywhere, most):
            raise ValueError(f"more than {most} rules have no token")
        named = asks.filter("asked <> ''").join(entries.filter("token <> ''"), on)
        fetched = asks.filter("asked IS NULL OR asked = ''").join(F.broadcast(everywhere), on, "left").unionByName(named)
    fits = fetched.filter(F.col("asked").isNull() | F.coalesce(F.rlike(F.col("address"), F.col("pattern")), F.lit(False)))
    base = F.when(F.col("base"), F.struct(F.length("rule"), F.when(F.col("action") == "block", 1).otherwise(0), F.col("rule"), F.col("action")))
    grouped = fits.groupBy("page_id", "host", "path").agg(
        F.count(F.when(F.col("asked").isNull(), 1)).alias("rows"),
        F.max(base).alias("best"),
        F.coalesce(F.bool_or(~F.col("base") & (F.col("action") == "block")), F.lit(False)).alias("blocked"),
        F.coalesce(F.bool_or(~F.col("base") & (F.col("action") == "allow")), F.lit(False)).alias("allowed"),
        F.count(F.when(~F.col("base"), 1)).alias("patterns"),
    )
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow"))
    out = grouped.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), (F.col("patterns") / F.col("rows")).cast("long").alias("patterns"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"))
    return out.drop("copy")
