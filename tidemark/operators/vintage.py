"""The same signal from first-published and from later-revised facts, in layers that are said to differ in one thing each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import finite
from tidemark.operators import audit, panel, protocol
from tidemark.operators.factors import REGISTRY, VALUES
from tidemark.sources.kept import kept
from tidemark.sources.tables import Tables

KEY = ["ticker", "signal_date"]


def common(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides on the keys that they share."""
    return a.join(b.select(*KEY), KEY, "left_semi"), b.join(a.select(*KEY), KEY, "left_semi")


def key_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of either side, each once, and which side has it: both, first or second."""
    sides = a.select(*KEY).distinct().withColumn("a_", F.lit(True)).join(b.select(*KEY).distinct().withColumn("b_", F.lit(True)), KEY, "full_outer")
    return sides.select(*KEY, F.when(F.col("b_").isNull(), "first").when(F.col("a_").isNull(), "second").otherwise("both").alias("side"))


def outcome_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for two scored panels: shared keys, those whose labels and dates agree exactly, and those in a wrong order of dates."""
    cols = ["label", "formation_session", "entry_date", "exit_date"]
    both = a.select(*KEY, *(F.col(c).alias(f"a_{c}") for c in cols)).join(b.select(*KEY, *(F.col(c).alias(f"b_{c}") for c in cols)), KEY)
    same = finite(F.col("a_label"))
    for c in cols:
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    order = (F.col("a_formation_session") <= F.col("a_entry_date")) & (F.col("a_entry_date") < F.col("a_exit_date"))
    return both.agg(F.count("*").alias("n_common"), F.count(F.when(same, 1)).alias("n_identical"), F.count(F.when(~order, 1)).alias("n_wrong_order"))


@dataclass(frozen=True)
class Layer:
    name: str
    pit_ic: float | None
    restated_ic: float | None
    n_dates: int

    @property
    def gap(self) -> float | None:
        return None if self.pit_ic is None or self.restated_ic is None else self.restated_ic - self.pit_ic


def mean_ic(scored: DataFrame) -> DataFrame:
    return protocol.information_coefficient(scored).agg(F.avg("ic").alias("ic"), F.count("*").alias("n")).select("ic", "n")


def layers(t: Tables, dates: DataFrame, factor_id: str, bars: DataFrame, members: DataFrame | None = None, least: int = 10, **how) -> list[Layer]:
    """Mean rank correlations of both arms.

    original_process: each arm as it is. common_observation: each arm cleaned alone, scored on shared keys.
    common_support: both cut to shared keys first, then cleaned and scored.
    """
    f = REGISTRY[factor_id]
    arms = [f.compute(t, dates, arm=arm, **how) for arm in ("pit", "restated")]
    if members is not None:
        arms = [panel.gate(a, members) for a in arms]
    arms = [kept(a.select(*VALUES)) for a in arms]  # read for each arm alone and for both sides of the shared keys
    clean = lambda v: panel.scored(panel.labelled(panel.cleaned(v, t.securities, least).select(*KEY, "value"), bars))
    own = [kept(clean(a)) for a in arms]
    found = []
    for name, pair in (("original_process", own), ("common_observation", common(*own)), ("common_support", [clean(a) for a in common(*arms)])):
        rows = [mean_ic(p).first() for p in pair]  # one row each
        found.append(Layer(name, rows[0]["ic"], rows[1]["ic"], min(rows[0]["n"], rows[1]["n"])))
    return found


def compare(t: Tables, dates: DataFrame, factor_id: str, bars: DataFrame, **how) -> dict:
    """The layers with a verdict on the last one's gap; signals that read no facts have none."""
    if not REGISTRY[factor_id].uses_facts:
        return {"factor_id": factor_id, "verdict": audit.verdict(False, 0, False, None), "layers": []}
    found = layers(t, dates, factor_id, bars, **how)
    last = found[-1]
    return {"factor_id": factor_id, "verdict": audit.verdict(True, last.n_dates, False, last.gap), "layers": found}
