"""A run's findings as one JSON-safe bundle, and its text. Only aggregates of a few rows come here."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import textwrap
from pathlib import Path

from pyspark.sql import DataFrame

from tidemark.operators import audit, guards, panel, protocol
from tidemark.operators.factors import REGISTRY
from tidemark.sources.tables import Tables

WIDTH = 84
STATUS = {"ValueError": "INVALID_INPUT", "EmptyFactorError": "EMPTY", "ImplausibleMagnitudeError": "IMPLAUSIBLE", "AnalysisException": "INVALID_PLAN"}


def status_of(e: Exception) -> str:
    """A failure by its kind; a guard in a plan tells by its reason whether there was no value at all."""
    if type(e).__name__ == "SparkRuntimeException" and "USER_RAISED_EXCEPTION" in str(e):
        return "EMPTY" if any(reason in str(e) for reason in (guards.BLANK, guards.NOTHING)) else "INVALID_INPUT"
    return STATUS.get(type(e).__name__, "FAILED")


def safe(x):
    """Plain values: what is not finite is null, days are ISO texts."""
    if isinstance(x, dict):
        return {str(k): safe(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [safe(v) for v in x]
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x.isoformat() if isinstance(x, dt.date) else x


def one(df: DataFrame) -> dict:
    return df.first().asDict(recursive=True)


def factor_report(factor_id: str, t: Tables, dates: DataFrame, bars: DataFrame, members: DataFrame, least: int = 10, bins: int = 5, **how) -> dict:
    """Counts and scores of one signal; a failure is recorded, not raised, so that other signals go on."""
    f = REGISTRY[factor_id]
    try:
        raw = guards.not_empty(f.compute(t, dates, **how))
        gated = panel.gate(raw, members)
        bounds = audit.enforced(gated, list(f.rules))
        clean = panel.cleaned(gated, t.securities, least)
        lab = panel.labelled(clean.select("ticker", "signal_date", "value"), bars)
        p = panel.scored(lab)
        q = protocol.quantile_returns(p, bins)
        slope = one(protocol.newey_west(protocol.slopes(p), "slope"))
        return safe(
            {
                "factor_id": factor_id,
                "status": "OK",
                "plausibility": bounds,
                "cleaning": one(panel.cleaning_report(gated, clean, least)),
                "outcomes": {r["outcome"]: r["n_rows"] for r in panel.attrition(lab).collect()},
                "breadth": one(protocol.breadth(q)),
                "summary": one(protocol.summary(protocol.information_coefficient(p), protocol.long_short(q, bins))),
                "monotonicity": one(protocol.monotonicity(q)),
                "slope": slope | {"p": protocol.normal_p(slope["nw_t"])},
            }
        )
    except Exception as e:
        return {"factor_id": factor_id, "status": status_of(e), "detail": str(e).splitlines()[0][:200] if str(e) else type(e).__name__}


def bundle(t: Tables, dates: DataFrame, bars: DataFrame, factor_ids: list[str], config: dict, **how) -> dict:
    """All reports with the data they are about; config_hash names the run."""
    members = panel.membership(t.securities, dates)
    takes = lambda i: how if REGISTRY[i].uses_facts else {}
    return {
        "config": safe(config),
        "config_hash": hashlib.sha256(json.dumps(safe(config), sort_keys=True).encode()).hexdigest(),
        "disclosure": safe(one(audit.disclosure_summary(t.facts))),
        "universe": safe(one(audit.frame_hash(members, ["ticker", "signal_date"]))),
        "factors": [factor_report(i, t, dates, bars, members, **takes(i)) for i in factor_ids],
    }


def render(found: dict) -> str:
    """A pure function of the bundle: no line is wider than WIDTH. [B] marks scores with three names or fewer in a bin, [B?] an unknown breadth."""
    lines = [f"run {found['config_hash'][:12]}", ""]
    for k, v in sorted(found["disclosure"].items()):
        lines.append(f"{k:<40}{v:>12}")
    lines.append("")
    for f in found["factors"]:
        if f["status"] != "OK":
            lines += textwrap.wrap(f"{f['factor_id']}: {f['status']} {f.get('detail', '')}", WIDTH)
            continue
        s, thin = f["summary"], f["breadth"].get("thin")
        mark = " [B?]" if thin is None else " [B]" if thin else ""
        number = lambda x: "n/a" if x is None else f"{x:+.4f}"
        lines += textwrap.wrap(f"{f['factor_id']:<16} ic {number(s['ic_mean'])} ls {number(s['ls_mean'])} t {number(f['slope']['nw_t'])} names {f['cleaning']['n_output']}{mark}", WIDTH)
    return "\n".join(lines) + "\n"


def write(found: dict, folder: str) -> None:
    """report.json and report.txt with plain line ends."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    (path / "report.json").write_text(json.dumps(found, indent=1, sort_keys=True) + "\n", newline="\n")
    (path / "report.txt").write_text(render(found), newline="\n")


def replay(folder: str) -> str:
    """The text of a saved bundle, without any computation."""
    return render(json.loads((Path(folder) / "report.json").read_text()))
