"""Twelve-month flows as states: what is known of a company changes on the days of its filings, and on no others.

Facts are dealt once by company and tag and sorted by the day on which each can be seen. One pass keeps the visible
reports of the current company and tag, changes what a filing touches, and returns a row for each day on which the flow
changed, with the day of the next change. Only these rows are handed out to signal dates, without a shuffle, so what is
shuffled does not grow with the number of dates. A worker holds the reports of one company and tag at a time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import TIES, handed_out, known_on, restated

QUARTER, YEAR, GAP = (45, 130), (300, 430), (60, 130)


class Flow:
    """The visible reports of one company and tag; days are numbers."""

    def __init__(self) -> None:
        self.spans: dict[int, dict[int, tuple[float, int]]] = {}  # by start and end: value and filing day
        self.ends: dict[int, list[int]] = {}  # by start, in order
        self.quarters: dict[int, dict[int, tuple[int, int, float]]] = {}  # by end and start: rank, filing day, flow
        self.closed: list[int] = []  # ends of quarters, in order
        self.years: list[tuple[int, int, int, float]] = []  # end, filing day, start, value, in order

    def put(self, start: int, end: int, value: float | None, filed: int) -> None:
        """The newest filing of a report; without a value the report is gone."""
        span, ends = self.spans.setdefault(start, {}), self.ends.setdefault(start, [])
        old = span.pop(end, None)
        annual = YEAR[0] <= end - start <= YEAR[1]
        if old is not None and annual:
            del self.years[bisect_left(self.years, (end, old[1], start, old[0]))]
        if value is None:
            if old is not None:
                del ends[bisect_left(ends, end)]
        else:
            span[end] = (value, filed)
            if old is None:
                insort(ends, end)
            if annual:
                insort(self.years, (end, filed, start, value))
        at = bisect_left(ends, end)
        if value is None:
            self._quarter(start, end, None)
        for i in (at, at + 1):  # the report, and the one that is counted from it
            if i < len(ends):
                self._quarter(start, ends[i], ends[i - 1] if i else None)

    def _quarter(self, start: int, end: int, before: int | None) -> None:
        """A report less the one before it of the same start, if that leaves a quarter."""
        held = self.quarters.setdefault(end, {})
        had = bool(held)
        held.pop(start, None)
        found = self.spans[start].get(end)
        if found is not None and QUARTER[0] <= end - (start if before is None else before) <= QUARTER[1]:
            held[start] = (0 if end - start <= QUARTER[1] else 1, found[1], found[0] - (0.0 if before is None else self.spans[start][before][0]))
        if bool(held) != had:
            if had:
                del self.closed[bisect_left(self.closed, end)]
            else:
                insort(self.closed, end)

    def value(self) -> float | None:
        """Four quarters in a row, or else the newest year."""
        last = self.closed[-4:]
        if len(last) == 4 and all(GAP[0] <= b - a <= GAP[1] for a, b in zip(last, last[1:])):
            return sum(min((rank, filed, start, flow) for start, (rank, filed, flow) in self.quarters[e].items())[3] for e in last)
        return self.years[-1][3] if self.years else None


def flow_states(facts: DataFrame, arm: str = "pit", caller: str = "flow_states") -> DataFrame:
    """cik, tag, day, until, value: the twelve-month flow from each day on which it changed up to the next; null: there is none."""
    rows = restated(facts.filter("filed IS NOT NULL"), caller) if arm == "restated" else facts
    rows = rows.withColumn("day", known_on(arm)).filter("day IS NOT NULL AND filed IS NOT NULL AND period_end >= period_start")
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).alias(c)
    order = ("cik", "tag", "day", "filed", *TIES)
    dealt = rows.repartition("cik", "tag").sortWithinPartitions(*order)
    dealt = dealt.select("cik", "tag", number("day"), number("period_start"), number("period_end"), number("filed"), F.col("value").cast("double").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, flow, day, since, last = None, Flow(), None, None, None
        out: list[tuple] = []

        def settle() -> None:
            """The day is over: its flow counts from here, if it is another one."""
            nonlocal since, last
            now = flow.value()
            if day is not None and now != last:
                if since is not None:
                    out.append((*key, since, day, last))
                since, last = day, now

        def leave() -> None:
            nonlocal since, last
            settle()
            if since is not None:
                out.append((*key, since, None, last))
            since = last = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cik", "tag", "day", "until", "value"])

        for batch in batches:
            for cik, tag, at, start, end, filed, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cik, tag) != key:
                    if key is not None:
                        leave()
                    key, flow, day = (cik, tag), Flow(), at
                elif at != day:
                    settle()
                    day = at
                flow.put(start, end, None if value is None or value != value else value, filed)
            yield batch_of(out)
            out.clear()
        if key is not None:
            leave()
            yield batch_of(out)

    states = dealt.mapInArrow(run, "cik string, tag string, day int, until int, value double")
    as_day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c)).alias(c)
    return states.select("cik", "tag", as_day("day"), as_day("until"), "value")


def ttm(facts: DataFrame, dates: DataFrame, lag: int = 2, arm: str = "pit", caller: str = "ttm") -> DataFrame:
    """cik, tag, signal_date, value: flow of the trailing twelve months, from what was visible.

    Reports that accumulate within a year are differenced within their start; of one period end the span of a
    quarter report counts before that of a longer one, then the earlier filing. Four quarters in a row are summed;
    else the newest report of about a year counts; else there is none.
    """
    states = flow_states(facts, arm, caller).filter("value IS NOT NULL")
    return handed_out(states, dates, lag, "day", "until").select("cik", "tag", "signal_date", "value")
