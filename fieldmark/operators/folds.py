"""Rows of a key in order, each decided by what the ones before it have used up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold_rows(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], told: str) -> DataFrame:
    """df with the columns ``told`` that a state's ``step(row)`` gives each row, its key's rows in order.

    A key is one partition's work, streamed past in batches: memory holds a batch and one state.
    """
    names = [c.split()[0] for c in told.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + told

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for b in batches:
            out = []
            for here, row in zip(zip(*(b[k] for k in keys), strict=True), b.itertuples(index=False), strict=True):
                if here != key:
                    key, state = here, start()
                out.append(state.step(row))
            yield b.assign(**{n: [o[i] for o in out] for i, n in enumerate(names)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


@dataclass(frozen=True)
class Limits:
    """What bets of a day may come to."""

    bankroll: float = 1000.0
    fraction: float = 0.25  # of the Kelly stake
    least: float = 2.0
    most: float = 50.0
    single: float = 0.05  # of the bankroll
    day: float = 120.0
    sport: float = 60.0
    event: float = 55.0

    def stake(self, kelly: Column) -> Column:
        """The stake asked for: fractional Kelly, the least stake without an edge, within bounds."""
        asked = F.when(kelly > 0, self.bankroll * kelly * self.fraction).otherwise(self.least)
        return F.least(F.lit(self.bankroll * self.single), F.greatest(F.lit(self.least), F.least(F.lit(self.most), asked)))


@dataclass
class Day:
    """A day's budget under the caps of its sports and events; once it is used up nothing more is looked at."""

    limits: Limits
    total: float = 0.0
    over: bool = False
    sports: dict = field(default_factory=dict)
    events: dict = field(default_factory=dict)

    def step(self, row) -> tuple[float, str | None]:
        have, asked = self.limits, row.asked
        if self.over:
            return 0.0, "not_considered"
        if self.sports.get(row.sport, 0.0) + asked > have.sport:
            return 0.0, "concentration_breach"
        if self.events.get(row.event, 0.0) + asked > have.event:
            return 0.0, "event_breach"
        reason = None
        if self.total + asked > have.day:
            asked, reason = have.day - self.total, "remaining_budget_downgrade"
            if asked < have.least:
                self.over = True
                return 0.0, "remaining_budget_breach"
        self.total += asked
        self.sports[row.sport] = self.sports.get(row.sport, 0.0) + asked
        self.events[row.event] = self.events.get(row.event, 0.0) + asked
        self.over = self.total >= have.day
        return asked, reason


def allocate_kelly(bets: DataFrame, limits: Limits) -> DataFrame:
    """bets (bet_id, day, sport, event, kelly, value) with place, asked, approved and reason.

    The best bet of each sport comes first, by value, then all others by value;
    ties go by bet_id.  Caps of day, sport and event hold at once, so what a bet
    gets depends on each one before it: a fold by day.
    """
    seat = F.row_number().over(Window.partitionBy("day", "sport").orderBy(F.col("value").desc(), "bet_id")) == 1
    ordered = bets.withColumn("_seat", seat).withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.col("_seat").desc(), F.col("value").desc(), "bet_id"))).drop("_seat")
    return fold_rows(ordered.withColumn("asked", limits.stake(F.col("kelly"))), ["day"], ["place"], lambda: Day(limits), "approved double, reason string")


def allocation_sql(bets: str, have: Limits) -> str:
    """The same as recursive SQL: a bet of every day a step."""
    real = lambda x: f"{float(x)!r}e0"
    used = lambda name: f"coalesce(list_sum([x.v FOR x IN taken IF x.{name} = {name}]), 0)"
    return f"""WITH RECURSIVE b AS ({bets}), s AS (SELECT *, row_number() OVER (PARTITION BY day, sport ORDER BY value DESC, bet_id) = 1 AS seat FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY seat DESC, value DESC, bet_id) AS place,
  least({real(have.bankroll * have.single)}, greatest({real(have.least)}, least({real(have.most)}, CASE WHEN kelly > 0 THEN {real(have.bankroll)} * kelly * {real(have.fraction)} ELSE {real(have.least)} END))) AS asked FROM s),
f(day, place, bet_id, asked, approved, reason, total, stopped, taken) AS (
SELECT DISTINCT day, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0.0e0, 0.0e0, CAST(NULL AS VARCHAR), 0.0e0, false, CAST([] AS STRUCT(sport VARCHAR, event BIGINT, v DOUBLE)[]) FROM o
UNION ALL
SELECT day, place, bet_id, asked, approved, reason, total + approved, stopped OR reason IS NOT DISTINCT FROM 'remaining_budget_breach' OR total + approved >= {real(have.day)},
  CASE WHEN approved > 0 THEN list_append(taken, {{'sport': sport, 'event': event, 'v': approved}}) ELSE taken END
FROM (SELECT *, CASE WHEN reason IS NULL THEN asked WHEN reason = 'remaining_budget_downgrade' THEN {real(have.day)} - total ELSE 0.0e0 END AS approved
FROM (SELECT o.*, f.total, f.stopped, f.taken, CASE WHEN f.stopped THEN 'not_considered' WHEN {used('sport')} + o.asked > {real(have.sport)} THEN 'concentration_breach' WHEN {used('event')} + o.asked > {real(have.event)} THEN 'event_breach'
  WHEN f.total + o.asked > {real(have.day)} THEN CASE WHEN {real(have.day)} - f.total < {real(have.least)} THEN 'remaining_budget_breach' ELSE 'remaining_budget_downgrade' END END AS reason
FROM f JOIN o ON o.day = f.day AND o.place = f.place + 1)))"""
