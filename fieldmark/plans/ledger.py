"""Closing-line value, allocation, reconciliation, validation: plans over a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import odds
from ..operators.core import asof_join


#: Spans of time that a market's quotes are cut into, so that a hot market is no task's burden.
SPANS = 32


def closing_line_value(wagers: DataFrame, quotes: DataFrame, stale_hours: int = 4) -> DataFrame:
    """Each wager with its closing quote, clv = bet probability - closing probability, and how fresh the close is."""
    got = asof_join(wagers, quotes, ["market"], "close_at", "observed_at", ["quote_id", "price", "observed_at"], parts=SPANS)
    old = F.col("close_at") - F.col("observed_at") > F.make_dt_interval(hours=F.lit(stale_hours))
    close = odds.implied(F.col("price"))
    fresh = F.when(F.col("quote_id").isNull(), "missing").when(old, "stale").otherwise("fresh")
    return got.withColumns({"closing_prob": close, "clv": F.col("bet_prob") - close, "freshness": fresh})


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, else 'approved'."""
    out = F.lit("approved")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def allocate(bets: DataFrame, day: str, order: list, stake: Column, budget: float, least: float) -> DataFrame:
    """Stakes by day in order until the budget is used: the stake that crosses it gets the rest if that is ``least`` or more, later ones nothing."""
    w = Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = bets.withColumn("_stake", stake).withColumn("_run", F.sum("_stake").over(w))
    rest = budget - (F.col("_run") - F.col("_stake"))
    given = F.when(F.col("_run") <= budget, F.col("_stake")).when(rest >= least, rest).otherwise(0.0)
    return run.withColumn("allocated", given).drop("_stake", "_run")


def duplicates(bets: DataFrame, days: int = 3) -> DataFrame:
    """The bets that an earlier one (by day and id) makes duplicates: one on the same base market at any time, or on the same market and side within ``days``.

    The base market is the ticker without its side.  The two rules have keys of
    their own, so each is a pass of its own with a look at the row before; a bet
    that both hit comes once.  No pair of bets is built.
    """
    base = F.regexp_replace("ticker", r"-([A-Z]{2,3}|HOME|DRAW|AWAY)$", "")
    before = lambda *keys: Window.partitionBy(*keys).orderBy("placed_date", "bet_id")
    again = bets.withColumn("_base", base).where(F.col("_base").isNotNull()).withColumn("_first", F.row_number().over(before("sport", "_base"))).where("_first > 1").select(*bets.columns)
    gap = F.date_diff("placed_date", F.lag("placed_date").over(before("sport", "market", "side")))
    soon = bets.withColumn("_gap", gap).where(F.col("_gap") <= days).select(*bets.columns)
    return again.unionByName(soon).dropDuplicates(["bet_id"])


def reconcile(local: DataFrame, remote: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each field that differs (both null is equal), and one for each key of remote only."""
    a = local.select(F.col(key), F.lit(True).alias("_here"), *[F.col(f).cast("string").alias(f"_a_{f}") for f in fields])
    b = remote.select(F.col(key), F.lit(True).alias("_there"), *[F.col(f).cast("string").alias(f"_b_{f}") for f in fields])
    both = a.join(b, key, "full_outer")
    diff = F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_a_{f}").alias("old_value"), F.col(f"_b_{f}").alias("new_value"))) for f in fields])
    changed = both.where("_here and _there").select(key, F.explode(F.filter(diff, lambda x: x.isNotNull())).alias("d")).select(key, F.lit("changed").alias("kind"), "d.*")
    null = F.lit(None).cast("string")
    return changed.unionByName(both.where("_here is null").select(key, F.lit("insert").alias("kind"), null.alias("field"), null.alias("old_value"), null.alias("new_value")))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with ``errors``: the codes of the rules that a row breaks; one pass, whatever the number of rules."""
    return df.withColumn("errors", F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules.items()]), lambda x: x.isNotNull()))
