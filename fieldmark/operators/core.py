"""Primitives that the domain operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_by(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key by ``order``; give a unique last term for a stable result."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, take: list[str], strict: bool = False, prefix: str = "", rank: Column | None = None, parts: int = 1,
    prefer: list[Column] | None = None, untimed: bool = False, tiers: list[Column] | None = None, ties: str | None = None,
) -> DataFrame:
    """left with the columns ``take`` of right's newest row of the same keys at or before left_ts (before it, if strict).

    Both sides go through one exchange and one sort on (keys, time): no pair of
    rows is ever built, however many quotes a key has.  rank (ascending, over
    right's columns) settles rows of the same time, then ``prefer`` (greater
    first).

    untimed: rows of right without a time count as older than all others, and a
    row of left without a time takes the newest of all.  Otherwise the former
    are left out and the latter find nothing.

    tiers: conditions over right's columns; a row of an earlier tier goes before
    any of a later one, whatever their times (rows of no tier are left out).
    Each tier's newest row is carried through the same sort.

    ties: the name of a column for the number of rows of right, of any tier,
    that share the time of the one found.

    parts: into how many spans of time a key's rows are cut, for keys that may
    hold a large part of all rows.  Each span is a task's work of its own, and
    gets the newest rows of the spans before it from a table of a row a span.
    """
    tiers = tiers or [F.lit(True)]
    got = [f"_r{i}" for i in range(len(tiers))]
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    order = F.struct((-(F.lit(0) if rank is None else rank)).cast("double").alias("r"), *[c.alias(f"p{i}") for i, c in enumerate(prefer or [])])
    row = F.struct(*[F.col(c) for c in take])
    late = F.col(left_ts).isNull() if untimed else F.lit(False)
    a = left.select(*keyed, late.alias("_late"), F.col(left_ts).alias("_t"), F.lit(1 if not strict else -1).alias("_side"), F.struct(*left.columns).alias("_l"))
    b = (right if untimed else right.where(F.col(right_ts).isNotNull())).select(*keyed, F.lit(False).alias("_late"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), order.alias("_rank"), *[F.when(c, row).alias(g) for c, g in zip(tiers, got, strict=True)])
    if parts > 1:
        cuts = F.broadcast(b.agg(F.percentile_approx("_t", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(1000)).alias("_cuts")))  # one row
        at = F.when(F.col("_late"), parts - 1).otherwise(F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c < F.col("_t"))))
        a, b = (x.crossJoin(cuts).withColumn("_span", at).drop("_cuts") for x in (a, b))
    span = ["_span"] if parts > 1 else []
    both = a.unionByName(b, allowMissingColumns=True)
    if ties:
        peers = F.count(F.when(F.col("_side") == 0, 1)).over(Window.partitionBy(*names, *span).orderBy("_late", "_t").rangeBetween(Window.currentRow, Window.currentRow))
        both = both.withColumn("_n", peers).withColumns({g: F.when(F.col(g).isNotNull(), F.struct(F.col(g).alias("row"), F.col("_n").alias("n"))) for g in got})
        b = both.where("_l is null")
    w = Window.partitionBy(*names, *span).orderBy("_late", "_t", "_side", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumns({g: F.last(g, ignorenulls=True).over(w) for g in got}).where("_l is not null")
    if parts > 1:
        newest = F.struct("_t", "_rank")
        last = b.groupBy(*names, "_span").agg(*[F.max_by(g, F.when(F.col(g).isNotNull(), newest)).alias(g) for g in got])
        by_span = Window.partitionBy(*names).orderBy("_span")
        ahead = last.withColumns({g: F.last(g, ignorenulls=True).over(by_span.rowsBetween(Window.unboundedPreceding, 0)) for g in got})
        ahead = ahead.withColumn("_until", F.coalesce(F.lead("_span").over(by_span), F.lit(parts)))
        # a row a span to come, up to and with the next that has rows of its own
        carried = ahead.select(*[F.col(n).alias(f"{n}_") for n in names], *[F.col(g).alias(f"{g}_") for g in got], F.explode(F.when(F.col("_until") > F.col("_span"), F.sequence(F.col("_span") + 1, "_until"))).alias("_span_"))
        same = F.col("_span") == F.col("_span_")
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
        held = held.join(carried, same, "left").withColumns({g: F.coalesce(g, f"{g}_") for g in got})
    found = held.withColumn("_r", F.coalesce(*got))
    if ties:
        return found.select("_l.*", *[F.col(f"_r.row.{c}").alias(prefix + c) for c in take], F.col("_r.n").alias(ties))
    return found.select("_l.*", *[F.col(f"_r.{c}").alias(prefix + c) for c in take])


def decayed_sum(value: Column, day: Column, days: int, half_life: float, keys: list[str]) -> Column:
    """Sum over the ``days`` days before a row's, a value halving every ``half_life`` days; up to a factor that two such sums of a row share.

    A weight counts from the start of its block of ``days`` days, so it stays
    between 1 and 2^(days / half_life) whatever the date; a frame lies in a
    row's own block and the one before it, whose sums are told apart by parity.
    """
    block = F.floor(day / days)
    weight = F.pow(F.lit(2.0), (day - block * days) / half_life)
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-days, -1)
    even, odd = (F.coalesce(F.sum(F.when(F.pmod(block, F.lit(2)) == p, weight * value)).over(w), F.lit(0.0)) for p in (0, 1))
    own = F.pmod(block, F.lit(2)) == 0
    earlier = 0.5 ** (days / half_life)
    return even * F.when(own, 1.0).otherwise(earlier) + odd * F.when(own, earlier).otherwise(1.0)  # each sum stands here once, as Spark works out each mention


def counted_before(values: DataFrame, value: str, weight: str, parts: int = 64) -> DataFrame:
    """values (a row a value, no nulls) with ``before``, the weight of all smaller values.

    Approximate quantiles part the values into ranges, which are sorted side by
    side; only the ranges' sums, ``parts`` rows, stand in one order.  The
    result is exact wherever the cuts fall.
    """
    cuts = values.agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(1000)).alias("_cuts"))
    binned = values.crossJoin(F.broadcast(cuts)).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy("_bin").agg(F.sum(weight).alias("_sum"))
    base = sums.select("_bin", F.coalesce(F.sum("_sum").over(earlier(Window.orderBy("_bin"))), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(weight).over(earlier(Window.partitionBy("_bin").orderBy(value))), F.lit(0))
    return binned.withColumn("_within", within).join(F.broadcast(base), "_bin").withColumn("before", F.col("_base") + F.col("_within")).drop("_bin", "_within", "_base")


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row with the array ``q`` of exact quantiles, interpolated linearly between neighbours; nulls don't count."""
    g = counted_before(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), value, "n")
    total = g.agg(F.sum("n").alias("total"))
    g = g.crossJoin(F.broadcast(total))

    def at(rank):
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col(value)))

    found = []
    for share in shares:
        place = share * (F.col("total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        found.append(low + (high - low) * F.max(place - F.floor(place)))
    return g.agg(F.array(*found).alias("q"))


def unpivot_sides(games: DataFrame) -> DataFrame:
    """Two rows a game, one for each team."""
    side = lambda team, other, mine, theirs, home: F.struct(
        F.col(team).alias("team"), F.col(other).alias("opponent"), F.col(mine).alias("points_for"), F.col(theirs).alias("points_against"), F.lit(home).alias("is_home")
    )
    both = F.explode(F.array(side("home", "away", "home_score", "away_score", True), side("away", "home", "away_score", "home_score", False)))
    return games.select("game_id", "league", "game_date", "status", both.alias("s")).select("game_id", "league", "game_date", "status", "s.*")


def close_versions(df: DataFrame, keys: list[str], at: str, *values: Column) -> DataFrame:
    """Slowly changing rows: only changes of any of the values stay, each valid until the next."""
    w = Window.partitionBy(*keys).orderBy(at)
    changed = df.withColumn("_v", F.struct(*values)).withColumn("_p", F.lag("_v").over(w)).where(F.col("_p").isNull() | ~F.col("_v").eqNullSafe(F.col("_p")))
    return changed.drop("_v", "_p").withColumn("valid_to", F.lead(at).over(w))


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """base with updates laid over it: of each key the row with the highest version."""
    return latest_by(base.unionByName(updates), keys, F.col(version).desc_nulls_last())


def tiered(first: Column, *more: Column) -> Column:
    return F.coalesce(first, *more)


def bins(p: Column, n: int = 10) -> Column:
    return F.least(F.floor(p * n), F.lit(n - 1)).cast("int")
