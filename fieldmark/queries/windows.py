"""Window functions: rolling features, ranks, drawdown, slowly changing rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..operators.core import asof_join, close_versions, decayed_sum, quantiles, unpivot_sides
from ..operators.versions import VersionTable
from ..plans.ledger import SPANS
from ..sources.shared import shared_path
from . import query

SIDES = "WITH s AS (SELECT game_id, league, home AS team, away AS opponent, game_date, home_score AS f, away_score AS a FROM games UNION ALL SELECT game_id, league, away, home, game_date, away_score, home_score FROM games)"


def team_games(t):
    return unpivot_sides(t.games).withColumn("w", (F.col("points_for") > F.col("points_against")).cast("double"))


def order(*more):
    return Window.partitionBy("league", "team").orderBy("game_date", "game_id", *more)


@query("wn_rank", "SELECT league, home AS team, CAST(rank() OVER (PARTITION BY league ORDER BY max(home_score) DESC, home) AS INTEGER) AS place FROM games GROUP BY 1, 2")
def _(t):
    g = t.games.groupBy("league", F.col("home").alias("team")).agg(F.max("home_score").alias("m"))
    return g.select("league", "team", F.rank().over(Window.partitionBy("league").orderBy(F.col("m").desc(), "team")).alias("place"))


@query("wn_row_number_latest", "SELECT market, bet_id FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY placed_date DESC, bet_id DESC) AS k FROM bets) WHERE k = 1")
def _(t):
    w = Window.partitionBy("market").orderBy(F.col("placed_date").desc(), F.col("bet_id").desc())
    return t.bets.withColumn("k", F.row_number().over(w)).where("k = 1").select("market", "bet_id")


WINDOWS, SPLITS = (7, 14, 30), {"all": "TRUE", "left": "batter % 2 = 0", "right": "batter % 2 = 1", "starter": "pitcher % 3 > 0", "relief": "pitcher % 3 = 0"}
_DAYS = ", ".join(f"count(*) FILTER (WHERE {on}) AS n_{s}, sum(velocity) FILTER (WHERE {on}) AS v_{s}" for s, on in SPLITS.items())
_ROLLED = ", ".join(f"CAST(coalesce(sum(n_{s}) OVER w{w}, 0) AS BIGINT) AS n_{s}_{w}, round(CASE WHEN sum(n_{s}) OVER w{w} > 0 THEN sum(v_{s}) OVER w{w} / sum(n_{s}) OVER w{w} END, 6) AS velocity_{s}_{w}" for w in WINDOWS for s in SPLITS)
_FRAMES = ", ".join(f"w{w} AS (PARTITION BY pitcher ORDER BY game_date RANGE BETWEEN INTERVAL {w} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)" for w in WINDOWS)


@query("wn_rolling_days", f"WITH d AS (SELECT pitcher, game_date, {_DAYS} FROM pitches GROUP BY 1, 2) SELECT pitcher, game_date, {_ROLLED} FROM d WINDOW {_FRAMES}")
def _(t):
    """Windows [day - w, day) over day sums, for all batters, either hand and either role; one exchange, one sort."""
    sums = [f.alias(f"{c}_{s}") for s, on in SPLITS.items() for c, f in (("n", F.count(F.when(F.expr(on), 1))), ("v", F.sum(F.when(F.expr(on), F.col("velocity")))))]
    d = t.pitches.groupBy("pitcher", "game_date").agg(*sums)
    out = []
    for days in WINDOWS:
        w = Window.partitionBy("pitcher").orderBy(F.unix_date("game_date")).rangeBetween(-days, -1)
        for s in SPLITS:
            n = F.coalesce(F.sum(f"n_{s}").over(w), F.lit(0).cast("bigint"))
            out += [n.alias(f"n_{s}_{days}"), F.round(F.try_divide(F.sum(f"v_{s}").over(w), n), 6).alias(f"velocity_{s}_{days}")]
    return d.select("pitcher", "game_date", *out)


@query("wn_decay_avg", """WITH d AS (SELECT pitcher, game_date, avg(velocity) AS v FROM pitches GROUP BY 1, 2)
SELECT a.pitcher, a.game_date, round(sum(b.v * exp(-ln(2) * date_diff('day', b.game_date, a.game_date) / 30.0)) / sum(exp(-ln(2) * date_diff('day', b.game_date, a.game_date) / 30.0)), 6) AS decayed
FROM d a JOIN d b ON a.pitcher = b.pitcher AND b.game_date >= a.game_date - 90 AND b.game_date < a.game_date GROUP BY 1, 2""")
def _(t):
    """exp decay is a ratio of sums: what the later day weighs cancels out, so one ordered window does without a self-join."""
    d = t.pitches.groupBy("pitcher", "game_date").agg(F.avg("velocity").alias("v")).where("v is not null")
    total = lambda x: decayed_sum(x, F.unix_date("game_date"), 90, 30.0, ["pitcher"])
    out = d.select("pitcher", "game_date", F.round(F.try_divide(total(F.col("v")), total(F.lit(1.0))), 6).alias("decayed"))
    return out.where("decayed is not null")


@query("wn_last_n_form", SIDES + """ SELECT game_id, team, round(coalesce(avg(CASE WHEN f > a THEN 1.0e0 ELSE 0.0e0 END) OVER w, 0.5), 6) AS form, round(coalesce(avg(f) OVER w, 80), 6) AS scored FROM s WINDOW w AS (PARTITION BY league, team ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def _(t):
    w = order().rowsBetween(-5, -1)
    return team_games(t).select("game_id", "team", F.round(F.coalesce(F.avg("w").over(w), F.lit(0.5)), 6).alias("form"), F.round(F.coalesce(F.avg("points_for").over(w), F.lit(80.0)), 6).alias("scored"))


@query("wn_last_n_form_now", SIDES + """, r AS (SELECT league, team, CASE WHEN f > a THEN 1.0e0 ELSE 0.0e0 END AS w, row_number() OVER (PARTITION BY league, team ORDER BY game_date DESC, game_id DESC) AS k FROM s)
SELECT league, team, round(least(greatest((avg(w) - 0.5) * 40, -50), 50), 6) AS adjustment FROM r WHERE k <= 10 GROUP BY 1, 2""")
def _(t):
    w = Window.partitionBy("league", "team").orderBy(F.col("game_date").desc(), F.col("game_id").desc())
    r = team_games(t).withColumn("k", F.row_number().over(w)).where("k <= 10")
    return r.groupBy("league", "team").agg(F.round(F.least(F.greatest((F.avg("w") - 0.5) * 40, F.lit(-50.0)), F.lit(50.0)), 6).alias("adjustment"))


@query("wn_rest_days", SIDES + """ SELECT game_id, team, CASE WHEN lag(game_date) OVER w IS NULL THEN 2 ELSE CAST(least(greatest(date_diff('day', lag(game_date) OVER w, game_date) - 1, 0), 7) AS INTEGER) END AS rest FROM s WINDOW w AS (PARTITION BY league, team ORDER BY game_date, game_id)""")
def _(t):
    gap = F.date_diff("game_date", F.lag("game_date").over(order())) - 1
    return team_games(t).select("game_id", "team", F.coalesce(F.when(gap.isNotNull(), F.least(F.greatest(gap, F.lit(0)), F.lit(7))), F.lit(2)).alias("rest"))


@query("wn_peak_drawdown", """SELECT strftime(hour, '%Y-%m-%d %H') AS hour, round(max(volume) OVER w, 4) AS peak, round(max(volume) OVER w - volume, 4) AS drawdown, CASE WHEN volume < max(volume) OVER w * 0.5 THEN 'deep' ELSE 'ok' END AS state FROM snapshots WINDOW w AS (ORDER BY hour ROWS UNBOUNDED PRECEDING)""")
def _(t):
    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)  # an hourly series: one row an hour
    peak = F.max("volume").over(w)
    return t.snapshots.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.round(peak, 4).alias("peak"), F.round(peak - F.col("volume"), 4).alias("drawdown"), F.when(F.col("volume") < peak * 0.5, "deep").otherwise("ok").alias("state"))


#: Wagers that were won, with what each paid and when.
WON = "SELECT close_at AS at, stake AS paid FROM wagers WHERE wager_id % 3 = 0"


@query("wn_balance_delta", f"""WITH b AS (SELECT hour, volume, lag(hour) OVER (ORDER BY hour) AS since, volume - lag(volume) OVER (ORDER BY hour) AS up FROM snapshots),
x AS (SELECT b.*, (SELECT coalesce(sum(paid), 0) FROM ({WON}) w WHERE w.at > b.since AND w.at <= b.hour) AS won FROM b)
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, round(up, 4) AS rise, round(won, 4) AS won, round(up - won, 4) AS deposit FROM x WHERE up > 0 AND up > won + 0.01""")
def _(t):
    """What a balance rose by beyond the wins since the snapshot before: wins of an hour are one row, and a running sum tells those of any interval."""
    ends = F.date_trunc("hour", F.col("close_at") + F.expr("INTERVAL '1' HOUR") - F.expr("INTERVAL '0.000001' SECOND"))  # the first full hour at or after
    paid = t.wagers.where("wager_id % 3 = 0").groupBy(ends.alias("hour")).agg(F.sum("stake").alias("paid"))
    both = t.snapshots.select("hour", "volume").unionByName(paid, allowMissingColumns=True).groupBy("hour").agg(F.max("volume").alias("volume"), F.sum("paid").alias("paid"))
    upto = both.withColumn("paid", F.coalesce(F.sum("paid").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).where("volume is not null")  # a row an hour
    w = Window.orderBy("hour")
    up, won = F.col("volume") - F.lag("volume").over(w), F.col("paid") - F.lag("paid").over(w)
    x = upto.select("hour", up.alias("up"), won.alias("won")).where("up > 0 and up > won + 0.01")
    return x.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.round("up", 4).alias("rise"), F.round("won", 4).alias("won"), F.round(F.col("up") - F.col("won"), 4).alias("deposit"))


@query("wn_day_over_day", "SELECT CAST(observed_at AS DATE) AS day, count(*) AS n, count(*) - lag(count(*)) OVER (ORDER BY CAST(observed_at AS DATE)) AS change FROM quotes GROUP BY 1")
def _(t):
    d = t.quotes.groupBy(F.to_date("observed_at").alias("day")).agg(F.count("*").alias("n"))
    return d.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("day")))


@query("wn_decile", """WITH q AS (SELECT quantile_cont(elo_prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM bets) SELECT bet_id, CAST(1 + len(list_filter(c, lambda x: x < elo_prob)) AS INTEGER) AS decile FROM bets, q""")
def _(t):
    cuts = quantiles(t.bets, "elo_prob", [round(i / 10, 1) for i in range(1, 10)])
    return t.bets.crossJoin(F.broadcast(cuts)).select("bet_id", (1 + F.size(F.filter("q", lambda x: x < F.col("elo_prob")))).alias("decile"))


@query("wn_markov", SIDES + """, r AS (SELECT game_id, league, team, game_date, CASE WHEN f > a THEN 1 ELSE 0 END AS w, lag(CASE WHEN f > a THEN 1 ELSE 0 END, 1, 1) OVER (PARTITION BY league, team ORDER BY game_date, game_id) AS prev FROM s)
SELECT game_id, team, round((coalesce(sum(w) OVER k, 0) + 1.0e0) / (count(*) OVER k + 2), 6) AS p FROM r WINDOW k AS (PARTITION BY league, team, prev ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(t):
    r = team_games(t).withColumn("prev", F.lag("w", 1, 1.0).over(order()))
    k = Window.partitionBy("league", "team", "prev").orderBy("game_date", "game_id").rowsBetween(Window.unboundedPreceding, -1)
    return r.select("game_id", "team", F.round((F.coalesce(F.sum("w").over(k), F.lit(0.0)) + 1) / (F.count("*").over(k) + 2), 6).alias("p"))


#: A candidate row a team and day; ratings count to two places, so a change of four thousandths alone is none.
DAILY = """v AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS valid_from, 'n' || CASE WHEN max(o_orderkey) % 7 = 0 THEN 1 ELSE 0 END AS name, 1500 + max(o_orderkey) % 3 * 0.004e0 AS raw, count(*) AS games FROM orders GROUP BY 1, 2)"""
SCD2_SQL = f"""WITH {DAILY}, r AS (SELECT *, CAST(round(raw, 2) AS DECIMAL(10, 2)) AS rating FROM v), c AS (SELECT *, lag((name, rating, games)) OVER w AS p FROM r WINDOW w AS (PARTITION BY entity ORDER BY valid_from))
SELECT entity, name, CAST(rating AS DOUBLE) AS rating, games, valid_from, lead(valid_from) OVER (PARTITION BY entity ORDER BY valid_from) AS valid_to FROM c WHERE p IS NULL OR p <> (name, rating, games)"""
VERSIONED = ["name", "rating", "games"]


def daily_ratings(t):
    day = t.orders.groupBy(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("valid_from"))
    named = F.concat(F.lit("n"), F.when(F.max("o_orderkey") % 7 == 0, 1).otherwise(0).cast("string"))
    return day.agg(named.alias("name"), F.round(1500 + F.max("o_orderkey") % 3 * 0.004, 2).cast("decimal(10,2)").alias("rating"), F.count("*").alias("games"))


def told_versions(v):
    return v.select("entity", "name", F.col("rating").cast("double").alias("rating"), "games", "valid_from", "valid_to")


@query("wn_scd2_close", SCD2_SQL)
def _(t):
    """Versions from all candidates at once: a row stays if name, rating (two places) or games differ from the one before."""
    return told_versions(close_versions(daily_ratings(t), ["entity"], "valid_from", *[F.col(c) for c in VERSIONED]))


@query("wn_scd2_upkeep", SCD2_SQL)
def _(t):
    """The same table kept up by three runs, each with the days since the last."""
    v = daily_ratings(t).withColumn("part", F.col("entity") % 8)
    table = VersionTable(t.spark, shared_path(t.spark, "versions"), ["part"], ["entity"], VERSIONED)
    days = v.where("valid_from < DATE '1995-01-01'"), v.where("valid_from >= DATE '1995-01-01' AND valid_from < DATE '1997-06-01'"), v.where("valid_from >= DATE '1997-06-01'")
    for some in days:
        table.merge(some)
    return told_versions(table.rows())


@query("wn_tie_count", """WITH q AS (SELECT *, date_trunc('hour', observed_at) AS seen FROM quotes), e AS (SELECT w.wager_id, q.seen, row_number() OVER (PARTITION BY w.wager_id ORDER BY q.seen DESC, q.quote_id) AS k, count(q.quote_id) OVER (PARTITION BY w.wager_id, q.seen) AS ties FROM wagers w LEFT JOIN q ON q.market = w.market AND q.seen <= w.close_at)
SELECT wager_id, CASE WHEN seen IS NOT NULL THEN ties END AS ties FROM e WHERE k = 1""")
def _(t):
    """How many quotes share the time of the one that closes a wager."""
    q = t.quotes.withColumn("observed_at", F.date_trunc("hour", "observed_at"))
    return asof_join(t.wagers, q, ["market"], "close_at", "observed_at", ["quote_id"], prefer=[-F.col("quote_id")], ties="ties", parts=SPANS).select("wager_id", "ties")


@query("wn_first_last", """WITH q AS (SELECT *, CASE WHEN quote_id % 9 = 0 THEN 'open' WHEN quote_id % 10 = 0 THEN 'close' ELSE 'intraday' END AS kind FROM quotes),
a AS (SELECT market, price, row_number() OVER (PARTITION BY market ORDER BY kind = 'open' DESC, observed_at, quote_id) AS k FROM q), z AS (SELECT market, price, row_number() OVER (PARTITION BY market ORDER BY kind = 'close' DESC, observed_at DESC, quote_id DESC) AS k FROM q)
SELECT market, round(a.price, 4) AS open_price, round(z.price, 4) AS close_price FROM a JOIN z USING (market) WHERE a.k = 1 AND z.k = 1""")
def _(t):
    """A snapshot typed as opening or closing goes before the first or last one by time; one aggregate."""
    kind = F.when(F.col("quote_id") % 9 == 0, "open").when(F.col("quote_id") % 10 == 0, "close").otherwise("intraday")
    first = F.min_by("price", F.struct((F.col("kind") != "open").alias("a"), "observed_at", "quote_id"))
    last = F.max_by("price", F.struct((F.col("kind") == "close").alias("a"), "observed_at", "quote_id"))
    return t.quotes.withColumn("kind", kind).groupBy("market").agg(F.round(first, 4).alias("open_price"), F.round(last, 4).alias("close_price"))


@query("wn_running_budget", """WITH x AS (SELECT bet_id, placed_date, cost, sum(cost) OVER (PARTITION BY placed_date ORDER BY elo_prob - market_prob DESC, bet_id ROWS UNBOUNDED PRECEDING) AS run FROM bets)
SELECT bet_id, round(CASE WHEN run <= 500000 THEN cost WHEN run - cost < 500000 AND 500000 - (run - cost) >= 1000 THEN 500000 - (run - cost) ELSE 0 END, 2) AS granted FROM x""")
def _(t):
    w = Window.partitionBy("placed_date").orderBy((F.col("elo_prob") - F.col("market_prob")).desc(), "bet_id").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("cost").over(w)
    left = 500_000 - (F.col("run") - F.col("cost"))
    return t.bets.withColumn("run", run).select("bet_id", F.round(F.when(F.col("run") <= 500_000, F.col("cost")).when((left > 0) & (left >= 1000), left).otherwise(0.0), 2).alias("granted"))
