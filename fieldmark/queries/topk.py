"""Sorts, limits, top rows per key, dedup."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.core import latest_by
from ..plans.ledger import duplicates
from . import query


@query("tk_distinct_on", "SELECT DISTINCT ON (market, bookmaker) market, bookmaker, quote_id FROM quotes ORDER BY market, bookmaker, observed_at DESC NULLS LAST, quote_id")
def _(t):
    return latest_by(t.quotes, ["market", "bookmaker"], F.col("observed_at").desc_nulls_last(), F.col("quote_id")).select("market", "bookmaker", "quote_id")


@query("tk_latest_signal", "SELECT bookmaker, arg_max(quote_id, (observed_at, quote_id)) AS quote_id, arg_max(price, (observed_at, quote_id)) > 1.5 AS available FROM quotes GROUP BY 1")
def _(t):
    return t.quotes.groupBy("bookmaker").agg(F.max_by("quote_id", F.struct("observed_at", "quote_id")).alias("quote_id"), (F.max_by("price", F.struct("observed_at", "quote_id")) > 1.5).alias("available"))


@query("tk_latest_market", "SELECT market, round(1 / arg_max(price, (observed_at, quote_id)), 6) AS p FROM quotes WHERE price > 1.05 GROUP BY 1")
def _(t):
    return t.quotes.where("price > 1.05").groupBy("market").agg(F.round(1 / F.max_by("price", F.struct("observed_at", "quote_id")), 6).alias("p"))


@query("tk_order_limit", "SELECT quote_id, market FROM quotes ORDER BY observed_at DESC, quote_id LIMIT 30")
def _(t):
    return t.quotes.orderBy(F.col("observed_at").desc(), "quote_id").limit(30).select("quote_id", "market")


@query("tk_starter", "SELECT pitcher, game_date, max(velocity) AS velocity FROM (SELECT *, rank() OVER (PARTITION BY pitcher ORDER BY is_csw DESC, game_date DESC, velocity DESC NULLS LAST) AS k FROM pitches) WHERE k = 1 GROUP BY 1, 2")
def _(t):
    w = Window.partitionBy("pitcher").orderBy(F.col("is_csw").desc(), F.col("game_date").desc(), F.col("velocity").desc_nulls_last())
    return t.pitches.withColumn("k", F.row_number().over(w)).where("k = 1").select("pitcher", "game_date", "velocity")


@query("tk_best_price", """WITH f AS (SELECT *, max(observed_at) OVER (PARTITION BY market) AS m FROM quotes), g AS (SELECT market, count(DISTINCT bookmaker) FILTER (WHERE observed_at >= m - INTERVAL '4' HOUR) AS books, max(price) FILTER (WHERE observed_at >= m - INTERVAL '4' HOUR) AS fresh, max(price) AS anyp FROM f GROUP BY 1)
SELECT market, round(CASE WHEN books >= 2 THEN fresh ELSE anyp END, 4) AS best, books >= 2 AS governed FROM g""")
def _(t):
    m = t.quotes.groupBy("market").agg(F.max("observed_at").alias("m"))
    fresh = F.col("observed_at") >= F.col("m") - F.expr("INTERVAL '4' HOUR")
    g = t.quotes.join(m, "market").groupBy("market").agg(F.count_distinct(F.when(fresh, F.col("bookmaker"))).alias("books"), F.max(F.when(fresh, F.col("price"))).alias("fresh"), F.max("price").alias("anyp"))
    return g.select("market", F.round(F.when(F.col("books") >= 2, F.col("fresh")).otherwise(F.col("anyp")), 4).alias("best"), (F.col("books") >= 2).alias("governed"))


@query("tk_top_per_group_first", """SELECT bet_id, CAST(row_number() OVER (ORDER BY k = 1 DESC, ev DESC, bet_id) AS INTEGER) AS place FROM (SELECT bet_id, elo_prob - market_prob AS ev, row_number() OVER (PARTITION BY sport ORDER BY elo_prob - market_prob DESC, bet_id) AS k FROM bets)
QUALIFY place <= 50""")
def _(t):
    ev = F.col("elo_prob") - F.col("market_prob")
    one = t.bets.select("bet_id", "sport", ev.alias("ev")).withColumn("k", F.row_number().over(Window.partitionBy("sport").orderBy(F.col("ev").desc(), "bet_id")))
    top = one.withColumn("first", F.col("k") == 1).orderBy(F.col("first").desc(), F.col("ev").desc(), "bet_id").limit(50)
    return top.select("bet_id", F.row_number().over(Window.orderBy(F.col("first").desc(), F.col("ev").desc(), "bet_id")).alias("place"))


@query("tk_dedup_key", """SELECT bet_id FROM (SELECT bet_id, k, row_number() OVER (PARTITION BY k ORDER BY bet_id) AS n FROM (SELECT bet_id, nullif(market % 20, 0) AS k FROM bets)) WHERE n = 1 OR k IS NULL""")
def _(t):
    b = t.bets.select("bet_id", F.nullif(F.col("market") % 20, F.lit(0)).alias("k"))
    first = b.where("k is not null").groupBy("k").agg(F.min("bet_id").alias("bet_id")).select("bet_id")
    return first.unionByName(b.where("k is null").select("bet_id"))


TICKET = "'KXG' || market % 90 || '-' || year(placed_date) || '-' || CASE WHEN bet_id % 10 = 0 THEN 'DRAW' WHEN side = 'home' THEN 'ABC' ELSE 'XY' END"


@query("tk_dup_window", f"""WITH b AS (SELECT *, regexp_replace({TICKET}, '-([A-Z]{{2,3}}|HOME|DRAW|AWAY)$', '') AS base FROM bets WHERE status IN ('open', 'filled', 'won', 'lost'))
SELECT a.bet_id FROM b a WHERE EXISTS (SELECT 1 FROM b x WHERE x.sport = a.sport AND x.base = a.base AND (x.placed_date, x.bet_id) < (a.placed_date, a.bet_id))
OR EXISTS (SELECT 1 FROM b x WHERE x.sport = a.sport AND x.market = a.market AND x.side = a.side AND x.placed_date >= a.placed_date - 3 AND (x.placed_date, x.bet_id) < (a.placed_date, a.bet_id))""")
def _(t):
    return duplicates(t.bets.where(F.col("status").isin("open", "filled", "won", "lost")).withColumn("ticker", F.expr(TICKET))).select("bet_id")


@query("tk_max_edge_side", """WITH s AS (SELECT bet_id, 'home' AS pick, elo_prob - market_prob AS e FROM bets UNION ALL SELECT bet_id, 'away', market_prob - elo_prob FROM bets)
SELECT bet_id, pick, round(e, 6) AS edge FROM s WHERE e >= 0.03 AND e <= 0.4""")
def _(t):
    e = F.col("elo_prob") - F.col("market_prob")
    sides = F.explode(F.array(F.struct(F.lit("home").alias("pick"), e.alias("e")), F.struct(F.lit("away").alias("pick"), (F.col("market_prob") - F.col("elo_prob")).alias("e"))))
    s = t.bets.select("bet_id", sides.alias("s")).select("bet_id", "s.*").where("e >= 0.03 and e <= 0.4")
    return s.groupBy("bet_id").agg(F.max_by("pick", "e").alias("pick"), F.round(F.max("e"), 6).alias("edge"))


@query("tk_last_known", "SELECT market, arg_max(quote_id, (observed_at, quote_id)) AS last_quote, round(arg_max(price, (observed_at, quote_id)) FILTER (WHERE bookmaker = 'purchase'), 4) AS last_purchase_price FROM quotes GROUP BY 1")
def _(t):
    buy = F.when(F.col("bookmaker") == "purchase", F.struct("observed_at", "quote_id"))
    return t.quotes.groupBy("market").agg(F.max_by("quote_id", F.struct("observed_at", "quote_id")).alias("last_quote"), F.round(F.max_by("price", buy), 4).alias("last_purchase_price"))
