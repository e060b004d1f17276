"""Projections, filters and predicates; set operations; integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import odds
from ..operators.core import unpivot_sides
from . import query

#: Statuses each read model takes for settled or open.
SETTLED = ("won", "lost", "void", "settled", "cashed_out", "push", "closed")
OPEN = ("open", "pending", "filled")


@query("prj_rename_cast", "SELECT o_orderkey AS bet_id, CAST(floor(o_totalprice) AS BIGINT) AS cost_whole, CAST(o_orderdate AS DATE) AS placed_date, CAST(o_custkey AS VARCHAR) AS account FROM orders")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("bet_id"), F.floor("o_totalprice").alias("cost_whole"), F.to_date("o_orderdate").alias("placed_date"), F.col("o_custkey").cast("string").alias("account"))


@query("prj_blank_null", "SELECT p_partkey, coalesce(nullif(trim(substr(p_name, 1, CAST(p_partkey % 4 AS INTEGER) * 3)), ''), nullif(p_brand, ''), 'unknown') AS label FROM part")
def _(t):
    name = F.trim(F.substring(F.col("p_name"), F.lit(1), (F.col("p_partkey") % 4).cast("int") * 3))
    return t.part.select("p_partkey", F.coalesce(F.nullif(name, F.lit("")), F.nullif("p_brand", F.lit("")), F.lit("unknown")).alias("label"))


@query("flt_live_status", "SELECT bet_id, status FROM bets WHERE lower(status) IN ('won', 'lost', 'void', 'settled', 'cashed_out', 'push', 'closed')")
def _(t):
    return t.bets.where(F.lower("status").isin(*SETTLED)).select("bet_id", "status")


@query("flt_prob_bounds", "SELECT bet_id, elo_prob, market_prob FROM bets WHERE elo_prob BETWEEN 0.01 AND 0.99 AND elo_prob - market_prob BETWEEN 0.03 AND 0.4")
def _(t):
    return t.bets.where(F.col("elo_prob").between(0.01, 0.99) & (F.col("elo_prob") - F.col("market_prob")).between(0.03, 0.4)).select("bet_id", "elo_prob", "market_prob")


@query("flt_upcoming", "SELECT game_id, game_date FROM games WHERE game_date >= DATE '1998-01-01' AND status NOT IN ('final', 'postponed')")
def _(t):
    return t.games.where((F.col("game_date") >= F.lit("1998-01-01").cast("date")) & ~F.col("status").isin("final", "postponed")).select("game_id", "game_date")


@query("flt_horizon", "SELECT quote_id, market FROM quotes WHERE observed_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def _(t):
    start = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return t.quotes.where(F.col("observed_at").between(start, start + F.expr("INTERVAL '60' HOUR"))).select("quote_id", "market")


@query("flt_run_window", """SELECT market, max(quote_id) AS quote_id FROM (SELECT *, max(observed_at) OVER (PARTITION BY market) AS m FROM quotes
WHERE observed_at >= TIMESTAMP '2024-01-15' AND observed_at < TIMESTAMP '2024-01-16') WHERE observed_at = m GROUP BY 1""")
def _(t):
    day = t.quotes.where((F.col("observed_at") >= "2024-01-15") & (F.col("observed_at") < "2024-01-16"))
    return day.groupBy("market").agg(F.max_by("quote_id", F.struct("observed_at", "quote_id")).alias("quote_id"))


@query("flt_regular_season", "SELECT game_id, game_date FROM games WHERE month(game_date) * 100 + day(game_date) >= 320")
def _(t):
    return t.games.where(F.month("game_date") * 100 + F.day("game_date") >= 320).select("game_id", "game_date")


@query("flt_game_type", "SELECT game_id, league FROM games WHERE league IN (1, 3, 5) AND status = 'final'")
def _(t):
    return t.games.where(F.col("league").isin(1, 3, 5) & (F.col("status") == "final")).select("game_id", "league")


@query("flt_value_bet", "SELECT bet_id FROM bets WHERE elo_prob - market_prob >= 0.05 AND elo_prob - market_prob <= 0.4 AND market_prob <= 0.99 AND 1 / market_prob > 1")
def _(t):
    edge = F.col("elo_prob") - F.col("market_prob")
    return t.bets.where((edge >= 0.05) & (edge <= 0.4) & (F.col("market_prob") <= 0.99) & (1 / F.col("market_prob") > 1)).select("bet_id")


@query("flt_segment_excl", "SELECT bet_id, sport, confidence FROM bets WHERE (sport, confidence) NOT IN (('ASIA', 'LOW'), ('EUROPE', 'MEDIUM'))")
def _(t):
    out = t.spark.createDataFrame([("ASIA", "LOW"), ("EUROPE", "MEDIUM")], "sport string, confidence string")
    return t.bets.join(F.broadcast(out), ["sport", "confidence"], "left_anti").select("bet_id", "sport", "confidence")


@query("prj_case_label", "SELECT bet_id, CASE WHEN elo_prob - market_prob >= 0.15 THEN 'HIGH' WHEN elo_prob - market_prob >= 0.08 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM bets")
def _(t):
    return t.bets.select("bet_id", odds.confidence(F.col("elo_prob") - F.col("market_prob")).alias("label"))


@query("prj_edge_bucket", "SELECT bet_id, CASE WHEN elo_prob - market_prob < 0.05 THEN '3-5%' WHEN elo_prob - market_prob < 0.08 THEN '5-8%' WHEN elo_prob - market_prob < 0.15 THEN '8-15%' ELSE '15%+' END AS bucket FROM bets WHERE elo_prob - market_prob >= 0.03")
def _(t):
    edge = F.col("elo_prob") - F.col("market_prob")
    return t.bets.where(edge >= 0.03).select("bet_id", odds.edge_bucket(edge).alias("bucket"))


@query("prj_game_result", "SELECT game_id, CASE WHEN home_score > away_score THEN 1.0e0 WHEN home_score = away_score THEN 0.5e0 ELSE 0.0e0 END AS result FROM games WHERE status = 'final'")
def _(t):
    h, a = F.col("home_score"), F.col("away_score")
    return t.games.where("status = 'final'").select("game_id", F.when(h > a, 1.0).when(h == a, 0.5).otherwise(0.0).alias("result"))


@query("prj_availability", """SELECT bet_id, concat_ws(',', CASE WHEN closing_prob IS NULL THEN 'no_close' END, CASE WHEN profit IS NULL THEN 'open' END, CASE WHEN elo_prob < 0.05 THEN 'low_prob' END) AS reasons,
CAST(closing_prob IS NULL AS INTEGER) + CAST(profit IS NULL AS INTEGER) + CAST(elo_prob < 0.05 AS INTEGER) AS n_reasons FROM bets""")
def _(t):
    reasons = F.filter(F.array(F.when(F.col("closing_prob").isNull(), "no_close"), F.when(F.col("profit").isNull(), "open"), F.when(F.col("elo_prob") < 0.05, "low_prob")), lambda x: x.isNotNull())
    return t.bets.select("bet_id", F.array_join(reasons, ",").alias("reasons"), F.size(reasons).alias("n_reasons"))


@query("prj_flatten", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS props_k, event_type AS meta_type FROM events")
def _(t):
    nested = t.events.select("event_id", F.from_json("props", "k int").alias("props"), F.struct(F.col("event_type").alias("type")).alias("meta"))
    return nested.select("event_id", F.col("props.k").alias("props_k"), F.col("meta.type").alias("meta_type"))


# ---------------------------------------------------------------- set operations


@query("so_union_all", "SELECT 'bets' AS source, count(*) AS n FROM bets UNION ALL SELECT 'quotes', count(*) FROM quotes UNION ALL SELECT 'games', count(*) FROM games")
def _(t):
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("source"), "n") for n, df in (("bets", t.bets), ("quotes", t.quotes), ("games", t.games))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("so_union_distinct", "SELECT league, home AS team FROM games UNION SELECT league, away FROM games")
def _(t):
    g = t.games
    return g.select("league", F.col("home").alias("team")).union(g.select("league", "away")).distinct()


@query("so_concat_dedup", "SELECT bet_id, sport FROM bets WHERE status = 'won' UNION SELECT bet_id, sport FROM bets WHERE elo_prob > 0.5")
def _(t):
    return t.bets.where("status = 'won'").select("bet_id", "sport").unionByName(t.bets.where("elo_prob > 0.5").select("bet_id", "sport")).dropDuplicates()


@query("so_intersect", "SELECT league, home AS team FROM games INTERSECT SELECT league, away FROM games")
def _(t):
    return t.games.select("league", F.col("home").alias("team")).intersect(t.games.select("league", "away"))


@query("so_except", "SELECT DISTINCT c_custkey AS account FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("account")).subtract(t.orders.select("o_custkey"))


@query("so_unpivot", """SELECT game_id, home AS team, away AS opponent, home_score AS points_for, away_score AS points_against, true AS is_home FROM games
UNION ALL SELECT game_id, away, home, away_score, home_score, false FROM games""")
def _(t):
    return unpivot_sides(t.games).select("game_id", "team", "opponent", "points_for", "points_against", "is_home")


@query("so_values", "SELECT confidence, CAST(f AS DOUBLE) AS floor_edge, n FROM (VALUES ('HIGH', 0.15), ('MEDIUM', 0.08), ('LOW', 0.0)) v(confidence, f) JOIN (SELECT confidence AS c, count(*) AS n FROM bets GROUP BY 1) ON confidence = c")
def _(t):
    floors = t.spark.createDataFrame([("HIGH", 0.15), ("MEDIUM", 0.08), ("LOW", 0.0)], "confidence string, floor_edge double")
    return t.bets.groupBy("confidence").agg(F.count("*").alias("n")).join(F.broadcast(floors), "confidence").select("confidence", "floor_edge", "n")


# ---------------------------------------------------------------- integrity


@query("chk_pk", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("chk_fk", "SELECT count(*) AS orphans FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)")
def _(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans"))


@query("chk_one_open", "SELECT o_custkey, count(*) AS open_rows FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("open_rows")).where("open_rows > 1")


@query("chk_domain", """SELECT count(*) FILTER (WHERE elo_prob NOT BETWEEN 0 AND 1) AS bad_prob, count(*) FILTER (WHERE status NOT IN ('won', 'lost', 'open')) AS bad_status,
count(*) FILTER (WHERE cost <= 0) AS bad_cost, count(*) FILTER (WHERE closing_prob IS NULL) AS null_close FROM bets""")
def _(t):
    n = lambda c: F.count(F.when(c, 1))
    return t.bets.agg(n(~F.col("elo_prob").between(0, 1)).alias("bad_prob"), n(~F.col("status").isin("won", "lost", "open")).alias("bad_status"), n(F.col("cost") <= 0).alias("bad_cost"), n(F.col("closing_prob").isNull()).alias("null_close"))
