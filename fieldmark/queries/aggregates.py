"""Aggregations: ledgers, calibration, model metrics, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import odds
from ..operators.core import bins, quantiles, unpivot_sides
from ..operators.bootstrap import bootstrap, bootstrap_sql
from . import query

n_if = lambda c: F.count(F.when(c, 1))
won = lambda: F.col("status") == "won"
lost = lambda: F.col("status") == "lost"
SETTLED = "status IN ('won', 'lost')"
EV = "CASE WHEN market_prob > 0 AND market_prob < 1 THEN (elo_prob - market_prob) / market_prob ELSE 0 END"


def ev():
    return odds.expected_value(F.col("elo_prob"), F.col("market_prob"))


@query("ag_filtered", "SELECT count(*) FILTER (WHERE status = 'won') AS wins, count(*) FILTER (WHERE status = 'lost') AS losses, round(sum(cost) FILTER (WHERE status = 'open'), 2) AS open_cost, round(sum(profit) FILTER (WHERE status <> 'open'), 2) AS profit FROM bets")
def _(t):
    return t.bets.agg(n_if(won()).alias("wins"), n_if(lost()).alias("losses"), F.round(F.sum(F.when(F.col("status") == "open", F.col("cost"))), 2).alias("open_cost"), F.round(F.sum(F.when(F.col("status") != "open", F.col("profit"))), 2).alias("profit"))


@query("ag_hash_group", f"SELECT sport, confidence, count(*) AS n, round(sum(profit), 2) AS profit, round(sum(profit) / nullif(sum(cost), 0), 6) AS roi FROM bets WHERE {SETTLED} GROUP BY 1, 2")
def _(t):
    return t.bets.where(SETTLED).groupBy("sport", "confidence").agg(F.count("*").alias("n"), F.round(F.sum("profit"), 2).alias("profit"), F.round(F.try_divide(F.sum("profit"), F.sum("cost")), 6).alias("roi"))


@query("ag_top_worst", f"SELECT market, count(*) AS n, round(sum(profit) / sum(cost), 6) AS roi FROM bets WHERE {SETTLED} GROUP BY 1 HAVING count(*) >= 5 ORDER BY sum(profit) / sum(cost), market LIMIT 10")
def _(t):
    g = t.bets.where(SETTLED).groupBy("market").agg(F.count("*").alias("n"), (F.sum("profit") / F.sum("cost")).alias("r")).where("n >= 5")
    return g.orderBy("r", "market").limit(10).select("market", "n", F.round("r", 6).alias("roi"))


@query("ag_two_level", "SELECT sport, round(max(x), 2) AS top_exposure FROM (SELECT sport, market, sum(cost) AS x FROM bets WHERE status = 'open' GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return t.bets.where("status = 'open'").groupBy("sport", "market").agg(F.sum("cost").alias("x")).groupBy("sport").agg(F.round(F.max("x"), 2).alias("top_exposure"))


@query("ag_calibration", f"SELECT CAST(least(floor(elo_prob * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(elo_prob), 6) AS predicted, round(avg(CASE WHEN status = 'won' THEN 1.0e0 ELSE 0.0e0 END), 6) AS observed FROM bets WHERE {SETTLED} GROUP BY 1")
def _(t):
    b = t.bets.where(SETTLED).withColumn("bin", bins(F.col("elo_prob")))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("elo_prob"), 6).alias("predicted"), F.round(F.avg(won().cast("double")), 6).alias("observed"))


@query("ag_ece", f"WITH b AS (SELECT least(floor(elo_prob * 10), 9) AS k, count(*) AS n, avg(elo_prob) AS p, avg(CASE WHEN status = 'won' THEN 1.0e0 ELSE 0.0e0 END) AS y FROM bets WHERE {SETTLED} GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b")
def _(t):
    b = t.bets.where(SETTLED).groupBy(bins(F.col("elo_prob")).alias("k")).agg(F.count("*").alias("n"), F.avg("elo_prob").alias("p"), F.avg(won().cast("double")).alias("y"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"))


@query("ag_binary_metrics", f"""WITH b AS (SELECT elo_prob AS p, CASE WHEN status = 'won' THEN 1.0e0 ELSE 0.0e0 END AS y, greatest(least(elo_prob, 1 - 1e-12), 1e-12) AS q FROM bets WHERE {SETTLED})
SELECT round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 5) AS log_loss FROM b""")
def _(t):
    b = t.bets.where(SETTLED).select(F.col("elo_prob").alias("p"), won().cast("double").alias("y"))
    p, y = F.col("p"), F.col("y")
    return b.agg(F.round(F.avg(((p >= 0.5) == (y == 1)).cast("double")), 6).alias("accuracy"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(F.avg(odds.log_loss(y, p)), 5).alias("log_loss"))


@query("ag_top_decile", f"""WITH b AS (SELECT abs(elo_prob - 0.5) AS c, CASE WHEN (elo_prob >= 0.5) = (status = 'won') THEN 1.0e0 ELSE 0.0e0 END AS hit FROM bets WHERE {SETTLED}), q AS (SELECT quantile_cont(c, 0.9) AS x FROM b)
SELECT round(avg(hit) FILTER (WHERE c >= x), 6) AS top_accuracy, round(avg(hit) FILTER (WHERE c >= x) - avg(hit), 6) AS lift FROM b, q""")
def _(t):
    b = t.bets.where(SETTLED).select(F.abs(F.col("elo_prob") - 0.5).alias("c"), ((F.col("elo_prob") >= 0.5) == won()).cast("double").alias("hit"))
    top = F.avg(F.when(F.col("c") >= F.col("q")[0], F.col("hit")))
    q = quantiles(b, "c", [0.9])
    return b.crossJoin(F.broadcast(q)).agg(F.round(top, 6).alias("top_accuracy"), F.round(top - F.avg("hit"), 6).alias("lift"))


@query("ag_multiclass", """WITH g AS (SELECT CASE WHEN home_score > away_score THEN 3 WHEN home_score = away_score THEN 2 ELSE 1 END AS y, CAST(1 + game_id % 5 AS DOUBLE) AS a, CAST(1 + game_id % 3 AS DOUBLE) AS d, CAST(2 + game_id % 7 AS DOUBLE) AS h FROM games),
p AS (SELECT y, a / (a + d + h) AS a, d / (a + d + h) AS d, h / (a + d + h) AS h FROM g)
SELECT round(avg(-ln(CASE y WHEN 1 THEN a WHEN 2 THEN d ELSE h END)), 5) AS log_loss, round(avg(pow(a - CAST(y = 1 AS INTEGER), 2) + pow(d - CAST(y = 2 AS INTEGER), 2) + pow(h - CAST(y = 3 AS INTEGER), 2)), 6) AS brier,
round(avg(CASE WHEN y = CASE WHEN a >= d AND a >= h THEN 1 WHEN d >= h THEN 2 ELSE 3 END THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy FROM p""")
def _(t):
    h, a = F.col("home_score"), F.col("away_score")
    y = F.when(h > a, 3).when(h == a, 2).otherwise(1)
    raw = [(1 + F.col("game_id") % 5).cast("double"), (1 + F.col("game_id") % 3).cast("double"), (2 + F.col("game_id") % 7).cast("double")]
    p = t.games.select(y.alias("y"), F.array(*[x / (raw[0] + raw[1] + raw[2]) for x in raw]).alias("p"))
    brier = sum((F.pow(F.col("p")[i] - (F.col("y") == i + 1).cast("int"), 2) for i in range(3)), F.lit(0.0))
    pick = F.array_position("p", F.array_max("p"))  # the first of equals
    return p.agg(F.round(F.avg(-F.ln(F.col("p")[F.col("y") - 1])), 5).alias("log_loss"), F.round(F.avg(brier), 6).alias("brier"), F.round(F.avg((pick == F.col("y")).cast("double")), 6).alias("accuracy"))


@query("ag_model_health", "SELECT sport, count(*) AS n, round(avg(CASE WHEN elo_prob < 0.1 THEN 1.0e0 ELSE 0.0e0 END), 6) AS abstain_rate, round(avg(elo_prob), 6) AS avg_prob, max(placed_date) AS latest FROM bets GROUP BY 1")
def _(t):
    return t.bets.groupBy("sport").agg(F.count("*").alias("n"), F.round(F.avg((F.col("elo_prob") < 0.1).cast("double")), 6).alias("abstain_rate"), F.round(F.avg("elo_prob"), 6).alias("avg_prob"), F.max("placed_date").alias("latest"))


@query("ag_clv_fidelity", "SELECT side, round(avg(CASE WHEN closing_prob IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END), 6) AS close_rate, round(avg(CASE WHEN closing_prob IS NOT NULL THEN CASE WHEN closing_prob > market_prob THEN 1.0e0 ELSE 0.0e0 END END), 6) AS hit_rate FROM bets GROUP BY 1")
def _(t):
    c = F.col("closing_prob")
    return t.bets.groupBy("side").agg(F.round(F.avg(c.isNotNull().cast("double")), 6).alias("close_rate"), F.round(F.avg((c > F.col("market_prob")).cast("double")), 6).alias("hit_rate"))


@query("ag_edge_buckets", f"""SELECT CASE WHEN e < 0.05 THEN '3-5%' WHEN e < 0.08 THEN '5-8%' WHEN e < 0.15 THEN '8-15%' ELSE '15%+' END AS bucket, count(*) AS n, round(avg(e), 6) AS avg_edge, round(avg(won), 6) AS win_rate, round(sum(profit) / sum(cost), 6) AS roi
FROM (SELECT elo_prob - market_prob AS e, CASE WHEN status = 'won' THEN 1.0e0 ELSE 0.0e0 END AS won, profit, cost FROM bets WHERE {SETTLED} AND elo_prob - market_prob >= 0.03) GROUP BY 1""")
def _(t):
    b = t.bets.where(SETTLED).withColumn("e", F.col("elo_prob") - F.col("market_prob")).where("e >= 0.03")
    return b.groupBy(odds.edge_bucket(F.col("e")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("avg_edge"), F.round(F.avg(won().cast("double")), 6).alias("win_rate"), F.round(F.sum("profit") / F.sum("cost"), 6).alias("roi"))


@query("ag_ev_buckets", f"""SELECT bucket, count(*) AS n, round(avg(ev), 6) AS predicted, round(sum(profit) / sum(cost), 6) AS realised, round(avg(ev) - sum(profit) / sum(cost), 6) AS error FROM
(SELECT {EV} AS ev, profit, cost, CASE WHEN {EV} < 0 THEN 0 WHEN {EV} < 0.1 THEN 1 WHEN {EV} < 0.5 THEN 2 ELSE 3 END AS bucket FROM bets WHERE {SETTLED}) GROUP BY 1 HAVING count(*) >= 5""")
def _(t):
    b = t.bets.where(SETTLED).withColumn("ev", ev())
    k = F.when(F.col("ev") < 0, 0).when(F.col("ev") < 0.1, 1).when(F.col("ev") < 0.5, 2).otherwise(3)
    g = b.groupBy(k.alias("bucket")).agg(F.count("*").alias("n"), F.avg("ev").alias("p"), (F.sum("profit") / F.sum("cost")).alias("r")).where("n >= 5")
    return g.select("bucket", "n", F.round("p", 6).alias("predicted"), F.round("r", 6).alias("realised"), F.round(F.col("p") - F.col("r"), 6).alias("error"))


@query("ag_ev_by_dim", f"SELECT coalesce(upper(sport), 'UNKNOWN') AS sport, coalesce(confidence, 'UNKNOWN') AS confidence, count(*) AS n, round(avg({EV}), 6) AS avg_ev FROM bets WHERE {SETTLED} GROUP BY GROUPING SETS ((upper(sport), confidence), (upper(sport)), (confidence), ())")
def _(t):
    b = t.bets.where(SETTLED).withColumn("ev", ev()).withColumn("s", F.upper("sport"))
    g = b.groupingSets([[F.col("s"), F.col("confidence")], [F.col("s")], [F.col("confidence")], []], F.col("s"), F.col("confidence")).agg(F.count("*").alias("n"), F.round(F.avg("ev"), 6).alias("avg_ev"))
    return g.select(F.coalesce("s", F.lit("UNKNOWN")).alias("sport"), F.coalesce("confidence", F.lit("UNKNOWN")).alias("confidence"), "n", "avg_ev")


@query("ag_weekly", f"SELECT CAST(date_trunc('week', placed_date) AS DATE) AS week, count(*) AS n, round(sum(profit), 2) AS profit FROM bets WHERE {SETTLED} GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    return t.bets.where(SETTLED).groupBy(F.to_date(F.date_trunc("week", "placed_date")).alias("week")).agg(F.count("*").alias("n"), F.round(F.sum("profit"), 2).alias("profit")).where("n >= 3")


@query("ag_corr_split", f"""WITH b AS (SELECT {EV} AS ev, closing_prob - market_prob AS clv, profit, cost FROM bets WHERE {SETTLED} AND closing_prob IS NOT NULL)
SELECT round(corr(ev, clv), 6) AS correlation, count(*) FILTER (WHERE clv > 0) AS n_positive, round(sum(profit) FILTER (WHERE clv > 0) / sum(cost) FILTER (WHERE clv > 0), 6) AS roi_positive, round(sum(profit) FILTER (WHERE clv <= 0) / sum(cost) FILTER (WHERE clv <= 0), 6) AS roi_negative FROM b""")
def _(t):
    b = t.bets.where(SETTLED).where("closing_prob is not null").select(ev().alias("ev"), (F.col("closing_prob") - F.col("market_prob")).alias("clv"), "profit", "cost")
    roi = lambda c: F.round(F.sum(F.when(c, F.col("profit"))) / F.sum(F.when(c, F.col("cost"))), 6)
    return b.agg(F.round(F.corr("ev", "clv"), 6).alias("correlation"), n_if(F.col("clv") > 0).alias("n_positive"), roi(F.col("clv") > 0).alias("roi_positive"), roi(F.col("clv") <= 0).alias("roi_negative"))


@query("ag_timing", f"""SELECT CASE WHEN hours_before < 1 THEN '0-1' WHEN hours_before < 2 THEN '1-2' WHEN hours_before < 4 THEN '2-4' WHEN hours_before < 8 THEN '4-8' ELSE '8+' END AS bucket, count(*) AS n, round(sum(profit) / sum(cost), 6) AS roi FROM bets WHERE {SETTLED} GROUP BY 1""")
def _(t):
    h = F.col("hours_before")
    b = F.when(h < 1, "0-1").when(h < 2, "1-2").when(h < 4, "2-4").when(h < 8, "4-8").otherwise("8+")
    return t.bets.where(SETTLED).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("profit") / F.sum("cost"), 6).alias("roi"))


@query("ag_whatif_timing", f"SELECT count(*) AS n, round(sum(profit), 2) AS profit, round(sum(cost), 2) AS cost FROM bets WHERE {SETTLED} AND hours_before <= 4")
def _(t):
    return t.bets.where(SETTLED).where("hours_before <= 4").agg(F.count("*").alias("n"), F.round(F.sum("profit"), 2).alias("profit"), F.round(F.sum("cost"), 2).alias("cost"))


@query("ag_real_clv", "SELECT round(avg(closing_prob - market_prob) FILTER (WHERE closing_prob NOT IN (0.0, 1.0)), 6) AS mean_clv, count(*) FILTER (WHERE closing_prob IN (0.0, 1.0)) AS placeholders, count(closing_prob) AS covered FROM bets")
def _(t):
    c = F.col("closing_prob")
    return t.bets.agg(F.round(F.avg(F.when(~c.isin(0.0, 1.0), c - F.col("market_prob"))), 6).alias("mean_clv"), n_if(c.isin(0.0, 1.0)).alias("placeholders"), F.count("closing_prob").alias("covered"))


@query("ag_bootstrap", f"WITH {bootstrap_sql('SELECT sport, bet_id AS id, closing_prob - market_prob AS x FROM bets WHERE closing_prob IS NOT NULL', 'sport')} SELECT sport, mean, low, high, p_value FROM boot")
def _(t):
    """Bootstrap of the mean CLV per sport."""
    x = t.bets.where("closing_prob is not null").select("sport", F.col("bet_id").alias("id"), (F.col("closing_prob") - F.col("market_prob")).alias("x"))
    return bootstrap(x, "sport").select("sport", "mean", "low", "high", "p_value")


@query("ag_games_summary", "SELECT league, count(*) AS n, count(DISTINCT home) AS homes, min(game_date) AS first_date, max(game_date) AS last_date, count(*) FILTER (WHERE status <> 'final') AS unplayed FROM games GROUP BY 1")
def _(t):
    return t.games.groupBy("league").agg(F.count("*").alias("n"), F.count_distinct("home").alias("homes"), F.min("game_date").alias("first_date"), F.max("game_date").alias("last_date"), n_if(F.col("status") != "final").alias("unplayed"))


@query("ag_season_counts", "SELECT league, CAST(year(game_date) AS INTEGER) AS season, count(*) AS n, CASE WHEN count(*) >= 150 THEN 'ok' WHEN count(*) >= 100 THEN 'warn' ELSE 'fail' END AS verdict FROM games GROUP BY 1, 2")
def _(t):
    g = t.games.groupBy("league", F.year("game_date").alias("season")).agg(F.count("*").alias("n"))
    return g.withColumn("verdict", F.when(F.col("n") >= 150, "ok").when(F.col("n") >= 100, "warn").otherwise("fail"))


@query("ag_elo_quality", "SELECT sport, round(count(DISTINCT elo_prob) * 1.0e0 / count(*), 6) AS distinct_ratio, round(stddev_samp(elo_prob), 6) AS spread, min(elo_prob) AS low, max(elo_prob) AS high FROM bets GROUP BY 1")
def _(t):
    return t.bets.groupBy("sport").agg(F.round(F.count_distinct("elo_prob") / F.count("*"), 6).alias("distinct_ratio"), F.round(F.stddev_samp("elo_prob"), 6).alias("spread"), F.min("elo_prob").alias("low"), F.max("elo_prob").alias("high"))


@query("ag_having_calib", f"SELECT sport, count(*) AS n, round(avg(elo_prob) - avg(CASE WHEN status = 'won' THEN 1.0e0 ELSE 0.0e0 END), 6) AS bias FROM bets WHERE {SETTLED} GROUP BY 1 HAVING count(*) >= 10")
def _(t):
    return t.bets.where(SETTLED).groupBy("sport").agg(F.count("*").alias("n"), F.round(F.avg("elo_prob") - F.avg(won().cast("double")), 6).alias("bias")).where("n >= 10")


@query("ag_ledger_summary", f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'won') AS wins, count(*) FILTER (WHERE status = 'open') AS open_bets, round(avg(profit) FILTER (WHERE {SETTLED}), 4) AS avg_profit FROM bets")
def _(t):
    return t.bets.agg(F.count("*").alias("total"), n_if(won()).alias("wins"), n_if(F.col("status") == "open").alias("open_bets"), F.round(F.avg(F.when(F.expr(SETTLED), F.col("profit"))), 4).alias("avg_profit"))


@query("ag_recs_summary", "SELECT sport, placed_date, count(*) AS n, round(avg(elo_prob - market_prob), 6) AS avg_edge FROM bets GROUP BY 1, 2")
def _(t):
    return t.bets.groupBy("sport", "placed_date").agg(F.count("*").alias("n"), F.round(F.avg(F.col("elo_prob") - F.col("market_prob")), 6).alias("avg_edge"))


@query("ag_pitch_features", """SELECT pitcher, batter, pitch_type, count(*) AS n, round(avg(CASE WHEN is_whiff THEN 1.0e0 ELSE 0.0e0 END), 6) AS whiff_rate, round(avg(CASE WHEN is_csw THEN 1.0e0 ELSE 0.0e0 END), 6) AS csw_rate, round(avg(velocity), 6) AS avg_velocity, round(stddev_samp(location), 6) AS spread FROM pitches GROUP BY 1, 2, 3""")
def _(t):
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return t.pitches.groupBy("pitcher", "batter", "pitch_type").agg(F.count("*").alias("n"), rate("is_whiff").alias("whiff_rate"), rate("is_csw").alias("csw_rate"), F.round(F.avg("velocity"), 6).alias("avg_velocity"), F.round(F.stddev_samp("location"), 6).alias("spread"))


@query("ag_pbp_team", """WITH a AS (SELECT l_orderkey % 200 AS game, l_suppkey % 10 AS team, sum(l_quantity) AS yards, count(*) FILTER (WHERE l_linenumber = 3) AS third, count(*) FILTER (WHERE l_linenumber = 3 AND l_quantity > 25) AS made, count(*) FILTER (WHERE l_linestatus = 'O' AND l_quantity < 5) AS sacked FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_orderkey % 200 AS game, l_partkey % 10 AS team, count(*) AS penalties, sum(l_tax * 100) AS penalty_yards FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), d AS (SELECT l_orderkey % 200 AS game, (l_suppkey + 1 + l_partkey % 9) % 10 AS team, count(*) AS sacks FROM lineitem WHERE l_linestatus = 'O' AND l_quantity < 5 GROUP BY 1, 2)
SELECT a.game, a.team, round(yards, 2) AS yards, CASE WHEN third > 0 THEN round(made * 1.0e0 / third, 6) ELSE 0.0e0 END AS third_rate, coalesce(penalties, 0) AS penalties, round(coalesce(penalty_yards, 0), 2) AS penalty_yards, sacked, coalesce(sacks, 0) AS sacks FROM a LEFT JOIN p ON a.game = p.game AND a.team = p.team LEFT JOIN d ON a.game = d.game AND a.team = d.team""")
def _(t):
    """A team's plays of a game: what it did with the ball, its own penalties, and sacks on either side; by three keys, each aggregated before it is joined."""
    x = t.lineitem.withColumn("game", F.col("l_orderkey") % 200)
    third, sack = F.col("l_linenumber") == 3, (F.col("l_linestatus") == "O") & (F.col("l_quantity") < 5)
    a = x.groupBy("game", (F.col("l_suppkey") % 10).alias("team")).agg(F.sum("l_quantity").alias("yards"), n_if(third).alias("third"), n_if(third & (F.col("l_quantity") > 25)).alias("made"), n_if(sack).alias("sacked"))
    p = x.where("l_returnflag = 'R'").groupBy("game", (F.col("l_partkey") % 10).alias("team")).agg(F.count("*").alias("penalties"), F.sum(F.col("l_tax") * 100).alias("penalty_yards"))
    d = x.where(sack).groupBy("game", ((F.col("l_suppkey") + 1 + F.col("l_partkey") % 9) % 10).alias("team")).agg(F.count("*").alias("sacks"))
    g, none = a.join(p, ["game", "team"], "left").join(d, ["game", "team"], "left"), F.lit(0).cast("bigint")
    rate = F.coalesce(F.round(F.try_divide("made", "third"), 6), F.lit(0.0))
    return g.select("game", "team", F.round("yards", 2).alias("yards"), rate.alias("third_rate"), F.coalesce("penalties", none).alias("penalties"), F.round(F.coalesce("penalty_yards", F.lit(0.0)), 2).alias("penalty_yards"), "sacked", F.coalesce("sacks", none).alias("sacks"))


@query("ag_epa", "SELECT l_suppkey AS team, round(avg(l_quantity - 25), 6) AS epa, round(-avg(l_quantity - 25), 6) AS epa_allowed, round(avg(CASE WHEN l_quantity > 25 THEN 1.0e0 ELSE 0.0e0 END), 6) AS success FROM lineitem GROUP BY 1")
def _(t):
    e = F.col("l_quantity") - 25
    return t.lineitem.groupBy(F.col("l_suppkey").alias("team")).agg(F.round(F.avg(e), 6).alias("epa"), F.round(-F.avg(e), 6).alias("epa_allowed"), F.round(F.avg((e > 0).cast("double")), 6).alias("success"))


@query("ag_bullpen", """WITH d AS (SELECT pitcher, game_date, count(*) * 9 AS pitches, avg(velocity) AS v FROM pitches GROUP BY 1, 2), u AS (SELECT *, avg(v) OVER (PARTITION BY pitcher ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usual FROM d),
x AS (SELECT *, CASE WHEN pitches > 15 THEN 0.05e0 ELSE 0.0e0 END + CASE WHEN pitches > 20 THEN 0.10e0 ELSE 0.0e0 END + CASE WHEN v < usual THEN least(0.25e0, (usual - v) * 0.05e0) ELSE 0.0e0 END AS cost FROM u)
SELECT a.pitcher, a.game_date, CAST(coalesce(sum(b.pitches) FILTER (WHERE b.game_date >= a.game_date - 3), 0) AS BIGINT) AS load3, CAST(coalesce(sum(b.pitches), 0) AS BIGINT) AS load5, count(*) FILTER (WHERE b.pitches > 15) AS over15, count(*) FILTER (WHERE b.pitches > 20) AS over20, round(-coalesce(sum(b.cost), 0), 4) + 0.0e0 AS penalty
FROM x a LEFT JOIN x b ON a.pitcher = b.pitcher AND b.game_date >= a.game_date - 5 AND b.game_date < a.game_date GROUP BY 1, 2""")
def _(t):
    """Work of three and five days, long outings, and what they and a drop in velocity cost."""
    usual = Window.partitionBy("pitcher").orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)
    d = t.pitches.groupBy("pitcher", "game_date").agg((F.count("*") * 9).alias("pitches"), F.avg("velocity").alias("v")).withColumn("usual", F.avg("v").over(usual))
    slow = F.when(F.col("v") < F.col("usual"), F.least(F.lit(0.25), (F.col("usual") - F.col("v")) * 0.05)).otherwise(0.0)
    d = d.withColumn("cost", F.when(F.col("pitches") > 15, 0.05).otherwise(0.0) + F.when(F.col("pitches") > 20, 0.10).otherwise(0.0) + slow)
    back = lambda n: Window.partitionBy("pitcher").orderBy(F.unix_date("game_date")).rangeBetween(-n, -1)
    total = lambda c, n: F.coalesce(F.sum(c).over(back(n)), F.lit(0))
    over = lambda n: n_if(F.col("pitches") > n).over(back(5)).alias(f"over{n}")
    return d.select("pitcher", "game_date", total("pitches", 3).cast("bigint").alias("load3"), total("pitches", 5).cast("bigint").alias("load5"), over(15), over(20), (F.round(-total("cost", 5), 4) + 0.0).alias("penalty"))


@query("ag_pa_weighted", """WITH x AS (SELECT pitcher, batter, velocity, spin, row_number() OVER (PARTITION BY pitcher, batter ORDER BY game_date DESC, velocity, spin, location) AS k FROM pitches)
SELECT pitcher, round(sum(velocity * spin) / sum(spin), 6) AS weighted FROM x WHERE k = 1 GROUP BY 1""")
def _(t):
    w = Window.partitionBy("pitcher", "batter").orderBy(F.col("game_date").desc(), "velocity", "spin", "location")
    x = t.pitches.withColumn("k", F.row_number().over(w)).where("k = 1")
    return x.groupBy("pitcher").agg(F.round(F.sum(F.col("velocity") * F.col("spin")) / F.sum("spin"), 6).alias("weighted"))


@query("ag_recency_norm", "SELECT pitcher, round(least(sum(exp(-ln(2) * date_diff('day', game_date, DATE '2003-01-01') / 365.0)) / count(DISTINCT batter) / 15, 1.0e0), 6) AS recency FROM pitches GROUP BY 1")
def _(t):
    age = F.date_diff(F.lit("2003-01-01").cast("date"), "game_date")
    return t.pitches.groupBy("pitcher").agg(F.round(F.least(F.sum(F.exp(-F.log(F.lit(2.0)) * age / 365.0)) / F.count_distinct("batter") / 15, F.lit(1.0)), 6).alias("recency"))


@query("ag_venue_factor", """WITH s AS (SELECT home AS team, true AS h, home_score > away_score AS w FROM games UNION ALL SELECT away, false, away_score > home_score FROM games)
SELECT team, round(avg(CASE WHEN w THEN 1.0e0 ELSE 0.0e0 END) FILTER (WHERE h) - avg(CASE WHEN w THEN 1.0e0 ELSE 0.0e0 END) FILTER (WHERE NOT h), 6) AS factor FROM s GROUP BY 1 HAVING count(*) > 10""")
def _(t):
    s = unpivot_sides(t.games).withColumn("w", (F.col("points_for") > F.col("points_against")).cast("double"))
    g = s.groupBy("team").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("is_home"), F.col("w"))) - F.avg(F.when(~F.col("is_home"), F.col("w"))), 6).alias("factor"))
    return g.where("n > 10").select("team", "factor")


@query("ag_pivot_market", """WITH p AS (SELECT market, max(CASE WHEN bookmaker = 'click' THEN 1 / price END) AS h, max(CASE WHEN bookmaker = 'view' THEN 1 / price END) AS a FROM quotes GROUP BY 1)
SELECT market, round(h / (h + a), 6) AS home_prob, round(a / (h + a), 6) AS away_prob FROM p""")
def _(t):
    one = lambda b: F.max(F.when(F.col("bookmaker") == b, 1 / F.col("price")))
    p = t.quotes.groupBy("market").agg(one("click").alias("h"), one("view").alias("a"))
    total = F.col("h") + F.col("a")
    return p.select("market", F.round(F.col("h") / total, 6).alias("home_prob"), F.round(F.col("a") / total, 6).alias("away_prob"))


@query("ag_coverage", "SELECT o_orderpriority, count(DISTINCT l_orderkey) AS covered, count(DISTINCT o_orderkey) AS games, round(count(DISTINCT l_orderkey) * 1.0e0 / count(DISTINCT o_orderkey), 6) AS coverage FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'N' GROUP BY 1")
def _(t):
    keys = t.lineitem.where("l_returnflag = 'N'").select("l_orderkey").distinct()  # reduced before the join, so neither count needs a set
    j = t.orders.join(keys, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    g = j.groupBy("o_orderpriority").agg(F.count("l_orderkey").alias("covered"), F.count("o_orderkey").alias("games"))
    return g.withColumn("coverage", F.round(F.col("covered") / F.col("games"), 6))


@query("ag_team_record", """WITH s AS (SELECT league, home AS team, home_score AS f, away_score AS a FROM games UNION ALL SELECT league, away, away_score, home_score FROM games)
SELECT league, team, count(*) FILTER (WHERE f > a) AS wins, count(*) FILTER (WHERE f < a) AS losses, CAST(sum(f) AS BIGINT) AS scored FROM s GROUP BY 1, 2""")
def _(t):
    s = unpivot_sides(t.games)
    f, a = F.col("points_for"), F.col("points_against")
    return s.groupBy("league", "team").agg(n_if(f > a).alias("wins"), n_if(f < a).alias("losses"), F.sum("points_for").alias("scored"))


@query("ag_cum_season", """WITH s AS (SELECT game_id, league, home AS team, game_date, home_score AS f FROM games UNION ALL SELECT game_id, league, away, game_date, away_score FROM games)
SELECT game_id, team, CAST(sum(f) OVER (PARTITION BY league, team, year(game_date) ORDER BY game_date, game_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS season_points FROM s""")
def _(t):
    w = Window.partitionBy("league", "team", F.year("game_date")).orderBy("game_date", "game_id").rowsBetween(Window.unboundedPreceding, 0)
    return unpivot_sides(t.games).select("game_id", "team", F.sum("points_for").over(w).alias("season_points"))


@query("ag_drift", """WITH s AS (SELECT bookmaker, count(*) * 1.0e0 / sum(count(*)) OVER () AS share FROM quotes WHERE observed_at >= TIMESTAMP '2024-01-20' GROUP BY 1), b AS (SELECT bookmaker, count(*) * 1.0e0 / sum(count(*)) OVER () AS share FROM quotes WHERE observed_at < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT s.bookmaker, round(s.share, 6) AS share, round(abs(s.share - coalesce(b.share, 0)) * 100, 4) AS drift, abs(s.share - coalesce(b.share, 0)) * 100 > 20 AS flagged FROM s LEFT JOIN b ON s.bookmaker = b.bookmaker""")
def _(t):
    cut = F.col("observed_at") >= "2024-01-20"
    g = t.quotes.groupBy("bookmaker").agg(n_if(cut).alias("n"), n_if(~cut).alias("m"))
    total = g.agg(F.sum("n").alias("tn"), F.sum("m").alias("tm"))
    s = g.crossJoin(F.broadcast(total)).where("n > 0").select("bookmaker", (F.col("n") / F.col("tn")).alias("s"), (F.col("m") / F.col("tm")).alias("b"))
    d = F.abs(F.col("s") - F.col("b")) * 100
    return s.select("bookmaker", F.round("s", 6).alias("share"), F.round(d, 4).alias("drift"), (d > 20).alias("flagged"))


@query("ag_distinct", "SELECT DISTINCT pitcher, batter FROM pitches")
def _(t):
    return t.pitches.select("pitcher", "batter").distinct()
