"""Domain pipelines put together from operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import odds, stats
from ..operators.bootstrap import bootstrap, bootstrap_sql
from ..operators.core import asof_join, decayed_sum, unpivot_sides
from ..operators.features import both_sides, clipped, rated_sides, side_features, tasks
from ..operators.folds import Limits, allocate_kelly, allocation_sql
from ..operators.ratings import StarterState, final_ratings, ordered_fold
from ..operators.records import records_before
from ..plans.ledger import SPANS, closing_line_value, first_reason, reconcile
from ..plans.quarantine import Rule, in_range, judged, not_after, present, quarantined
from ..sources.files import csv_or_torn
from ..sources.shared import shared_path
from . import query
from .rating_sql import elo_sql
from .ratings import PITCHER, PITCHER_WEIGHT, SOCCER, SPECS, STARTERS, STD, final_games, last_sql, starters

n_if = lambda c: F.count(F.when(c, 1))
CLOSE = "least(greatest(1 / q.price, 0.01), 0.99)"
edge = lambda: F.col("elo_prob") - F.col("market_prob")


@query("op_clv", f"""WITH c AS (SELECT w.stake, w.bet_prob - {CLOSE} AS clv, CASE WHEN q.quote_id IS NULL THEN 'missing' WHEN w.close_at - q.observed_at > INTERVAL '4' HOUR THEN 'stale' ELSE 'fresh' END AS freshness FROM wagers w ASOF LEFT JOIN quotes q ON w.market = q.market AND w.close_at >= q.observed_at)
SELECT freshness, count(*) AS n, round(avg(clv), 6) AS avg_clv, round(avg(CASE WHEN clv > 0 THEN 1.0e0 WHEN clv IS NOT NULL THEN 0.0e0 END), 6) AS hit_rate, round(sum(stake * clv), 4) AS weighted FROM c GROUP BY 1""")
def _(t):
    c = closing_line_value(t.wagers, t.quotes)
    return c.groupBy("freshness").agg(F.count("*").alias("n"), F.round(F.avg("clv"), 6).alias("avg_clv"), F.round(F.avg((F.col("clv") > 0).cast("double")), 6).alias("hit_rate"), F.round(F.sum(F.col("stake") * F.col("clv")), 4).alias("weighted"))


@query("op_clv_backfill", f"""WITH b AS (SELECT bet_id, market % 150 AS market, market_prob, closing_prob, TIMESTAMP '2024-01-08' + INTERVAL '1' HOUR * (bet_id % 500) AS close_at FROM bets WHERE status <> 'open'),
c AS (SELECT b.*, q.quote_id, q.bookmaker, q.observed_at, {CLOSE} AS close, row_number() OVER (PARTITION BY bet_id ORDER BY q.observed_at DESC, q.quote_id) AS k FROM b LEFT JOIN quotes q ON q.market = b.market AND q.observed_at <= b.close_at)
SELECT bet_id, CASE WHEN closing_prob IS NOT NULL AND closing_prob NOT IN (0.0, 1.0) THEN 'recorded' WHEN quote_id IS NULL THEN 'missing_close' ELSE 'market_close' END AS source,
round(CASE WHEN closing_prob IS NOT NULL AND closing_prob NOT IN (0.0, 1.0) THEN closing_prob WHEN quote_id IS NOT NULL THEN close END, 6) AS closing, round(market_prob - CASE WHEN closing_prob IS NOT NULL AND closing_prob NOT IN (0.0, 1.0) THEN closing_prob WHEN quote_id IS NOT NULL THEN close END, 6) AS clv,
CASE WHEN quote_id IS NULL THEN 'missing' WHEN close_at - observed_at > INTERVAL '4' HOUR THEN 'stale' ELSE 'fresh' END AS freshness, closing_prob IN (0.0, 1.0) AS was_placeholder FROM c WHERE k = 1""")
def _(t):
    """Settled bets whose closing probability is missing or a mere result (0 or 1) get that of the closing quote, and say where it is from."""
    b = t.bets.where("status <> 'open'").select("bet_id", (F.col("market") % 150).alias("market"), "market_prob", "closing_prob", F.expr("TIMESTAMP '2024-01-08' + make_interval(0, 0, 0, 0, cast(bet_id % 500 as int), 0, 0)").alias("close_at"))
    got = asof_join(b, t.quotes, ["market"], "close_at", "observed_at", ["quote_id", "price", "observed_at"], prefer=[-F.col("quote_id")], parts=SPANS)
    known = F.col("closing_prob").isNotNull() & ~F.col("closing_prob").isin(0.0, 1.0)
    there = F.col("quote_id").isNotNull()
    close = F.when(known, F.col("closing_prob")).when(there, odds.implied(F.col("price")))
    old = F.col("close_at") - F.col("observed_at") > F.expr("INTERVAL '4' HOUR")
    return got.select("bet_id", F.when(known, "recorded").when(there, "market_close").otherwise("missing_close").alias("source"), F.round(close, 6).alias("closing"), F.round(F.col("market_prob") - close, 6).alias("clv"), F.when(~there, "missing").when(old, "stale").otherwise("fresh").alias("freshness"), F.col("closing_prob").isin(0.0, 1.0).alias("was_placeholder"))


@query("op_find_opps", """WITH s AS (SELECT bet_id, 'home' AS pick, elo_prob AS p, market_prob AS m FROM bets UNION ALL SELECT bet_id, 'away', 1 - elo_prob, 1 - market_prob FROM bets)
SELECT bet_id, pick, round(p - m, 6) AS edge, round((p - m) / m, 6) AS ev, CASE WHEN p - m >= 0.15 THEN 'HIGH' WHEN p - m >= 0.08 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s WHERE p - m >= 0.05 AND p - m <= 0.4 AND m <= 0.99""")
def _(t):
    p, m = F.col("elo_prob"), F.col("market_prob")
    side = F.explode(F.array(F.struct(F.lit("home").alias("pick"), p.alias("p"), m.alias("m")), F.struct(F.lit("away").alias("pick"), (1 - p).alias("p"), (1 - m).alias("m"))))
    s = t.bets.select("bet_id", side.alias("s")).select("bet_id", "s.*")
    e = F.col("p") - F.col("m")
    return s.where(e.between(0.05, 0.4) & (F.col("m") <= 0.99)).select("bet_id", "pick", F.round(e, 6).alias("edge"), F.round(odds.expected_value(F.col("p"), F.col("m")), 6).alias("ev"), odds.confidence(e).alias("confidence"))


#: Segments that take no bets.
CLOSED = (("AFRICA", "LOW"), ("EUROPE", "LOW"))


@query("op_gate", f"""WITH b AS (SELECT *, market % 25 AS event FROM bets), o AS (SELECT * FROM b WHERE status = 'open'), h AS (SELECT sport, event, count(*) FILTER (WHERE side = 'home') AS homes, count(*) FILTER (WHERE side = 'away') AS aways FROM b WHERE status = 'won' AND placed_date >= DATE '1998-06-01' GROUP BY 1, 2),
g AS (SELECT sport, sum(cost) FILTER (WHERE status = 'open') AS exposed, 0.5e0 * sum(cost) + sum(coalesce(profit, 0)) AS worth FROM bets GROUP BY 1),
x AS (SELECT o.*, coalesce(CASE o.side WHEN 'home' THEN homes ELSE aways END, 0) AS same, coalesce(CASE o.side WHEN 'home' THEN aways ELSE homes END, 0) AS other, exposed >= worth AS ruined FROM o LEFT JOIN h ON h.sport = o.sport AND h.event = o.event JOIN g ON g.sport = o.sport)
SELECT bet_id, CASE WHEN same > 0 AND other > 0 THEN 'both_sides' WHEN same > 0 THEN 'same_side' WHEN other > 0 THEN 'opposite_side' ELSE 'no_existing_position' END AS position,
CASE WHEN {' OR '.join(f"(sport = '{a}' AND confidence = '{b}')" for a, b in CLOSED)} THEN 'segment_excluded' WHEN closing_prob IN (0.0, 1.0) THEN 'contaminated_evidence' WHEN closing_prob IS NULL THEN 'missing_evidence' WHEN ruined THEN 'risk_of_ruin_gate_blocked' WHEN other > 0 THEN 'same_match_conflict' WHEN same > 0 THEN 'existing_position_conflict' WHEN elo_prob - market_prob < 0.05 THEN 'low_edge' ELSE 'approved' END AS decision FROM x""")
def _(t):
    """An open bet's first reason to be refused: segment, evidence, the sport's guardrail, positions on its event, edge."""
    b = t.bets.withColumn("event", F.col("market") % 25)
    held = b.where("status = 'won' and placed_date >= DATE '1998-06-01'").groupBy("sport", "event").agg(n_if(F.col("side") == "home").alias("homes"), n_if(F.col("side") == "away").alias("aways"))
    g = t.bets.groupBy("sport").agg((F.sum(F.when(F.col("status") == "open", F.col("cost"))) >= 0.5 * F.sum("cost") + F.sum(F.coalesce("profit", F.lit(0.0)))).alias("ruined"))
    x = b.where("status = 'open'").join(held, ["sport", "event"], "left").join(F.broadcast(g), "sport")  # a row a sport
    home = F.col("side") == "home"
    same, other = (F.coalesce(F.when(home, a).otherwise(z), F.lit(0)) for a, z in ((F.col("homes"), F.col("aways")), (F.col("aways"), F.col("homes"))))
    closed = F.concat_ws("|", "sport", "confidence").isin(*["|".join(c) for c in CLOSED])
    place = F.when((same > 0) & (other > 0), "both_sides").when(same > 0, "same_side").when(other > 0, "opposite_side").otherwise("no_existing_position")
    close = F.col("closing_prob")
    why = first_reason(("segment_excluded", closed), ("contaminated_evidence", close.isin(0.0, 1.0)), ("missing_evidence", close.isNull()), ("risk_of_ruin_gate_blocked", F.coalesce("ruined", F.lit(False))), ("same_match_conflict", other > 0), ("existing_position_conflict", same > 0), ("low_edge", edge() < 0.05))
    return x.select("bet_id", place.alias("position"), why.alias("decision"))


LIMITS = Limits()
STAKED = """SELECT bet_id, placed_date AS day, sport, market % 25 AS event, (elo_prob - market_prob) / market_prob AS value,
greatest(0.0e0, (elo_prob * (1 / market_prob - 1) - (1 - elo_prob)) / (1 / market_prob - 1)) AS kelly FROM bets WHERE elo_prob - market_prob >= 0.05"""


@query("op_allocate", f"{allocation_sql(STAKED, LIMITS)} SELECT bet_id, day, place, round(asked, 4) AS asked, round(approved, 2) AS allocated, round(approved / {LIMITS.bankroll}, 6) AS share, reason FROM f WHERE place > 0")
def _(t):
    """Fractional Kelly stakes in the order that gives each sport a seat, under the caps of day, sport and event."""
    p, m = F.col("elo_prob"), F.col("market_prob")
    b = t.bets.where(edge() >= 0.05).select("bet_id", F.col("placed_date").alias("day"), "sport", (F.col("market") % 25).alias("event"), odds.expected_value(p, m).alias("value"), odds.kelly(p, m).alias("kelly"))
    out = allocate_kelly(b, LIMITS)
    return out.select("bet_id", "day", F.col("place").cast("bigint").alias("place"), F.round("asked", 4).alias("asked"), F.round("approved", 2).alias("allocated"), F.round(F.col("approved") / LIMITS.bankroll, 6).alias("share"), "reason")


@query("op_equal_alloc", "SELECT bet_id, round(1000.0e0 / count(*) OVER (PARTITION BY placed_date), 4) AS stake FROM bets WHERE status = 'open'")
def _(t):
    return t.bets.where("status = 'open'").select("bet_id", F.round(1000.0 / F.count("*").over(Window.partitionBy("placed_date")), 4).alias("stake"))


@query("op_governance_prob", """SELECT bet_id, CASE WHEN closing_prob IS NOT NULL AND closing_prob < 1 THEN 'calibrated' WHEN abs(elo_prob - 0.5) >= 0.02 THEN 'raw' ELSE 'abstain' END AS source,
round(CASE WHEN closing_prob IS NOT NULL AND closing_prob < 1 THEN 0.5 * elo_prob + 0.5 * closing_prob WHEN abs(elo_prob - 0.5) >= 0.02 THEN elo_prob END, 6) AS p FROM bets""")
def _(t):
    c, e = F.col("closing_prob"), F.col("elo_prob")
    good = c.isNotNull() & (c < 1)
    sure = F.abs(e - 0.5) >= 0.02
    return t.bets.select("bet_id", F.when(good, "calibrated").when(sure, "raw").otherwise("abstain").alias("source"), F.round(F.when(good, 0.5 * e + 0.5 * c).when(sure, e), 6).alias("p"))


@query("op_reconcile", """WITH l AS (SELECT bet_id, status, side, confidence FROM bets WHERE bet_id % 50 <> 0), r AS (SELECT bet_id, CASE WHEN bet_id % 7 = 0 THEN 'void' ELSE status END AS status, CASE WHEN bet_id % 11 = 0 THEN NULL ELSE side END AS side, confidence FROM bets)
SELECT r.bet_id, 'changed' AS kind, 'status' AS field, l.status AS old_value, r.status AS new_value FROM l JOIN r ON l.bet_id = r.bet_id WHERE l.status IS DISTINCT FROM r.status
UNION ALL SELECT r.bet_id, 'changed', 'side', l.side, r.side FROM l JOIN r ON l.bet_id = r.bet_id WHERE l.side IS DISTINCT FROM r.side
UNION ALL SELECT r.bet_id, 'insert', NULL, NULL, NULL FROM r WHERE r.bet_id NOT IN (SELECT bet_id FROM l)""")
def _(t):
    local = t.bets.where("bet_id % 50 <> 0").select("bet_id", "status", "side", "confidence")
    remote = t.bets.select("bet_id", F.when(F.col("bet_id") % 7 == 0, "void").otherwise(F.col("status")).alias("status"), F.when(F.col("bet_id") % 11 != 0, F.col("side")).alias("side"), "confidence")
    return reconcile(local, remote, "bet_id", ["status", "side", "confidence"])


OPEN_CLOSE = "SELECT market, arg_min(price, (observed_at, quote_id)) AS open_price, arg_max(price, (observed_at, quote_id)) AS close_price FROM quotes GROUP BY 1"


def open_close(t):
    return t.quotes.groupBy("market").agg(F.min_by("price", F.struct("observed_at", "quote_id")).alias("open_price"), F.max_by("price", F.struct("observed_at", "quote_id")).alias("close_price"))


@query("op_value_recs", f"""WITH o AS ({OPEN_CLOSE}), s AS (SELECT bet_id, 'home' AS pick, elo_prob - 1 / open_price AS e FROM bets b JOIN o ON b.market = o.market UNION ALL SELECT bet_id, 'away', (1 - elo_prob) - (1 - 1 / open_price) FROM bets b JOIN o ON b.market = o.market)
SELECT bet_id, arg_max(pick, e) AS pick, round(max(e), 6) AS edge FROM s WHERE e >= 0.03 AND e <= 0.5 GROUP BY 1""")
def _(t):
    j = t.bets.join(open_close(t), "market")
    home = F.col("elo_prob") - 1 / F.col("open_price")
    away = (1 - F.col("elo_prob")) - (1 - 1 / F.col("open_price"))
    s = j.select("bet_id", F.explode(F.array(F.struct(F.lit("home").alias("pick"), home.alias("e")), F.struct(F.lit("away").alias("pick"), away.alias("e")))).alias("s")).select("bet_id", "s.*")
    return s.where("e >= 0.03 and e <= 0.5").groupBy("bet_id").agg(F.max_by("pick", "e").alias("pick"), F.round(F.max("e"), 6).alias("edge"))


@query("op_evidence_frame", f"""WITH o AS ({OPEN_CLOSE}) SELECT bet_id, round(CASE status WHEN 'won' THEN open_price - 1 ELSE -1 END, 6) AS flat_pnl, round(1 / close_price - 1 / open_price, 6) AS clv FROM bets b JOIN o ON b.market = o.market WHERE status <> 'open'""")
def _(t):
    j = t.bets.where("status <> 'open'").join(open_close(t), "market")
    return j.select("bet_id", F.round(F.when(F.col("status") == "won", F.col("open_price") - 1).otherwise(-1.0), 6).alias("flat_pnl"), F.round(1 / F.col("close_price") - 1 / F.col("open_price"), 6).alias("clv"))


@query("op_evidence_metrics", f"""WITH o AS ({OPEN_CLOSE}), f AS (SELECT confidence, CASE status WHEN 'won' THEN open_price - 1 ELSE -1 END AS pnl, 1 / close_price - 1 / open_price AS clv FROM bets b JOIN o ON b.market = o.market WHERE status <> 'open')
SELECT count(*) AS bets, round(avg(pnl), 6) AS flat_roi, round(avg(CASE WHEN clv > 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS clv_hit_rate, round(avg(pnl) FILTER (WHERE confidence = 'HIGH'), 6) AS tier_a_roi FROM f""")
def _(t):
    j = t.bets.where("status <> 'open'").join(open_close(t), "market")
    f = j.select("confidence", F.when(F.col("status") == "won", F.col("open_price") - 1).otherwise(-1.0).alias("pnl"), (1 / F.col("close_price") - 1 / F.col("open_price")).alias("clv"))
    return f.agg(F.count("*").alias("bets"), F.round(F.avg("pnl"), 6).alias("flat_roi"), F.round(F.avg((F.col("clv") > 0).cast("double")), 6).alias("clv_hit_rate"), F.round(F.avg(F.when(F.col("confidence") == "HIGH", F.col("pnl"))), 6).alias("tier_a_roi"))


@query("op_compare_models", """WITH m AS (SELECT sport, avg(pow(elo_prob - CAST(status = 'won' AS INTEGER), 2)) AS a, avg(pow(market_prob - CAST(status = 'won' AS INTEGER), 2)) AS b FROM bets WHERE status <> 'open' GROUP BY 1) SELECT sport, round(a, 6) AS elo_brier, round(b, 6) AS market_brier, round(a - b, 6) AS delta FROM m""")
def _(t):
    y = (F.col("status") == "won").cast("int")
    sq = lambda c: F.avg(F.pow(F.col(c) - y, F.lit(2.0)))
    m = t.bets.where("status <> 'open'").groupBy("sport").agg(sq("elo_prob").alias("a"), sq("market_prob").alias("b"))
    return m.select("sport", F.round("a", 6).alias("elo_brier"), F.round("b", 6).alias("market_brier"), F.round(F.col("a") - F.col("b"), 6).alias("delta"))


@query("op_gates", """WITH m AS (SELECT sport, avg(CASE WHEN closing_prob > market_prob THEN 1.0e0 ELSE 0.0e0 END) AS hit, sum(profit) / sum(cost) AS roi FROM bets WHERE status <> 'open' GROUP BY 1)
SELECT sport, concat_ws(',', CASE WHEN hit < 0.58 THEN 'clv_hit_rate' END, CASE WHEN roi < 0.021 THEN 'roi' END) AS failed FROM m""")
def _(t):
    m = t.bets.where("status <> 'open'").groupBy("sport").agg(F.avg(F.coalesce((F.col("closing_prob") > F.col("market_prob")).cast("double"), F.lit(0.0))).alias("hit"), (F.sum("profit") / F.sum("cost")).alias("roi"))
    return m.select("sport", F.concat_ws(",", F.when(F.col("hit") < 0.58, "clv_hit_rate"), F.when(F.col("roi") < 0.021, "roi")).alias("failed"))


@query("op_rolling_features", """WITH d AS (SELECT pitcher, game_date, count(*) AS n, sum(velocity) AS v, count(*) FILTER (WHERE is_csw) AS c, count(*) FILTER (WHERE is_whiff) AS k, avg(velocity) AS m FROM pitches GROUP BY 1, 2),
e AS (SELECT a.pitcher, a.game_date, sum(b.m * exp(-ln(2) * date_diff('day', b.game_date, a.game_date) / 15.0)) / sum(exp(-ln(2) * date_diff('day', b.game_date, a.game_date) / 15.0)) AS x FROM d a JOIN d b ON a.pitcher = b.pitcher AND b.game_date >= a.game_date - 30 AND b.game_date < a.game_date GROUP BY 1, 2)
SELECT d.pitcher, d.game_date, CAST(coalesce(sum(n) OVER w7, 0) AS BIGINT) AS n7, CAST(coalesce(sum(n) OVER w30, 0) AS BIGINT) AS n30, round(sum(v) OVER w30 / sum(n) OVER w30, 6) AS velocity30, round(sum(c) OVER w30 * 1.0e0 / sum(n) OVER w30, 6) AS csw30,
round(sum(k) OVER w30 * 1.0e0 / sum(n) OVER w30, 6) AS whiff30, round(sum(v) OVER w7 / sum(n) OVER w7 - sum(v) OVER w30 / sum(n) OVER w30, 6) AS velocity_trend, round(e.x, 6) AS velocity_decayed FROM d LEFT JOIN e ON d.pitcher = e.pitcher AND d.game_date = e.game_date
WINDOW w7 AS (PARTITION BY d.pitcher ORDER BY d.game_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), w30 AS (PARTITION BY d.pitcher ORDER BY d.game_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def _(t):
    """Windows, trend and decay of a pitcher's days: one exchange and one sort, no join of days with days."""
    d = t.pitches.groupBy("pitcher", "game_date").agg(F.count("*").alias("n"), F.sum("velocity").alias("v"), n_if(F.col("is_csw")).alias("c"), n_if(F.col("is_whiff")).alias("k"), F.avg("velocity").alias("m"))
    w7, w30 = (Window.partitionBy("pitcher").orderBy(F.unix_date("game_date")).rangeBetween(-days, -1) for days in (7, 30))
    n = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0).cast("bigint"))
    share = lambda x, w: F.sum(x).over(w) / F.sum("n").over(w)
    total = lambda x: decayed_sum(x, F.unix_date("game_date"), 30, 15.0, ["pitcher"])
    rates = [F.round(share(x, w30), 6).alias(name) for x, name in (("v", "velocity30"), ("c", "csw30"), ("k", "whiff30"))]
    decayed = F.round(F.try_divide(total(F.col("m")), total(F.lit(1.0))), 6).alias("velocity_decayed")
    return d.select("pitcher", "game_date", n(w7).alias("n7"), n(w30).alias("n30"), *rates, F.round(share("v", w7) - share("v", w30), 6).alias("velocity_trend"), decayed)


SIDES = "s AS (SELECT game_id, league, home AS team, game_date, home_score AS f, away_score AS a FROM games UNION ALL SELECT game_id, league, away, game_date, away_score, home_score FROM games)"


def form(t):
    w = Window.partitionBy("league", "team").orderBy("game_date", "game_id").rowsBetween(Window.unboundedPreceding, -1)
    s = unpivot_sides(t.games)
    return s.select("game_id", "league", "team", "is_home", "points_for", F.avg("points_for").over(w).alias("avg_for"), F.avg("points_against").over(w).alias("avg_against"), F.count("*").over(w).alias("prior"))


MLB, LADDER = SPECS["rt_elo_mlb"], "SELECT * FROM (" + elo_sql({"ladder": PITCHER}, STARTERS, 150) + " SELECT * FROM scored WHERE home >= 0 AND away >= 0)"
#: Both sides of each game with what is known before its day, as SQL.
KNOWN = f"""{elo_sql({'mlb': MLB})}, ladder AS ({LADDER}),
elo AS (SELECT league, home AS team, game_date AS day, game_id, home_after AS r FROM scored UNION ALL SELECT league, away, game_date, game_id, away_after FROM scored),
arm AS (SELECT league, home AS who, game_date AS day, game_id, home_after AS r FROM ladder UNION ALL SELECT league, away, game_date, game_id, away_after FROM ladder),
app AS (SELECT pitcher, game_date AS day, count(*) * 9 AS pitches, avg(velocity) AS v, 100 * avg(location) AS runs FROM pitches GROUP BY 1, 2),
load AS (SELECT pitcher % 16 AS league, pitcher % 30 AS team, day, pitches, runs, (CASE WHEN pitches > 15 THEN 0.05e0 ELSE 0.0e0 END + CASE WHEN pitches > 20 THEN 0.10e0 ELSE 0.0e0 END) + least(0.25e0, greatest(0.0e0, coalesce(usual - v, 0)) * 0.05e0) AS tired
  FROM (SELECT *, avg(v) OVER (PARTITION BY pitcher ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usual FROM app)),
s AS (SELECT game_id, league, home AS team, true AS is_home, game_date AS day, home_score AS f, away_score AS a, CASE WHEN game_id % 11 <> 0 THEN home * 5 + game_id % 5 END AS who FROM games
  UNION ALL SELECT game_id, league, away, false, game_date, away_score, home_score, CASE WHEN game_id % 13 <> 0 THEN away * 5 + game_id % 5 END FROM games),
h AS (SELECT *, sum(f) OVER w AS rf, sum(a) OVER w AS ra, count(*) OVER w AS n, avg(CASE WHEN f > a THEN 1.0e0 ELSE 0.0e0 END) OVER (PARTITION BY league, team ORDER BY day, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS form,
  date_diff('day', lag(day) OVER (PARTITION BY league, team ORDER BY day, game_id), day) - 1 AS rest FROM s WINDOW w AS (PARTITION BY league, team ORDER BY day, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e1 AS (SELECT s.game_id, s.team, arg_max(elo.r, (elo.day, elo.game_id)) AS r FROM s JOIN elo ON elo.league = s.league AND elo.team = s.team AND elo.day < s.day GROUP BY 1, 2),
e2 AS (SELECT s.game_id, s.team, arg_max(arm.r, (arm.day, arm.game_id)) AS r FROM s JOIN arm ON arm.league = s.league AND arm.who = s.who AND arm.day < s.day GROUP BY 1, 2),
e3 AS (SELECT s.game_id, s.team, sum(pitches) FILTER (WHERE load.day >= s.day - 3) AS p3, sum(pitches) FILTER (WHERE load.day >= s.day - 5) AS p5, count(*) FILTER (WHERE load.day >= s.day - 5 AND pitches > 15) AS o15, count(*) FILTER (WHERE load.day >= s.day - 5 AND pitches > 20) AS o20,
  sum(tired) FILTER (WHERE load.day >= s.day - 5) AS tired, avg(runs) AS bullpen FROM s JOIN load ON load.league = s.league AND load.team = s.team AND load.day < s.day AND load.day >= s.day - 30 GROUP BY 1, 2),
k AS (SELECT h.*, coalesce(e1.r, 1500.0e0) AS rating, e2.r AS arm, CAST(coalesce(p3, 0) AS BIGINT) AS p3, CAST(coalesce(p5, 0) AS BIGINT) AS p5, coalesce(o15, 0) AS o15, coalesce(o20, 0) AS o20, -coalesce(tired, 0.0e0) AS penalty, bullpen
  FROM h LEFT JOIN e1 USING (game_id, team) LEFT JOIN e2 USING (game_id, team) LEFT JOIN e3 USING (game_id, team))"""


def known_sides(t):
    """``side_features`` of all games, on the ladders of teams and starters and the work of relievers."""
    s = starters(t)
    ladder = ordered_fold(s, lambda league: StarterState(PITCHER)).where("home >= 0 and away >= 0")
    usual = Window.partitionBy("pitcher").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    # a pitcher has hardly more pitches a day than one, so they are dealt out before they are counted, and the window needs no exchange of its own
    p = t.pitches.select("pitcher", F.col("game_date").alias("day"), "velocity", "location")
    app = p.repartition(tasks(p), "pitcher").groupBy("pitcher", "day").agg((F.count("*") * 9).alias("pitches"), F.avg("velocity").alias("v"), (100 * F.avg("location")).alias("runs"))
    loads = app.withColumn("drop", F.avg("v").over(usual) - F.col("v")).withColumns({"league": F.col("pitcher") % 16, "team": F.col("pitcher") % 30})
    who = lambda side, n: F.when(F.col("game_id") % n != 0, F.col(side) * 5 + F.col("game_id") % 5)
    games = t.games.withColumns({"home_starter": who("home", 11), "away_starter": who("away", 13)})
    return side_features(games, rated_sides(ordered_fold(final_games(t), MLB)), rated_sides(ladder, lambda arm: F.floor(arm / 5)), loads)


@query("op_matchup", f"""{KNOWN} SELECT x.game_id, round(x.rating, 6) AS home_rating, round(y.rating, 6) AS away_rating, round(1 / (1 + pow(10.0e0, (y.rating - x.rating - 20) / 400)), 6) AS home_win_prob, round(x.arm, 6) AS home_starter, round(y.arm, 6) AS away_starter,
round(x.rf * 1.0e0 / x.n - y.ra * 1.0e0 / y.n, 6) AS home_attack, round(y.rf * 1.0e0 / y.n - x.ra * 1.0e0 / x.n, 6) AS away_attack, x.p3 AS home_pitches3, y.p3 AS away_pitches3, x.p5 AS home_pitches5, y.p5 AS away_pitches5, x.o15 AS home_over15, y.o15 AS away_over15, x.o20 AS home_over20, y.o20 AS away_over20,
round(x.penalty, 4) AS home_penalty, round(y.penalty, 4) AS away_penalty, round(x.bullpen, 6) AS home_bullpen, round(y.bullpen, 6) AS away_bullpen, round(x.form, 6) AS home_form, round(y.form, 6) AS away_form, CAST(x.rest AS INTEGER) AS home_rest, CAST(y.rest AS INTEGER) AS away_rest,
concat_ws(',', CASE WHEN x.arm IS NULL OR y.arm IS NULL THEN 'starter' END, CASE WHEN x.bullpen IS NULL OR y.bullpen IS NULL THEN 'bullpen' END, CASE WHEN x.n = 0 OR y.n = 0 THEN 'record' END) AS missing FROM k x JOIN k y ON x.game_id = y.game_id AND x.is_home AND NOT y.is_home""")
def _(t):
    """A game's row at the time of the decision: ratings, starters, records, bullpens, form, rest, and which of them aren't known."""
    cols = ["rating", "starter_rating", "runs_for", "runs_against", "games", "pitches3", "pitches5", "over15", "over20", "penalty", "bullpen", "form", "rest"]
    g = both_sides(known_sides(t), cols)
    c, mean = F.col, lambda side, what: F.try_divide(F.col(f"{side}_{what}").cast("double"), F.col(f"{side}_games"))
    out = [F.round(odds.expected_score(c("home_rating"), c("away_rating"), 20.0), 6).alias("home_win_prob")]
    out += [F.round(mean(a, "runs_for") - mean(b, "runs_against"), 6).alias(f"{a}_attack") for a, b in (("home", "away"), ("away", "home"))]
    for side in ("home", "away"):
        out += [F.round(f"{side}_rating", 6).alias(f"{side}_rating"), F.round(f"{side}_starter_rating", 6).alias(f"{side}_starter"), F.round(f"{side}_penalty", 4).alias(f"{side}_penalty"), F.round(f"{side}_bullpen", 6).alias(f"{side}_bullpen"), F.round(f"{side}_form", 6).alias(f"{side}_form")]
        out += [c(f"{side}_{x}") for x in ("pitches3", "pitches5", "over15", "over20", "rest")]
    gone = lambda what: c(f"home_{what}").isNull() | c(f"away_{what}").isNull()
    missing = F.concat_ws(",", F.when(gone("starter_rating"), "starter"), F.when(gone("bullpen"), "bullpen"), F.when((c("home_games") == 0) | (c("away_games") == 0), "record"))
    return g.select("game_id", *out, missing.alias("missing"))


@query("op_training_rows", f"""WITH {SIDES}, h AS (SELECT game_id, team, f, a, count(*) OVER w AS prior, avg(f) OVER w AS avg_for FROM s WINDOW w AS (PARTITION BY league, team ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT game_id, team, prior, round(avg_for, 6) AS avg_for, CAST(f > a AS INTEGER) AS label FROM h WHERE prior >= 15""")
def _(t):
    w = Window.partitionBy("league", "team").orderBy("game_date", "game_id").rowsBetween(Window.unboundedPreceding, -1)
    s = unpivot_sides(t.games).withColumns({"prior": F.count("*").over(w), "avg_for": F.avg("points_for").over(w)})
    return s.where("prior >= 15").select("game_id", "team", "prior", F.round("avg_for", 6).alias("avg_for"), (F.col("points_for") > F.col("points_against")).cast("int").alias("label"))


#: Time zones of the venues, by the home side's number; one of them keeps no summer time.
ZONES = ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Phoenix")
PER_ZONE = -0.015
_OFFSET = "(epoch(CAST({d} AS TIMESTAMP)) - epoch(timezone(CASE {v} % 5 " + " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(ZONES)) + " END, CAST({d} AS TIMESTAMP)))) / 3600"


@query("op_travel", f"""WITH v AS (SELECT game_id, league, home AS team, game_date, home AS venue FROM games UNION ALL SELECT game_id, league, away, game_date, home FROM games), l AS (SELECT *, lag(venue) OVER w AS pv, lag(game_date) OVER w AS pd FROM v WINDOW w AS (PARTITION BY league, team ORDER BY game_date, game_id)),
o AS (SELECT *, {_OFFSET.format(d='game_date', v='venue')} AS here, {_OFFSET.format(d='game_date', v='pv')} AS there FROM l)
SELECT game_id, team, pv AS previous_venue, CAST(CASE WHEN pv IS NULL THEN 0 ELSE round(abs(here - there)) END AS INTEGER) AS zones, CASE WHEN pv IS NULL OR here = there THEN 'none' WHEN here > there THEN 'east' ELSE 'west' END AS direction, round(coalesce(there - here, 0.0e0), 6) AS circadian,
CASE WHEN pd IS NULL THEN 2 ELSE CAST(greatest(date_diff('day', pd, game_date) - 1, 0) AS INTEGER) END AS rest, round(CASE WHEN here > there THEN {PER_ZONE}e0 * round(abs(here - there)) ELSE 0.0e0 END, 6) AS penalty FROM o""")
def _(t):
    """The trip from a side's last venue: zones by the clocks of the day, which way, rest, and what a trip east costs."""
    s = t.games.select("game_id", "league", "game_date", F.col("home").alias("venue"), F.explode(F.array("home", "away")).alias("team"))
    w = Window.partitionBy("league", "team").orderBy("game_date", "game_id")
    s = s.withColumns({"previous_venue": F.lag("venue").over(w), "last": F.lag("game_date").over(w)})
    zone = lambda c: F.element_at(F.array(*map(F.lit, ZONES)), (F.col(c) % 5 + 1).cast("int"))
    day = F.col("game_date").cast("timestamp")
    offset = lambda c: (F.unix_timestamp(day) - F.unix_timestamp(F.to_utc_timestamp(day, zone(c)))) / 3600
    here, there = offset("venue"), F.when(F.col("previous_venue").isNotNull(), offset("previous_venue"))
    zones = F.coalesce(F.round(F.abs(here - there)), F.lit(0.0))
    rest = F.when(F.col("last").isNull(), 2).otherwise(F.greatest(F.date_diff("game_date", "last") - 1, F.lit(0)))  # greatest() skips nulls
    way = F.when(here > there, "east").when(here < there, "west").otherwise("none")
    cost = F.when(here > there, PER_ZONE * zones).otherwise(0.0)
    return s.select("game_id", "team", "previous_venue", zones.cast("int").alias("zones"), way.alias("direction"), F.round(F.coalesce(there - here, F.lit(0.0)), 6).alias("circadian"), rest.cast("int").alias("rest"), F.round(cost, 6).alias("penalty"))


#: Parks and the weather at them: a small table by the home side's number, and a reading a day where there is one.
PARKS = "SELECT n_nationkey AS home, n_name AS park, 0.9e0 + (n_nationkey % 5) / 20.0e0 AS runs, 0.85e0 + (n_nationkey % 7) / 20.0e0 AS home_runs, (n_nationkey * 137) % 5300 AS altitude FROM nation"


@query("op_environment", f"""WITH p AS ({PARKS}), w AS (SELECT l_suppkey % 25 AS home, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) + 50 AS temperature, max(l_linenumber) * 3 AS wind FROM lineitem GROUP BY 1, 2)
SELECT game_id, park, round(p.runs, 6) AS run_factor, round(p.home_runs, 6) AS home_run_factor, CAST(altitude AS BIGINT) AS altitude, round(temperature, 4) AS temperature, CAST(wind AS BIGINT) AS wind, round((temperature - 70) / 10.0e0 * 4.5, 6) AS carry_feet,
CASE WHEN p.park IS NULL THEN 'unknown_park' WHEN temperature IS NULL THEN 'no_weather' ELSE 'available' END AS availability FROM games g LEFT JOIN p ON p.home = g.home LEFT JOIN w ON w.home = g.home AND w.day = g.game_date""")
def _(t):
    """Park factors and the day's weather of each game, what warmth adds to a ball's flight, and what isn't known."""
    p = t.spark.sql(PARKS.replace("FROM nation", "FROM {nation}"), nation=t.nation).withColumn("home", F.col("home").cast("bigint"))
    w = t.lineitem.groupBy((F.col("l_suppkey") % 25).alias("home"), F.to_date("l_shipdate").alias("game_date")).agg((F.avg("l_quantity") + 50).alias("temperature"), (F.max("l_linenumber") * 3).cast("bigint").alias("wind"))
    g = t.games.join(F.broadcast(p), "home", "left").join(w, ["home", "game_date"], "left")  # one row a nation
    known = F.when(F.col("park").isNull(), "unknown_park").when(F.col("temperature").isNull(), "no_weather").otherwise("available")
    return g.select("game_id", "park", F.round("runs", 6).alias("run_factor"), F.round("home_runs", 6).alias("home_run_factor"), F.col("altitude").cast("bigint").alias("altitude"), F.round("temperature", 4).alias("temperature"), "wind", F.round((F.col("temperature") - 70) / 10 * 4.5, 6).alias("carry_feet"), known.alias("availability"))


#: Weight of a match on another surface than the coming one.
OTHER_SURFACE = 0.5


@query("op_tennis_features", f"""WITH s AS (SELECT game_id, league, game_id % 3 AS surface, home AS team, away AS opponent, game_date, CASE WHEN home_score > away_score THEN 1.0e0 ELSE 0.0e0 END AS won FROM games
UNION ALL SELECT game_id, league, game_id % 3, away, home, game_date, CASE WHEN away_score > home_score THEN 1.0e0 ELSE 0.0e0 END FROM games),
p AS (SELECT a.game_id, a.team, a.game_date, b.game_date AS then_, b.won, exp(-ln(2) * date_diff('day', b.game_date, a.game_date) / 180.0) AS w, CASE WHEN a.surface = b.surface THEN 1.0e0 ELSE {OTHER_SURFACE} END AS f FROM s a JOIN s b ON a.league = b.league AND a.team = b.team AND b.game_date < a.game_date AND b.game_date >= a.game_date - 365),
h AS (SELECT game_id, team, sum(w * won) / sum(w) AS rate, sum(w * f * won) / sum(w * f) AS surface_rate, count(*) AS n, count(*) FILTER (WHERE then_ >= game_date - 14) AS fatigue FROM p GROUP BY 1, 2),
u AS (SELECT game_id, team, sum(won) OVER v AS wins, count(*) OVER v AS met FROM s WINDOW v AS (PARTITION BY league, team, opponent ORDER BY game_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
r AS (SELECT a.game_id, a.team, b.opponent, avg(b.won) AS rate, count(*) AS n FROM s a JOIN s b ON a.league = b.league AND a.team = b.team AND b.game_date < a.game_date GROUP BY 1, 2, 3),
c AS (SELECT x.game_id, x.team, sum(least(x.n, y.n) * (x.rate - y.rate)) / sum(least(x.n, y.n)) AS edge, count(*) AS shared FROM r x JOIN r y ON x.game_id = y.game_id AND x.opponent = y.opponent AND x.team <> y.team GROUP BY 1, 2)
SELECT h.game_id, h.team, round(h.rate, 6) AS decayed_rate, round(h.surface_rate, 6) AS surface_rate, h.n, h.fatigue, coalesce(u.wins, 0) AS h2h_wins, u.met AS h2h_met, round(h.n / (h.n + 10.0e0), 6) AS certainty, round(coalesce(c.edge, 0) + 1e-9, 6) AS common_edge, coalesce(c.shared, 0) AS common_opponents
FROM h JOIN u ON u.game_id = h.game_id AND u.team = h.team LEFT JOIN c ON c.game_id = h.game_id AND c.team = h.team""")
def _(t):
    """A side's record before the match: decayed, by surface, head to head, tiredness, and against opponents that both have met.

    exp decay is a ratio of sums: what the coming day weighs cancels out, so ordered windows do without a self-join.  They run over a row
    a side and day, as a window that slides by days takes in each of its rows anew at each step.  A mean of few ratios often ends halfway
    between two roundings, which 1e-9 settles whatever the order of the sum.
    """
    games = t.games.where("game_date is not null")
    won = lambda mine, theirs: F.when(F.col(mine) > F.col(theirs), 1.0).otherwise(0.0)
    s = unpivot_sides(games).select("game_id", "league", "game_date", "team", "opponent", (F.col("game_id") % 3).alias("surface"), won("points_for", "points_against").alias("won"))
    on = lambda i, c: F.when(F.col("surface") == i, c)
    sums = [F.sum("won").alias("won"), F.count("*").alias("n")] + [c for i in range(3) for c in (F.sum(on(i, F.col("won"))).alias(f"won{i}"), F.count(on(i, 1)).alias(f"n{i}"))]
    day = Window.partitionBy("league", "team").orderBy(F.unix_date("game_date"))
    decayed = {f"d_{c}": decayed_sum(F.col(c), F.unix_date("game_date"), 365, 180.0, ["league", "team"]) for c in ("won", "n", *(f"{c}{i}" for c in ("won", "n") for i in range(3)))}
    count = lambda d: F.coalesce(F.sum("n").over(day.rangeBetween(-d, -1)), F.lit(0))
    days = s.groupBy("league", "team", "game_date").agg(*sums).withColumns({**decayed, "n": count(365), "fatigue": count(14)}).where("n > 0")
    of = lambda c, i: OTHER_SURFACE * F.col(f"d_{c}") + (1 - OTHER_SURFACE) * F.col(f"d_{c}{i}")
    days = days.select(
        "league", "team", "game_date", "n", "fatigue", F.round(F.col("n") / (F.col("n") + 10.0), 6).alias("certainty"),
        F.round(F.try_divide("d_won", "d_n"), 6).alias("decayed_rate"), F.array(*[F.round(F.try_divide(of("won", i), of("n", i)), 6) for i in range(3)]).alias("surfaces"),
    )
    met = records_before(games.withColumns({"home_won": won("home_score", "away_score"), "away_won": won("away_score", "home_score")}))
    known = met.join(days, ["league", "team", "game_date"])
    out = s.select("game_id", "league", "game_date", "team", "opponent", "surface").join(known, ["league", "game_date", "team", "opponent"])
    return out.select(
        "game_id", "team", "decayed_rate", F.get("surfaces", F.col("surface").cast("int")).alias("surface_rate"), "n", "fatigue", F.col("wins").alias("h2h_wins"), F.col("met").alias("h2h_met"), "certainty",
        F.round(F.coalesce("edge", F.lit(0.0)) + 1e-9, 6).alias("common_edge"), F.col("shared").alias("common_opponents"),
    )


@query("op_oriented_rows", "SELECT game_id, greatest(home_score, away_score) AS a, least(home_score, away_score) AS b, 1 AS target FROM games UNION ALL SELECT game_id, least(home_score, away_score), greatest(home_score, away_score), 0 FROM games")
def _(t):
    hi, lo = F.greatest("home_score", "away_score"), F.least("home_score", "away_score")
    row = lambda a, b, y: F.struct(a.alias("a"), b.alias("b"), F.lit(y).alias("target"))
    return t.games.select("game_id", F.explode(F.array(row(hi, lo, 1), row(lo, hi, 0))).alias("r")).select("game_id", "r.*")


@query("op_epl_frame", f"""{elo_sql({'EPL': SOCCER['EPL']})}, w AS (SELECT game_id, league, game_date, home AS team, TRUE AS is_home, CASE WHEN home_score > away_score THEN 1.0e0 ELSE 0.0e0 END AS won FROM games WHERE status <> 'scheduled'
UNION ALL SELECT game_id, league, game_date, away, FALSE, CASE WHEN away_score > home_score THEN 1.0e0 ELSE 0.0e0 END FROM games WHERE status <> 'scheduled'),
l AS (SELECT *, avg(won) OVER (PARTITION BY league, team ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS form FROM w),
e AS (SELECT game_id, least(greatest(0.28e0 * exp(-pow((home_before + 60 - away_before) / 350, 2)), 0.05e0), 0.35e0) AS d, 1 / (1 + pow(10.0e0, (away_before - home_before - 60) / 400)) AS e FROM scored),
p AS (SELECT game_id, d, greatest(e - d / 2, 0.01e0) AS h, greatest(1 - e - d / 2, 0.01e0) AS a FROM e)
SELECT p.game_id, round(h / (h + d + p.a), 6) AS p_home, round(d / (h + d + p.a), 6) AS p_draw, round(x.form, 6) AS home_form, round(y.form, 6) AS away_form FROM p JOIN l x ON x.game_id = p.game_id AND x.is_home JOIN l y ON y.game_id = p.game_id AND NOT y.is_home""")
def _(t):
    """Soccer training frame: ratings before the game, three-way odds of the ratings, both sides' last five."""
    s = ordered_fold(t.games.where("status <> 'scheduled'"), SOCCER["EPL"])
    w = Window.partitionBy("league", "team").orderBy("game_date", "game_id").rowsBetween(-5, -1)
    f = unpivot_sides(t.games.where("status <> 'scheduled'")).select("game_id", "is_home", F.avg((F.col("points_for") > F.col("points_against")).cast("double")).over(w).alias("form"))
    pick = lambda home: F.max(F.when(F.col("is_home") == home, F.col("form")))
    f = f.groupBy("game_id").agg(pick(True).alias("home_form"), pick(False).alias("away_form"))
    p = odds.three_way(F.col("home_before"), F.col("away_before"))
    return s.join(f, "game_id").select("game_id", F.round(p["home"], 6).alias("p_home"), F.round(p["draw"], 6).alias("p_draw"), F.round("home_form", 6).alias("home_form"), F.round("away_form", 6).alias("away_form"))


@query("op_time_split", "WITH c AS (SELECT quantile_disc(game_date, 0.8) AS d FROM games) SELECT game_id, CASE WHEN game_date <= d THEN 'train' ELSE 'holdout' END AS part FROM games, c")
def _(t):
    """The cut is a date, found from the counts by day."""
    days = t.games.groupBy("game_date").agg(F.count("*").alias("n"))
    w = Window.orderBy("game_date").rowsBetween(Window.unboundedPreceding, 0)
    run = days.withColumn("run", F.sum("n").over(w)).crossJoin(F.broadcast(days.agg(F.sum("n").alias("total"))))
    cut = run.where(F.col("run") >= 0.8 * F.col("total")).agg(F.min("game_date").alias("d"))
    return t.games.crossJoin(F.broadcast(cut)).select("game_id", F.when(F.col("game_date") <= F.col("d"), "train").otherwise("holdout").alias("part"))


def newton_sql(names: list[str], rounds: int = 15) -> str:
    """A relation b(i, b0, b1, ...): logistic coefficients after i Newton steps on the rows of d(x0, x1, ..., y) marked ``learn``."""
    n = range(len(names))
    beta = ", ".join(f"b{k}" for k in n)
    at = " + ".join(f"b{k} * x{k}" for k in n)
    sums = [f"sum(p * (1 - p) * x{r} * x{c}) AS h{r}_{c}" for r in n for c in n] + [f"sum(x{r} * (y - p)) AS g{r}" for r in n]
    step = f"SELECT i, {beta}, {', '.join(sums)} FROM (SELECT b.*, d.*, 1 / (1 + exp(-({at}))) AS p FROM b CROSS JOIN d WHERE i < {rounds} AND learn) GROUP BY i, {beta}"
    for k in n:  # elimination, a column a layer
        new = [f"h{r}_{c} - h{r}_{k} / h{k}_{k} * h{k}_{c} AS h{r}_{c}" for r in n if r > k for c in n if c > k] + [f"g{r} - h{r}_{k} / h{k}_{k} * g{k} AS g{r}" for r in n if r > k]
        if new:
            step = f"SELECT * REPLACE ({', '.join(new)}) FROM ({step})"
    for k in reversed(n):
        rest = "".join(f" - h{k}_{c} * s{c}" for c in n if c > k)
        step = f"SELECT *, (g{k}{rest}) / h{k}_{k} AS s{k} FROM ({step})"
    return f"b(i, {beta}) AS (SELECT 0, {', '.join('0.0e0' for _ in n)} UNION ALL SELECT i + 1, {', '.join(f'b{k} + s{k}' for k in n)} FROM ({step}))"


@query("op_logistic", f"""WITH RECURSIVE d AS (SELECT bet_id, 1.0e0 AS x0, elo_prob AS x1, market_prob AS x2, hours_before AS x3, CASE WHEN status = 'won' THEN 1.0e0 ELSE 0.0e0 END AS y, bet_id % 2 = 0 AS learn FROM bets WHERE status <> 'open'),
{newton_sql(['one', 'elo_prob', 'market_prob', 'hours_before'])}
SELECT bet_id, round(p, 4) AS p, CASE WHEN p > 0.5 THEN 1.0e0 ELSE 0.0e0 END AS prediction FROM (SELECT bet_id, 1 / (1 + exp(-(b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3))) AS p FROM d CROSS JOIN (SELECT * FROM b WHERE i = 15))""")
def _(t):
    """Scaled logistic regression of the outcome on probabilities and timing, fitted on even ids and applied to all."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    b = t.bets.where("status <> 'open'").select("bet_id", "elo_prob", "market_prob", "hours_before", (F.col("status") == "won").cast("double").alias("label"))
    steps = [VectorAssembler(inputCols=["elo_prob", "market_prob", "hours_before"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=200, tol=1e-12)]
    model = Pipeline(stages=steps).fit(b.where("bet_id % 2 = 0"))
    return model.transform(b).select("bet_id", F.round(vector_to_array("probability")[1], 4).alias("p"), "prediction")


@query("op_pnl_diag", f"""WITH d AS (SELECT * FROM bets WHERE status <> 'open'), {bootstrap_sql("SELECT sport, bet_id AS id, profit AS x FROM bets WHERE status <> 'open'", 'sport', 2)},
g AS (SELECT sport, count(*) AS n, count(*) FILTER (WHERE profit > 0) AS wins, sum(profit) / sum(cost) AS roi, avg(closing_prob - market_prob) FILTER (WHERE closing_prob NOT IN (0.0, 1.0)) AS clv, count(closing_prob) AS covered, avg(hours_before) AS hours,
  sum(profit) FILTER (WHERE hours_before < 2) / sum(cost) FILTER (WHERE hours_before < 2) AS late, sum(profit) FILTER (WHERE hours_before >= 8) / sum(cost) FILTER (WHERE hours_before >= 8) AS early FROM d GROUP BY 1)
SELECT sport, n, wins, n - wins AS losses, round(roi, 6) AS roi, round(clv, 6) AS clv, covered, round(hours, 6) AS avg_hours, round(late, 6) AS roi_under_2h, round(early, 6) AS roi_over_8h, mean AS mean_profit, low, high, p_value,
CASE WHEN n < 50 THEN 'INSUFFICIENT_DATA' WHEN high < 0 THEN 'PAUSE' ELSE 'CONTINUE' END AS verdict FROM g JOIN boot USING (sport)""")
def _(t):
    """A sport's results, closing-line value, timing and the bootstrap of its profit; it pauses where the bound is below nothing."""
    d = t.bets.where("status <> 'open'")
    roi = lambda c: F.sum(F.when(c, F.col("profit"))) / F.sum(F.when(c, F.col("cost")))
    real = F.when(~F.col("closing_prob").isin(0.0, 1.0), F.col("closing_prob") - F.col("market_prob"))
    h = F.col("hours_before")
    g = d.groupBy("sport").agg(F.count("*").alias("n"), n_if(F.col("profit") > 0).alias("wins"), F.round(roi(F.lit(True)), 6).alias("roi"), F.round(F.avg(real), 6).alias("clv"), F.count("closing_prob").alias("covered"), F.round(F.avg(h), 6).alias("avg_hours"), F.round(roi(h < 2), 6).alias("roi_under_2h"), F.round(roi(h >= 8), 6).alias("roi_over_8h"))
    boot = bootstrap(d.select("sport", F.col("bet_id").alias("id"), F.col("profit").alias("x")), "sport", 2).withColumnRenamed("mean", "mean_profit")
    verdict = F.when(F.col("n") < 50, "INSUFFICIENT_DATA").when(F.col("high") < 0, "PAUSE").otherwise("CONTINUE")
    return g.join(boot, "sport").withColumns({"losses": F.col("n") - F.col("wins"), "verdict": verdict})


@query("op_backtest_kelly", """WITH k AS (SELECT greatest(0, (elo_prob * 0.9 - (1 - elo_prob)) / 0.9) * 100 AS stake, CASE status WHEN 'won' THEN 0.9 ELSE -1 END AS r FROM bets WHERE status <> 'open') SELECT round(sum(stake * r), 2) AS pnl, round(sum(stake * r) / sum(stake), 6) AS roi FROM k""")
def _(t):
    k = t.bets.where("status <> 'open'").select((F.greatest(F.lit(0.0), (F.col("elo_prob") * 0.9 - (1 - F.col("elo_prob"))) / 0.9) * 100).alias("stake"), F.when(F.col("status") == "won", 0.9).otherwise(-1.0).alias("r"))
    pnl = F.sum(F.col("stake") * F.col("r"))
    return k.agg(F.round(pnl, 2).alias("pnl"), F.round(pnl / F.sum("stake"), 6).alias("roi"))


@query("op_adjustments", """WITH g AS (SELECT game_id, home, away, home_score, away_score, elo_prob AS p, market_prob AS m, date_diff('day', game_date, max(game_date) OVER ()) AS days FROM games JOIN bets ON bet_id = game_id),
h AS (SELECT home AS team, count(*) AS n, count(*) FILTER (WHERE home_score > away_score) AS w FROM g GROUP BY 1), a AS (SELECT away AS team, count(*) AS n, count(*) FILTER (WHERE away_score > home_score) AS w FROM g GROUP BY 1),
f AS (SELECT team, coalesce(h.w * 1.0e0 / h.n, 0.5e0) - 0.5 AS at_home, coalesce(a.w * 1.0e0 / a.n, 0.5e0) - 0.5 AS away FROM h FULL JOIN a USING (team) WHERE coalesce(h.n, 0) + coalesce(a.n, 0) > 10)
SELECT game_id, round(least(greatest(0.7 * p + 0.3 * m, 0.01), 0.99), 6) AS blend, round(least(greatest(p * least(1.0e0, greatest(0.5e0, 1 - days / 365.0e0)), 0.01), 0.99), 6) AS recency,
round(CASE WHEN x.team IS NULL OR y.team IS NULL THEN p ELSE least(greatest(p * (1 + x.at_home - y.away), 0.01), 0.99) END, 6) AS team_factor,
round(least(greatest(p * (CASE WHEN home_score = away_score THEN 1.0e0 ELSE 1 + 0.001 * least(greatest(abs(home_score - away_score), 1), 10) * ln(abs(home_score - away_score) + 1) END), 0.01), 0.99), 6) AS margin, round(least(greatest(p, 0.01), 0.99), 6) AS situation
FROM g LEFT JOIN f x ON x.team = g.home LEFT JOIN f y ON y.team = g.away""")
def _(t):
    """Five variants of a game's probability: blended with the market, weighed by age, by the sides' records at home and away, by the margin, by the situation (none is known)."""
    g = t.games.join(t.bets.select(F.col("bet_id").alias("game_id"), F.col("elo_prob").alias("p"), F.col("market_prob").alias("m")), "game_id")
    won = lambda a, b: F.count(F.when(F.col(f"{a}_score") > F.col(f"{b}_score"), 1))
    h = g.groupBy(F.col("home").alias("team")).agg(F.count("*").alias("hn"), won("home", "away").alias("hw"))
    a = g.groupBy(F.col("away").alias("team")).agg(F.count("*").alias("an"), won("away", "home").alias("aw"))
    rate = lambda w, n: F.coalesce(F.col(w) / F.col(n), F.lit(0.5)) - 0.5
    f = h.join(a, "team", "full_outer").where(F.coalesce("hn", F.lit(0)) + F.coalesce("an", F.lit(0)) > 10).select("team", rate("hw", "hn").alias("at_home"), rate("aw", "an").alias("on_road"))
    x, y = f.select(F.col("team").alias("home"), "at_home"), f.select(F.col("team").alias("away"), "on_road")
    last = t.games.join(t.bets.select(F.col("bet_id").alias("game_id")), "game_id", "left_semi").agg(F.max("game_date").alias("last"))  # one row
    g = g.join(x, "home", "left").join(y, "away", "left").crossJoin(F.broadcast(last))
    p, gap = F.col("p"), F.abs(F.col("home_score") - F.col("away_score"))
    clip = lambda c: odds.clip(c, 0.01, 0.99)
    age = odds.clip(1 - F.date_diff("last", "game_date") / 365.0, 0.5, 1.0)
    mov = F.when(gap == 0, 1.0).otherwise(1 + 0.001 * F.least(F.greatest(gap, F.lit(1)), F.lit(10)) * F.log(gap + 1.0))
    team = F.when(F.col("at_home").isNull() | F.col("on_road").isNull(), p).otherwise(clip(p * (1 + F.col("at_home") - F.col("on_road"))))
    variants = {"blend": clip(0.7 * p + 0.3 * F.col("m")), "recency": clip(p * age), "team_factor": team, "margin": clip(p * mov), "situation": clip(p)}
    return g.select("game_id", *[F.round(c, 6).alias(n) for n, c in variants.items()])


#: The day of the check; rows from after it are of the future.
TODAY = "1998-10-01"
LINE_RULES = lambda: [
    *present("l_orderkey", "l_partkey"), in_range("l_quantity", 1, 45), in_range("l_discount", 0, 0.08, "warning"),
    Rule("flag_status", (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F")), Rule("ship_receipt", F.col("l_extendedprice") >= F.col("l_quantity") * 900, "warning"), not_after("l_shipdate", F.lit(TODAY).cast("date")),
]
LINE_CODES = f"""CASE WHEN NOT l_quantity BETWEEN 1 AND 45 THEN 'l_quantity_range' END, CASE WHEN NOT l_discount BETWEEN 0 AND 0.08 THEN 'l_discount_range' END, CASE WHEN NOT (l_returnflag <> 'R' OR l_linestatus = 'F') THEN 'flag_status' END,
CASE WHEN NOT l_extendedprice >= l_quantity * 900 THEN 'ship_receipt' END, CASE WHEN NOT CAST(l_shipdate AS DATE) <= DATE '{TODAY}' THEN 'l_shipdate_future' END"""
LINE_ERRORS = f"(NOT l_quantity BETWEEN 1 AND 45 OR (l_returnflag = 'R' AND l_linestatus <> 'F') OR CAST(l_shipdate AS DATE) > DATE '{TODAY}')"
LINE_WARNINGS = "(NOT l_discount BETWEEN 0 AND 0.08 OR NOT l_extendedprice >= l_quantity * 900)"


def dated_lines(t):
    return t.lineitem.withColumn("l_shipdate", F.to_date("l_shipdate"))


@query("op_ingest_validate", f"""SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', {LINE_CODES}) AS errors, CASE WHEN {LINE_ERRORS} THEN 'error' WHEN {LINE_WARNINGS} THEN 'warning' END AS severity,
CASE WHEN {LINE_ERRORS} THEN 'rejected' ELSE 'good' END AS verdict FROM lineitem""")
def _(t):
    """Missing, out of range, at odds with one another, of the future: codes, the worst severity and the verdict, in one pass."""
    return judged(dated_lines(t), LINE_RULES()).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("codes", ",").alias("errors"), "severity", "verdict")


@query("op_ingest_quarantine", f"""WITH x AS (SELECT l_orderkey % 97 = 0 AS torn, {LINE_ERRORS} AS bad, {LINE_WARNINGS} AS odd FROM lineitem)
SELECT 'unparsable' AS sink, count(*) FILTER (WHERE torn) AS n, CAST(0 AS BIGINT) AS warned FROM x UNION ALL SELECT 'rejected', count(*) FILTER (WHERE NOT torn AND bad), 0 FROM x
UNION ALL SELECT 'good', count(*) FILTER (WHERE NOT torn AND NOT bad), count(*) FILTER (WHERE NOT torn AND NOT bad AND odd) FROM x""")
def _(t):
    """CSV lines, some of them torn: what can't be read, what is rejected and what is good each have a sink, and nothing is lost."""
    cols = ["l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = dated_lines(t).select(F.when(F.col("l_orderkey") % 97 == 0, F.concat(F.lit("?,"), F.col("l_orderkey").cast("string"))).otherwise(F.concat_ws(",", *[F.col(c).cast("string") for c in cols])).alias("value"))
    path = shared_path(t.spark, "lines")
    lines.write.text(path)
    rows, torn = csv_or_torn(t.spark, path, "l_orderkey bigint, l_partkey bigint, l_quantity double, l_discount double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate date")
    good, rejected, _ = quarantined(rows, LINE_RULES())
    warned = lambda df: df.agg(F.count("*").alias("n"), n_if(F.col("severity") == "warning").alias("warned"))
    told = [(sink, warned(df)) for sink, df in (("unparsable", torn.withColumn("severity", F.lit("error"))), ("rejected", rejected), ("good", good))]
    out = [df.select(F.lit(sink).alias("sink"), "n", "warned") for sink, df in told]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("op_stats_validate", """SELECT 'rows' AS name, CAST(count(*) AS BIGINT) AS value FROM lineitem UNION ALL SELECT 'null_discount', count(*) FILTER (WHERE l_discount IS NULL) FROM lineitem UNION ALL SELECT 'orphans', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def _(t):
    x = t.lineitem.agg(F.count("*").alias("rows"), n_if(F.col("l_discount").isNull()).alias("null_discount"))
    x = x.crossJoin(t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans")))
    return x.unpivot([], ["rows", "null_discount", "orphans"], "name", "value")


@query("op_sync_update", "WITH n AS (SELECT market, arg_max(price, (observed_at, quote_id)) AS price FROM quotes WHERE bookmaker = 'click' GROUP BY 1) SELECT bet_id, round(coalesce(1 / n.price, market_prob), 6) AS market_prob FROM bets b LEFT JOIN n ON b.market = n.market")
def _(t):
    n = t.quotes.where("bookmaker = 'click'").groupBy("market").agg(F.max_by("price", F.struct("observed_at", "quote_id")).alias("price"))
    return t.bets.join(n, "market", "left").select("bet_id", F.round(F.coalesce(1 / F.col("price"), "market_prob"), 6).alias("market_prob"))


@query("op_ledger_lineage", """SELECT w.wager_id, q.quote_id AS entry_quote, round(w.stake / q.price, 4) AS contracts, round(CASE WHEN w.wager_id % 3 = 0 THEN w.stake ELSE 0 END - w.stake / q.price, 4) AS profit FROM wagers w ASOF LEFT JOIN (SELECT * FROM quotes WHERE bookmaker <> 'purchase') q ON w.market = q.market AND w.placed_at >= q.observed_at""")
def _(t):
    g = asof_join(t.wagers, t.quotes.where("bookmaker <> 'purchase'"), ["market"], "placed_at", "observed_at", ["quote_id", "price"], parts=SPANS)
    cost = F.col("stake") / F.col("price")
    return g.select("wager_id", F.col("quote_id").alias("entry_quote"), F.round(cost, 4).alias("contracts"), F.round(F.when(F.col("wager_id") % 3 == 0, F.col("stake")).otherwise(0.0) - cost, 4).alias("profit"))


@query("op_deposits", """WITH d AS (SELECT date_trunc('hour', ts) AS hour, sum(value) AS deposit FROM events WHERE event_type = 'signup' GROUP BY 1), c AS (SELECT s.hour, volume, coalesce(deposit, 0) AS deposit FROM snapshots s LEFT JOIN d ON d.hour = s.hour)
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, round(sum(deposit) OVER w, 2) AS deposits, round(sum(volume) OVER w, 2) AS worth, round(sum(volume) OVER w - sum(deposit) OVER w, 2) AS net_profit FROM c WINDOW w AS (ORDER BY hour ROWS UNBOUNDED PRECEDING)""")
def _(t):
    """Deposits up to each hour, what the portfolio is worth then, and what is left of that without them."""
    d = t.events.where("event_type = 'signup'").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("deposit"))
    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)  # a row an hour
    paid, worth = F.sum(F.coalesce("deposit", F.lit(0.0))).over(w), F.sum("volume").over(w)
    return t.snapshots.join(d, "hour", "left").select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.round(paid, 2).alias("deposits"), F.round(worth, 2).alias("worth"), F.round(worth - paid, 2).alias("net_profit"))


#: Weight of the market's probability; what park factors are by the home side's number.
MARKET_WEIGHT, PARK = 0.3, "(0.9e0 + (g.home % 5) / 20.0e0)"
_CLIP = "least(greatest({}, -50.0e0), 50.0e0)"


@query("op_mlb_ensemble", f"""{KNOWN}, z AS (SELECT *, CASE WHEN pow(rf, 1.83e0) + pow(ra, 1.83e0) > 0 THEN pow(rf, 1.83e0) / (pow(rf, 1.83e0) + pow(ra, 1.83e0)) ELSE 0.5e0 END AS pyth FROM k),
t AS (SELECT g.game_id, x.rating AS hr, y.rating AS ar, round(coalesce({PITCHER_WEIGHT}e0 * (x.arm - y.arm), 0.0e0), 6) AS starter, round({_CLIP.format('(coalesce(x.pyth, 0.5e0) - coalesce(y.pyth, 0.5e0)) / 0.00144e0 * 0.3e0')}, 6) AS record,
  round(coalesce(CASE WHEN x.bullpen > 0 AND y.bullpen > 0 THEN {_CLIP.format('(y.bullpen - x.bullpen) * 30')} END, 0.0e0), 6) AS bullpen, round({_CLIP.format(f'(x.rating - y.rating) * (({PARK} - 1) * 0.10e0)')}, 6) AS park,
  round((coalesce(x.form, 0.5e0) - coalesce(y.form, 0.5e0)) * 40, 6) AS form, (least(2, greatest(0, coalesce(x.rest, 2))) - least(2, greatest(0, coalesce(y.rest, 2)))) * 6.0e0 AS rest
  FROM games g JOIN z x ON x.game_id = g.game_id AND x.is_home JOIN z y ON y.game_id = g.game_id AND NOT y.is_home)
SELECT t.game_id, starter, record, bullpen, park, form, rest, round(CASE WHEN b.market_prob > 0 AND b.market_prob < 1 THEN {MARKET_WEIGHT}e0 * b.market_prob + (1 - {MARKET_WEIGHT}e0) * p ELSE p END, 6) AS p
FROM (SELECT *, 1 / (1 + pow(10.0e0, (ar - (hr + 20 + (starter + record + bullpen + park + form + rest))) / 400)) AS p FROM t) t LEFT JOIN bets b ON b.bet_id = t.game_id""")
def _(t):
    """Team ratings and the points of starter, record, bullpen, park, form and rest, blended with the market where it has a price."""
    g = both_sides(known_sides(t), ["rating", "starter_rating", "runs_for", "runs_against", "bullpen", "form", "rest"])
    h, a = (lambda what, side=side: F.col(f"{side}_{what}") for side in ("home", "away"))
    half = lambda c: F.coalesce(c, F.lit(0.5))
    pyth = lambda side: half(stats.pythagorean(side("runs_for").cast("double"), side("runs_against").cast("double")))
    rest = lambda side: F.least(F.lit(2), F.greatest(F.lit(0), F.coalesce(side("rest"), F.lit(2))))
    g = g.join(t.games.select("game_id", "home"), "game_id").join(t.bets.select(F.col("bet_id").alias("game_id"), "market_prob"), "game_id", "left")
    terms = {
        "starter": F.coalesce(PITCHER_WEIGHT * (h("starter_rating") - a("starter_rating")), F.lit(0.0)),
        "record": clipped((pyth(h) - pyth(a)) / 0.00144 * 0.3),
        "bullpen": F.coalesce(F.when((h("bullpen") > 0) & (a("bullpen") > 0), clipped((a("bullpen") - h("bullpen")) * 30)), F.lit(0.0)),
        "park": clipped((h("rating") - a("rating")) * ((0.9 + (F.col("home") % 5) / 20.0 - 1) * 0.10)),
        "form": (half(h("form")) - half(a("form"))) * 40,
        "rest": (rest(h) - rest(a)) * 6.0,
    }
    g = g.select("game_id", "home_rating", "away_rating", "market_prob", *[F.round(c, 6).alias(n) for n, c in terms.items()])
    adj = sum((F.col(n) for n in list(terms)[1:]), F.col("starter"))
    p = 1 / (1 + F.pow(F.lit(10.0), (F.col("away_rating") - (F.col("home_rating") + 20 + adj)) / 400))
    m = F.col("market_prob")
    return g.select("game_id", *terms, F.round(F.when((m > 0) & (m < 1), MARKET_WEIGHT * m + (1 - MARKET_WEIGHT) * p).otherwise(p), 6).alias("p"))


@query("op_soccer_blend", """WITH p AS (SELECT bet_id, elo_prob * 0.75 AS mh, 0.25e0 AS md, (1 - elo_prob) * 0.75 AS ma, market_prob * 0.72 AS eh, 0.28e0 AS ed, (1 - market_prob) * 0.72 AS ea, coalesce(closing_prob * 0.7, 0.4) AS bh, CASE WHEN closing_prob IS NULL THEN 0.25e0 ELSE 0.3e0 END AS bd, coalesce((1 - closing_prob) * 0.7, 0.35) AS ba FROM bets),
x AS (SELECT bet_id, mh * 0.6 + eh * 0.2 + bh * 0.2 AS h, md * 0.6 + ed * 0.2 + bd * 0.2 AS d, ma * 0.6 + ea * 0.2 + ba * 0.2 AS a FROM p) SELECT bet_id, round(h / (h + d + a), 6) AS home, round(d / (h + d + a), 6) AS draw, round(a / (h + d + a), 6) AS away FROM x""")
def _(t):
    """Model, ratings and bookmaker, 60 to 20 to 20, over three outcomes; a bookmaker without a price counts with usual shares."""
    e, m, c = F.col("elo_prob"), F.col("market_prob"), F.col("closing_prob")
    usual = {"home": 0.4, "draw": 0.25, "away": 0.35}
    model = {"home": e * 0.75, "draw": F.lit(0.25), "away": (1 - e) * 0.75}
    rated = {"home": m * 0.72, "draw": F.lit(0.28), "away": (1 - m) * 0.72}
    book = {"home": c * 0.7, "draw": F.when(c.isNotNull(), 0.3), "away": (1 - c) * 0.7}
    x = {o: model[o] * 0.6 + rated[o] * 0.2 + F.coalesce(book[o], F.lit(u)) * 0.2 for o, u in usual.items()}
    total = x["home"] + x["draw"] + x["away"]
    return t.bets.select("bet_id", *[F.round(p / total, 6).alias(o) for o, p in x.items()])


@query("op_book_probs", """WITH l AS (SELECT market, bookmaker, arg_max(price, (observed_at, quote_id)) AS price FROM quotes WHERE observed_at >= TIMESTAMP '2024-01-20' GROUP BY 1, 2), p AS (SELECT market, 1 / coalesce(max(price) FILTER (WHERE bookmaker = 'click'), 2.5) AS h, 1 / coalesce(max(price) FILTER (WHERE bookmaker = 'view'), 3.3) AS d, 1 / coalesce(max(price) FILTER (WHERE bookmaker = 'error'), 2.9) AS a FROM l GROUP BY 1)
SELECT market, round(h / (h + d + a), 6) AS home, round(d / (h + d + a), 6) AS draw, round(a / (h + d + a), 6) AS away FROM p""")
def _(t):
    last = t.quotes.where(F.col("observed_at") >= "2024-01-20").groupBy("market", "bookmaker").agg(F.max_by("price", F.struct("observed_at", "quote_id")).alias("price"))
    one = lambda b, d: 1 / F.coalesce(F.max(F.when(F.col("bookmaker") == b, F.col("price"))), F.lit(d))
    p = last.groupBy("market").agg(one("click", 2.5).alias("h"), one("view", 3.3).alias("d"), one("error", 2.9).alias("a"))
    total = F.col("h") + F.col("d") + F.col("a")
    return p.select("market", *[F.round(F.col(c) / total, 6).alias(n) for c, n in (("h", "home"), ("d", "draw"), ("a", "away"))])


@query("op_sharp_confirm", "WITH s AS (SELECT market, arg_max(price, (observed_at, quote_id)) < arg_min(price, (observed_at, quote_id)) AS rlm FROM quotes GROUP BY 1) SELECT bet_id, coalesce(s.rlm, false) OR coalesce(closing_prob - market_prob >= 0.15, false) AS confirmed FROM bets b LEFT JOIN s ON b.market = s.market WHERE status = 'open'")
def _(t):
    s = open_close(t).select("market", (F.col("close_price") < F.col("open_price")).alias("rlm"))
    no = F.lit(False)
    return t.bets.where("status = 'open'").join(s, "market", "left").select("bet_id", (F.coalesce("rlm", no) | F.coalesce(F.col("closing_prob") - F.col("market_prob") >= 0.15, no)).alias("confirmed"))


@query("op_surface", """WITH s AS (SELECT game_id, league, home AS team, away AS opponent, game_date, game_id % 3 AS surface, TRUE AS is_home FROM games UNION ALL SELECT game_id, league, away, home, game_date, game_id % 3, FALSE FROM games),
l AS (SELECT *, max(CASE WHEN surface = 0 THEN game_date END) OVER w AS d0, max(CASE WHEN surface = 1 THEN game_date END) OVER w AS d1, max(CASE WHEN surface = 2 THEN game_date END) OVER w AS d2, lag(surface) OVER v AS met
FROM s WINDOW w AS (PARTITION BY league, team ORDER BY game_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), v AS (PARTITION BY league, least(team, opponent), greatest(team, opponent), is_home ORDER BY game_date, game_id)),
v AS (SELECT a.game_id, CASE WHEN a.d0 IS NOT NULL AND b.d0 IS NOT NULL THEN least(a.d0, b.d0) END AS s0, CASE WHEN a.d1 IS NOT NULL AND b.d1 IS NOT NULL THEN least(a.d1, b.d1) END AS s1, CASE WHEN a.d2 IS NOT NULL AND b.d2 IS NOT NULL THEN least(a.d2, b.d2) END AS s2,
a.met, greatest(a.d0, b.d0) AS e0, greatest(a.d1, b.d1) AS e1, greatest(a.d2, b.d2) AS e2 FROM l a JOIN l b ON a.game_id = b.game_id AND a.is_home AND NOT b.is_home)
SELECT game_id, CAST(CASE WHEN coalesce(s0, s1, s2) IS NOT NULL THEN CASE greatest(s0, s1, s2) WHEN s0 THEN 0 WHEN s1 THEN 1 ELSE 2 END WHEN met IS NOT NULL THEN met WHEN coalesce(e0, e1, e2) IS NOT NULL THEN CASE greatest(e0, e1, e2) WHEN e0 THEN 0 WHEN e1 THEN 1 ELSE 2 END ELSE 0 END AS BIGINT) AS surface FROM v""")
def _(t):
    """The surface to expect before a match: the newest that both have played on, else that of their last meeting, else the newest of either, else 0."""
    g = t.games.withColumn("surface", F.col("game_id") % 3)
    s = unpivot_sides(g).withColumn("surface", F.col("game_id") % 3)
    w = Window.partitionBy("league", "team").orderBy(F.unix_date("game_date")).rangeBetween(Window.unboundedPreceding, -1)
    pair = Window.partitionBy("league", F.least("team", "opponent"), F.greatest("team", "opponent"), "is_home").orderBy("game_date", "game_id")
    last = [F.max(F.when(F.col("surface") == i, F.col("game_date"))).over(w).alias(f"d{i}") for i in range(3)]
    held = s.select("game_id", "is_home", F.lag("surface").over(pair).alias("met"), *last)
    pick = lambda c, home: F.max(F.when(F.col("is_home") == home, F.col(c)))
    v = held.groupBy("game_id").agg(pick("met", True).alias("met"), *[pick(f"d{i}", h).alias(f"{n}{i}") for i in range(3) for n, h in (("a", True), ("b", False))])

    def newest(dates):
        top = F.greatest(*dates)
        return F.when(top == dates[0], 0).when(top == dates[1], 1).when(top == dates[2], 2)

    shared = newest([F.when(F.col(f"a{i}").isNotNull() & F.col(f"b{i}").isNotNull(), F.least(f"a{i}", f"b{i}")) for i in range(3)])
    either = newest([F.greatest(f"a{i}", f"b{i}") for i in range(3)])
    return v.select("game_id", F.coalesce(shared, F.col("met"), either, F.lit(0)).cast("bigint").alias("surface"))


@query("op_identity_merge", """WITH m AS (SELECT league, home, away, game_date, min(game_id) AS keep FROM games GROUP BY 1, 2, 3, 4) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(m.keep, l_orderkey) AS game_id FROM lineitem l LEFT JOIN games g ON l.l_orderkey = g.game_id LEFT JOIN m ON g.league = m.league AND g.home = m.home AND g.away = m.away AND g.game_date = m.game_date""")
def _(t):
    keys = ["league", "home", "away", "game_date"]
    keep = t.games.groupBy(*keys).agg(F.min("game_id").alias("keep"))
    moved = t.games.join(keep, keys).where("keep <> game_id").select("game_id", "keep")
    return t.lineitem.join(moved, F.col("l_orderkey") == F.col("game_id"), "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("keep", "l_orderkey").alias("game_id"))


@query("op_calibration_bias", "SELECT sport, round(avg(elo_prob - CAST(status = 'won' AS INTEGER)), 6) AS raw_bias, round(avg(0.5 * elo_prob + 0.25 - CAST(status = 'won' AS INTEGER)), 6) AS calibrated_bias FROM bets WHERE status <> 'open' GROUP BY 1")
def _(t):
    y = (F.col("status") == "won").cast("int")
    return t.bets.where("status <> 'open'").groupBy("sport").agg(F.round(F.avg(F.col("elo_prob") - y), 6).alias("raw_bias"), F.round(F.avg(0.5 * F.col("elo_prob") + 0.25 - y), 6).alias("calibrated_bias"))


@query("op_clv_fill", "WITH q AS (SELECT market, arg_max(price, (observed_at, quote_id)) AS price FROM quotes GROUP BY 1) SELECT bet_id, round(coalesce(closing_prob, 1 / q.price), 6) AS closing_prob, round(market_prob - coalesce(closing_prob, 1 / q.price), 6) AS clv FROM bets b LEFT JOIN q ON b.market = q.market")
def _(t):
    q = t.quotes.groupBy("market").agg(F.max_by("price", F.struct("observed_at", "quote_id")).alias("price"))
    c = F.coalesce("closing_prob", 1 / F.col("price"))
    return t.bets.join(q, "market", "left").select("bet_id", F.round(c, 6).alias("closing_prob"), F.round(F.col("market_prob") - c, 6).alias("clv"))


@query("op_upcoming_probs", f"""{STD}, {last_sql('fin')}, r AS (SELECT league, lower(trim('T' || team)) AS name, rating FROM fin)
SELECT g.game_id, round(x.rating, 4) AS home_rating, round(y.rating, 4) AS away_rating, round(1 / (1 + pow(10.0e0, (y.rating - x.rating - 100) / 400)), 6) AS p FROM games g JOIN r x ON x.league = g.league AND lower(trim('t' || g.home)) = x.name JOIN r y ON y.league = g.league AND lower(trim('t' || g.away)) = y.name WHERE status = 'scheduled'""")
def _(t):
    """Games to come whose sides both have a rating from the games played; names match whatever their case."""
    name = lambda c, t_: F.lower(F.trim(F.concat(F.lit(t_), F.col(c).cast("string"))))
    r = final_ratings(ordered_fold(final_games(t), SPECS["rt_elo_std"])).select("league", name("team", "T").alias("name"), "rating")
    x, y = (r.select("league", F.col("name").alias(f"{s_}n"), F.col("rating").alias(f"{s_}r")) for s_ in "ha")
    g = t.games.where("status = 'scheduled'").withColumns({"hn": name("home", "t"), "an": name("away", "t")}).join(x, ["league", "hn"]).join(y, ["league", "an"])
    return g.select("game_id", F.round("hr", 4).alias("home_rating"), F.round("ar", 4).alias("away_rating"), F.round(odds.expected_score(F.col("hr"), F.col("ar"), 100.0), 6).alias("p"))

