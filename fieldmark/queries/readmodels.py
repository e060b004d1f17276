"""Read models: the views behind the dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.core import bins, latest_by
from ..plans.ledger import first_reason
from . import query

n_if = lambda c: F.count(F.when(c, 1))
ROI = "round(sum(profit) FILTER (WHERE status <> 'open') / nullif(sum(cost) FILTER (WHERE status <> 'open'), 0), 6)"


@query("rm_portfolio", f"SELECT strftime(hour, '%Y-%m-%d %H') AS hour, round(volume, 4) AS value, (SELECT count(*) FILTER (WHERE status = 'won') FROM bets) AS wins, (SELECT {ROI} FROM bets) AS roi FROM snapshots")
def _(t):
    done = F.col("status") != "open"
    ledger = t.bets.agg(n_if(F.col("status") == "won").alias("wins"), F.round(F.try_divide(F.sum(F.when(done, F.col("profit"))), F.sum(F.when(done, F.col("cost")))), 6).alias("roi"))
    return t.snapshots.crossJoin(F.broadcast(ledger)).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.round("volume", 4).alias("value"), "wins", "roi")


@query("rm_live_markets", """WITH q AS (SELECT market, arg_max(quote_id, (observed_at, quote_id)) AS quote_id, arg_max(price, (observed_at, quote_id)) AS price FROM quotes GROUP BY 1), r AS (SELECT market, max(bet_id) AS rec_id FROM bets WHERE status = 'open' GROUP BY 1)
SELECT q.market, q.quote_id, round(q.price, 4) AS price, r.rec_id FROM q LEFT JOIN r ON q.market = r.market""")
def _(t):
    q = t.quotes.groupBy("market").agg(F.max_by("quote_id", F.struct("observed_at", "quote_id")).alias("quote_id"), F.round(F.max_by("price", F.struct("observed_at", "quote_id")), 4).alias("price"))
    r = t.bets.where("status = 'open'").groupBy("market").agg(F.max("bet_id").alias("rec_id"))
    return q.join(r, "market", "left").select("market", "quote_id", "price", "rec_id")


@query("rm_rankings", "SELECT sport, market, round(sum(elo_prob), 3) AS rating, CAST(rank() OVER (PARTITION BY sport ORDER BY round(sum(elo_prob), 3) DESC, market) AS INTEGER) AS place FROM bets GROUP BY 1, 2")
def _(t):
    from pyspark.sql.window import Window

    g = t.bets.groupBy("sport", "market").agg(F.round(F.sum("elo_prob"), 3).alias("rating"))
    return g.withColumn("place", F.rank().over(Window.partitionBy("sport").orderBy(F.col("rating").desc(), "market")))


@query("rm_calibration", """WITH k AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10)), b AS (SELECT CAST(least(floor(elo_prob * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(elo_prob), 6) AS predicted, round(avg(CASE WHEN status = 'won' THEN 1.0e0 ELSE 0.0e0 END), 6) AS observed FROM bets WHERE status <> 'open' GROUP BY 1)
SELECT k.bin, coalesce(n, 0) AS n, predicted, observed FROM k LEFT JOIN b ON k.bin = b.bin""")
def _(t):
    b = t.bets.where("status <> 'open'").groupBy(bins(F.col("elo_prob")).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("elo_prob"), 6).alias("predicted"), F.round(F.avg((F.col("status") == "won").cast("double")), 6).alias("observed"))
    k = t.spark.range(10).select(F.col("id").cast("int").alias("bin"))
    return k.join(b, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "predicted", "observed")


@query("rm_data_quality", """SELECT 'quotes' AS name, count(*) AS n, CAST(date_diff('minute', max(observed_at), TIMESTAMP '2024-02-01') AS BIGINT) AS lag_minutes, CASE WHEN count(*) > 0 THEN 'pass' ELSE 'warn' END AS verdict FROM quotes
UNION ALL SELECT 'bets', count(*), CAST(date_diff('minute', CAST(max(placed_date) AS TIMESTAMP), TIMESTAMP '2024-02-01') AS BIGINT), CASE WHEN count(*) > 0 THEN 'pass' ELSE 'warn' END FROM bets""")
def _(t):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    minute = lambda x: F.floor(F.unix_timestamp(x) / 60)

    def one(name, df, at):
        g = df.agg(F.count("*").alias("n"), F.max(at).cast("timestamp").alias("m"))
        return g.select(F.lit(name).alias("name"), "n", (minute(as_of) - minute(F.col("m"))).alias("lag_minutes"), F.when(F.col("n") > 0, "pass").otherwise("warn").alias("verdict"))

    return one("quotes", t.quotes, "observed_at").unionByName(one("bets", t.bets, "placed_date"))


@query("rm_bet_detail", """WITH q AS (SELECT market, arg_max(price, (observed_at, quote_id)) AS price FROM quotes GROUP BY 1) SELECT bet_id, sport, round(elo_prob - market_prob, 6) AS edge, round(q.price, 4) AS price FROM bets b LEFT JOIN q ON b.market = q.market WHERE elo_prob BETWEEN 0.01 AND 0.99 AND elo_prob - market_prob BETWEEN 0 AND 0.4""")
def _(t):
    q = t.quotes.groupBy("market").agg(F.round(F.max_by("price", F.struct("observed_at", "quote_id")), 4).alias("price"))
    e = F.col("elo_prob") - F.col("market_prob")
    return t.bets.where(F.col("elo_prob").between(0.01, 0.99) & e.between(0, 0.4)).join(q, "market", "left").select("bet_id", "sport", F.round(e, 6).alias("edge"), "price")


@query("rm_tennis_predictions", "SELECT bet_id, market, side FROM bets WHERE sport = 'EUROPE' AND status = 'open' AND elo_prob - market_prob BETWEEN 0.03 AND 0.40")
def _(t):
    return t.bets.where("sport = 'EUROPE' and status = 'open'").where((F.col("elo_prob") - F.col("market_prob")).between(0.03, 0.40)).select("bet_id", "market", "side")


HEALTH = "SELECT market, count(*) AS n, round(avg(CASE WHEN abs(elo_prob - 0.5) < 0.05 THEN 1.0e0 ELSE 0.0e0 END), 6) AS abstain_rate, round(avg(closing_prob), 6) AS avg_close FROM bets WHERE sport = '{}' GROUP BY 1"


def _health(t, sport):
    return t.bets.where(F.col("sport") == sport).groupBy("market").agg(F.count("*").alias("n"), F.round(F.avg((F.abs(F.col("elo_prob") - 0.5) < 0.05).cast("double")), 6).alias("abstain_rate"), F.round(F.avg("closing_prob"), 6).alias("avg_close"))


query("rm_mlb_health", HEALTH.format("AMERICA"))(lambda t: _health(t, "AMERICA"))
query("rm_tennis_health", HEALTH.format("EUROPE"))(lambda t: _health(t, "EUROPE"))


@query("rm_validation_state", """WITH v AS (SELECT * FROM (VALUES ('AFRICA', true, 0.4), ('AMERICA', true, 0.5), ('ASIA', false, 0.5), ('EUROPE', true, 0.6)) x(sport, enabled, least)),
m AS (SELECT sport, avg(CASE WHEN (elo_prob >= 0.5) = (status = 'won') THEN 1.0e0 ELSE 0.0e0 END) AS acc FROM bets WHERE status <> 'open' GROUP BY 1)
SELECT m.sport, coalesce(enabled, false) AS enabled, CASE WHEN enabled IS NULL THEN 'ungoverned' WHEN NOT enabled THEN 'disabled' WHEN acc < least THEN 'below_gate' ELSE 'validated' END AS state FROM m LEFT JOIN v ON m.sport = v.sport""")
def _(t):
    v = t.spark.createDataFrame([("AFRICA", True, 0.4), ("AMERICA", True, 0.5), ("ASIA", False, 0.5), ("EUROPE", True, 0.6)], "sport string, enabled boolean, least double")
    m = t.bets.where("status <> 'open'").groupBy("sport").agg(F.avg(((F.col("elo_prob") >= 0.5) == (F.col("status") == "won")).cast("double")).alias("acc"))
    state = F.when(F.col("enabled").isNull(), "ungoverned").when(~F.col("enabled"), "disabled").when(F.col("acc") < F.col("least"), "below_gate").otherwise("validated")
    return m.join(F.broadcast(v), "sport", "left").select("sport", F.coalesce("enabled", F.lit(False)).alias("enabled"), state.alias("state"))


@query("rm_evidence", """SELECT bet_id, concat_ws(';', CASE WHEN closing_prob IS NULL THEN 'no_close' END, CASE WHEN closing_prob IN (0, 1) THEN 'binary_close' END, CASE WHEN hours_before < 1 THEN 'late_entry' END) AS contamination,
CASE WHEN closing_prob IS NULL OR closing_prob IN (0, 1) THEN 'C' WHEN hours_before < 1 THEN 'B' ELSE 'A' END AS tier FROM bets""")
def _(t):
    c, late = F.col("closing_prob"), F.col("hours_before") < 1
    reasons = F.concat_ws(";", F.when(c.isNull(), "no_close"), F.when(c.isin(0.0, 1.0), "binary_close"), F.when(late, "late_entry"))
    return t.bets.select("bet_id", reasons.alias("contamination"), F.when(c.isNull() | c.isin(0.0, 1.0), "C").when(late, "B").otherwise("A").alias("tier"))


@query("rm_exec_link", """WITH r AS (SELECT market, side, bet_id AS rec_id, elo_prob AS rec_prob, row_number() OVER (PARTITION BY market, side ORDER BY placed_date DESC, bet_id DESC) AS k FROM bets WHERE status = 'lost')
SELECT b.bet_id, r.rec_id, CASE WHEN r.rec_id IS NULL THEN 'no_recommendation' WHEN abs(b.elo_prob - r.rec_prob) > 0.2 THEN 'probability_moved' ELSE 'linked' END AS reason FROM bets b LEFT JOIN r ON b.market = r.market AND b.side = r.side AND r.k = 1 WHERE b.status = 'won'""")
def _(t):
    r = latest_by(t.bets.where("status = 'lost'"), ["market", "side"], F.col("placed_date").desc(), F.col("bet_id").desc()).select("market", "side", F.col("bet_id").alias("rec_id"), F.col("elo_prob").alias("rec_prob"))
    b = t.bets.where("status = 'won'").join(r, ["market", "side"], "left")
    reason = F.when(F.col("rec_id").isNull(), "no_recommendation").when(F.abs(F.col("elo_prob") - F.col("rec_prob")) > 0.2, "probability_moved").otherwise("linked")
    return b.select("bet_id", "rec_id", reason.alias("reason"))


@query("rm_clv_envelope", """SELECT w.wager_id, q.quote_id, round(w.bet_prob - least(greatest(1 / q.price, 0.01), 0.99), 6) AS clv, CASE WHEN q.quote_id IS NULL THEN 'none' WHEN w.bet_prob > least(greatest(1 / q.price, 0.01), 0.99) THEN 'positive' ELSE 'negative' END AS direction,
CASE WHEN q.quote_id IS NULL THEN 'missing' WHEN w.close_at - q.observed_at > INTERVAL '4' HOUR THEN 'stale' ELSE 'fresh' END AS tier FROM wagers w ASOF LEFT JOIN quotes q ON w.market = q.market AND w.close_at >= q.observed_at""")
def _(t):
    from ..plans.ledger import closing_line_value

    c = closing_line_value(t.wagers, t.quotes)
    way = F.when(F.col("quote_id").isNull(), "none").when(F.col("clv") > 0, "positive").otherwise("negative")
    return c.select("wager_id", "quote_id", F.round("clv", 6).alias("clv"), way.alias("direction"), F.col("freshness").alias("tier"))


@query("rm_portfolio_risk", """WITH v AS (SELECT 0.5e0 * sum(cost) + sum(coalesce(profit, 0)) AS worth, sum(cost) FILTER (WHERE status = 'open') AS exposed FROM bets), d AS (SELECT max(volume) AS peak, arg_max(volume, hour) AS now FROM snapshots),
k AS (SELECT sport, market, sum(cost) AS cost, count(*) AS n, count(DISTINCT side) AS sides FROM bets WHERE status = 'open' GROUP BY 1, 2),
e AS (SELECT sport, sum(cost) AS open_cost, max(cost) AS largest_event, max(n) AS most_in_event, max(sides) AS sides FROM k GROUP BY 1), s AS (SELECT DISTINCT sport FROM bets), q AS (SELECT sport, count(closing_prob) * 1.0e0 / count(*) AS covered, count(*) FILTER (WHERE closing_prob IN (0.0, 1.0)) * 1.0e0 / count(*) AS placeholders FROM bets GROUP BY 1),
g AS (SELECT s.sport, coalesce(open_cost, 0) AS open_cost, coalesce(largest_event, 0) AS largest_event, coalesce(most_in_event, 0) AS most_in_event, coalesce(sides, 0) AS sides, covered, placeholders, worth, exposed, worth * 0.25 AS budget, (peak - now) / peak AS drawdown FROM s LEFT JOIN e USING (sport) JOIN q USING (sport), v, d),
r AS (SELECT *, CASE WHEN worth IS NULL THEN 'risk_of_ruin_state_unavailable' WHEN worth <= 0 THEN 'bankroll_exhausted' WHEN exposed >= worth AND exposed > 0 THEN 'open_exposure_exhausts_bankroll' ELSE 'capital_available' END AS ruin FROM g)
SELECT sport, round(open_cost, 2) AS open_cost, round(open_cost / budget, 6) AS used, round(greatest(budget - exposed, 0), 2) AS remaining, round(drawdown, 6) AS drawdown, ruin AS ruin_state, CASE WHEN ruin <> 'capital_available' THEN 'blocked_risk_of_ruin' WHEN drawdown > 0.8 THEN 'blocked_drawdown' ELSE 'eligible' END AS guardrail,
CASE WHEN sides > 1 THEN 'same_event' WHEN most_in_event > 1 THEN 'same_side' ELSE 'sport' END AS bucket,
CASE WHEN ruin <> 'capital_available' THEN 'risk_of_ruin_gate_blocked' WHEN drawdown > 0.8 THEN 'drawdown_gate_blocked' WHEN placeholders > 0.2 THEN 'contaminated_evidence' WHEN covered < 0.5 THEN 'missing_evidence' WHEN largest_event > budget * 0.05 THEN 'concentration_breach' WHEN open_cost > 0 THEN 'existing_position_conflict' END AS rejection FROM r""")
def _(t):
    """A sport's open exposure against a budget of a quarter of the bankroll, the state of ruin and drawdown, and why a bet would be refused."""
    live = t.bets.where("status = 'open'")
    v = t.bets.agg((0.5 * F.sum("cost") + F.sum(F.coalesce("profit", F.lit(0.0)))).alias("worth"), F.sum(F.when(F.col("status") == "open", F.col("cost"))).alias("exposed"))  # one row
    d = t.snapshots.agg(((F.max("volume") - F.max_by("volume", "hour")) / F.max("volume")).alias("drawdown"))  # one row
    k = live.groupBy("sport", "market").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"), F.count_distinct("side").alias("sides"))
    e = k.groupBy("sport").agg(F.sum("cost").alias("open_cost"), F.max("cost").alias("largest_event"), F.max("n").alias("most_in_event"), F.max("sides").alias("sides"))
    q = t.bets.groupBy("sport").agg((F.count("closing_prob") / F.count("*")).alias("covered"), (F.count(F.when(F.col("closing_prob").isin(0.0, 1.0), 1)) / F.count("*")).alias("placeholders"))
    g = q.join(e, "sport", "left").na.fill(0).crossJoin(F.broadcast(v)).crossJoin(F.broadcast(d)).withColumn("budget", F.col("worth") * 0.25)
    worth, exposed, none = F.col("worth"), F.col("exposed"), F.lit(None).cast("string")
    ruin = F.when(worth.isNull(), "risk_of_ruin_state_unavailable").when(worth <= 0, "bankroll_exhausted").when((exposed >= worth) & (exposed > 0), "open_exposure_exhausts_bankroll").otherwise("capital_available")
    ruined, fallen = ruin != "capital_available", F.col("drawdown") > 0.8
    reason = F.when(ruined, "risk_of_ruin_gate_blocked").when(fallen, "drawdown_gate_blocked").when(F.col("placeholders") > 0.2, "contaminated_evidence").when(F.col("covered") < 0.5, "missing_evidence").when(F.col("largest_event") > F.col("budget") * 0.05, "concentration_breach").when(F.col("open_cost") > 0, "existing_position_conflict").otherwise(none)
    bucket = F.when(F.col("sides") > 1, "same_event").when(F.col("most_in_event") > 1, "same_side").otherwise("sport")
    left = F.greatest(F.col("budget") - exposed, F.lit(0.0))
    return g.select("sport", F.round("open_cost", 2).alias("open_cost"), F.round(F.col("open_cost") / F.col("budget"), 6).alias("used"), F.round(left, 2).alias("remaining"), F.round("drawdown", 6).alias("drawdown"), ruin.alias("ruin_state"), F.when(ruined, "blocked_risk_of_ruin").when(fallen, "blocked_drawdown").otherwise("eligible").alias("guardrail"), bucket.alias("bucket"), reason.alias("rejection"))

