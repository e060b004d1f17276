"""Rating queries, each with its recursive SQL counterpart (``rating_sql``)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import odds
from ..operators.core import close_versions
from ..operators.ratings import EloState, GlickoState, RatingSpec, StarterState, final_ratings, ordered_fold, replay
from ..sources.shared import shared_path
from . import query
from .rating_sql import elo_sql, glicko_sql

#: K, home points and the rest of each family as published for it.
SPECS = {
    "rt_elo_std": RatingSpec(),
    "rt_elo_mov": RatingSpec(home=65, margin=True),
    "rt_elo_recency": RatingSpec(home=65, recency=1.0),
    "rt_elo_mlb": RatingSpec(k=4, home=20),
    "rt_elo_nba": RatingSpec(),
    "rt_elo_tennis": RatingSpec(k=32, home=0, novice=20),
    "rt_elo_cba": RatingSpec(home=80, carry=0.67, to_mean=True),
    "rt_elo_unrivaled": RatingSpec(k=24, home=0),
    "rt_elo_decay": RatingSpec(k=32, home=0, half_life=365),
}
#: The soccer leagues differ in K alone.
SOCCER = {"EPL": RatingSpec(k=40, home=60, soft=True), "LIGUE1": RatingSpec(home=60, soft=True)}
PITCHER, PITCHER_WEIGHT = RatingSpec(k=6, home=0), 0.35
BACKTEST = {"k10": RatingSpec(k=10), "k20": RatingSpec(k=20), "carry": RatingSpec(k=20, carry=0.6)}
GRID = {"90": RatingSpec(k=32, home=0, half_life=90), "365": RatingSpec(k=32, home=0, half_life=365), "1000": RatingSpec(k=32, home=0, half_life=1000)}
RATINGS = ("home_before", "away_before", "p_home", "home_after", "away_after")
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in RATINGS)
STD = elo_sql({"std": RatingSpec()})
SIDES_AFTER = "SELECT league, game_date, game_id, home AS team, home_after AS r FROM {s} UNION ALL SELECT league, game_date, game_id, away, away_after FROM {s}"


def last_sql(name: str, scored: str = "scored") -> str:
    """A relation league, team, rating, games: each team's newest rating."""
    return f"{name} AS (SELECT league, team, arg_max(r, (game_date, game_id)) AS rating, count(*) AS games FROM ({SIDES_AFTER.format(s=scored)}) GROUP BY 1, 2)"


#: Smoothed win rate of each side after a result like its last one: m_home, m_away and y (did home win) by game.
MOMENTUM = """side AS (SELECT game_id, league, game_date, home AS team, TRUE AS is_home, CASE WHEN home_score > away_score THEN 1.0e0 ELSE 0.0e0 END AS w FROM games WHERE status <> 'scheduled'
UNION ALL SELECT game_id, league, game_date, away, FALSE, CASE WHEN away_score > home_score THEN 1.0e0 ELSE 0.0e0 END FROM games WHERE status <> 'scheduled'),
held AS (SELECT *, lag(w, 1, 1.0e0) OVER (PARTITION BY league, team ORDER BY game_date, game_id) AS prev FROM side),
rate AS (SELECT *, (coalesce(sum(w) OVER k, 0) + 1) / (count(*) OVER k + 2) AS m FROM held WINDOW k AS (PARTITION BY league, team, prev ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
momentum AS (SELECT h.game_id, h.m AS m_home, a.m AS m_away, h.w AS y FROM rate h JOIN rate a ON a.game_id = h.game_id AND h.is_home AND NOT a.is_home)"""
CLIPPED = "least(greatest(p_home, 1e-6), 1 - 1e-6)"
LOG_LOSS = "-(y * ln(least(greatest({p}, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest({p}, 1e-12), 1 - 1e-12)))"


def mixed_sql(gamma: str) -> str:
    return f"1 / (1 + exp(-(ln({CLIPPED} / (1 - {CLIPPED})) + {gamma} * (ln(m_home / (1 - m_home)) - ln(m_away / (1 - m_away))))))"


def rounded(scored, *more):
    return scored.select("game_id", "league", *more, *[F.round(c, 6).alias(c) for c in RATINGS])


def final_games(t):
    return t.games.where("status <> 'scheduled'")


for _name, _spec in SPECS.items():
    query(_name, f"{elo_sql({'one': _spec})} SELECT game_id, league, {ROUNDED} FROM scored")(lambda t, s=_spec: rounded(ordered_fold(final_games(t), s)))


def configured(t, specs: dict[str, RatingSpec]):
    """The fold of every spec over all games at once: the key is (league, config)."""
    g = final_games(t).withColumn("config", F.explode(F.array(*[F.lit(c) for c in specs])))
    return ordered_fold(g, lambda league, config: EloState(specs[config]), ("league", "config"))


@query("rt_elo_soccer", f"{elo_sql(SOCCER)} SELECT game_id, league, config, {ROUNDED} FROM scored")
def _(t):
    return rounded(configured(t, SOCCER), "config")


def starters(t):
    """Games by starting pitcher instead of team; of some games a starter is unknown."""
    pitcher = lambda side, n: F.when(F.col("game_id") % n == 0, StarterState.UNKNOWN).otherwise(F.col(side) * 5 + F.col("game_id") % 5)
    return final_games(t).withColumn("home", pitcher("home", 11)).withColumn("away", pitcher("away", 13))


STARTERS = """SELECT game_id, league, game_date, CASE WHEN game_id % 11 = 0 THEN -1 ELSE home * 5 + game_id % 5 END AS home, CASE WHEN game_id % 13 = 0 THEN -1 ELSE away * 5 + game_id % 5 END AS away,
home_score - away_score AS margin, TRUE AS is_neutral FROM games WHERE status <> 'scheduled'"""


@query("rt_pitcher", f"{elo_sql({'one': PITCHER}, STARTERS, 150)} SELECT game_id, league, {ROUNDED}, round(CASE WHEN home < 0 OR away < 0 THEN 0 ELSE {PITCHER_WEIGHT}e0 * (home_before - away_before) END, 6) AS adjustment FROM scored")
def _(t):
    """The ladder of starters, and the points that a pair of them gives the home team; an unknown one gives none."""
    s = ordered_fold(starters(t), lambda league: StarterState(PITCHER))
    known = (F.col("home") >= 0) & (F.col("away") >= 0)
    return rounded(s, F.round(F.when(known, PITCHER_WEIGHT * (F.col("home_before") - F.col("away_before"))).otherwise(0.0), 6).alias("adjustment"))


@query("rt_glicko2", f"{glicko_sql()} SELECT game_id, league, {ROUNDED} FROM scored")
def _(t):
    return rounded(ordered_fold(final_games(t), lambda *_: GlickoState()))


@query("rt_replay", f"{STD}, {last_sql('fin')} SELECT league, team, round(rating, 4) AS rating, games FROM fin")
def _(t):
    return final_ratings(ordered_fold(final_games(t), SPECS["rt_elo_std"])).select("league", "team", F.round("rating", 4).alias("rating"), "games")


@query("rt_replay_seasons", f"""{STD}, {last_sql('fin')} SELECT league, team, round(rating, 4) AS rating FROM fin""")
def _(t):
    """The same ratings by a chain of stored seasons."""
    return replay(final_games(t), SPECS["rt_elo_std"], shared_path(t.spark, "seasons")).where("kind = 0 and team is not null").select("league", "team", F.round("rating", 4).alias("rating"))


@query("rt_compare", f"""{STD}, {last_sql('fin')}, early AS (SELECT * FROM scored WHERE year(game_date) < 1998), {last_sql('old', 'early')}
SELECT league, round(max(abs(fin.rating - old.rating)), 4) AS divergence FROM fin JOIN old USING (league, team) GROUP BY 1""")
def _(t):
    """Largest distance of replayed ratings from those of an earlier cut."""
    now = final_ratings(ordered_fold(final_games(t), SPECS["rt_elo_std"]))
    old = final_ratings(ordered_fold(final_games(t).where("year(game_date) < 1998"), SPECS["rt_elo_std"])).withColumnRenamed("rating", "old")
    return now.join(old.select("league", "team", "old"), ["league", "team"]).groupBy("league").agg(F.round(F.max(F.abs(F.col("rating") - F.col("old"))), 4).alias("divergence"))


@query("rt_recalc", f"""{STD}, {last_sql('fin')}, p AS (SELECT g.game_id, g.league, h.rating AS hr, a.rating AS ar, 1 / (1 + pow(10.0e0, (a.rating - h.rating - 100) / 400)) AS p_home FROM games g JOIN fin h ON h.league = g.league AND h.team = g.home JOIN fin a ON a.league = g.league AND a.team = g.away)
SELECT bet_id, round(hr, 4) AS home_rating, round(ar, 4) AS away_rating, round(q, 6) AS prob, round(q - market_prob, 6) AS edge, round((q - market_prob) / market_prob, 6) AS value, round(abs(q - elo_prob), 6) AS shift FROM (SELECT *, CASE WHEN side = 'home' THEN p_home ELSE 1 - p_home END AS q FROM bets JOIN p ON p.game_id = bet_id WHERE bets.status IN ('won', 'lost'))""")
def _(t):
    """Settled bets priced anew with replayed ratings: the probability of the side that was bet on, its edge and value, and how far it moved."""
    r = final_ratings(ordered_fold(final_games(t), SPECS["rt_elo_std"])).select("league", "team", "rating")
    h, a = r.select("league", F.col("team").alias("home"), F.col("rating").alias("hr")), r.select("league", F.col("team").alias("away"), F.col("rating").alias("ar"))
    g = t.games.join(h, ["league", "home"]).join(a, ["league", "away"]).select(F.col("game_id").alias("bet_id"), "hr", "ar")
    b = t.bets.where("status in ('won', 'lost')").join(g, "bet_id")
    home = odds.expected_score(F.col("hr"), F.col("ar"), 100.0)
    q, m = F.when(F.col("side") == "home", home).otherwise(1 - home), F.col("market_prob")
    return b.select("bet_id", F.round("hr", 4).alias("home_rating"), F.round("ar", 4).alias("away_rating"), F.round(q, 6).alias("prob"), F.round(q - m, 6).alias("edge"), F.round((q - m) / m, 6).alias("value"), F.round(F.abs(q - F.col("elo_prob")), 6).alias("shift"))


@query("rt_backtest", f"""{elo_sql(BACKTEST)}, m AS (SELECT s.config, s.p_home AS p, CASE WHEN g.home_score > g.away_score THEN 1.0e0 ELSE 0.0e0 END AS y FROM scored s JOIN games g USING (game_id))
SELECT config, count(*) AS n, round(avg({LOG_LOSS.format(p='p')}), 6) AS log_loss, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy FROM m GROUP BY 1""")
def _(t):
    """Predict before update under several configurations at once."""
    y = final_games(t).select("game_id", (F.col("home_score") > F.col("away_score")).cast("double").alias("y"))
    m = configured(t, BACKTEST).join(y, "game_id").withColumn("loss", odds.log_loss(F.col("y"), F.col("p_home")))
    return m.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("log_loss"), F.round(F.avg(F.pow(F.col("p_home") - F.col("y"), F.lit(2.0))), 6).alias("brier"), F.round(F.avg(((F.col("p_home") > 0.5) == (F.col("y") == 1)).cast("double")), 6).alias("accuracy"))


@query("rt_grid", f"""{elo_sql(GRID)}, {MOMENTUM}, m AS (SELECT s.config, gamma, {mixed_sql('gamma')} AS p, y FROM scored s JOIN momentum USING (game_id) CROSS JOIN (VALUES (0.0e0), (0.25e0), (0.5e0)) v(gamma))
SELECT CAST(config AS DOUBLE) AS half_life, gamma, round(avg({LOG_LOSS.format(p='p')}), 6) AS log_loss FROM m GROUP BY 1, 2""")
def _(t):
    """Half-lives and momentum weights by log loss: decayed ratings mixed with each side's record after its last result."""
    m = configured(t, GRID).join(momentum(t), ["game_id", "league", "game_date", "home", "away"]).withColumn("gamma", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5)])))
    p = mixed(F.col("gamma"))
    return m.groupBy(F.col("config").cast("double").alias("half_life"), "gamma").agg(F.round(F.avg(odds.log_loss(F.col("y"), p)), 6).alias("log_loss"))


def mixed(gamma):
    """Decayed rating and momentum as one probability."""
    return odds.sigmoid(odds.logit(odds.clip(F.col("p_home"), 1e-6, 1 - 1e-6)) + gamma * (odds.logit(F.col("m_home")) - odds.logit(F.col("m_away"))))


def momentum(t):
    """Smoothed win rate of each side after a result like its last one."""
    from .windows import order, team_games

    r = team_games(t).where("status <> 'scheduled'").withColumn("prev", F.lag("w", 1, 1.0).over(order()))
    k = Window.partitionBy("league", "team", "prev").orderBy("game_date", "game_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("m", (F.coalesce(F.sum("w").over(k), F.lit(0.0)) + 1) / (F.count("*").over(k) + 2))
    pick = lambda c, home: F.max(F.when(F.col("is_home") == home, F.col(c)))
    return r.groupBy("game_id", "league", "game_date").agg(pick("team", True).alias("home"), pick("team", False).alias("away"), pick("m", True).alias("m_home"), pick("m", False).alias("m_away"), pick("w", True).alias("y"))


@query("rt_momentum", f"{elo_sql({'one': SPECS['rt_elo_decay']})}, {MOMENTUM} SELECT game_id, round(CASE WHEN home < away THEN p ELSE 1 - p END, 6) AS p_first FROM (SELECT game_id, home, away, {mixed_sql('0.25e0')} AS p FROM scored JOIN momentum USING (game_id))")
def _(t):
    m = ordered_fold(final_games(t), SPECS["rt_elo_decay"]).join(momentum(t), ["game_id", "league", "game_date", "home", "away"])
    # by the lower team number, so that the order of the two can't tell the winner
    p = mixed(F.lit(0.25))
    return m.select("game_id", F.round(F.when(F.col("home") < F.col("away"), p).otherwise(1 - p), 6).alias("p_first"))


@query("wn_rating_history", f"{STD} SELECT game_id, league, home AS team, round(home_before, 4) AS before, round(home_after, 4) AS after FROM scored UNION ALL SELECT game_id, league, away, round(away_before, 4), round(away_after, 4) FROM scored")
def _(t):
    s = ordered_fold(final_games(t), SPECS["rt_elo_std"])
    side = lambda x: F.struct(F.col(x).alias("team"), F.round(f"{x}_before", 4).alias("before"), F.round(f"{x}_after", 4).alias("after"))
    return s.select("game_id", "league", F.explode(F.array(side("home"), side("away"))).alias("s")).select("game_id", "league", "s.*")


@query("op_elo_history", f"{STD} SELECT game_date, game_id, round(CASE WHEN home = 13 THEN home_after ELSE away_after END, 2) AS rating FROM scored WHERE league = 3 AND 13 IN (home, away)")
def _(t):
    s = ordered_fold(final_games(t).where("league = 3"), SPECS["rt_elo_std"])
    h = s.where("home = 13 or away = 13").select("game_date", "game_id", F.round(F.when(F.col("home") == 13, F.col("home_after")).otherwise(F.col("away_after")), 2).alias("rating"))
    return h.orderBy("game_date", "game_id")


@query("op_rating_monitor", f"""{STD}, d AS (SELECT league, home AS team, game_date AS valid_from, arg_max(round(home_after, 2), game_id) AS rating, arg_max(round(home_after - home_before, 4), game_id) AS change FROM scored GROUP BY 1, 2, 3),
v AS (SELECT *, lag(rating) OVER (PARTITION BY league, team ORDER BY valid_from) AS held FROM d),
k AS (SELECT *, lead(valid_from) OVER (PARTITION BY league, team ORDER BY valid_from) AS valid_to FROM v WHERE held IS NULL OR held <> rating)
SELECT league, team, valid_from, valid_to, rating, change FROM k WHERE abs(change) > 2""")
def _(t):
    """Rating versions with a change above two points, and how long each held."""
    s = ordered_fold(final_games(t), SPECS["rt_elo_std"])
    v = s.select("league", F.col("home").alias("team"), F.col("game_date").alias("valid_from"), "game_id", F.round("home_after", 2).alias("rating"), F.round(F.col("home_after") - F.col("home_before"), 4).alias("change"))
    day = v.groupBy("league", "team", "valid_from").agg(F.max_by(F.struct("rating", "change"), "game_id").alias("r")).select("league", "team", "valid_from", "r.*")
    return close_versions(day, ["league", "team"], "valid_from", F.col("rating")).where("abs(change) > 2").select("league", "team", "valid_from", "valid_to", "rating", "change")


#: Least spread of a league's ratings and of its chances, shares of which alarm; and the share about the start that does.
LEAST_RANGE, LEAST_CHANCES, NEAR_START = 200.0, 0.5, 0.5


@query("op_rating_alarms", f"""{STD}, {last_sql('fin')}, x AS (SELECT league, count(*) AS teams, stddev_samp(rating) AS spread, max(rating) - min(rating) AS reach, avg(CASE WHEN rating > 1490 AND rating < 1510 THEN 1.0e0 ELSE 0.0e0 END) AS near FROM fin GROUP BY 1),
c AS (SELECT league, max(p_home) - min(p_home) AS chances, stddev_samp(p_home) AS chance_spread FROM scored GROUP BY 1)
SELECT league, teams, round(spread, 4) AS spread, round(reach, 4) AS reach, round(near, 6) AS near_start, round(chances, 6) AS chances, round(chance_spread, 6) AS chance_spread,
concat_ws(',', CASE WHEN reach < {LEAST_RANGE}e0 * 0.5 THEN 'narrow_ratings' END, CASE WHEN near > {NEAR_START}e0 THEN 'near_start' END, CASE WHEN teams < 2 THEN 'too_few' WHEN chances < {LEAST_CHANCES}e0 * 0.3 THEN 'narrow_chances' END) AS alarms FROM x JOIN c USING (league)""")
def _(t):
    """How far a league's ratings and chances spread, and which alarms that raises."""
    s = ordered_fold(final_games(t), SPECS["rt_elo_std"])
    r = F.col("rating")
    x = final_ratings(s).groupBy("league").agg(F.count("*").alias("teams"), F.stddev_samp(r).alias("spread"), (F.max(r) - F.min(r)).alias("reach"), F.avg(((r > 1490) & (r < 1510)).cast("double")).alias("near"))
    c = s.groupBy("league").agg((F.max("p_home") - F.min("p_home")).alias("chances"), F.stddev_samp("p_home").alias("chance_spread"))
    few = F.when(F.col("teams") < 2, "too_few").when(F.col("chances") < LEAST_CHANCES * 0.3, "narrow_chances")
    alarms = F.concat_ws(",", F.when(F.col("reach") < LEAST_RANGE * 0.5, "narrow_ratings"), F.when(F.col("near") > NEAR_START, "near_start"), few)
    return x.join(c, "league").select("league", "teams", F.round("spread", 4).alias("spread"), F.round("reach", 4).alias("reach"), F.round("near", 6).alias("near_start"), F.round("chances", 6).alias("chances"), F.round("chance_spread", 6).alias("chance_spread"), alarms.alias("alarms"))
