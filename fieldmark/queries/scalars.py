"""Scalar functions over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import odds, stats
from ..operators.core import counted_before
from ..sources.files import this_century
from . import query

r6 = lambda c: F.round(c, 6)


@query("sc_implied", "SELECT quote_id, round(least(greatest(1 / price, 0.01), 0.99), 6) AS p FROM quotes")
def _(t):
    return t.quotes.select("quote_id", r6(odds.implied(F.col("price"))).alias("p"))


@query("sc_american", "SELECT bet_id, round(CASE WHEN a > 0 THEN 1 + a / 100 WHEN a < 0 THEN 1 + 100 / abs(a) END, 6) AS price FROM (SELECT bet_id, CAST(bet_id % 700 - 350 AS DOUBLE) AS a FROM bets)")
def _(t):
    return t.bets.select("bet_id", r6(odds.from_american((F.col("bet_id") % 700 - 350).cast("double"))).alias("price"))


@query("sc_cents", "SELECT bet_id, CASE WHEN bet_id % 101 BETWEEN 1 AND 99 THEN round(100.0e0 / (bet_id % 101), 6) END AS price, (bet_id % 101) / 100.0e0 AS p FROM bets")
def _(t):
    c = (F.col("bet_id") % 101).cast("double")
    return t.bets.select("bet_id", r6(odds.cents_to_decimal(c)).alias("price"), (c / 100).alias("p"))


@query("sc_ask_prob", "SELECT bet_id, CASE WHEN bet_id % 40 > 0 THEN (bet_id % 40) / 100.0e0 WHEN bet_id % 30 > 0 THEN round(1 - (bet_id % 30) / 100.0e0, 6) END AS p FROM bets")
def _(t):
    return t.bets.select("bet_id", r6(odds.ask_probability((F.col("bet_id") % 40).cast("double"), (F.col("bet_id") % 30).cast("double"))).alias("p"))


@query("sc_ev_kelly", "SELECT bet_id, round((elo_prob - market_prob) / market_prob, 6) AS ev, round(greatest(0, (elo_prob * (1 / market_prob - 1) - (1 - elo_prob)) / (1 / market_prob - 1)), 6) AS kelly FROM bets")
def _(t):
    p, m = F.col("elo_prob"), F.col("market_prob")
    return t.bets.select("bet_id", r6(odds.expected_value(p, m)).alias("ev"), r6(odds.kelly(p, m)).alias("kelly"))


@query("sc_blend", "SELECT bet_id, round(least(greatest(0.7 * elo_prob + 0.3 * market_prob, 0.01), 0.99), 6) AS p FROM bets")
def _(t):
    return t.bets.select("bet_id", r6(odds.blend(F.col("elo_prob"), F.col("market_prob"))).alias("p"))


@query("sc_novig", """WITH o AS (SELECT bet_id, 1.2e0 + bet_id % 7 AS a, CASE WHEN bet_id % 4 <> 0 THEN 2.5e0 + bet_id % 3 END AS b, 1.5e0 + bet_id % 5 AS c, 1.3e0 + bet_id % 6 AS d, 3.1e0 AS e, CASE WHEN bet_id % 12 <> 0 THEN 2.2e0 + bet_id % 2 END AS f FROM bets),
x AS (SELECT bet_id, CASE WHEN b IS NOT NULL THEN 'closing' WHEN f IS NOT NULL THEN 'average' END AS used, CASE WHEN b IS NOT NULL THEN [1 / a, 1 / b, 1 / c] WHEN f IS NOT NULL THEN [1 / d, 1 / e, 1 / f] END AS q FROM o)
SELECT bet_id, used, round(q[1] / (q[1] + q[2] + q[3]), 6) AS home, round(q[2] / (q[1] + q[2] + q[3]), 6) AS draw, round(q[3] / (q[1] + q[2] + q[3]), 6) AS away FROM x""")
def _(t):
    """Probabilities without the bookmaker's margin, from the first set of prices that is complete."""
    i = F.col("bet_id")
    sets = {"closing": (1.2 + i % 7, F.when(i % 4 != 0, 2.5 + i % 3), 1.5 + i % 5), "average": (1.3 + i % 6, F.lit(3.1), F.when(i % 12 != 0, 2.2 + i % 2))}
    p = F.coalesce(*[F.when(odds.no_vig(*prices).isNotNull(), F.struct(F.lit(name).alias("used"), odds.no_vig(*prices).alias("p"))) for name, prices in sets.items()])
    return t.bets.select("bet_id", p.alias("x")).select("bet_id", "x.used", *[r6(F.col("x.p")[k]).alias(n) for k, n in enumerate(("home", "draw", "away"))])


@query("sc_settle", "SELECT bet_id, CASE status WHEN 'won' THEN bet_id % 50 * 1.0e0 WHEN 'lost' THEN 0.0e0 END AS payout, round(CASE status WHEN 'won' THEN bet_id % 50 * 1.0e0 WHEN 'lost' THEN 0.0e0 END - cost, 2) AS profit FROM bets")
def _(t):
    s = odds.settlement(F.col("status"), F.col("cost"), F.col("bet_id") % 50)
    return t.bets.select("bet_id", s["payout"].alias("payout"), F.round(s["profit"], 2).alias("profit"))


@query("sc_platt", "SELECT bet_id, round(1 / (1 + exp(-(0.8 * ln(p / (1 - p)) + 0.1))), 6) AS p FROM (SELECT bet_id, least(greatest(elo_prob, 1e-6), 1 - 1e-6) AS p FROM bets)")
def _(t):
    return t.bets.select("bet_id", r6(odds.platt(F.col("elo_prob"), 0.8, 0.1)).alias("p"))


@query("sc_shrink", "SELECT market, round((avg(elo_prob) * count(*) + 0.5 * 20) / (count(*) + 20), 6) AS p FROM bets GROUP BY 1")
def _(t):
    g = t.bets.groupBy("market").agg(F.avg("elo_prob").alias("r"), F.count("*").alias("n"))
    return g.select("market", r6(stats.shrink(F.col("r"), F.col("n"), 20, 0.5)).alias("p"))


#: Outcomes of a plate appearance; what is left to one is an out.
OUTCOMES = ("strikeout", "walk", "single", "extra", "homer")
_RATES = "0.1 + elo_prob * 0.15 AS strikeout_a, 0.15 + market_prob * 0.1 AS strikeout_b, 0.05 + elo_prob * 0.05 AS walk_a, 0.06 + market_prob * 0.04 AS walk_b, 0.12 + elo_prob * 0.05 AS single_a, 0.13 + market_prob * 0.03 AS single_b, 0.03 + elo_prob * 0.03 AS extra_a, 0.04 + market_prob * 0.02 AS extra_b, 0.02 + elo_prob * 0.03 AS homer_a, 0.02 + market_prob * 0.04 AS homer_b"
LEAGUE = {"strikeout": 0.22, "walk": 0.09, "single": 0.14, "extra": 0.05, "homer": 0.03}
_LOG5 = ", ".join(f"{o}_a * {o}_b / {LEAGUE[o]}e0 / ({o}_a * {o}_b / {LEAGUE[o]}e0 + (1 - {o}_a) * (1 - {o}_b) / (1 - {LEAGUE[o]}e0)) AS {o}" for o in OUTCOMES)
_SUM = " + ".join(OUTCOMES)


@query("sc_log5", f"""WITH r AS (SELECT bet_id, {_RATES} FROM bets), l AS (SELECT bet_id, {_LOG5} FROM r), o AS (SELECT *, greatest(0.0e0, 1 - ({_SUM})) AS batted FROM l)
SELECT bet_id, {', '.join(f'round({o} / ({_SUM} + batted), 6) AS {o}' for o in (*OUTCOMES, 'batted'))} FROM o""")
def _(t):
    """A batter's rates against a pitcher's by log5, outcome by outcome, and six outcomes that sum to one."""
    r = t.bets.selectExpr("bet_id", *_RATES.split(", "))
    p = r.select("bet_id", stats.matchup({o: (F.col(f"{o}_a"), F.col(f"{o}_b"), LEAGUE[o]) for o in OUTCOMES}, "batted").alias("p"))
    return p.select("bet_id", *[r6(F.col(f"p.{o}")).alias(o) for o in (*OUTCOMES, "batted")])


@query("sc_pythag", "SELECT game_id, round(pow(home_score, 1.83) / (pow(home_score, 1.83) + pow(away_score, 1.83)), 6) AS p FROM games")
def _(t):
    return t.games.select("game_id", r6(stats.pythagorean(F.col("home_score").cast("double"), F.col("away_score").cast("double"))).alias("p"))


@query("sc_park_bullpen_rest", "SELECT game_id, round(least(greatest((home % 5 - 2) * 10 + (3.8 - (away % 40) / 10.0e0) * 30 + (home % 4) * 6.0e0, -50), 50), 6) AS adjustment FROM games")
def _(t):
    x = (F.col("home") % 5 - 2) * 10 + (3.8 - (F.col("away") % 40) / 10.0) * 30 + (F.col("home") % 4) * 6.0
    return t.games.select("game_id", r6(odds.clip(x, -50.0, 50.0)).alias("adjustment"))


@query("sc_basketball", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a = 0 THEN 0.0e0 ELSE round((m + 0.5 * h) / a, 6) END AS efg, CASE WHEN a + 0.44 * f = 0 THEN 0.0e0 ELSE round(p / (2 * (a + 0.44 * f)), 6) END AS ts, round(n, 6) AS poss,
CASE WHEN q > 0 THEN round(48 * n / q, 6) ELSE 0.0e0 END AS pace, CASE WHEN n > 0 THEN round(100 * p / n, 6) ELSE 0.0e0 END AS ortg, CASE WHEN n > 0 THEN round(100 * o / n, 6) ELSE 0.0e0 END AS drtg FROM (SELECT *, a - r + 2 + 0.44 * f AS n
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS p, CAST(l_suppkey % 5 AS DOUBLE) AS m, CAST(l_suppkey % 3 AS DOUBLE) AS h, CAST(l_partkey % 6 AS DOUBLE) AS a, CAST(l_linenumber % 4 AS DOUBLE) AS f, CAST(l_orderkey % 5 AS DOUBLE) AS r, CAST(l_orderkey % 3 * 20 AS DOUBLE) AS q, CAST(l_partkey % 40 AS DOUBLE) AS o FROM lineitem))""")
def _(t):
    m, h, a, f, r, o = ((F.col(c) % n).cast("double") for c, n in (("l_suppkey", 5), ("l_suppkey", 3), ("l_partkey", 6), ("l_linenumber", 4), ("l_orderkey", 5), ("l_partkey", 40)))
    minutes, points = (F.col("l_orderkey") % 3 * 20).cast("double"), F.col("l_quantity")
    n = stats.possessions(a, r, F.lit(2.0), f)
    rates = {"efg": stats.effective_fg(m, h, a), "ts": stats.true_shooting(points, a, f), "poss": n, "pace": stats.pace(n, minutes), "ortg": stats.rating(points, n), "drtg": stats.rating(o, n)}
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[r6(c).alias(k) for k, c in rates.items()])


@query("sc_hockey", "SELECT game_id, CASE WHEN home_score % 3 + away_score % 3 = 0 THEN 0.5e0 ELSE round((home_score % 3) * 1.0e0 / (home_score % 3 + away_score % 3), 6) END AS corsi FROM games")
def _(t):
    return t.games.select("game_id", r6(stats.share_or_half(F.col("home_score") % 3, F.col("away_score") % 3)).alias("corsi"))


@query("sc_baseball", """WITH g AS (SELECT game_id, home % 6 AS bb, home % 7 AS s, away % 4 AS d, away % 2 AS t, home % 3 AS hr, away % 10 AS k, away % 9 AS ip, (home_score - 60) % 30 AS bf, (0.69 * (home % 6) + 0.88 * (home % 7) + 1.24 * (away % 4) + 1.56 * (away % 2) + 2.0 * (home % 3)) / (home_score + 0.37) AS w FROM games)
SELECT game_id, round(w, 6) AS woba, round(w / 0.312 * 100, 6) AS wrc_plus, CASE WHEN ip > 0 THEN round((13 * hr + 3 * bb - 2 * k) * 1.0e0 / ip + 3.1, 6) ELSE 0.0e0 END AS fip,
CASE WHEN bf >= 4 THEN round(greatest(0.0e0, 6.145 - 16.986 * (k * 1.0e0 / bf) + 11.434 * (k * 1.0e0 / bf) * (k * 1.0e0 / bf) - 1.858 * (bb * 1.0e0 / bf) + 7.653 * (bb * 1.0e0 / bf) * (bb * 1.0e0 / bf) - 4.005 * (k * 1.0e0 / bf) * (bb * 1.0e0 / bf)), 6) END AS siera,
CASE WHEN bf > 0 THEN round((k - bb) * 1.0e0 / bf * 100, 6) END AS k_bb_pct FROM g""")
def _(t):
    h, a = F.col("home"), F.col("away")
    faced = (F.col("home_score") - 60) % 30
    w = stats.woba(h % 6, h % 7, a % 4, a % 2, h % 3, F.col("home_score") + 0.37)
    rates = {"woba": w, "wrc_plus": stats.wrc_plus(w), "fip": stats.fip(h % 3, h % 6, a % 10, a % 9), "siera": stats.siera(a % 10, h % 6, faced), "k_bb_pct": stats.k_bb_pct(a % 10, h % 6, faced)}
    return t.games.select("game_id", *[r6(c).alias(k) for k, c in rates.items()])


@query("sc_soccer", "SELECT game_id, CASE WHEN away % 5 = 0 THEN 0.0e0 ELSE round(home_score * 1.0e0 / (away % 5), 6) END AS ppda FROM games")
def _(t):
    return t.games.select("game_id", r6(stats.ppda(F.col("home_score"), F.col("away") % 5)).alias("ppda"))


@query("sc_temp", "SELECT game_id, round((home_score - 60) / 10.0e0 * 4.5, 6) AS carry_feet, round(least(greatest(0.5 + (away % 13) / 3.0e0 * 0.106, 0), 1), 6) AS circadian FROM games")
def _(t):
    return t.games.select("game_id", r6((F.col("home_score") - 60) / 10 * 4.5).alias("carry_feet"), r6(odds.clip(0.5 + (F.col("away") % 13) / 3 * 0.106, 0.0, 1.0)).alias("circadian"))


@query("sc_rlm", "SELECT bet_id, closing_prob < market_prob AND elo_prob > 0.5 AS reverse_move, closing_prob - market_prob >= 0.15 AS pro_edge FROM bets WHERE closing_prob IS NOT NULL")
def _(t):
    b = t.bets.where("closing_prob is not null")
    return b.select("bet_id", ((F.col("closing_prob") < F.col("market_prob")) & (F.col("elo_prob") > 0.5)).alias("reverse_move"), (F.col("closing_prob") - F.col("market_prob") >= 0.15).alias("pro_edge"))


@query("sc_tz", """WITH s AS (SELECT quote_id, date_trunc('day', observed_at) + INTERVAL '12' HOUR + INTERVAL '1' MONTH * (quote_id % 12) AS s FROM quotes), g AS (SELECT quote_id, (epoch(s) - epoch(timezone('America/New_York', s))) / 3600 AS east, (epoch(s) - epoch(timezone(CASE quote_id % 3 WHEN 0 THEN 'America/Los_Angeles' WHEN 1 THEN 'America/Phoenix' ELSE 'America/New_York' END, s))) / 3600 AS west FROM s)
SELECT quote_id, abs(east - west) AS zones, east AS offset_hours, CASE WHEN east > west THEN 'east' WHEN east < west THEN 'west' ELSE 'none' END AS direction FROM g""")
def _(t):
    """Hours between two venues' clocks on the day of a game, and which way the trip goes; summer time included (the rules are the engine's own)."""
    at = F.expr("date_trunc('day', observed_at) + INTERVAL '12' HOUR + make_ym_interval(0, cast(quote_id % 12 as int))")
    other = F.when(F.col("quote_id") % 3 == 0, "America/Los_Angeles").when(F.col("quote_id") % 3 == 1, "America/Phoenix").otherwise("America/New_York")
    gap = lambda z: (F.unix_timestamp(at) - F.unix_timestamp(F.to_utc_timestamp(at, z))) / 3600
    east, west = gap("America/New_York"), gap(other)
    way = F.when(east > west, "east").when(east < west, "west").otherwise("none")
    return t.quotes.select("quote_id", F.abs(east - west).alias("zones"), east.alias("offset_hours"), way.alias("direction"))


@query("sc_ticker", """SELECT bet_id, regexp_extract(ticker, '^KX([A-Z]+)-', 1) AS league, CAST(strptime(regexp_extract(ticker, '-(\\d{2}[A-Z]{3}\\d{2})', 1), '%y%b%d') AS DATE) AS game_date, regexp_extract(ticker, '-([A-Z]+)$', 1) AS side
FROM (SELECT bet_id, 'KX' || upper(substr(sport, 1, 3)) || 'GAME-' || upper(strftime(placed_date, '%y%b%d')) || 'HOMAWY-' || upper(side) AS ticker FROM bets)""")
def _(t):
    day = F.date_format("placed_date", "yyMMMdd")
    ticker = F.concat(F.lit("KX"), F.upper(F.substring("sport", 1, 3)), F.lit("GAME-"), F.upper(day), F.lit("HOMAWY-"), F.upper("side"))
    b = t.bets.select("bet_id", ticker.alias("ticker"))
    raw = F.regexp_extract("ticker", r"-(\d{2}[A-Z]{3}\d{2})", 1)
    proper = F.concat(F.substring(raw, 1, 3), F.lower(F.substring(raw, 4, 2)), F.substring(raw, 6, 2))
    return b.select("bet_id", F.regexp_extract("ticker", "^KX([A-Z]+)-", 1).alias("league"), this_century(F.to_date(proper, "yyMMMdd")).alias("game_date"), F.regexp_extract("ticker", "-([A-Z]+)$", 1).alias("side"))


@query("sc_base_id", "SELECT DISTINCT regexp_replace('KX-' || market || '-' || upper(side), '-(HOME|AWAY)$', '') AS base_id FROM bets")
def _(t):
    full = F.concat(F.lit("KX-"), F.col("market").cast("string"), F.lit("-"), F.upper("side"))
    return t.bets.select(F.regexp_replace(full, "-(HOME|AWAY)$", "").alias("base_id")).distinct()


@query("sc_bet_id", "SELECT bet_id, CASE WHEN sport IN ('ASIA', 'EUROPE') THEN sport || '_' || market || '_' || side ELSE concat_ws('_', sport, strftime(placed_date, '%Y-%m-%d'), market) END AS stable_id FROM bets")
def _(t):
    m = F.col("market").cast("string")
    special = F.when(F.col("sport").isin("ASIA", "EUROPE"), F.concat_ws("_", "sport", m, "side"))
    return t.bets.select("bet_id", F.coalesce(special, F.concat_ws("_", "sport", F.date_format("placed_date", "yyyy-MM-dd"), m)).alias("stable_id"))


@query("sc_game_id", "SELECT game_id, league || '_' || strftime(game_date, '%Y%m%d') || '_' || upper(regexp_replace('t.' || home, '[^A-Za-z0-9]', '', 'g')) || '_' || upper('T' || away) AS stable_id FROM games")
def _(t):
    clean = F.upper(F.regexp_replace(F.concat(F.lit("t."), F.col("home").cast("string")), "[^A-Za-z0-9]", ""))
    return t.games.select("game_id", F.concat_ws("_", F.col("league").cast("string"), F.date_format("game_date", "yyyyMMdd"), clean, F.concat(F.lit("T"), F.col("away").cast("string"))).alias("stable_id"))


@query("sc_tennis_name", """SELECT c_custkey, CASE WHEN n LIKE '%.' THEN n ELSE split_part(n, ' ', 2) || ' ' || substr(n, 1, 1) || '.' END AS short_name, lower(trim(regexp_replace(replace(raw, '.', ''), '[ ]+', ' ', 'g'))) AS plain_name
FROM (SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE '' END AS raw, replace(c_name, '#', ' ') || CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE '' END AS n FROM customer)""")
def _(t):
    """Two forms of a name: rest and first initial, unless it ends with a dot already; and without dots, with single spaces."""
    raw = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, ".").otherwise(""))
    c = t.customer.select("c_custkey", raw.alias("raw"), F.regexp_replace(raw, "#", " ").alias("n"))
    p = F.split("n", " ")
    short = F.concat(F.array_join(F.slice(p, 2, 9), " "), F.lit(" "), F.substring(p[0], 1, 1), F.lit("."))
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace("raw", r"\.", ""), " +", " ")))
    return c.select("c_custkey", F.when(F.col("n").endswith("."), F.col("n")).otherwise(short).alias("short_name"), plain.alias("plain_name"))


@query("sc_tennis_score", """SELECT game_id, 2 + CASE WHEN home % 2 = 0 THEN 1 ELSE 0 END AS winner_sets, 6 + 7 + CASE WHEN home % 2 = 0 THEN 6 ELSE 3 END AS winner_games, away % 5 = 0 AS retired
FROM games""")
def _(t):
    """Sets and games of a score text such as "6-4 7-6(3) 6-3"; a set is won by the higher number of games."""
    last = F.when(F.col("home") % 2 == 0, "6-2").otherwise("3-6")
    score = F.concat(F.lit("6-4 7-6(3) "), last, F.when(F.col("away") % 5 == 0, " RET").otherwise(""))
    sets = F.filter(F.split(F.regexp_replace(score, r"\(\d+\)| RET", ""), " "), lambda s: s.contains("-"))
    pair = F.transform(sets, lambda s: F.struct(F.split(s, "-")[0].cast("int").alias("a"), F.split(s, "-")[1].cast("int").alias("b")))
    won = F.aggregate(pair, F.lit(0), lambda n, x: n + F.when(x["a"] > x["b"], 1).otherwise(0))
    points = F.aggregate(pair, F.lit(0), lambda n, x: n + x["a"])
    return t.games.select("game_id", won.alias("winner_sets"), points.alias("winner_games"), score.endswith("RET").alias("retired"))


@query("sc_serve_pct", "SELECT game_id, round(CASE WHEN home_score % 10 > 0 THEN (away_score % 7) * 1.0e0 / (home_score % 10) WHEN home % 2 = 0 THEN 0.6e0 ELSE 0.5e0 END, 6) AS serve_pct FROM games")
def _(t):
    own = F.try_divide(F.col("away_score") % 7, F.col("home_score") % 10)
    return t.games.select("game_id", r6(F.coalesce(own, F.when(F.col("home") % 2 == 0, 0.6).otherwise(0.5))).alias("serve_pct"))


@query("sc_season", "SELECT game_id, CASE WHEN month(game_date) >= 8 THEN year(game_date) || '-' || (year(game_date) + 1) ELSE (year(game_date) - 1) || '-' || year(game_date) END AS season FROM games")
def _(t):
    first = F.year("game_date") - F.when(F.month("game_date") >= 8, 0).otherwise(1)
    return t.games.select("game_id", F.concat_ws("-", first.cast("string"), (first + 1).cast("string")).alias("season"))


@query("sc_floor_hour", "SELECT quote_id, strftime(date_trunc('hour', observed_at), '%Y-%m-%d %H:%M') AS hour FROM quotes")
def _(t):
    return t.quotes.select("quote_id", F.date_format(F.date_trunc("hour", "observed_at"), "yyyy-MM-dd HH:mm").alias("hour"))


@query("sc_et", "SELECT quote_id, strftime(timezone('America/New_York', timezone('UTC', observed_at + INTERVAL '1' MONTH * (quote_id % 12))), '%Y-%m-%d %H:%M') AS eastern FROM quotes")
def _(t):
    """Eastern wall-clock time over all months, summer time included."""
    at = F.expr("observed_at + make_ym_interval(0, cast(quote_id % 12 as int))")
    return t.quotes.select("quote_id", F.date_format(F.from_utc_timestamp(at, "America/New_York"), "yyyy-MM-dd HH:mm").alias("eastern"))


@query("sc_innings", "SELECT game_id, round(home_score % 10 + (away % 3) / 3.0e0, 6) AS innings FROM games")
def _(t):
    return t.games.select("game_id", r6(stats.innings(F.concat_ws(".", (F.col("home_score") % 10).cast("string"), (F.col("away") % 3).cast("string")))).alias("innings"))


@query("sc_safe", "SELECT p_partkey, coalesce(TRY_CAST(substr(p_brand, 7) AS INTEGER), -1) AS brand_no, CASE WHEN p_size % 5 = 0 THEN 0.0e0 ELSE round(p_retailprice / (p_size % 5), 4) END AS per_unit FROM part")
def _(t):
    return t.part.select("p_partkey", F.coalesce(F.substring("p_brand", 7, 9).try_cast("int"), F.lit(-1)).alias("brand_no"), F.round(stats.safe(F.col("p_retailprice"), F.col("p_size") % 5), 4).alias("per_unit"))


@query("sc_hash", "SELECT bet_id, sha256(concat_ws('|', 'confidence=' || confidence, 'market=' || market, 'side=' || side)) AS feature_hash FROM bets")
def _(t):
    named = sorted({"side": F.col("side"), "market": F.col("market").cast("string"), "confidence": F.col("confidence")}.items())
    return t.bets.select("bet_id", F.sha2(F.concat_ws("|", *[F.concat(F.lit(n + "="), c) for n, c in named]), 256).alias("feature_hash"))


@query("sc_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("sc_freshness", "SELECT market, CASE WHEN max(observed_at) FILTER (WHERE bookmaker = 'view') IS NULL THEN 'missing' WHEN max(observed_at) FILTER (WHERE bookmaker = 'view') < max(observed_at) - INTERVAL '4' HOUR THEN 'stale' ELSE 'fresh' END AS freshness FROM quotes GROUP BY 1")
def _(t):
    g = t.quotes.groupBy("market").agg(F.max(F.when(F.col("bookmaker") == "view", F.col("observed_at"))).alias("v"), F.max("observed_at").alias("m"))
    return g.select("market", F.when(F.col("v").isNull(), "missing").when(F.col("v") < F.col("m") - F.expr("INTERVAL '4' HOUR"), "stale").otherwise("fresh").alias("freshness"))


@query("sc_to_char", "SELECT strftime(hour, '%Y-%m-%dT%H:%M:%SZ') AS snapshot_id, n FROM snapshots")
def _(t):
    return t.snapshots.select(F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("snapshot_id"), "n")


@query("rt_expected", "SELECT game_id, round(1 / (1 + pow(10, ((1500 + away * 7) - (1500 + home * 7) - 100) / 400.0e0)), 6) AS p FROM games")
def _(t):
    return t.games.select("game_id", r6(odds.expected_score(1500 + F.col("home") * 7, 1500 + F.col("away") * 7, 100.0)).alias("p"))


@query("rt_soccer_3way", """WITH r AS (SELECT game_id, (home - away) * 7 + 60.0e0 AS g FROM games), d AS (SELECT game_id, g, least(greatest(0.28 * exp(-pow(g / 350, 2)), 0.05), 0.35) AS d, 1 / (1 + pow(10, -g / 400)) AS e FROM r),
p AS (SELECT game_id, d, greatest(e - d / 2, 0.01) AS h, greatest(1 - e - d / 2, 0.01) AS a FROM d) SELECT game_id, round(h / (h + d + a), 6) AS home, round(d / (h + d + a), 6) AS draw, round(a / (h + d + a), 6) AS away FROM p""")
def _(t):
    p = odds.three_way(1500 + F.col("home") * 7, 1500 + F.col("away") * 7)
    return t.games.select("game_id", r6(p["home"]).alias("home"), r6(p["draw"]).alias("draw"), r6(p["away"]).alias("away"))


@query("rt_reversion", "SELECT market, round(1500 + (avg(elo_prob) * 1000 + 1000 - 1500) * 0.6, 6) AS rating FROM bets GROUP BY 1")
def _(t):
    return t.bets.groupBy("market").agg(r6(1500 + (F.avg("elo_prob") * 1000 + 1000 - 1500) * 0.6).alias("rating"))


@query("rt_glicko_decay", "SELECT market, round(least(sqrt(pow(50 + market % 100, 2) + count(*) * pow(10.0e0, 2)), 350), 6) AS rd FROM bets GROUP BY 1")
def _(t):
    n = t.bets.groupBy("market").agg(F.count("*").alias("n"))
    return n.select("market", r6(F.least(F.sqrt(F.pow(50 + F.col("market") % 100, F.lit(2.0)) + F.col("n") * 100.0), F.lit(350.0))).alias("rd"))


@query("rt_glicko_predict", """SELECT game_id, round(1 / (1 + exp(-g * (mh - ma))), 6) AS p FROM (SELECT game_id, ((home - away) * 7 + 100) / 173.7178 AS mh, 0.0e0 AS ma, 1 / sqrt(1 + 3 * (pow((50 + home) / 173.7178, 2) + pow((50 + away) / 173.7178, 2)) / pow(pi(), 2)) AS g FROM games)""")
def _(t):
    s = 173.7178
    phi2 = F.pow((50 + F.col("home")) / s, F.lit(2.0)) + F.pow((50 + F.col("away")) / s, F.lit(2.0))
    g = 1 / F.sqrt(1 + 3 * phi2 / F.pow(F.pi(), F.lit(2.0)))
    return t.games.select("game_id", r6(odds.sigmoid(g * ((F.col("home") - F.col("away")) * 7 + 100) / s)).alias("p"))


@query("rt_auc", """WITH r AS (SELECT elo_prob AS p, status = 'won' AS y, rank() OVER (ORDER BY elo_prob) + (count(*) OVER (PARTITION BY elo_prob) - 1) / 2.0e0 AS k FROM bets WHERE status <> 'open')
SELECT round((sum(k) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0e0) / (count(*) FILTER (WHERE y) * 1.0e0 * count(*) FILTER (WHERE NOT y)), 6) AS auc FROM r""")
def _(t):
    """By distinct score; their order is made in ranges side by side."""
    y = F.col("status") == "won"
    g = t.bets.where("status <> 'open'").groupBy("elo_prob").agg(F.count(F.when(y, 1)).alias("pos"), F.count(F.when(~y, 1)).alias("neg"))
    g = counted_before(g, "elo_prob", "neg")
    return g.agg(F.round(F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))
