"""Joins: equi, as-of, interval, tiered look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.core import asof_join, latest_by, unpivot_sides
from ..operators.intervals import valid_at
from ..plans.ledger import SPANS
from . import query

#: Order in which bookmakers' quotes of the same time are preferred.
BOOK_RANK = {"purchase": 1, "signup": 2, "view": 3, "click": 4, "error": 5}


def book_rank():
    return F.coalesce(*[F.when(F.col("bookmaker") == b, r) for b, r in BOOK_RANK.items()], F.lit(9))


@query("jn_inner_equi", "SELECT l_orderkey, l_linenumber, o_custkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def _(t):
    return t.lineitem.join(t.orders.where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "l_quantity")


@query("jn_left_equi", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("jn_two_key", "SELECT a.game_id, a.team, b.points_for AS other_points FROM (SELECT game_id, home AS team, away AS o FROM games) a JOIN (SELECT game_id, away AS team, away_score AS points_for FROM games) b ON a.game_id = b.game_id AND a.o = b.team")
def _(t):
    s = unpivot_sides(t.games)
    a, b = s.where("is_home").select("game_id", "team", "opponent"), s.where("not is_home").select("game_id", F.col("team").alias("opponent"), F.col("points_for").alias("other_points"))
    return a.join(b, ["game_id", "opponent"]).select("game_id", "team", "other_points")


@query("jn_cross_scalar", "SELECT strftime(hour, '%Y-%m-%d %H') AS hour, round(volume / (SELECT sum(cost) FROM bets), 8) AS share FROM snapshots")
def _(t):
    total = t.bets.agg(F.sum("cost").alias("total"))  # one row
    return t.snapshots.crossJoin(F.broadcast(total)).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.round(F.col("volume") / F.col("total"), 8).alias("share"))


@query("jn_left_true", "SELECT r_name, x.n FROM region LEFT JOIN (SELECT count(*) AS n FROM bets HAVING count(*) < 0) x ON true")
def _(t):
    one = t.bets.agg(F.count("*").alias("n")).where("n < 0")
    return t.region.join(F.broadcast(one), F.lit(True), "left").select("r_name", "n")


#: Some quotes come without a time, some are marked as closing quotes, and some wagers have no known close.
GAPS = """w AS (SELECT wager_id, market, CASE WHEN wager_id % 11 <> 0 THEN close_at END AS close_at FROM wagers),
q AS (SELECT quote_id, market, bookmaker, price, CASE WHEN quote_id % 13 <> 0 THEN date_trunc('hour', observed_at) END AS observed_at, quote_id % 17 = 0 AS explicit_close FROM quotes)"""
BOOK_SQL = "CASE bookmaker " + " ".join(f"WHEN '{b}' THEN {r}" for b, r in BOOK_RANK.items()) + " ELSE 9 END"


def with_gaps(t):
    w = t.wagers.withColumn("close_at", F.when(F.col("wager_id") % 11 != 0, F.col("close_at")))
    q = t.quotes.withColumns({"observed_at": F.when(F.col("quote_id") % 13 != 0, F.date_trunc("hour", "observed_at")), "explicit_close": F.col("quote_id") % 17 == 0})
    return w, q


@query("jn_asof_close", f"""WITH {GAPS} SELECT w.wager_id, q.quote_id, round(q.price, 4) AS close_price FROM w LEFT JOIN LATERAL (SELECT quote_id, price FROM q
WHERE q.market = w.market AND (w.close_at IS NULL OR q.observed_at IS NULL OR q.observed_at <= w.close_at) ORDER BY observed_at DESC NULLS LAST, {BOOK_SQL}, quote_id LIMIT 1) q ON true""")
def _(t):
    """A quote without a time is admitted before all others, a wager without a close admits every quote; then bookmaker, then id."""
    w, q = with_gaps(t)
    got = asof_join(w, q, ["market"], "close_at", "observed_at", ["quote_id", "price"], rank=book_rank(), prefer=[-F.col("quote_id")], untimed=True, parts=SPANS)
    return got.select("wager_id", "quote_id", F.round("price", 4).alias("close_price"))


@query("jn_asof_close_py", f"""WITH {GAPS}, e AS (SELECT w.wager_id, w.market, w.close_at, q.quote_id, q.bookmaker, q.observed_at, q.explicit_close,
  row_number() OVER (PARTITION BY w.wager_id ORDER BY coalesce(q.explicit_close, false) DESC, q.observed_at DESC NULLS LAST, {BOOK_SQL}, q.price DESC, q.quote_id) AS k,
  count(q.quote_id) OVER (PARTITION BY w.wager_id, q.observed_at) AS ties
  FROM w LEFT JOIN q ON q.market = w.market AND (w.close_at IS NULL OR q.observed_at IS NULL OR q.observed_at <= w.close_at))
SELECT wager_id, quote_id, CASE WHEN observed_at IS NOT NULL THEN bookmaker || '|' || market || '|' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S') END AS provenance,
CASE WHEN quote_id IS NULL THEN 'missing' WHEN observed_at IS NULL THEN 'missing_source_timestamp' WHEN close_at IS NULL OR close_at - observed_at <= INTERVAL '4' HOUR THEN 'fresh' ELSE 'stale' END AS freshness,
CASE WHEN quote_id IS NULL THEN NULL WHEN explicit_close THEN 'explicit_close_snapshot' WHEN ties > 1 THEN 'source_priority_tiebreak' ELSE 'latest_admissible_pregame_quote' END AS rule FROM e WHERE k = 1""")
def _(t):
    """A quote marked as closing goes before newer ones; the label tells whether others shared the time of the one taken."""
    w, q = with_gaps(t)
    take = ["quote_id", "bookmaker", "observed_at", "explicit_close"]
    got = asof_join(w, q, ["market"], "close_at", "observed_at", take, rank=book_rank(), prefer=[F.col("price"), -F.col("quote_id")], untimed=True, tiers=[F.col("explicit_close"), F.lit(True)], ties="ties", parts=SPANS)
    none, old = F.col("quote_id").isNull(), F.col("close_at") - F.col("observed_at") > F.expr("INTERVAL '4' HOUR")
    fresh = F.when(none, "missing").when(F.col("observed_at").isNull(), "missing_source_timestamp").when(old, "stale").otherwise("fresh")
    rule = F.when(none, None).when(F.col("explicit_close"), "explicit_close_snapshot").when(F.col("ties") > 1, "source_priority_tiebreak").otherwise("latest_admissible_pregame_quote")
    told = F.concat_ws("|", "bookmaker", F.col("market").cast("string"), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return got.select("wager_id", "quote_id", F.when(F.col("observed_at").isNotNull(), told).alias("provenance"), fresh.alias("freshness"), rule.alias("rule"))


#: Ratings that hold from a game on: some until the next change at the earliest, some for a few weeks only, so that they overlap and leave gaps.
VERSIONS = """v AS (SELECT league, home AS team, game_date AS valid_from, CASE WHEN game_id % 5 <> 0 THEN game_date + CAST(game_id % 40 AS INTEGER) END AS valid_to, home_score AS rating, game_id AS version FROM games WHERE status = 'final' AND game_id % 3 = 0)"""


@query("jn_asof_rating", f"""WITH {VERSIONS} SELECT g.game_id, r.rating, r.version FROM (SELECT * FROM games WHERE status = 'scheduled') g
LEFT JOIN LATERAL (SELECT rating, version FROM v WHERE v.league = g.league AND v.team = g.home AND valid_from <= g.game_date AND (valid_to IS NULL OR valid_to >= g.game_date) ORDER BY valid_from DESC, version DESC LIMIT 1) r ON true""")
def _(t):
    """The newest of the ratings that hold on the day."""
    v = t.games.where("status = 'final' and game_id % 3 = 0").select("league", F.col("home").alias("team"), F.col("game_date").alias("valid_from"), F.when(F.col("game_id") % 5 != 0, F.date_add("game_date", (F.col("game_id") % 40).cast("int"))).alias("valid_to"), F.col("home_score").alias("rating"), F.col("game_id").alias("version"))
    g = t.games.where("status = 'scheduled'").select("game_id", "league", F.col("home").alias("team"), "game_date")
    got = valid_at(g, v, ["league", "team"], "game_date", "valid_from", "valid_to", "version", ["rating", "version"], parts=SPANS)
    return got.select("game_id", "rating", "version")


@query("jn_asof_feature", """WITH f AS (SELECT pitcher, game_date AS as_of, avg(velocity) AS v FROM pitches GROUP BY 1, 2), a AS (SELECT DISTINCT l_suppkey AS pitcher, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.pitcher, a.day, round(f.v, 4) AS velocity FROM a ASOF LEFT JOIN f ON a.pitcher = f.pitcher AND a.day >= f.as_of""")
def _(t):
    f = t.pitches.groupBy("pitcher", F.col("game_date").alias("as_of")).agg(F.avg("velocity").alias("v"))
    a = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("pitcher"), F.to_date("o_orderdate").alias("day")).distinct()
    return asof_join(a, f, ["pitcher"], "day", "as_of", ["v"]).select("pitcher", "day", F.round("v", 4).alias("velocity"))


@query("jn_asof_strict", """WITH f AS (SELECT market, observed_at, max(price) AS price FROM quotes GROUP BY 1, 2)
SELECT w.wager_id, round(f.price, 4) AS price FROM wagers w ASOF LEFT JOIN f ON w.market = f.market AND w.placed_at > f.observed_at""")
def _(t):
    f = t.quotes.groupBy("market", "observed_at").agg(F.max("price").alias("price"))
    return asof_join(t.wagers, f, ["market"], "placed_at", "observed_at", ["price"], strict=True, parts=SPANS).select("wager_id", F.round("price", 4).alias("price"))


@query("jn_prev_row", """WITH s AS (SELECT league, home AS team, game_date FROM games UNION SELECT league, away, game_date FROM games)
SELECT league, team, game_date, lag(game_date) OVER (PARTITION BY league, team ORDER BY game_date) AS prev_date FROM s""")
def _(t):
    days = unpivot_sides(t.games).select("league", "team", "game_date").distinct()
    return days.withColumn("prev_date", F.lag("game_date").over(Window.partitionBy("league", "team").orderBy("game_date")))


@query("jn_range_window", "SELECT w.wager_id, count(q.quote_id) AS n FROM wagers w LEFT JOIN quotes q ON q.market = w.market AND q.observed_at > w.placed_at - INTERVAL '3' DAY AND q.observed_at <= w.placed_at GROUP BY 1")
def _(t):
    w = Window.partitionBy("market").orderBy(F.unix_micros("observed_at")).rangeBetween(-3 * 86_400_000_000 + 1, 0)
    q = t.quotes.withColumn("n", F.count("*").over(w))
    return t.wagers.select("wager_id").join(q.select(F.col("quote_id").alias("wager_id"), "n"), "wager_id")


@query("jn_theta_or", "SELECT g.game_id, count(*) AS n FROM games g JOIN (SELECT DISTINCT n_nationkey FROM nation) x ON g.home = x.n_nationkey OR g.away = x.n_nationkey GROUP BY 1")
def _(t):
    keys = t.nation.select("n_nationkey").distinct()
    either = t.games.select("game_id", F.explode(F.array("home", "away")).alias("n_nationkey")).distinct()
    return either.join(keys, "n_nationkey").groupBy("game_id").agg(F.count("*").alias("n"))


@query("jn_fuzzy_pm1", """WITH b AS (SELECT bet_id, market % 30 AS team, placed_date FROM bets WHERE status = 'open'), g AS (SELECT home AS team, game_date, min(game_id) AS game_id FROM games GROUP BY 1, 2),
c AS (SELECT bet_id, g.game_id, CASE WHEN g.game_date = placed_date THEN 0 WHEN g.game_date = placed_date + 1 THEN 1 ELSE 2 END AS p FROM b JOIN g ON b.team = g.team AND g.game_date BETWEEN placed_date - 1 AND placed_date + 1)
SELECT bet_id, arg_min(game_id, p) AS game_id FROM c GROUP BY 1""")
def _(t):
    b = t.bets.where("status = 'open'").select("bet_id", (F.col("market") % 30).alias("team"), "placed_date")
    tries = F.posexplode(F.array(F.col("placed_date"), F.date_add("placed_date", 1), F.date_sub("placed_date", 1))).alias("priority", "game_date")
    g = t.games.groupBy(F.col("home").alias("team"), "game_date").agg(F.min("game_id").alias("game_id"))
    return b.select("bet_id", "team", tries).join(g, ["team", "game_date"]).groupBy("bet_id").agg(F.min_by("game_id", "priority").alias("game_id"))


@query("jn_normalised_name", "SELECT c_custkey, n_nationkey FROM customer JOIN nation ON lower(replace(n_name, '_', '')) = 'nation' || (c_custkey % 40)")
def _(t):
    names = t.nation.select("n_nationkey", F.lower(F.regexp_replace("n_name", "_", "")).alias("name"))
    return t.customer.withColumn("name", F.concat(F.lit("nation"), (F.col("c_custkey") % 40).cast("string"))).join(F.broadcast(names), "name").select("c_custkey", "n_nationkey")


@query("jn_self_pair", "SELECT a.game_id, b.game_id AS return_id FROM games a JOIN games b ON a.league = b.league AND a.home = b.away AND a.away = b.home AND a.game_date = b.game_date")
def _(t):
    a = t.games.select("game_id", "league", "home", "away", "game_date")
    b = t.games.select(F.col("game_id").alias("return_id"), "league", F.col("away").alias("home"), F.col("home").alias("away"), "game_date")
    return a.join(b, ["league", "home", "away", "game_date"]).select("game_id", "return_id")


@query("jn_multi_left", """SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    o = o.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return o.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("jn_semi_exists", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jn_exists_where", "SELECT o_orderkey FROM orders o WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND nullif(l_discount, 0) IS NULL)")
def _(t):
    bare = t.lineitem.where(F.nullif("l_discount", F.lit(0.0)).isNull())
    return t.orders.where(F.col("o_orderdate") >= "1997-01-01").join(bare, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("jn_remap_ids", """WITH u AS (SELECT league, home, game_date, min(game_id) AS unified FROM games GROUP BY 1, 2, 3)
SELECT g.game_id, u.unified, u.unified IS NULL AS unmapped FROM games g LEFT JOIN u ON g.league = u.league AND g.away = u.home AND g.game_date = u.game_date""")
def _(t):
    u = t.games.groupBy("league", "home", "game_date").agg(F.min("game_id").alias("unified")).withColumnRenamed("home", "away")
    return t.games.select("game_id", "league", "away", "game_date").join(u, ["league", "away", "game_date"], "left").select("game_id", "unified", F.col("unified").isNull().alias("unmapped"))


@query("jn_fill_ticker", "SELECT w.wager_id, coalesce(CASE WHEN w.wager_id % 2 = 0 THEN 'own' || w.wager_id END, x.ticker) AS ticker FROM wagers w LEFT JOIN (SELECT market, 'q' || min(quote_id) AS ticker FROM quotes WHERE bookmaker = 'view' GROUP BY 1) x ON w.market = x.market")
def _(t):
    x = t.quotes.where("bookmaker = 'view'").groupBy("market").agg(F.concat(F.lit("q"), F.min("quote_id").cast("string")).alias("ticker"))
    own = F.when(F.col("wager_id") % 2 == 0, F.concat(F.lit("own"), F.col("wager_id").cast("string")))
    return t.wagers.join(x, "market", "left").select("wager_id", F.coalesce(own, "ticker").alias("ticker"))


@query("jn_anti_orphan", "SELECT p_partkey FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45 WHERE l_partkey IS NULL")
def _(t):
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("jn_latest_link", """WITH r AS (SELECT market, side, bet_id AS rec_id, row_number() OVER (PARTITION BY market, side ORDER BY placed_date DESC, bet_id) AS k FROM bets WHERE status <> 'open')
SELECT b.bet_id, r.rec_id FROM bets b LEFT JOIN r ON r.market = b.market AND r.side = b.side AND k = 1 WHERE b.status = 'open'""")
def _(t):
    r = latest_by(t.bets.where("status <> 'open'"), ["market", "side"], F.col("placed_date").desc_nulls_last(), F.col("bet_id")).select("market", "side", F.col("bet_id").alias("rec_id"))
    return t.bets.where("status = 'open'").join(r, ["market", "side"], "left").select("bet_id", "rec_id")


@query("jn_ordered_lookup", """SELECT s_suppkey, coalesce(a.n_name, b.r_name, CASE WHEN s_suppkey % 3 = 0 THEN 'related' END, s_name) AS name FROM supplier
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) a ON s_nationkey = a.n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 2) b ON s_nationkey = b.r_regionkey""")
def _(t):
    a, b = t.nation.where("n_regionkey = 1").select("n_nationkey", "n_name"), t.region.where("r_regionkey > 2")
    s = t.supplier.join(F.broadcast(a), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(b), F.col("s_nationkey") == F.col("r_regionkey"), "left")
    return s.select("s_suppkey", F.coalesce("n_name", "r_name", F.when(F.col("s_suppkey") % 3 == 0, "related"), "s_name").alias("name"))


@query("jn_ci_lookup", "SELECT s_suppkey, n_nationkey FROM supplier LEFT JOIN nation ON lower(trim(n_name)) = lower(trim(' Nation_' || (s_suppkey % 30) || ' '))")
def _(t):
    n = t.nation.select("n_nationkey", F.lower(F.trim("n_name")).alias("k"))
    s = t.supplier.withColumn("k", F.lower(F.trim(F.concat(F.lit(" Nation_"), (F.col("s_suppkey") % 30).cast("string"), F.lit(" ")))))
    return s.join(F.broadcast(n), "k", "left").select("s_suppkey", "n_nationkey")
