"""Primitives on small frames with the awkward rows: nulls, ties, empty sides."""

import datetime as dt
import math
import os
import random

import numpy as np
import pytest
from fieldmark.functions import odds, stats
from fieldmark.operators import core
from fieldmark.operators.ratings import GlickoState, RatingSpec, StarterState, final_ratings, ordered_fold
from fieldmark.plans.ledger import allocate, first_reason, reconcile, validate
from fieldmark.sources import files
from pyspark.sql import functions as F

DAY = dt.date(2024, 1, 1)


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 7), (4, "a", 12), (5, None, 3)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 100, 2), ("a", 10, 200, 2), ("a", 10, 201, 1), ("b", 8, 300, 1), ("a", None, 400, 1)], "k string, u int, v int, pref int")
    got = {r.id: r.v for r in core.asof_join(left, right, ["k"], "t", "u", ["v"], rank=F.col("pref")).collect()}
    assert got == {1: 201, 2: 100, 3: None, 4: 201, 5: None}
    strict = {r.id: r.v for r in core.asof_join(left, right, ["k"], "t", "u", ["v"], strict=True, rank=F.col("pref")).collect()}
    assert strict == {1: 100, 2: None, 3: None, 4: 201, 5: None}
    assert core.asof_join(left.limit(0), right, ["k"], "t", "u", ["v"]).count() == 0


def test_asof_join_by_spans(spark):
    rng = random.Random(6)
    pick = lambda: rng.choice(["a", "a", "a", "b", None])
    left = spark.createDataFrame([(i, pick(), rng.choice([None, *range(200)])) for i in range(300)], "id int, k string, t int").repartition(3)
    right = spark.createDataFrame([(pick(), rng.choice([None, *range(0, 200, 7)]), i, rng.randrange(3)) for i in range(90)], "k string, u int, v int, pref int").dropDuplicates(["k", "u", "pref"])
    for strict in (False, True):
        want, got = (sorted((r.id, r.v or -1) for r in core.asof_join(left, right, ["k"], "t", "u", ["v"], strict=strict, rank=F.col("pref"), parts=n).collect()) for n in (1, 8))
        assert got == want and any(v > 0 for _, v in got)
    assert core.asof_join(left, right.limit(0), ["k"], "t", "u", ["v"], parts=8).where("v is not null").count() == 0


def test_latest_upsert_versions(spark):
    df = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("y", None, "c")], "k string, n int, v string")
    assert {(r.k, r.v) for r in core.latest_by(df, ["k"], F.col("n").desc_nulls_last()).collect()} == {("x", "b"), ("y", "c")}
    new = spark.createDataFrame([("x", 3, "z"), ("w", 1, "q")], df.schema)
    assert {(r.k, r.v) for r in core.upsert(df, new, ["k"], "n").collect()} == {("x", "z"), ("y", "c"), ("w", "q")}
    v = spark.createDataFrame([("x", 1, 5), ("x", 2, 5), ("x", 3, 6), ("x", 4, None)], "k string, t int, v int")
    got = [(r.t, r.valid_to) for r in core.close_versions(v, ["k"], "t", F.col("v")).orderBy("t").collect()]
    assert got == [(1, 3), (3, 4), (4, None)]


def test_ranks_and_quantiles_side_by_side(spark):
    rng = random.Random(4)
    for values in ([rng.gauss(0, 1) for _ in range(500)], [float(rng.randrange(9)) for _ in range(300)], [1.0], [2.0] * 50 + [9.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
        counts = core.counted_before(df.where("v is not null").groupBy("v").agg(F.count("*").alias("n")), "v", "n", parts=8)
        assert {r.v: r.before for r in counts.collect()} == {v: sum(x < v for x in values) for v in values}
        shares = [0.0, 0.1, 0.5, 0.9, 1.0]
        assert np.allclose(core.quantiles(df, "v", shares).first().q, np.quantile(values, shares))
    assert core.quantiles(df.limit(0), "v", [0.5]).first().q == [None]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_formulas(spark):
    lit = F.lit
    assert one(spark, odds.implied(lit(0.0))) is None and one(spark, odds.implied(lit(1.0))) == 0.99
    assert one(spark, odds.from_american(lit(-200.0))) == 1.5 and one(spark, odds.from_american(lit(0.0))) is None
    for m in (0.0, 1.0, -0.1, 1.2):
        assert one(spark, odds.kelly(lit(0.6), lit(m))) == 0 and one(spark, odds.expected_value(lit(0.6), lit(m))) == 0
    assert abs(one(spark, odds.kelly(lit(0.6), lit(0.5))) - 0.2) < 1e-12
    p = one(spark, odds.three_way(lit(1500.0), lit(1500.0)))
    assert abs(p.home + p.draw + p.away - 1) < 1e-12 and p.home > p.away
    assert one(spark, stats.safe(lit(1.0), lit(0.0))) == 0 and one(spark, stats.share_or_half(lit(0), lit(0))) == 0.5
    assert abs(one(spark, stats.innings(lit("6.2"))) - 20 / 3) < 1e-12 and one(spark, stats.innings(lit("7"))) == 7


def games(spark, n=120):
    rows = [(i, i % 3, DAY + dt.timedelta(days=7 * i), i % 8, (i + 1 + i % 5) % 8, 100 + 3 * i % 30, 95 + 7 * i % 25, i % 7 == 0) for i in range(n)]
    rows = [r for r in rows if r[3] != r[4]]
    return rows, spark.createDataFrame(rows, "game_id long, league long, game_date date, home long, away long, home_score long, away_score long, is_neutral boolean").repartition(5)


def plain_elo(rows, change, lift=0.0, held=None, season=None):
    """Ratings after each game by a plain loop; change(margin, chance, gap, days, games of either) -> the two changes."""
    ratings, played, last, count, out = {}, {}, {}, {}, {}
    for game, league, day, home, away, hs, as_, neutral in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if season and league in last and last[league].year != day.year:
            season([k for k in ratings if k[0] == league], ratings)
        h, a = (league, home), (league, away)
        before = [ratings.get(k, 1500.0) for k in (h, a)]
        if held:
            before = [held(r, (day - played[k]).days) if k in played else r for k, r in zip((h, a), before, strict=True)]
        gap = before[0] + (0 if neutral else lift) - before[1]
        up, down = change(hs - as_, 1 / (1 + 10 ** (-gap / 400)), gap, (day - last[league]).days if league in last else None, (count.get(h, 0), count.get(a, 0)))
        ratings[h], ratings[a] = before[0] + up, before[1] - down
        for k in (h, a):
            played[k], count[k] = day, count.get(k, 0) + 1
        last[league] = day
        out[game] = (*before, ratings[h], ratings[a])
    return out


def test_folds_against_plain_loops(spark):
    rows, df = games(spark)
    win = lambda m: float(m > 0)

    def regress(keys, ratings):
        mean = sum(ratings[k] for k in keys) / len(keys)
        for k in keys:
            ratings[k] = 0.67 * ratings[k] + 0.33 * mean

    soccer = lambda m: 0.5 if m == 0 else 1.0 if m == 1 else 1 / (1 + math.exp(-min(2, max(-2, m))))
    cases = [
        (RatingSpec(), {"change": lambda m, p, g, d, c: (20 * (win(m) - p),) * 2, "lift": 100}),
        # the gap of the margin's scale is home minus away, home points included, whoever wins
        (RatingSpec(home=65, margin=True), {"change": lambda m, p, g, d, c: (20 * (win(m) - p) * math.log(max(abs(m), 1) + 1) * 2.2 / (0.001 * g + 2.2),) * 2, "lift": 65}),
        (RatingSpec(home=65, recency=1.0), {"change": lambda m, p, g, d, c: (20 * (win(m) - p) * (1 if d is None else min(1.5, max(0.5, 1 + d / 365))),) * 2, "lift": 65}),
        (RatingSpec(k=40, home=60, soft=True), {"change": lambda m, p, g, d, c: (40 * (soccer(m) - p),) * 2, "lift": 60}),
        (RatingSpec(k=32, home=0, novice=20), {"change": lambda m, p, g, d, c: tuple(32 * (1.5 if n < 20 else 1) * (win(m) - p) for n in c)}),
        (RatingSpec(k=32, home=0, half_life=90), {"change": lambda m, p, g, d, c: (32 * (win(m) - p),) * 2, "held": lambda r, days: 1500 + (r - 1500) * 0.5 ** (days / 90)}),
        (RatingSpec(home=80, carry=0.67, to_mean=True), {"change": lambda m, p, g, d, c: (20 * (win(m) - p),) * 2, "lift": 80, "season": regress}),
    ]
    for spec, plain in cases:
        want = plain_elo(rows, **plain)
        got = {r.game_id: (r.home_before, r.away_before, r.home_after, r.away_after) for r in ordered_fold(df, spec).collect()}
        assert got.keys() == want.keys() and all(max(abs(a - b) for a, b in zip(got[k], want[k], strict=True)) < 1e-9 for k in got), spec
    whole = {r.game_id: r.p_home for r in ordered_fold(df, RatingSpec()).collect()}
    early = {r.game_id: r.p_home for r in ordered_fold(df.where("game_id < 60"), RatingSpec()).collect()}
    assert all(whole[k] == p for k, p in early.items())
    assert ordered_fold(df.limit(0), RatingSpec()).count() == 0


def test_unknown_starters_tell_nothing(spark):
    rows = [(1, 0, DAY, 7, 8, 3, 1), (2, 0, DAY + dt.timedelta(1), 7, -1, 0, 9), (3, 0, DAY + dt.timedelta(2), 8, 7, 2, 1)]
    df = spark.createDataFrame(rows, "game_id long, league long, game_date date, home long, away long, home_score long, away_score long")
    r = {x.game_id: x for x in ordered_fold(df, lambda league: StarterState(RatingSpec(k=6, home=0))).collect()}
    assert r[1].p_home == 0.5 and r[1].home_after == 1503 and r[1].away_after == 1497
    assert r[2].p_home == 0.5 and (r[2].home_before, r[2].home_after, r[2].away_after) == (1503, 1503, 1500)
    p = 1 / (1 + 10 ** (6 / 400))
    assert abs(r[3].home_after - (1497 + 6 * (1 - p))) < 1e-9


def test_standard_elo_by_hand(spark):
    df = spark.createDataFrame([(1, 0, DAY, 1, 2, 3, 1), (2, 0, DAY + dt.timedelta(1), 2, 1, 2, 2)], "game_id long, league long, game_date date, home long, away long, home_score long, away_score long")
    r = {x.game_id: x for x in ordered_fold(df, RatingSpec()).collect()}
    p1 = 1 / (1 + 10 ** (-100 / 400))
    assert abs(r[1].p_home - p1) < 1e-12 and abs(r[1].home_after - (1500 + 20 * (1 - p1))) < 1e-9
    assert abs(r[2].home_after + r[2].away_after - 3000) < 1e-9
    last = {x.team: x.rating for x in final_ratings(ordered_fold(df, RatingSpec())).collect()}
    assert abs(sum(last.values()) - 3000) < 1e-9


def test_glicko_published_example():
    """The worked example of the method's description: three games in one rating period."""
    rating, deviation, volatility = GlickoState.update((1500.0, 200.0, 0.06), [(1400.0, 30.0, 1.0), (1550.0, 100.0, 0.0), (1700.0, 300.0, 0.0)])
    assert abs(rating - 1464.06) < 0.02 and abs(deviation - 151.52) < 0.01 and abs(volatility - 0.05999) < 1e-5


def test_glicko_volatility_is_the_root():
    for variance, gain, spread in ((0.0036, 9.0, 2.0), (0.0036, 0.01, 4.0), (0.04, 30.0, 1.2)):
        x = 2 * math.log(GlickoState.volatility(variance, gain, spread))
        e = math.exp(x)
        assert abs(e * (gain - spread - e) / (2 * (spread + e) ** 2) - (x - math.log(variance)) / GlickoState.TAU**2) < 1e-9


def test_glicko_step_sees_the_home_points_on_one_side():
    s = GlickoState(home=100)
    s.step(1, 2, 3, 1, DAY)
    assert s.state[1] == GlickoState.update(GlickoState.START, [(1500.0, 350.0, 1.0)])
    assert s.state[2] == GlickoState.update(GlickoState.START, [(1600.0, 350.0, 0.0)])


def test_allocation_stops_at_the_first_breach(spark):
    rows = [(1, DAY, 40.0), (2, DAY, 40.0), (3, DAY, 40.0), (4, DAY, 5.0), (5, DAY + dt.timedelta(1), 500.0)]
    df = spark.createDataFrame(rows, "id int, d date, s double")
    got = {r.id: r.allocated for r in allocate(df, "d", [F.col("id")], F.col("s"), 100.0, 10.0).collect()}
    assert got == {1: 40.0, 2: 40.0, 3: 20.0, 4: 0.0, 5: 100.0}


def test_reconcile_and_validate(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "q"), (3, "z", "r")], "id int, s string, c string")
    b = spark.createDataFrame([(1, "x", None), (2, "w", None), (4, "n", "m")], "id int, s string, c string")
    got = sorted((r.id, r.kind, r.field or "", r.old_value, r.new_value) for r in reconcile(a, b, "id", ["s", "c"]).collect())
    assert got == [(2, "changed", "c", "q", None), (2, "changed", "s", "y", "w"), (4, "insert", "", None, None)]
    v = validate(a, {"c_there": F.col("c").isNotNull(), "s_x": F.col("s") == "x"}).collect()
    assert {r.id: r.errors for r in v} == {1: ["c_there"], 2: ["s_x"], 3: ["s_x"]}
    assert one(spark, first_reason(("a", F.lit(False)), ("b", F.lit(True)))) == "b"


def test_soccer_rows(spark):
    lines = spark.createDataFrame([("1,03/02/2024,H",), ("2,03/02/98,D",), ("3,99/99/2024,A",), ("4,03/02/2024,X",), ("junk",)], "value string")
    got = {(r.game_id, r.game_date) for r in files.soccer_rows(lines).collect()}
    assert got == {(1, dt.date(2024, 2, 3)), (2, dt.date(1998, 2, 3))}


def test_jdbc_options_push_the_filter():
    got = files.jdbc_options("jdbc:x", "bets", ["bet_id", "cost"], {"sport": "O'x", "cost": (">=", 10), "profit": None}, "bet_id", (1, 900), 6)
    assert got["dbtable"] == """(SELECT "bet_id", "cost" FROM "bets" WHERE "sport" = 'O''x' AND "cost" >= 10 AND "profit" IS NULL) AS q"""
    assert (got["partitionColumn"], got["lowerBound"], got["upperBound"], got["numPartitions"]) == ("bet_id", "1", "900", "6")
    with pytest.raises(ValueError):
        files.jdbc_options("jdbc:x", "bets", ["bet_id"], {"cost": ("= 1 OR", 1)})


def test_csv_in_several_encodings(spark, tmp_path):
    for name, encoding, text in (("a", "utf-8", "k,v\n1,Ä\n2,x\n"), ("b", "iso-8859-1", "k,v\n3,Ö\n4,y\n"), ("c", "utf-8", "k,v\n")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
    got = files.csv_any_encoding(spark, str(tmp_path), "k bigint, v string").collect()
    assert {(r.k, r.v) for r in got} == {(1, "Ä"), (2, "x"), (3, "Ö"), (4, "y")}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_logistic_against_newton_steps(spark):
    from fieldmark import registry
    from fieldmark.sources.tables import Tables

    sf = "/root/testdata/sf0.001"
    rows = Tables(spark, sf).bets.where("status <> 'open'").select("bet_id", "elo_prob", "market_prob", "hours_before", (F.col("status") == "won").cast("double").alias("y")).collect()
    x = np.array([[1.0, r.elo_prob, r.market_prob, r.hours_before] for r in rows])
    y, even = np.array([r.y for r in rows]), np.array([r.bet_id % 2 == 0 for r in rows])
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x[even] @ beta))
        beta += np.linalg.solve((x[even] * (p * (1 - p))[:, None]).T @ x[even], x[even].T @ (y[even] - p))
    want = dict(zip([r.bet_id for r in rows], 1 / (1 + np.exp(-x @ beta)), strict=True))
    got = {r.bet_id: (r.p, r.prediction) for r in registry.QUERIES["op_logistic"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(p - want[k]) < 1e-3 and (abs(want[k] - 0.5) < 1e-3 or c == float(want[k] > 0.5)) for k, (p, c) in got.items())
