"""Tables that are kept up: versions, seasons of ratings, databases, sinks; and folds under caps."""

import datetime as dt
import os
import random

from fieldmark.functions import odds
from fieldmark.operators.core import close_versions
from fieldmark.operators.features import rated_sides, side_features
from fieldmark.operators.folds import Limits, allocate_kelly
from fieldmark.operators.ratings import RatingSpec, final_ratings, ordered_fold, replay
from fieldmark.operators.records import common_opponents, records_before
from fieldmark.operators.versions import VersionTable
from fieldmark.plans.ledger import duplicates
from fieldmark.plans.quarantine import Rule, in_range, judged, not_after, present, quarantined
from fieldmark.sources import jdbc
from fieldmark.sources.files import csv_or_torn
from pyspark.sql import functions as F

DAY = dt.date(2024, 1, 1)
GAMES = "game_id long, league long, game_date date, home long, away long, home_score long, away_score long"


def games(n, leagues=2, teams=5, step=11):
    return [(i, i % leagues, DAY + dt.timedelta(i * step), i % teams, (i + 1 + i % (teams - 1)) % teams, i % 7, i % 4) for i in range(n) if i % teams != (i + 1 + i % (teams - 1)) % teams]


def test_versions_of_three_runs_are_those_of_one(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k % 3, k, DAY + dt.timedelta(d), rng.choice("pq"), rng.choice([1, 2])) for k in range(12) for d in range(30) if rng.random() < 0.5]
    schema = "part int, k int, valid_from date, name string, games int"
    df = spark.createDataFrame(rows, schema)
    want = {tuple(r) for r in close_versions(df, ["part", "k"], "valid_from", F.col("name"), F.col("games")).select("part", "k", "valid_from", "name", "games", "valid_to").collect()}
    table = VersionTable(spark, str(tmp_path / "v"), ["part"], ["k"], ["name", "games"])
    for low, high in ((0, 10), (10, 11), (11, 30)):
        table.merge(df.where(F.col("valid_from").between(DAY + dt.timedelta(low), DAY + dt.timedelta(high - 1))))
    assert {tuple(r) for r in table.rows().select("part", "k", "valid_from", "name", "games", "valid_to").collect()} == want
    before = {p: os.stat(tmp_path / "v" / p).st_mtime_ns for p in os.listdir(tmp_path / "v") if p.startswith("part=")}
    again = VersionTable(spark, str(tmp_path / "v"), ["part"], ["k"], ["name", "games"])  # as a later process finds it
    last = {r.k: r for r in df.collect()} and df.groupBy("part", "k").agg(F.max_by(F.struct("name", "games"), "valid_from").alias("r")).select("part", "k", F.lit(DAY + dt.timedelta(90)).alias("valid_from"), "r.*")
    assert again.merge(last) == 0  # nothing differs: nothing is written
    assert again.merge(last.where("k = 4").withColumn("name", F.lit("z"))) == 1
    after = {p: os.stat(tmp_path / "v" / p).st_mtime_ns for p in os.listdir(tmp_path / "v") if p.startswith("part=")}
    assert {p for p in after if after[p] != before[p]} == {"part=1"}
    assert again.rows().where("k = 4 and valid_to is null").count() == 1


def test_seasons_go_on_from_stored_ratings(spark, tmp_path):
    spec = RatingSpec(novice=3, carry=0.8, half_life=200)
    rows = games(150)
    df, at = spark.createDataFrame(rows, GAMES), str(tmp_path / "s")
    want = {r.game_id: tuple(r) for r in ordered_fold(df, spec).collect()}
    out = replay(df, spec, at)
    told = out.where("kind = 1").select(*ordered_fold(df, spec).columns)
    assert {r.game_id: tuple(r) for r in told.collect()} == want
    fin = {(r.league, r.team): r.rating for r in final_ratings(ordered_fold(df, spec)).collect()}
    assert {(r.league, r.team): r.rating for r in out.where("kind = 0 and team is not null").collect()} == fin
    made = {d: os.stat(tmp_path / "s" / d).st_mtime_ns for d in os.listdir(tmp_path / "s")}
    assert len(made) == len({r[2].year for r in rows})
    more = spark.createDataFrame([*rows, (999, 0, rows[-1][2] + dt.timedelta(1), 0, 1, 3, 0)], GAMES)
    replay(more, spec, at)
    new = {d: os.stat(tmp_path / "s" / d).st_mtime_ns for d in os.listdir(tmp_path / "s")}
    assert all(new[d] == made[d] for d in made) and len(new) == len(made) + 1  # only the last season is rated anew


def test_caps_of_day_sport_and_event_hold_at_once(spark):
    rng = random.Random(6)
    bets = [(i, DAY + dt.timedelta(i % 4), rng.choice("AB"), rng.randrange(4), rng.choice([0.0, 0.1, 0.2, 0.3]), rng.random()) for i in range(80)]
    have = Limits(day=100, sport=70, event=52)
    got = allocate_kelly(spark.createDataFrame(bets, "bet_id long, day date, sport string, event long, kelly double, value double"), have).orderBy("day", "place").collect()
    assert len(got) == 80
    for day in {r.day for r in got}:
        mine = [r for r in got if r.day == day]
        seats = [max((r for r in mine if r.sport == s), key=lambda r: r.value).bet_id for s in {r.sport for r in mine}]
        assert {r.bet_id for r in mine[: len(seats)]} == set(seats)
        total, sports, events, over = 0.0, {}, {}, False
        for r in mine:
            ask = r.asked
            if over:
                assert (r.approved, r.reason) == (0.0, "not_considered")
                continue
            if sports.get(r.sport, 0) + ask > have.sport:
                assert r.reason == "concentration_breach"
            elif events.get(r.event, 0) + ask > have.event:
                assert r.reason == "event_breach"
            elif total + ask > have.day and have.day - total < have.least:
                assert r.reason == "remaining_budget_breach"
                over = True
            else:
                assert r.approved == min(ask, have.day - total) and (r.reason is None) == (r.approved == ask)
                total += r.approved
                sports[r.sport] = sports.get(r.sport, 0) + r.approved
                events[r.event] = events.get(r.event, 0) + r.approved
                over = total >= have.day
            assert r.approved == 0 or r.reason in (None, "remaining_budget_downgrade")
    assert {r.reason for r in got} >= {None, "concentration_breach", "event_breach", "not_considered"}


def test_kelly_of_no_edge_is_none(spark):
    df = spark.createDataFrame([(0.4, 0.5), (0.6, 0.5), (0.6, 1.0)], "p double, m double").select(odds.kelly(F.col("p"), F.col("m")).alias("k"))
    assert [round(r.k, 6) for r in df.collect()] == [0.0, 0.2, 0.0]


def test_common_opponents_by_loops(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        a, b = rng.sample(range(6), 2)
        rows.append((i, i % 2, DAY + dt.timedelta(i // 5), a, b, float(rng.random() < 0.5)))
    got = {(r.game_id, r.team): (round(r.edge, 9), r.shared) for r in common_opponents(spark.createDataFrame(rows, "game_id long, league long, game_date date, home long, away long, won double")).collect()}
    want = {}
    for g, lg, day, a, b, _ in rows:
        def record(x, lg=lg, day=day):
            out = {}
            for _, l2, d2, h, w, won in rows:
                if l2 == lg and d2 < day and x in (h, w):
                    other, y = (w, won) if h == x else (h, 1 - won)
                    n, s = out.get(other, (0, 0.0))
                    out[other] = (n + 1, s + y)
            return out
        x, y = record(a), record(b)
        if both := x.keys() & y.keys():
            n = {o: min(x[o][0], y[o][0]) for o in both}
            edge = sum(n[o] * (x[o][1] / x[o][0] - y[o][1] / y[o][0]) for o in both) / sum(n.values())
            want[g, a], want[g, b] = (round(edge, 9), len(both)), (round(-edge, 9), len(both))
    assert {k: (v[0] + 0.0, v[1]) for k, v in got.items()} == {k: (v[0] + 0.0, v[1]) for k, v in want.items()}


def test_duplicates_by_base_market_and_by_window(spark):
    rows = [
        (1, "S", "m", "home", DAY, "KX-1-HOME"), (2, "S", "n", "home", DAY + dt.timedelta(50), "KX-1-AB"), (3, "S", "n", "away", DAY + dt.timedelta(60), "KX-2-AWAY"),
        (4, "S", "n", "away", DAY + dt.timedelta(63), None), (5, "S", "n", "away", DAY + dt.timedelta(67), "KX-3-abc"), (6, "T", "n", "away", DAY + dt.timedelta(67), "KX-1-HOME"), (7, "S", "m", "home", DAY, None),
    ]
    df = spark.createDataFrame(rows, "bet_id int, sport string, market string, side string, placed_date date, ticker string")
    assert {r.bet_id for r in duplicates(df).collect()} == {2, 4, 7}


def test_good_and_rejected_rows_are_all_rows(spark, tmp_path):
    lines = ["1,5,2024-01-01,x", "2,50,2024-01-02,x", ",5,2024-01-03,x", "4,5,2030-01-01,y", "5,-1,2024-01-05,", "torn", "7,8,not a day,x", "8,2,2024-01-08,x"]
    (tmp_path / "in.csv").write_text("\n".join(lines))
    rows, torn = csv_or_torn(spark, str(tmp_path / "in.csv"), "id int, n int, day date, tag string")
    assert {r.line for r in torn.collect()} == {"torn", "7,8,not a day,x"}
    rules = [*present("id"), in_range("n", 0, 10), not_after("day", F.lit(dt.date(2025, 1, 1))), Rule("tag_missing", F.col("tag").isNotNull(), "warning")]
    good, rejected, seen = quarantined(rows, rules)
    assert seen == {"rows": 6, "good": 2, "rejected": 4, "warned": 0}
    assert {r.id for r in good.collect()} == {1, 8}
    assert {(r.id, tuple(r.codes), r.severity) for r in rejected.collect()} == {(2, ("n_range",), "error"), (None, ("id_missing",), "error"), (4, ("day_future",), "error"), (5, ("n_range", "tag_missing"), "error")}
    assert [r.severity for r in judged(spark.createDataFrame([(1, 2, DAY, None)], rows.schema), rules).collect()] == ["warning"]


def test_the_database_filters_and_an_upsert_is_one_merge(spark):
    url = jdbc.embedded(spark)
    jdbc.execute(spark, url, 'CREATE TABLE "t" ("k" BIGINT NOT NULL PRIMARY KEY, "v" VARCHAR(10), "own" BIGINT)')
    jdbc.write_table(spark.range(20).selectExpr("id k", "'old' v", "id own"), url, "t", "append")
    some = jdbc.read_table(spark, url, "t", "k", (0, 20), 4).where("v = 'old' and k >= 15").select("k")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(v,old)" in plan and "GreaterThanOrEqual(k,15)" in plan and "PushedFilters" in plan
    assert some.rdd.getNumPartitions() == 4 and {r.k for r in some.collect()} == set(range(15, 20))
    assert jdbc.upsert_table(spark.range(18, 23).selectExpr("id k", "'it''s' v"), url, "t", ["k"]) == 5
    got = {r.k: (r.v, r.own) for r in jdbc.read_table(spark, url, "t").collect()}
    assert len(got) == 23 and got[18] == ("it's", 18) and got[22] == ("it's", None) and got[0] == ("old", 0)


def test_one_exchange_takes_all_feature_tables(spark):
    g = spark.createDataFrame(games(40), GAMES).withColumns({"home_starter": F.col("home") * 5, "away_starter": F.lit(None).cast("long")})
    scored = ordered_fold(g, RatingSpec())
    loads = spark.createDataFrame([(0, 1, DAY, 22, 1.0, 4.0)], "league long, team long, day date, pitches long, drop double, runs double")
    sides = side_features(g, rated_sides(scored), rated_sides(scored, lambda who: who), loads)
    plan = sides._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Union")]
    assert top.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in top and "BroadcastHashJoin" not in top
    first = {(r.game_id, r.is_home): r for r in sides.collect()}
    assert len(first) == 2 * len(games(40)) and first[0, True].rating == 1500.0 and first[0, True].games == 0 and first[0, True].rest is None


def test_records_before_by_loops(spark):
    """Games without a winner, several of a pair on a day, some without a day."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        a, b = rng.sample(range(5), 2)
        x, y = rng.choice([(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)])
        rows.append((i % 2, None if i % 17 == 0 else DAY + dt.timedelta(i // 12), a, b, x, y))
    df = spark.createDataFrame(rows, "league long, game_date date, home long, away long, home_won double, away_won double")
    got = {(r.league, r.game_date, r.team, r.opponent): (r.wins, r.met, None if r.edge is None else round(r.edge, 9) + 0.0, r.shared) for r in records_before(df.repartition(3)).collect()}
    sides = [(lg, d, *s) for lg, d, h, w, x, y in rows if d for s in ((h, w, x), (w, h, y))]
    want = {}
    for lg, d, team, opponent, _ in sides:
        won = lambda who, other, lg=lg, d=d: [w for l2, d2, t, o, w in sides if l2 == lg and d2 < d and t == who and o == other]
        own = won(team, opponent)
        pairs = [(len(p), sum(p), len(q), sum(q)) for o in range(5) if (p := won(team, o)) and (q := won(opponent, o))]
        weight = sum(min(m, n) for m, _, n, _ in pairs)
        want[lg, d, team, opponent] = (sum(own), len(own), round(sum(min(m, n) * (v / m - w / n) for m, v, n, w in pairs) / weight, 9) + 0.0 if pairs else None, len(pairs))
    assert got == want


def test_feature_tables_are_a_row_a_day_before_they_are_sorted(spark):
    """Two appearances, two games of a day: the sums and the last rating of the day, and no more rows than days in the sorts."""
    g = spark.createDataFrame(games(40), GAMES).withColumns({"home_starter": F.col("home") * 5, "away_starter": F.lit(None).cast("long")})
    scored = ordered_fold(g, RatingSpec())
    team, day = scored.selectExpr("home", "game_date").orderBy("game_id").first()
    loads = spark.createDataFrame([(lg, team, day - dt.timedelta(ago), n, 1.0, runs) for lg in range(4) for ago, n, runs in ((1, 16, 4.0), (1, 22, None), (4, 30, 7.0), (40, 50, 9.0))], "league long, team long, day date, pitches long, drop double, runs double")
    sides = side_features(g, rated_sides(scored), rated_sides(scored, lambda who: who), loads)
    plan = sides._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Union") :].count("Aggregate") == 3 and "RepartitionByExpression [league" in plan[: plan.index("Union")]
    first = min((r for r in sides.join(g.where(F.col("home") == team), "game_id").collect() if r.is_home and r.game_date == day), key=lambda r: r.game_id)
    assert (first.pitches3, first.pitches5, first.over15, first.over20, first.bullpen) == (38, 68, 3, 2, 5.5)
    assert round(first.penalty, 9) == -round(3 * 0.05 + 2 * 0.10 + 3 * 0.05, 9)
