"""Records of players against opponents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEETINGS = "league bigint, game_date date, a bigint, b bigint, wins_a double, wins_b double, met bigint, edge double, shared bigint"


def records_before(games: DataFrame) -> DataFrame:
    """league, game_date, team, opponent, wins, met, edge, shared: a row a side, opponent and day on which they meet.

    games: league, game_date, home, away, home_won, away_won (1.0 or 0.0).
    ``wins`` and ``met`` count the side's earlier days against this opponent;
    ``edge`` is how much better it did than the other against the ``shared``
    opponents that both had met, null if there are none.  Of each of those the
    difference of the two win rates counts as often as the side that met it
    less did.

    All games of a pair on a day see the same records, so they are summed up
    first: the fold costs a step a pair and day, however many games that is.  A
    league streams past in order of days with its sides' records as state, a
    dictionary of opponents each; a pair intersects two of them before anything
    is looked up, so what it costs are the opponents of the side that has met
    fewer.  Rows without a day are left out.
    """

    def run(batches):
        league = day = None
        records: dict = {}
        waiting: list = []

        def settle():
            for a, b, won, lost, n in waiting:
                for x, y, w in ((a, b, won), (b, a, lost)):
                    wins, met = records.setdefault(x, {}).get(y, (0.0, 0))
                    records[x][y] = (wins + w, met + n)
            waiting.clear()

        for batch in batches:
            out = []
            for lg, date, a, b, won, lost, n in zip(*(batch.column(c).to_pylist() for c in ("league", "game_date", "a", "b", "wins_a", "wins_b", "n")), strict=True):
                if lg != league:
                    league, day, records = lg, date, {}
                    waiting.clear()
                elif date != day:
                    settle()
                    day = date
                mine, theirs = records.get(a, {}), records.get(b, {})
                wins, met = mine.get(b, (0.0, 0))
                both = mine.keys() & theirs.keys()
                edge = None
                if both:
                    total = weight = 0.0
                    for o in both:
                        (w1, m1), (w2, m2) = mine[o], theirs[o]
                        k = min(m1, m2)
                        total += k * (w1 / m1 - w2 / m2)
                        weight += k
                    edge = total / weight
                out.append((lg, date, a, b, wins, theirs.get(a, (0.0, 0))[0], met, edge, len(both)))
                waiting.append((a, b, won, lost, n))
            types = (pa.int64(), pa.date32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[c.split()[0] for c in MEETINGS.split(", ")])

    first = F.col("home") < F.col("away")
    won = lambda one, other: F.coalesce(F.sum(F.when(first, F.col(one)).otherwise(F.col(other))), F.lit(0.0))
    days = games.where("game_date is not null and home <> away").groupBy("league", "game_date", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"))
    days = days.agg(won("home_won", "away_won").alias("wins_a"), won("away_won", "home_won").alias("wins_b"), F.count("*").alias("n"))
    pairs = days.repartition("league").sortWithinPartitions("league", "game_date").mapInArrow(run, MEETINGS)
    side = lambda me, other, sign: F.struct(F.col(me).alias("team"), F.col(other).alias("opponent"), F.col(f"wins_{me}").alias("wins"), "met", (sign * F.col("edge")).alias("edge"), "shared")
    return pairs.select("league", "game_date", F.explode(F.array(side("a", "b", 1), side("b", "a", -1))).alias("s")).select("league", "game_date", "s.*")


def common_opponents(games: DataFrame) -> DataFrame:
    """game_id, team, edge, shared (see ``records_before``), two rows a game; sides that share no opponent have none.

    games: game_id, league, game_date, home, away, won (1.0 if home won).
    """
    side = lambda me, other: F.struct(F.col(me).alias("team"), F.col(other).alias("opponent"))
    sides = games.select("game_id", "league", "game_date", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("game_id", "league", "game_date", "s.*")
    known = records_before(games.withColumns({"home_won": F.col("won"), "away_won": 1.0 - F.col("won")})).where("shared > 0")
    return sides.join(known, ["league", "game_date", "team", "opponent"]).select("game_id", "team", "edge", "shared")
