"""What is known of both sides of a game before its day, from several tables in one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START = 1500.0


def tasks(df: DataFrame) -> int:
    """A fixed number of tasks for sorts of wide rows: left to itself Spark joins tasks up to a size of compressed bytes, which is many times that in a sort."""
    return max(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rated_sides(scored: DataFrame, team_of=None) -> DataFrame:
    """league, team, who, day, game_id, rating of both sides of rated games, after each.

    team_of: the team of a rated one; given, ``who`` is the rated one, such as a pitcher.
    """
    side = lambda who, r: F.struct(F.col(who).alias("who"), F.col(r).alias("rating"))
    s = scored.select("league", F.col("game_date").alias("day"), "game_id", F.explode(F.array(side("home", "home_after"), side("away", "away_after"))).alias("s"))
    s = s.select("league", "day", "game_id", "s.*")
    return s.withColumn("team", F.col("who")) if team_of is None else s.withColumn("team", team_of(F.col("who")))


def side_features(games: DataFrame, ratings: DataFrame, starters: DataFrame, loads: DataFrame) -> DataFrame:
    """Two rows a game: game_id, is_home and what its side brings.

    games: game_id, league, game_date, home, away, scores, home_starter, away_starter (null: unknown);
    ratings, starters: ``rated_sides`` of the teams' and of the starters' ladders (who: the starter);
    loads: league, team, day, pitches, drop (of velocity below the usual), runs (allowed, of nine innings): a row a reliever's appearance.

    Ratings, starters and loads are first reduced to a row a day (and starter),
    as nothing of a game's own day counts but its earlier games in the record (by
    id), which are over.  Those rows are tagged and put end to end with the
    games, so that one exchange by team takes all of them; sorts within it give
    each side the last rating of each ladder, sums over days, and its last games.
    Each sort is told only what those after it need, and the last one games alone.
    """
    at = F.unix_date("day").alias("at")
    side = lambda me, other, home: F.struct(F.col(me).alias("team"), F.col(f"{me}_score").alias("scored"), F.col(f"{other}_score").alias("allowed"), F.col(f"{me}_starter").cast("long").alias("starter"), F.lit(home).alias("is_home"))
    played = games.select("game_id", "league", F.unix_date("game_date").alias("at"), F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s")).select("game_id", "league", "at", "s.*")
    over = lambda n: F.count(F.when(F.col("pitches") > n, 1))
    tired = F.when(F.col("pitches") > 15, 0.05).otherwise(0.0) + F.when(F.col("pitches") > 20, 0.10).otherwise(0.0) + F.least(F.lit(0.25), F.greatest(F.lit(0.0), F.coalesce("drop", F.lit(0.0))) * 0.05)
    newest = F.max_by("rating", "game_id")
    tables = [
        played,
        ratings.where("rating is not null").groupBy("league", "team", at).agg(newest.alias("elo")),
        starters.where("who is not null and rating is not null").groupBy("league", "team", at, F.col("who").alias("starter")).agg(newest.alias("ladder")),
        loads.groupBy("league", "team", at).agg(F.sum("pitches").alias("pitches"), over(15).alias("over15"), over(20).alias("over20"), F.sum(tired).alias("tired"), F.sum("runs").alias("runs"), F.count("runs").alias("outings")),
    ]
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.repartition(tasks(games), "league", "team")
    team = Window.partitionBy("league", "team").orderBy("at")
    before = lambda w: w.rangeBetween(Window.unboundedPreceding, -1)
    days = lambda n: team.rangeBetween(-n, -1)
    total = lambda c, n: F.coalesce(F.sum(c).over(days(n)), F.lit(0))
    by_day = {
        "rating": F.coalesce(F.last("elo", ignorenulls=True).over(before(team)), F.lit(START)),
        "pitches3": total("pitches", 3), "pitches5": total("pitches", 5), "over15": total("over15", 5), "over20": total("over20", 5),
        "penalty": -total("tired", 5), "bullpen": F.try_divide(F.sum("runs").over(days(30)), F.sum("outings").over(days(30))),
    }
    own = before(Window.partitionBy("league", "team", "starter").orderBy("at"))
    record = Window.partitionBy("league", "team").orderBy("at", "game_id")
    past = record.rowsBetween(Window.unboundedPreceding, -1)
    by_game = {
        "runs_for": F.sum("scored").over(past), "runs_against": F.sum("allowed").over(past), "games": F.count("game_id").over(past),
        "form": F.avg((F.col("scored") > F.col("allowed")).cast("double")).over(record.rowsBetween(-10, -1)), "rest": F.col("at") - F.lag("at").over(record) - 1,
    }
    key, game = ["league", "team", "at"], ["game_id", "is_home", "scored", "allowed"]
    rows = rows.select(*key, *game, "starter", "ladder", *[c.alias(n) for n, c in by_day.items()]).where("game_id is not null or ladder is not null")
    rows = rows.select(*key, *game, *by_day, F.when(F.col("starter").isNotNull(), F.last("ladder", ignorenulls=True).over(own)).alias("starter_rating")).where("game_id is not null")
    return rows.select("game_id", "is_home", *by_day, "starter_rating", *[c.alias(n) for n, c in by_game.items()])


def both_sides(sides: DataFrame, cols: list[str]) -> DataFrame:
    """A row a game, with home_ and away_ before each of the columns.

    A game's two sides come from different tasks, so they are dealt out by game first: put together where they are, they would only be held there one by one.
    """
    pick = lambda c, home: F.max(F.when(F.col("is_home") == home, F.col(c)))
    return sides.repartition(tasks(sides), "game_id").groupBy("game_id").agg(*[pick(c, home).alias(f"{name}_{c}") for c in cols for name, home in (("home", True), ("away", False))])


def clipped(points: Column, most: float = 50.0) -> Column:
    return F.least(F.greatest(points, F.lit(-most)), F.lit(most))
