"""Rating recurrences: games of a league in time order, each reading two ratings and writing two.

Leagues (and configurations) are independent, so they are the partitioning
key.  Within a partition rows stream past in order: memory holds one batch and
the ratings of one league, never a league's history.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

SCORED = "game_id long, league long, game_date date, home long, away long, home_before double, away_before double, p_home double, home_after double, away_after double"


@dataclass(frozen=True)
class RatingSpec:
    """One Elo family: what a game's update depends on."""

    k: float = 20.0
    home: float = 100.0  # points for the home side, unless the venue is neutral
    start: float = 1500.0
    margin: bool = False  # scale by the margin of victory
    soft: bool = False  # a draw counts half, and a margin beyond one goal as a logistic of it, clipped at two goals
    recency: float = 0.0  # scale by days since the league's last game
    carry: float | None = None  # part of a rating's distance from the mean that survives a new year
    to_mean: bool = False  # revert towards the league's mean, not the start
    half_life: float = 0.0  # days in which an idle team's distance from the start halves
    novice: int = 0  # a team's first games count half as much again


def expected(mine: float, other: float) -> float:
    return 1 / (1 + 10 ** ((other - mine) / 400))


class EloState:
    """The ratings of one league."""

    def __init__(self, spec: RatingSpec):
        self.spec, self.rating, self.games, self.played, self.last = spec, {}, {}, {}, None

    def _now(self, team: int, date) -> float:
        s, r = self.spec, self.rating.get(team, self.spec.start)
        if s.half_life and team in self.played:
            r = s.start + (r - s.start) * math.exp(-math.log(2) * (date - self.played[team]).days / s.half_life)
        return r

    def _result(self, margin: float) -> float:
        """The home side's score: 1 for a win, else 0; with ``soft`` by the margin."""
        if not self.spec.soft:
            return 1.0 if margin > 0 else 0.0
        if margin in (0, 1):
            return 0.5 if margin == 0 else 1.0
        return 1 / (1 + math.exp(-max(-2.0, min(2.0, margin))))

    def step(self, home: int, away: int, hs: float, as_: float, date, neutral: bool = False) -> tuple[float, float, float, float, float]:
        s = self.spec
        if s.carry is not None and self.last is not None and date.year != self.last.year and self.rating:
            mean = sum(self.rating.values()) / len(self.rating) if s.to_mean else s.start
            self.rating = {t: mean + (r - mean) * s.carry for t, r in self.rating.items()}
        h, a = self._now(home, date), self._now(away, date)
        lifted = h if neutral else h + s.home
        p = expected(lifted, a)
        margin = hs - as_
        scale = 1.0
        if s.margin:  # the gap keeps its sign by home, whoever wins
            scale = math.log(max(abs(margin), 1) + 1) * (2.2 / (0.001 * (lifted - a) + 2.2))
        if s.recency and self.last is not None:
            scale *= max(0.5, min(1.5, 1 + s.recency * ((date - self.last).days / 365)))
        up = [1.5 if self.games.get(t, 0) < s.novice else 1.0 for t in (home, away)]
        delta = s.k * scale * (self._result(margin) - p)
        self.rating[home], self.rating[away] = h + delta * up[0], a - delta * up[1]
        for t in (home, away):
            self.games[t] = self.games.get(t, 0) + 1
            self.played[t] = date
        self.last = date
        return h, a, p, self.rating[home], self.rating[away]


class StarterState(EloState):
    """A ladder of starting pitchers: a game whose starter is unknown (UNKNOWN) changes nothing and tells nothing."""

    UNKNOWN = -1

    def step(self, home: int, away: int, hs: float, as_: float, date, neutral: bool = False) -> tuple[float, float, float, float, float]:
        if self.UNKNOWN in (home, away):
            h, a = self._now(home, date), self._now(away, date)
            return h, a, 0.5, h, a
        return super().step(home, away, hs, as_, date, True)


#: What a fold leaves for the next: kind 1, a rated game; kind 0, a team's rating after the last (team null: the league's last day alone).
STORED = SCORED + ", kind int, team long, rating double, games int, played date, last date"


def fold_from(games: DataFrame, spec: RatingSpec, held: DataFrame | None = None) -> DataFrame:
    """STORED: games rated from where ``held`` (rows of kind 0 of an earlier fold) left off, and what the next fold starts from.

    A league's stored ratings come first, then its games in order; all stream
    past.  A game older than the league's stored last day would change every
    rating since: it comes out with null ratings and changes nothing.
    """
    from pyspark.sql import functions as F

    names = [c.split()[0] for c in STORED.split(", ")]
    own = ["home_score", "away_score", "is_neutral"]
    rows = with_venue(games).select("game_id", "league", "game_date", "home", "away", *own, F.lit(1).alias("kind"))
    rows = rows if held is None else rows.unionByName(held.where("kind = 0").select("league", "kind", "team", "rating", "games", "played", "last"), allowMissingColumns=True)
    if held is None:
        rows = rows.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in STORED.split(", ")[-5:]})
    schema = pa.schema([pa.field(n, {"long": pa.int64(), "double": pa.float64(), "date": pa.date32(), "int": pa.int32()}[t]) for n, t in (c.split() for c in STORED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        league = now = since = None

        def leave() -> list[tuple]:
            if now is None:
                return []
            kept = [(None, league, *[None] * 8, 0, t, r, now.games.get(t), now.played.get(t), now.last) for t, r in now.rating.items()]
            return kept or [(None, league, *[None] * 8, 0, None, None, None, None, now.last)]

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            out = []
            for row in b.to_pylist():
                if now is None or row["league"] != league:
                    out += leave()
                    league, now, since = row["league"], EloState(spec), None
                if row["kind"] == 0:
                    now.last = since = row["last"]
                    if (t := row["team"]) is not None:
                        now.rating[t] = row["rating"]
                        now.games.update({t: row["games"]} if row["games"] is not None else {})
                        now.played.update({t: row["played"]} if row["played"] is not None else {})
                    continue
                game = tuple(row[c] for c in ("game_id", "league", "game_date", "home", "away"))
                late = since is not None and row["game_date"] < since
                step = [None] * 5 if late else now.step(row["home"], row["away"], row["home_score"], row["away_score"], row["game_date"], row["is_neutral"])
                out.append((*game, *step, 1, *[None] * 5))
            yield told(out)
        yield told(leave())

    ordered = rows.repartition("league").sortWithinPartitions("league", "kind", "game_date", "game_id")
    return ordered.mapInArrow(run, STORED).select(*names)


def replay(games: DataFrame, spec: RatingSpec, path: str) -> DataFrame:
    """STORED of all games, season by season (calendar years), each kept below ``path`` under a name made of its games and all before.

    A season starts from the ratings that the one before has stored.  What is
    there already is not rated again: a lost run costs the season it was in, a
    new or changed game its own season and those after it.
    """
    from pyspark.sql import functions as F

    spark = games.sparkSession
    seen = with_venue(games)
    mark = F.sum(F.pmod(F.xxhash64("game_id", "league", "game_date", "home", "away", "home_score", "away_score", "is_neutral"), F.lit(1 << 40)))
    seasons = seen.groupBy(F.year("game_date").alias("season")).agg(F.count("*").alias("n"), mark.alias("mark")).orderBy("season").collect()  # a row a season
    chain, held, parts = "", None, []
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    schema = None
    for s in seasons:
        chain = hashlib.sha256(f"{chain}|{spec}|{s['season']}|{s['n']}|{s['mark']}".encode()).hexdigest()[:16]
        at = f"{path}/season-{s['season']}-{chain}"
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
            rated = fold_from(seen.where(F.year("game_date") == s["season"]), spec, held)
            rated.write.mode("overwrite").parquet(at)
        held = spark.read.schema(STORED).parquet(at)
        parts.append(held.where("kind = 1"))
    if held is None:
        return fold_from(seen, spec)
    out = held.where("kind = 0")
    for x in parts:
        out = out.unionByName(x)
    return out


def replayed(scored: DataFrame, games: DataFrame, spec: RatingSpec) -> DataFrame:
    """scored from a stream, with the leagues that had a late game rated anew from all games."""
    late = scored.where("p_home is null").select("league").distinct()
    scored = scored.select([c.split()[0] for c in SCORED.split(", ")])
    again = ordered_fold(games.join(late, "league", "left_semi"), spec)
    return scored.join(late, "league", "left_anti").select(again.columns).unionByName(again)


class GlickoState:
    """Rating, deviation and volatility of one league's teams, each game a rating period of its own (Glickman's Glicko-2)."""

    SCALE, TAU, START = 173.7178, 0.5, (1500.0, 350.0, 0.06)
    #: How far apart the bracket's ends may be left, and steps at most (of halving alone, which the SQL beside it takes).
    NEAR, HALVINGS = 1e-12, 60

    def __init__(self, home: float = 100.0):
        self.home, self.state = home, {}

    @classmethod
    def volatility(cls, variance: float, gain: float, spread: float) -> float:
        """The new volatility: root of e^x (gain - spread - e^x) / (2 (spread + e^x)^2) = (x - ln variance) / tau^2, with gain the
        squared improvement and spread the squared deviation plus the variance of the outcome.

        The left side lies between -1/2 and gain / (8 spread), so the root is
        bracketed by what the right side can be then, and halving finds it.
        """
        at, stiff = math.log(variance), cls.TAU**2

        def miss(x: float) -> float:
            e = math.exp(x)
            return e * (gain - spread - e) / (2 * (spread + e) * (spread + e)) - (x - at) / stiff

        low, high = at - stiff / 2, at + stiff * gain / (8 * spread)
        below, above = miss(low), miss(high)
        for _ in range(cls.HALVINGS):
            if high - low < cls.NEAR or below == above:
                break
            x = low - below * (high - low) / (above - below)  # where the chord crosses; halving where that is no inner point
            x = x if low < x < high else (low + high) / 2
            y = miss(x)
            if abs(y) < 1e-15:
                low = high = x
            elif y > 0:
                low, below, above = x, y, above / 2  # the other end weighs half, so that both ends move
            else:
                high, above, below = x, y, below / 2
        return math.exp((low + high) / 4)

    @classmethod
    def update(cls, me: tuple[float, float, float], games: list[tuple[float, float, float]]) -> tuple[float, float, float]:
        """me after one rating period; games: (opponent's rating, its deviation, score)."""
        rating, spread = (me[0] - 1500) / cls.SCALE, me[1] / cls.SCALE
        information = surprise = 0.0
        for other, deviation, score in games:
            weight = 1 / math.sqrt(1 + 3 * (deviation / cls.SCALE) ** 2 / math.pi**2)
            chance = 1 / (1 + math.exp(-weight * (rating - (other - 1500) / cls.SCALE)))
            information += weight * weight * chance * (1 - chance)
            surprise += weight * (score - chance)
        variance = 1 / information
        sigma = cls.volatility(me[2] * me[2], (variance * surprise) ** 2, spread * spread + variance)
        tight = 1 / (1 / (spread * spread + sigma * sigma) + information)
        return 1500 + cls.SCALE * (rating + tight * surprise), cls.SCALE * math.sqrt(tight), sigma

    def step(self, home, away, hs, as_, date, neutral=False):
        h, a, lift = self.state.get(home, self.START), self.state.get(away, self.START), 0.0 if neutral else self.home
        both = math.sqrt(h[1] ** 2 + a[1] ** 2) / self.SCALE
        p = 1 / (1 + math.exp(-(h[0] + lift - a[0]) / self.SCALE / math.sqrt(1 + 3 * both**2 / math.pi**2)))
        y = 1.0 if hs > as_ else 0.0
        self.state[home] = self.update(h, [(a[0], a[1], y)])
        self.state[away] = self.update(a, [(h[0] + lift, h[1], 1 - y)])
        return h[0], a[0], p, self.state[home][0], self.state[away][0]


def with_venue(games: DataFrame) -> DataFrame:
    """games with ``is_neutral``, false where it isn't known."""
    from pyspark.sql import functions as F

    neutral = F.coalesce("is_neutral", F.lit(False)) if "is_neutral" in games.columns else F.lit(False)
    return games.withColumn("is_neutral", neutral)


def ordered_fold(games: DataFrame, state, keys: tuple[str, ...] = ("league",)) -> DataFrame:
    """SCORED for each game (and keys beyond league): prediction before the game, ratings after it.

    state: a spec, or a function of the key values that gives a fresh state.
    """
    make = (lambda *_: EloState(state)) if isinstance(state, RatingSpec) else state
    more = [k for k in keys if k != "league"]
    schema = SCORED + "".join(f", {k} {games.schema[k].dataType.simpleString()}" for k in more)
    cols = ["game_id", "league", "game_date", "home", "away", "home_score", "away_score", "is_neutral", *more]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = now = None
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                here = tuple(getattr(row, k) for k in keys)
                if here != key:
                    key, now = here, make(*here)
                told = now.step(row.home, row.away, row.home_score, row.away_score, row.game_date, row.is_neutral)
                out.append((row.game_id, row.league, row.game_date, row.home, row.away, *told, *(getattr(row, k) for k in more)))
            yield pd.DataFrame(out, columns=[*(c.split()[0] for c in SCORED.split(", ")), *more])

    ordered = with_venue(games).select(*cols).repartition(*keys).sortWithinPartitions(*keys, "game_date", "game_id")
    return ordered.mapInPandas(run, schema)


def final_ratings(scored: DataFrame) -> DataFrame:
    """league, team, rating after a team's last game."""
    from pyspark.sql import functions as F

    sides = F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("home_after").alias("r")), F.struct(F.col("away").alias("team"), F.col("away_after").alias("r"))))
    s = scored.select("league", "game_date", "game_id", sides.alias("s")).select("league", "game_date", "game_id", "s.*")
    return s.groupBy("league", "team").agg(F.max_by("r", F.struct("game_date", "game_id")).alias("rating"), F.count("*").alias("games"))
