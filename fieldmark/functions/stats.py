"""Box-score and sabermetric formulas; a zero denominator gives 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def effective_fg(fgm: Column, threes: Column, fga: Column) -> Column:
    return safe(fgm + 0.5 * threes, fga)


def true_shooting(points: Column, fga: Column, fta: Column) -> Column:
    return safe(points, 2 * (fga + 0.44 * fta))


def possessions(fga: Column, oreb: Column, tov: Column, fta: Column) -> Column:
    return fga - oreb + tov + 0.44 * fta


def rating(points: Column, poss: Column) -> Column:
    """Points of a hundred possessions."""
    return F.when(poss > 0, 100 * points / poss).otherwise(0.0)


def pace(poss: Column, minutes: Column) -> Column:
    """Possessions of 48 minutes."""
    return F.when(minutes > 0, 48 * poss / minutes).otherwise(0.0)


def share_or_half(a: Column, b: Column) -> Column:
    """a of a + b; a half of nothing."""
    return F.coalesce(F.try_divide(a * 1.0, a + b), F.lit(0.5))


#: Fixed weights of the run estimators.
WOBA = {"bb": 0.69, "single": 0.88, "double": 1.24, "triple": 1.56, "hr": 2.0}
FIP_CONSTANT = 3.1


def woba(bb: Column, single: Column, double: Column, triple: Column, hr: Column, pa: Column) -> Column:
    w = WOBA
    return safe(w["bb"] * bb + w["single"] * single + w["double"] * double + w["triple"] * triple + w["hr"] * hr, pa)


def fip(hr: Column, bb: Column, so: Column, innings: Column) -> Column:
    return F.when(innings > 0, (13 * hr + 3 * bb - 2 * so) / innings + FIP_CONSTANT).otherwise(0.0)


def wrc_plus(woba: Column, league: float = 0.312) -> Column:
    return woba / league * 100


#: Fixed weights of the skill-interactive estimate: constant, k, k squared, bb, bb squared, k times bb.
SIERA = (6.145, -16.986, 11.434, -1.858, 7.653, -4.005)


def siera(so: Column, bb: Column, faced: Column) -> Column:
    """Null below four batters faced; never below 0."""
    k, b = so / faced, bb / faced
    c = SIERA
    return F.when(faced >= 4, F.greatest(F.lit(0.0), c[0] + c[1] * k + c[2] * k * k + c[3] * b + c[4] * b * b + c[5] * k * b))


def k_bb_pct(so: Column, bb: Column, faced: Column) -> Column:
    return F.when(faced > 0, (so - bb) / faced * 100)


def pythagorean(scored: Column, allowed: Column, power: float = 1.83) -> Column:
    a, b = F.pow(scored, F.lit(power)), F.pow(allowed, F.lit(power))
    return F.coalesce(F.try_divide(a, a + b), F.lit(0.5))


def shrink(rate: Column, n: Column, k: float, prior: float) -> Column:
    return (rate * n + prior * k) / (n + k)


def log5(a: Column, b: Column, league: Column) -> Column:
    x, y = a * b / league, (1 - a) * (1 - b) / (1 - league)
    return x / (x + y)


def matchup(rates: dict[str, tuple[Column, Column, float]], rest: str) -> Column:
    """Struct of outcome probabilities that sum to one: each by log5 of (batter, pitcher, league), ``rest`` what they leave."""
    p = {name: log5(a, b, F.lit(league)) for name, (a, b, league) in rates.items()}
    total = sum(list(p.values())[1:], next(iter(p.values())))
    p[rest] = F.greatest(F.lit(0.0), 1 - total)
    return F.struct(*[(x / (total + p[rest])).alias(name) for name, x in p.items()])


def half_life(age: Column, days: float) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * age / max(1.0, days))


def innings(text: Column) -> Column:
    """"6.2" is six and two thirds."""
    part = F.split(text, r"\.")
    return F.try_element_at(part, F.lit(1)).cast("double") + F.coalesce(F.try_element_at(part, F.lit(2)).cast("double"), F.lit(0.0)) / 3


def ppda(passes: Column, actions: Column) -> Column:
    return safe(passes * 1.0, actions)
