"""Prices, probabilities, stakes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def implied(price: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Probability that a decimal price implies; null for no price."""
    return F.when(price > 0, clip(1 / price, low, high))


def from_american(odds: Column) -> Column:
    """American odds as a decimal price."""
    return F.when(odds > 0, 1 + odds / 100).when(odds < 0, 1 + 100 / F.abs(odds))


def cents_to_decimal(cents: Column) -> Column:
    return F.when((cents > 0) & (cents < 100), F.round(100 / cents, 10))


def ask_probability(yes: Column, no: Column) -> Column:
    """The yes ask in cents, or what the no ask leaves."""
    return F.when(yes > 0, yes / 100).when(no > 0, 1 - no / 100)


def expected_value(prob: Column, market: Column) -> Column:
    return F.when((market > 0) & (market < 1), (prob - market) / market).otherwise(0.0)


def kelly(prob: Column, market: Column) -> Column:
    """Share of the bankroll; 0 where the market gives no price or no edge."""
    b = 1 / market - 1
    return F.when((market > 0) & (market < 1), F.greatest(F.lit(0.0), (prob * b - (1 - prob)) / b)).otherwise(0.0)


def blend(model: Column, market: Column, weight: float = 0.7) -> Column:
    return clip(weight * model + (1 - weight) * market, 0.01, 0.99)


def no_vig(*prices: Column) -> Column:
    """Array of probabilities that sum to one; null if a price is missing."""
    raw = [1 / p for p in prices]
    total = sum(raw[1:], raw[0])
    return F.when(total.isNotNull(), F.array(*[r / total for r in raw]))


def expected_score(mine: Column, other: Column, home: float = 0.0) -> Column:
    """Elo win probability of a side that has ``home`` points more."""
    return 1 / (1 + F.pow(F.lit(10.0), (other - mine - home) / 400))


def three_way(home_rating: Column, away_rating: Column, home: float = 60.0, peak: float = 0.28, width: float = 350.0) -> Column:
    """Struct of home, draw and away probabilities: the draw is likeliest between equals."""
    gap = home_rating + home - away_rating
    draw = clip(peak * F.exp(-F.pow(gap / width, 2)), 0.05, 0.35)
    e = expected_score(home_rating, away_rating, home)
    h, a = F.greatest(e - draw / 2, F.lit(0.01)), F.greatest(1 - e - draw / 2, F.lit(0.01))
    total = h + draw + a
    return F.struct((h / total).alias("home"), (draw / total).alias("draw"), (a / total).alias("away"))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(p: Column, alpha: float, beta: float) -> Column:
    return sigmoid(alpha * logit(clip(p, 1e-6, 1 - 1e-6)) + beta)


def confidence(edge: Column, high: float = 0.15, medium: float = 0.08) -> Column:
    return F.when(edge >= high, "HIGH").when(edge >= medium, "MEDIUM").otherwise("LOW")


def edge_bucket(edge: Column) -> Column:
    return F.when(edge < 0.05, "3-5%").when(edge < 0.08, "5-8%").when(edge < 0.15, "8-15%").otherwise("15%+")


def settlement(status: Column, cost: Column, contracts: Column) -> Column:
    """Struct of payout and profit."""
    payout = F.when(status == "won", contracts * 1.0).when(status == "lost", 0.0)
    return F.struct(payout.alias("payout"), (payout - cost).alias("profit"))


def log_loss(y: Column, p: Column, eps: float = 1e-12) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))
