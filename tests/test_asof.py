"""As-of joins, validity intervals and decayed windows against plain loops."""

import datetime as dt
import random

import pytest
from fieldmark.operators.core import asof_join, decayed_sum
from fieldmark.operators.intervals import valid_at
from pyspark.sql import functions as F

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize("parts", [1, 5])
def test_tiers_nulls_and_ties(spark, parts):
    rng = random.Random(4)
    asks = [(i, rng.choice("ab"), None if i % 9 == 0 else rng.randrange(40)) for i in range(60)] + [(900, "c", 5), (901, "c", None), (902, "d", 3)]
    quotes = [(i, rng.choice("ab"), None if i % 11 == 0 else rng.randrange(40), rng.randrange(3), i % 13 == 0) for i in range(120)] + [(700, "c", None, 1, False), (701, "c", None, 0, False)]
    left = spark.createDataFrame(asks, "ask int, k string, t int").repartition(3)
    right = spark.createDataFrame(quotes, "id int, k string, at int, book int, closing boolean").repartition(3)
    got = asof_join(left, right, ["k"], "t", "at", ["id", "at"], rank=F.col("book"), prefer=[-F.col("id")], untimed=True, tiers=[F.col("closing"), F.lit(True)], ties="ties", parts=parts)
    want = {}
    for ask, k, t in asks:
        pool = [q for q in quotes if q[1] == k and (t is None or q[2] is None or q[2] <= t)]
        best = min(pool, key=lambda q: (not q[4], -(-1 if q[2] is None else q[2]), q[3], q[0]), default=None)
        want[ask] = (best and best[0], best and best[2], best and sum(q[2] == best[2] for q in pool))
    assert {r.ask: (r.id, r.at, r.ties) for r in got.collect()} == want


@pytest.mark.parametrize("parts", [1, 6])
def test_the_newest_version_that_holds(spark, parts):
    rng = random.Random(8)
    versions = []
    for i in range(150):
        start = rng.randrange(100)
        versions.append((i, rng.choice("xyz"), DAY + dt.timedelta(start), None if i % 29 == 0 else DAY + dt.timedelta(start + rng.choice([0, 1, 5, 40, -2])), i * 10))
    versions += [(400, "x", None, None, 1), (401, "x", DAY + dt.timedelta(7), DAY + dt.timedelta(90), None)]
    asks = [(i, rng.choice(["x", "y", "z", "none", None]), None if i % 17 == 0 else DAY + dt.timedelta(rng.randrange(-5, 130))) for i in range(200)]
    got = valid_at(spark.createDataFrame(asks, "ask int, k string, d date").repartition(3), spark.createDataFrame(versions, "version int, k string, a date, b date, rating int"), ["k"], "d", "a", "b", "version", ["version", "rating"], parts=parts)
    want = {}
    for ask, k, d in asks:
        pool = [v for v in versions if k is not None and v[1] == k and d is not None and v[2] is not None and v[2] <= d and (v[3] is None or v[3] >= d)]
        best = max(pool, key=lambda v: (v[2], v[0]), default=None)
        want[ask] = (best and best[0], best and best[4])
    assert {r.ask: (r.version, r.rating) for r in got.collect()} == want
    assert any(v == (None, None) for v in want.values()) and sum(v[0] is not None for v in want.values()) > 80


@pytest.mark.parametrize("year", [1970, 1995, 2040, 2190])
def test_decay_does_not_overflow(spark, year):
    days = [(1, dt.date(year, 1, 1) + dt.timedelta(d), float(d % 7)) for d in (0, 1, 5, 29, 30, 31, 58, 59, 60, 89, 90, 200)]
    df = spark.createDataFrame(days, "k int, day date, v double")
    total = lambda c: decayed_sum(c, F.unix_date("day"), 30, 7.0, ["k"])
    got = {r.day: r.x for r in df.select("day", F.try_divide(total(F.col("v")), total(F.lit(1.0))).alias("x")).collect()}
    for _, day, _ in days:
        past = [(v, 0.5 ** ((day - d).days / 7)) for _, d, v in days if 1 <= (day - d).days <= 30]
        want = sum(v * w for v, w in past) / sum(w for _, w in past) if past else None
        assert got[day] == pytest.approx(want)


def test_a_decayed_sum_takes_two_window_sums(spark):
    """One of even and one of odd blocks; what an expression mentions twice is worked out twice."""
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1.0)], "k int, day date, v double")
    plan = df.select(decayed_sum(F.col("v"), F.unix_date("day"), 30, 7.0, ["k"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition") == 2
