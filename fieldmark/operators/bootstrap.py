"""Bootstrap of means by group, with the same draws in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Resamples, and blocks of rows that are drawn together: enough replicates for a bound of 2.5 %, whatever the number of rows.
REPLICATES, BLOCKS = 10_000, 256
#: Cumulative chances of drawing 0, 1, 2 ... times (Poisson with mean 1).
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
_PRIME = 2147483647
_WEIGHT = " + ".join(f"CASE WHEN u >= {c}e0 THEN 1 ELSE 0 END" for c in POISSON)


def bootstrap_sql(rows: str, key: str, digits: int = 6, replicates: int = REPLICATES, blocks: int = BLOCKS) -> str:
    """Relations that end with ``boot``: key, mean, low, high, p_value; rows: a query for key, id and x."""
    return f"""b AS (SELECT {key}, (id * 7919 + 13) % {blocks} AS block, sum(x) AS s, count(*) AS n FROM ({rows}) GROUP BY 1, 2),
h AS (SELECT b.*, rep, (block * 1000003 + rep * 7919 + 17) % {_PRIME} AS h FROM b CROSS JOIN range(1, {replicates + 1}) r(rep)),
h2 AS (SELECT *, ((h * h + 1) % {_PRIME} * 48271 + rep) % {_PRIME} AS k FROM h),
drawn AS (SELECT {key}, rep, s, n, {_WEIGHT} AS w FROM (SELECT *, (k * k + block) % {_PRIME} / {_PRIME}.0e0 AS u FROM h2)),
m AS (SELECT {key}, rep, sum(w * s) / sum(w * n) AS m FROM drawn GROUP BY 1, 2 HAVING sum(w * n) > 0),
boot AS (SELECT {key}, round(avg(m), {digits}) AS mean, round(quantile_cont(m, 0.025), {digits}) AS low, round(quantile_cont(m, 0.975), {digits}) AS high,
  least(1.0e0, 2 * least(avg(CASE WHEN m <= 0 THEN 1.0e0 ELSE 0.0e0 END), avg(CASE WHEN m >= 0 THEN 1.0e0 ELSE 0.0e0 END))) AS p_value FROM m GROUP BY 1)"""


def bootstrap(rows: DataFrame, key: str, digits: int = 6, replicates: int = REPLICATES, blocks: int = BLOCKS) -> DataFrame:
    """key, mean, low, high, p_value of the mean of x; rows: key, id, x.

    Rows fall into ``blocks`` by their id, and each replicate draws every block
    Poisson(1) times; with ids spread evenly a block is a random part of the
    rows, so the spread of the mean is that of drawing rows (its own error is
    some 1 / sqrt(2 blocks), 4 % with 256).  The weights come from arithmetic on
    (block, replicate), so the work beyond one aggregate is the same however
    many rows there are.
    """
    b = rows.groupBy(key, F.expr(f"(id * 7919 + 13) % {blocks}").alias("block")).agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    each = b.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(replicates).cast("bigint"))))
    each = each.withColumn("h", F.expr(f"(block * 1000003 + rep * 7919 + 17) % {_PRIME}")).withColumn("k", F.expr(f"((h * h + 1) % {_PRIME} * 48271 + rep) % {_PRIME}"))
    each = each.withColumn("u", F.expr(f"(k * k + block) % {_PRIME}") / float(_PRIME)).withColumn("w", F.expr(_WEIGHT))
    means = each.groupBy(key, "rep").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m")).where("m is not null")
    share = lambda c: F.avg(c.cast("double"))
    ends = [F.round(F.percentile("m", q), digits).alias(n) for n, q in (("low", 0.025), ("high", 0.975))]  # over the replicates of a key
    return means.groupBy(key).agg(F.round(F.avg("m"), digits).alias("mean"), *ends, F.least(F.lit(1.0), 2 * F.least(share(F.col("m") <= 0), share(F.col("m") >= 0))).alias("p_value"))
