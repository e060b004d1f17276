"""The driver's tables, and domain tables that are projections of them.

Each domain table is one SELECT that both Spark and DuckDB run; ``{name}``
stands for a base table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

DOMAIN = {
    "bets": """
SELECT o.o_orderkey AS bet_id, r.r_name AS sport, o.o_custkey % 400 AS market,
  CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' WHEN o.o_orderpriority = '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE o.o_orderstatus WHEN 'F' THEN 'won' WHEN 'P' THEN 'lost' ELSE 'open' END AS status,
  CAST(o.o_orderdate AS DATE) AS placed_date, o.o_totalprice AS cost,
  CASE WHEN o.o_orderkey % 2 = 0 THEN 'home' ELSE 'away' END AS side,
  CAST((o.o_orderkey * 37 + 11) % 1000 AS DOUBLE) / 1000 AS elo_prob,
  CAST((o.o_orderkey * 53 + 17) % 960 + 20 AS DOUBLE) / 1000 AS market_prob,
  CASE o.o_orderstatus WHEN 'F' THEN o.o_totalprice * 0.8 WHEN 'P' THEN -o.o_totalprice ELSE CAST(NULL AS DOUBLE) END AS profit,
  CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(NULL AS DOUBLE) WHEN o.o_orderkey % 7 = 0 THEN 1.0e0 ELSE CAST((o.o_orderkey * 71 + 5) % 900 + 50 AS DOUBLE) / 1000 END AS closing_prob,
  CAST((o.o_orderkey * 17) % 15 AS DOUBLE) AS hours_before
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "quotes": """
SELECT event_id AS quote_id, user_id AS market, event_type AS bookmaker, 1.01e0 + value / 100 AS price, ts AS observed_at FROM {events}""",
    "wagers": """
SELECT event_id AS wager_id, user_id AS market, event_type AS kind, value AS stake, ts AS placed_at, ts + INTERVAL '6' HOUR AS close_at,
  CAST((event_id * 31 + 7) % 900 + 50 AS DOUBLE) / 1000 AS bet_prob
FROM {events} WHERE event_type = 'purchase'""",
    "games": """
SELECT o_orderkey AS game_id, o_custkey % 16 AS league, o_custkey % 30 AS home, (o_custkey * 7 + o_orderkey) % 30 AS away,
  CAST(o_orderdate AS DATE) AS game_date, 60 + (o_orderkey * 13) % 50 AS home_score, 60 + (o_orderkey * 29 + 7) % 50 AS away_score,
  CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'P' THEN 'postponed' ELSE 'scheduled' END AS status, o_orderkey % 23 = 0 AS is_neutral
FROM {orders} WHERE o_custkey % 30 <> (o_custkey * 7 + o_orderkey) % 30""",
    "pitches": """
SELECT l_suppkey AS pitcher, l_partkey % 50 AS batter, l_returnflag || l_linestatus AS pitch_type, l_quantity AS velocity, l_discount AS location,
  l_linenumber = 1 AS is_whiff, l_linenumber <= 2 AS is_csw, CAST(l_shipdate AS DATE) AS game_date, l_extendedprice AS spin
FROM {lineitem}""",
    "snapshots": """
SELECT date_trunc('hour', ts) AS hour, max(ts) AS last_at, sum(value) AS volume, count(*) AS n FROM {events} GROUP BY 1""",
}


class Tables:
    """Lazy DataFrames over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})

    def domain(self, name: str) -> DataFrame:
        text = DOMAIN[name]
        return self.spark.sql(text, **{b: self.base(b) for b in BASE if "{" + b + "}" in text})

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name in DOMAIN:
            return self.domain(name)
        raise AttributeError(name)



def oracle(sql: str) -> str:
    """sql with the domain tables that it names put before it."""
    import re

    used = [n for n in DOMAIN if re.search(rf"\b{n}\b", sql)]
    views = ", ".join(f"{n} AS ({DOMAIN[n].format(**{b: b for b in BASE})})" for n in used)
    sql = sql.strip()
    if not views:
        return sql
    recursive = sql.upper().startswith("WITH RECURSIVE")
    if sql.upper().startswith("WITH"):
        return ("WITH RECURSIVE " if recursive else "WITH ") + views + ", " + sql[14 if recursive else 4 :].strip()
    return f"WITH {views} {sql}"
