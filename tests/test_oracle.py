"""Every query with SQL against DuckDB on the smallest tables, and all names in order."""

import decimal
import os

import duckdb
import pytest
from fieldmark import registry

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def test_names():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES and len(registry.QUERIES) > 200


def plain(v):
    if isinstance(v, decimal.Decimal):
        return str(v)
    return 0.0 if isinstance(v, float) and v == 0 else v


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in at] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def test_queries_match_duckdb(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    wrong = []
    for name, sql in registry.ORACLE_SQL.items():
        df = registry.QUERIES[name](spark, SF)
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        got, want = ordered(df.columns, df.collect()), ordered(names, rel.fetchall())
        if sorted(names) != sorted(df.columns) or len(got) != len(want):
            wrong.append(name)
            continue
        for a, b in zip(got, want, strict=True):
            # the last digit of a rounded sum may differ with its order
            if any(x != y and not (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1.1e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)):
                wrong.append(name)
                break
    assert wrong == []
