"""Named queries of the engine: name -> callable, and name -> DuckDB SQL."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES, load

FLAGSHIP = "op_clv"

load()
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
