"""Training-data operators: packing, deduplication, scoring, scanning, mixing and media columns.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` are what ``__spark_entry__`` registers.
"""
