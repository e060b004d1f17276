"""Exact dedup with a heavy-hitter split, with DataFrame functions only.

A text's digest is the sha256 of the text with A-Z lower-cased.  Misra-Gries
counters (Spark's frequent-items sketch, which lowers all counters together
when its table is full) find the digests that may hold ``share`` of all rows:
a sketch a task, merged within ``shards`` groups of tasks and then once more.
The sketch misses no digest above ``share``; what it names is verified by exact
counts.  The verified digests, at most 1 / share, are broadcast with their
winners, so their rows are settled where they are read.  All other digests,
each with less than ``share`` of the rows, go through an ordinary shuffle.

Of equal texts the row with the largest doc_id stays; of rows that share that
id too, one (the last by place in the table as first read).  A null text is an
empty one.  A null doc_id is below all others, so such a row stays only where
all ids of its group are null, and keep_id is null then.  Texts are taken whole.
An empty table gives an empty result.  Other columns, whatever their names, are
kept by ``deduplicated`` and not read otherwise.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, fresh, materialise

#: Share of all rows from which on a digest is heavy.
SHARE = 0.001
#: Groups of tasks whose sketches are merged side by side.
SHARDS = 64


def digest_of(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.sha2(plain, 256)


def counters(share: float) -> int:
    """How many counters leave no digest of ``share`` out: the sketch errs by at most 3.5 / (4/3 counters) of the rows, and names what is above twice that."""
    return int(-(-5.25 // share))


def candidates(rows: DataFrame, share: float, shards: int = SHARDS) -> DataFrame:
    """digest: all that hold ``share`` of the rows or more, and perhaps a few others."""
    n = counters(share)
    each = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(shards)).alias("shard")).agg(F.expr(f"approx_top_k_accumulate(digest, {n})").alias("sketch"))
    # by a key that all share, as a task without rows would bring an empty sketch to a total over all
    top = each.groupBy(F.col("shard").isNotNull()).agg(F.expr(f"approx_top_k_combine(sketch, {n})").alias("sketch"))
    return top.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {n})")).alias("top")).select(F.col("top.item").alias("digest"))


def winners(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """digest, n, best (doc_id, row) of each heavy digest, verified: at most 1 / share stored rows."""
    total = rows.count()
    if not total:
        return rows.select("digest", F.lit(0).cast("long").alias("n"), F.struct("doc_id", "row").alias("best")).limit(0)
    met = rows.join(F.broadcast(candidates(rows, share)), "digest").groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("best"))
    return materialise(met.where(F.col("n") >= share * total), "heavy-digests")


def grouped(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """rows (doc_id, digest, row), stored and with row unique -> the same with n, the size of the group, and best, its row that stays."""
    heavy = winners(rows, share)
    here = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    w = Window.partitionBy("digest")
    rest = rest.withColumns({"n": F.count("*").over(w), "best": F.max(F.struct("doc_id", "row")).over(w)})
    return here.unionByName(rest)


def addressed(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a number for each row, stored, so that texts are read once."""
    return materialise(docs.select("doc_id", digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


def deduplicated(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of docs that stay, with all their columns: heavy copies go where they are read, texts of all others move once."""
    names = docs.columns
    digest, row, best, place = (fresh(n, names) for n in ("_digest", "_row", "_best", "_place"))
    held = materialise(docs.withColumn(digest, digest_of(F.col("text"))).withColumn(row, F.monotonically_increasing_id()), "exact-rows")
    heavy = winners(held.select("doc_id", F.col(digest).alias("digest"), F.col(row).alias("row")), share)
    heavy = heavy.select(F.col("digest").alias(digest), F.col("best.row").alias(best))
    stay = held.join(F.broadcast(heavy), digest).where(F.col(row) == F.col(best)).select(*names)
    rest = held.join(F.broadcast(heavy.select(digest)), digest, "left_anti")
    first = Window.partitionBy(digest).orderBy(F.col("doc_id").desc_nulls_last(), F.col(row).desc())
    return stay.unionByName(rest.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*names))


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = grouped(addressed(documents(spark, sf_dir)))
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"))


OP11_SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)"""
