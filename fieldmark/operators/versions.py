"""A table of slowly changing rows that is kept up run by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from .core import close_versions


class VersionTable:
    """Stored versions of rows, each valid from a time until the next (valid_to null: open), at most one open row a key.

    Parquet below ``path``, partitioned by the columns ``parts``, which depend on
    the key.  ``merge`` looks at the open rows of the keys that come, writes the
    partitions with a change anew and leaves all others alone; a run with nothing
    new writes nothing.  Partitions are swapped when all of them are written
    (dynamic overwrite), so a run that fails, or is run again, does no harm.
    """

    def __init__(self, spark: SparkSession, path: str, parts: list[str], keys: list[str], values: list[str], start: str = "valid_from"):
        self.spark, self.path, self.parts, self.keys, self.values, self.start = spark, path, parts, keys, values, start
        self.schema = None

    def rows(self) -> DataFrame | None:
        """All versions; None before the first run."""
        if self.schema is None:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(self.path)
            if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
                return None
            return self.spark.read.parquet(self.path)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def merge(self, candidates: DataFrame) -> int:
        """Takes candidates (parts, keys, start, values; any number of times a key, none older than its open row); the number of versions it opened.

        A candidate that agrees with the row before it in all values is none.
        One that is older than its key's open row, or of the same time, is left out.
        """
        cols = [*self.parts, *self.keys, self.start, *self.values]
        new = candidates.select(*cols)
        held = self.rows()
        if held is None:
            first = close_versions(new, [*self.parts, *self.keys], self.start, *[F.col(c) for c in self.values])
            return self._write(first.select(*cols, "valid_to"))
        keys = [*self.parts, *self.keys]
        now = held.where("valid_to is null").join(new.select(*keys).distinct(), keys, "left_semi").select(*cols, F.lit(True).alias("_old"))
        since = new.join(now.select(*keys, F.col(self.start).alias("_since")), keys, "left").where(F.col("_since").isNull() | (F.col(self.start) > F.col("_since"))).drop("_since")
        versions = close_versions(now.unionByName(since.withColumn("_old", F.lit(False))), keys, self.start, *[F.col(c) for c in self.values])
        # what changes: open rows that end, and rows that are new
        path = shared_path(self.spark, "version-changes")
        versions.where("not _old or valid_to is not null").write.parquet(path)
        changed = self.spark.read.schema(versions.schema).parquet(path)
        touched = held.join(F.broadcast(changed.select(*self.parts).distinct()), self.parts, "left_semi")  # a row a partition
        closed = changed.where("_old").select(*keys, F.col(self.start), F.col("valid_to").alias("_ends"))
        kept = touched.join(closed, [*keys, self.start], "left").withColumn("valid_to", F.coalesce("valid_to", "_ends")).drop("_ends")
        return self._write(kept.select(*cols, "valid_to").unionByName(changed.where("not _old").select(*cols, "valid_to")), changed.where("not _old").count())

    def _write(self, rows: DataFrame, opened: int | None = None) -> int:
        if opened == 0:
            return 0
        rows.repartition(*self.parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts).parquet(self.path)
        self.schema = rows.schema
        return self.rows().count() if opened is None else opened
