"""Structured Streaming jobs; each runs to the end of what is there (availableNow) and equals its batch twin.

One run takes all files that are there as one batch, so their order and number
don't matter.  With a named ``path`` a job goes on from its checkpoint: the next
run takes new files only, and what its results rest on is in the state store
and in files named by batch, so a batch that is run again overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ratings import SCORED, STORED, RatingSpec, fold_from
from ..sources.shared import shared_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as a stream, its time cast once."""
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def run_now(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """All rows that the stream has appended once all there is has been read."""
    spark = stream.sparkSession
    out = path or shared_path(spark, label)
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def epochs(spark: SparkSession, path: str, prefix: str = "epoch=") -> list[int]:
    """The numbers of the folders prefix<number> below path whose write is complete."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    done = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith(prefix)]
    return sorted(int(d.getName()[len(prefix) :]) for d in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def latest_updates(stream: DataFrame, keys: list[str], label: str, path: str | None = None, seen: list | None = None) -> DataFrame:
    """An aggregated stream's newest row of each key: every batch writes the keys that it changed.

    When the run ends, its batches' files and the table of the run before are
    folded into one table, and then go; a run that fails before that leaves
    them, and the next one folds them.  seen: gets the progress of each batch.
    """
    spark = stream.sparkSession
    out = path or shared_path(spark, label)
    rest = [c for c in stream.columns if c not in keys]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, epoch bigint"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if seen is not None:
        seen += query.recentProgress
    told, known = epochs(spark, f"{out}/rows"), epochs(spark, f"{out}/folded")
    base = known[-1] if known else -1
    if new := [e for e in told if e > base]:
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[f"{out}/rows/epoch={e}" for e in new])
        if known:
            rows = rows.unionByName(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/folded/epoch={base}"))
        folded = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r"), F.max("epoch").alias("epoch")).select(*keys, "r.*", "epoch")
        folded.write.mode("overwrite").parquet(f"{out}/folded/epoch={new[-1]}")
        base = new[-1]
    for e in told:
        if e <= base:
            drop_folder(spark, f"{out}/rows/epoch={e}")
    for e in known:
        if e < base:
            drop_folder(spark, f"{out}/folded/epoch={e}")
    if base < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/folded/epoch={base}").select(*stream.columns)


def keep_latest(stream: DataFrame, keys: list[str], at: str, label: str, path: str | None = None) -> DataFrame:
    """The newest row of each key (of rows of one time that with the greatest values); rows older than what is held change nothing."""
    rest = [c for c in stream.columns if c not in keys]
    newest = stream.groupBy(*keys).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("r"))
    return latest_updates(newest.select(*keys, "r.*"), keys, label, path).select(*stream.columns)


def gate(stream: DataFrame, at: str, delay: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(a stream of the rows in time, the table of the rows too late): a row is late if it is older by ``delay`` than the newest of the batches before its own.

    A watermark of ``delay`` further on never drops a row of the first, so what
    it would drop is here, in the second.  Each batch writes its own folders and
    the newest time so far; a batch that is run again overwrites them.
    """
    spark, schema = stream.sparkSession, stream.schema

    def split(batch: DataFrame, epoch: int) -> None:
        before = [e for e in epochs(spark, f"{path}/marks") if e < epoch]
        mark = spark.read.schema("mark timestamp").parquet(f"{path}/marks/epoch={before[-1]}").first()["mark"] if before else None
        late = F.coalesce(F.col(at) < F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/intime/epoch={epoch}")
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        batch.agg(F.greatest(F.max(at), F.lit(mark).cast("timestamp")).alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/epoch={epoch}")

    stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{path}/gate").trigger(availableNow=True).start().awaitTermination()
    late = spark.read.schema(schema).option("recursiveFileLookup", True)
    return spark.readStream.schema(schema).parquet(f"{path}/intime/epoch=*").withWatermark(at, delay), late.parquet(f"{path}/late") if epochs(spark, f"{path}/late") else spark.createDataFrame([], schema)


def hourly(stream: DataFrame, at: str, value: str, delay: str, label: str, path: str | None = None, seen: list | None = None) -> DataFrame:
    """hour, value (the newest of the hour), n: hours leave the state ``delay`` after they end; rows that come later still are folded in from the gate's table."""
    out = path or shared_path(stream.sparkSession, label)
    intime, late = gate(stream.select(at, value), at, delay, out)
    newest = F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("value"))).alias("last")
    open_hours = intime.groupBy(F.window(at, "1 hour").alias("w")).agg(newest, F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "last", "n")
    told = latest_updates(open_hours, ["hour"], label, f"{out}/hours", seen)
    more = late.groupBy(F.date_trunc("hour", at).alias("hour")).agg(newest, F.count("*").alias("n"))
    return told.unionByName(more).groupBy("hour").agg(F.max("last").alias("last"), F.sum("n").alias("n")).select("hour", F.col("last.value").alias("value"), "n")


def first_deliveries(stream: DataFrame, keys: list[str], at: str, delay: str, label: str, path: str | None = None) -> DataFrame:
    """One row of each key, whose deliveries all bear the same time ``at``: known keys leave the state ``delay`` later; of those that come later still, the unknown are added from the gate's table."""
    out = path or shared_path(stream.sparkSession, label)
    intime, late = gate(stream, at, delay, out)
    kept = run_now(intime.dropDuplicatesWithinWatermark(keys), label, f"{out}/kept")
    return kept.unionByName(late.dropDuplicates(keys).join(kept.select(*keys), keys, "left_anti").select(*kept.columns))


def rated_stream(games: DataFrame, spec: RatingSpec, label: str, path: str | None = None) -> DataFrame:
    """The Elo fold over a stream of games, with every game rated as it comes (late ones: null, see ``replayed``).

    A league's games have to be taken in order, which a stateful operator would
    have to gather and sort in memory; here a batch is sorted by Spark and
    streams past the stored ratings of the batch before: typed rows, a row a
    team.  Each batch writes its games and ratings in one go, so one that is
    run again starts from the same ratings.  Bound a batch by the source
    (maxFilesPerTrigger), and no task holds more than a batch of rows.
    """
    spark = games.sparkSession
    out = path or shared_path(spark, label)

    def write(batch: DataFrame, epoch: int) -> None:
        before = [e for e in epochs(spark, f"{out}/rated") if e < epoch]
        held = spark.read.schema(STORED).parquet(f"{out}/rated/epoch={before[-1]}") if before else None
        fold_from(batch, spec, held).write.mode("overwrite").parquet(f"{out}/rated/epoch={epoch}")

    games.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    done = epochs(spark, f"{out}/rated")
    rows = spark.read.schema(STORED).option("recursiveFileLookup", True).parquet(*[f"{out}/rated/epoch={e}" for e in done]) if done else spark.createDataFrame([], STORED)
    return rows.where("kind = 1").select([c.split()[0] for c in SCORED.split(", ")])
