"""Which of several intervals holds at a time."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def valid_at(left: DataFrame, versions: DataFrame, keys: list[str], at: str, start: str, end: str, tie: str, take: list[str], parts: int = 1) -> DataFrame:
    """left with the columns ``take`` of the newest version (latest start, then greatest tie) of its keys with start <= at <= end.

    A null end is open; a version without a start holds at no time, and a row
    without a time or with a null key finds none.  Versions may overlap, lie
    within one another and leave gaps, so the newest start may have ended
    while an older one still holds: both sides go through one exchange and one
    sort, and a sweep keeps the versions that have begun and not yet ended on a
    heap, the newest on top; those that ended go when they come to the top.

    parts: into how many spans of time a key is cut, for keys that may hold a
    large part of all rows; a version goes to all spans that it reaches into.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    none = lambda kind: F.lit(None).cast(kind)
    kind, order = versions.schema[start].dataType, versions.schema[tie].dataType
    a = left.select(*keyed, F.col(at).alias("_t"), F.lit(1).alias("_side"), none(kind).alias("_end"), none(order).alias("_tie"), F.struct(*left.columns).alias("_l"))
    b = versions.where(F.col(start).isNotNull()).select(*keyed, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.col(end).alias("_end"), F.col(tie).alias("_tie"), F.struct(*take).alias("_r"))
    if parts > 1:
        as_time = lambda c: F.col(c).cast("timestamp")
        cuts = F.broadcast(b.agg(F.percentile_approx(as_time("_t"), F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(1000)).alias("_cuts")))  # one row
        span = lambda c: F.size(F.filter(F.coalesce("_cuts", F.array()), lambda x: x < as_time(c)))
        a = a.crossJoin(cuts).withColumn("_span", span("_t")).drop("_cuts")
        upto = F.greatest(span("_t"), F.when(F.col("_end").isNull(), parts - 1).otherwise(span("_end")))
        b = b.crossJoin(cuts).withColumn("_span", F.explode(F.sequence(span("_t"), upto))).drop("_cuts")
        names = [*names, "_span"]
    both = a.unionByName(b, allowMissingColumns=True).repartition(*names).sortWithinPartitions(*names, "_t", "_side")
    schema = T.StructType([T.StructField("_l", a.schema["_l"].dataType), T.StructField("_r", b.schema["_r"].dataType)])

    def sweep(batches):
        heap, now, count = [], None, 0
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in (*names, "_t", "_side", "_end", "_tie", "_r")}
            rows, found = [], []
            for i, key in enumerate(zip(*(col[n] for n in names), strict=True)):
                if key != now:
                    heap, now = [], key
                t = col["_t"][i]
                if not col["_side"][i]:
                    count += 1
                    heapq.heappush(heap, (_Last(t, col["_tie"][i]), count, col["_end"][i], col["_r"][i]))
                    continue
                while heap and heap[0][2] is not None and (t is None or heap[0][2] < t):
                    heapq.heappop(heap)
                rows.append(i)
                found.append(heap[0][3] if heap and t is not None and None not in key else None)
            yield pa.RecordBatch.from_arrays([batch.column("_l").take(pa.array(rows, pa.int64())), pa.array(found, batch.schema.field("_r").type)], names=["_l", "_r"])

    out = both.mapInArrow(sweep, schema)
    return out.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in take])


class _Last:
    """Orders versions with the newest first."""

    __slots__ = ("key",)

    def __init__(self, t, tie):
        self.key = (t, tie is not None, tie)

    def __lt__(self, other: _Last) -> bool:
        return self.key > other.key
