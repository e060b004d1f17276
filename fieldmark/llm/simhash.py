"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are computed per text; copies share one, so links are sought
between distinct fingerprints only.  A 64-bit fingerprint is cut into m = 3
segments on a ring.  If two differ in at most t = 2 bits, then some segment i
starts a chain whose running difference after l segments never exceeds
floor(l * t / m), that is 0, 1, 2.  The first two budgets make the index key:
segment i is equal, and as the next differs in at most one bit, one of its two
halves is equal too.  Pairs that meet in a bucket pass the chain test before
the full Hamming check.

A bucket of more than ``BUCKET`` fingerprints is not paired.  Its members go
an exact way of linear size instead: two fingerprints differ in at most two
bits exactly if one and the same value is within one bit of both, so each
member is sent to its 65 values and linked with the smallest member there.

Nulls: a null text has no words and fingerprint zero.  A null doc_id keeps its
row; it never is a component_id unless no other id is reachable.  Repeated rows
stay.  A bit that exactly half the hashes have is 0.  Texts are taken whole,
whatever their length.  An empty table gives an empty result.  Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, materialise, slices
from .components import connected_components

#: Segments as (first bit, width); each next segment is also known by its two halves.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS = 2
#: Buckets up to this size are paired; larger ones go the linear way.
BUCKET = 64


def shingle_hashes(raw: bytes | None, width: int) -> np.ndarray:
    """64-bit hashes of the ``width``-word shingles of a text's UTF-8 bytes, in order, repeats included."""
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    grams = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    h, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([h(join(g), 42) for g in grams], "<u8")


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:  # sums of 255 rows fit a byte
            ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp for each row; one narrow pass over the texts."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([simhash(shingle_hashes(t, width)) for t in texts], pa.int64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _bits(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def index_keys(fp: Column) -> Column:
    """Array of six keys: for each segment on the ring, it and either half of the next one."""
    keys = []
    for i, (first, width) in enumerate(SEGMENTS):
        nxt, wide = SEGMENTS[(i + 1) % len(SEGMENTS)]
        halves = ((nxt, wide // 2), (nxt + wide // 2, wide - wide // 2))
        for j, (at, w) in enumerate(halves):
            tag = F.lit((i * 2 + j) << 40)
            keys.append(tag.bitwiseOR(F.shiftleft(_bits(fp, first, width), 12)).bitwiseOR(_bits(fp, at, w)))
    return F.array(*keys)


def chain_holds(x: Column, y: Column) -> Column:
    """Does some segment start a chain within the proportional budgets?"""
    diff = x.bitwiseXOR(y)
    d = [F.bit_count(_bits(diff, a, w)) for a, w in SEGMENTS]
    m = len(SEGMENTS)
    starts = []
    for i in range(m):
        ok = F.lit(True)
        for n in range(1, m + 1):
            ok = ok & (sum((d[(i + k) % m] for k in range(n)), F.lit(0)) <= n * RADIUS // m)
        starts.append(ok)
    return F.greatest(*starts)


def near_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """fps: distinct fp -> links (a, b) whose closure equals that of all pairs within RADIUS bits."""
    keyed = fps.select("fp", F.explode(index_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(keyed.join(sizes, "key"), "buckets")
    few = met.where(F.col("n") <= bucket).select("key", "fp")
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    x, y = F.col("a"), F.col("b")
    pairs = a.join(b, "key").where("a < b").where(chain_holds(x, y)).where(F.bit_count(x.bitwiseXOR(y)) <= RADIUS).select("a", "b")
    many = met.where(F.col("n") > bucket).select("fp").distinct()
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    near = materialise(many.select("fp", F.explode(ball).alias("value")), "balls")
    hubs = materialise(near.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("value", "b"), "hubs")
    stars = near.join(hubs, "value").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, fp, component_id for each row of docs; component_id is the smallest doc_id reachable over links."""
    fps = materialise(fingerprints(docs, width), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = materialise(connected_components(near_links(classes.select("fp"))), "components")
    linked = roots.join(classes, roots.node == classes.fp).select("fp", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = linked.join(least, "root").select("fp", "component_id")
    named = materialise(
        classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "class-names"
    )
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), width=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
