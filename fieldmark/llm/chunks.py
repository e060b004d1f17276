"""Documents in chunks of a few megabytes, and sorted 64-bit keys as compact columns.

Operators that must look every n-gram of a corpus up in corpus-wide counts
would move a row per n-gram.  They move one block per chunk and key range
instead: a chunk's distinct keys, sorted, as byte planes of their differences.
A block never holds a key twice, so a frequent key weighs no more than one
entry per chunk, whatever its share of all rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

CHUNK_BYTES = 4 << 20


def pack_ints(values: np.ndarray, sort: bool = False) -> bytes:
    """Non-negative integers as compressed byte planes; sorted ones as differences."""
    v = np.asarray(values, np.uint64)
    if sort and len(v):
        v = np.r_[v[:1], np.diff(v)]
    planes = v.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(len(v).to_bytes(8, "little") + planes.tobytes())


def unpack_ints(data: bytes, sort: bool = False) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    v = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(v, dtype=np.uint64) if sort else v


def seal(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def unseal(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def chunked(docs: DataFrame, label: str, size: int = CHUNK_BYTES) -> DataFrame:
    """docs with a column ``text`` -> stored rows (chunk, bytes, payload); a text is never cut."""

    def run(batches):
        held, total = [], 0

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([total], pa.int64()), pa.array([seal(table.to_batches()[0])], pa.binary())],
                names=["chunk", "bytes", "payload"],
            )

        for b in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(sizes):
                upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), size - total, side="right")))
                held.append(b.slice(at, upto - at))
                total += int(sizes[at:upto].sum())
                at = upto
                if total >= size or at < len(sizes):
                    yield out()
                    held, total = [], 0
        if held:
            yield out()

    return materialise(docs.mapInArrow(run, "chunk string, bytes bigint, payload binary"), label)


def ranges_for(chunks: DataFrame, per_range: int = 8 << 20) -> int:
    """How many key ranges (a power of two) the corpus needs for each to stay small."""
    total = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return 1 << max(2, int(np.ceil(np.log2(max(1, total / per_range)))))


def segments(keys: np.ndarray, ranges: int, bits: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of the key ranges that a sorted array of ``bits``-bit keys has keys in."""
    if not len(keys):
        return []
    part = keys >> np.uint64(bits - (ranges.bit_length() - 1))
    cut = np.flatnonzero(part[1:] != part[:-1]) + 1
    return list(zip(part[np.r_[0, cut]].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their total counts, the place of each given key among them)."""
    uniq, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(uniq), np.uint64)
    np.add.at(total, inverse, np.concatenate(counts))
    return uniq, total, inverse


#: Blocks of one key range that a task takes at once.
FAN = 4096


def salts_for(chunks: DataFrame, fan: int = FAN) -> int:
    """In how many parts the blocks of a key range are first taken, so that a key that every chunk has is no task's burden."""
    return max(1, -(-chunks.count() // fan))


def corpus_totals(sent: DataFrame, salts: int, label: str, told=lambda total: total, keyed=None) -> DataFrame:
    """sent(chunk, part, keys, counts), sorted keys of key ranges -> stored (chunk, part, data, total, distinct).

    data: what ``told`` makes of the corpus totals of a chunk's keys, in their
    order; or what ``keyed`` makes of all keys of a range, sorted, and their
    totals.  Rows without a chunk hold a range's sum of totals and the number of
    its keys with a total above 0.  With more than one salt, each salt's
    blocks are added up first, then the salts' sums; totals go back the same way.
    """
    answers = "chunk string, part bigint, data binary, total bigint, distinct bigint"

    def table(chunk, part, data, total, distinct):
        n = len(chunk)
        cols = [pa.array(chunk, pa.string()), pa.array([part] * n, pa.int64()), pa.array(data, pa.binary()), pa.array(total, pa.int64()), pa.array(distinct, pa.int64())]
        return pa.Table.from_arrays(cols, names=["chunk", "part", "data", "total", "distinct"])

    def blocks(t: pa.Table):
        return [unpack_ints(k, True) for k in t.column("keys").to_pylist()], [unpack_ints(c) for c in t.column("counts").to_pylist()]

    def add(told):
        def run(t: pa.Table) -> pa.Table:
            keys, counts = blocks(t)
            uniq, total, inverse = summed(keys, counts)
            each = np.split((keyed(uniq, total) if keyed else told(total))[inverse], np.cumsum([len(k) for k in keys])[:-1])
            chunk = [*t.column("chunk").to_pylist(), None]
            return table(chunk, t.column("part")[0].as_py(), [*map(pack_ints, each), None], [0] * len(each) + [int(total.sum())], [0] * len(each) + [int((total > 0).sum())])

        return run

    if salts == 1:
        return materialise(sent.groupBy("part").applyInArrow(add(told), answers), label)

    def add_some(t: pa.Table) -> pa.Table:
        uniq, total, _ = summed(*blocks(t))
        return pa.table({"chunk": t.column("salt").slice(0, 1).cast(pa.string()), "part": t.column("part").slice(0, 1), "keys": pa.array([pack_ints(uniq, True)], pa.binary()), "counts": pa.array([pack_ints(total)], pa.binary())})

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, counts = blocks(left)
        uniq, _, inverse = summed(keys, counts)
        total = unpack_ints(right.column("data")[0].as_py())
        each = np.split(told(total)[inverse], np.cumsum([len(k) for k in keys])[:-1])
        n = len(each)
        return table(left.column("chunk").to_pylist(), left.column("part")[0].as_py(), [pack_ints(x) for x in each], [0] * n, [0] * n)

    sent = materialise(sent.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")), f"{label}-sent")
    some = sent.groupBy("part", "salt").applyInArrow(add_some, "chunk string, part bigint, keys binary, counts binary")
    top = materialise(some.groupBy("part").applyInArrow(add(lambda total: total), answers), f"{label}-sums")
    back = top.where("chunk is not null").withColumn("salt", F.col("chunk").cast("int"))
    found = sent.groupBy("part", "salt").cogroup(back.groupBy("part", "salt")).applyInArrow(look_up, answers)
    return materialise(found.unionByName(top.where("chunk is null")), label)
