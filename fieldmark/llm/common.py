"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (``spark.checkpoint.dir``); a temporary one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can read")
        base = tempfile.mkdtemp(prefix="fieldmark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_SCRATCH: ContextVar[str | None] = ContextVar("fieldmark_scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that ``materialise`` writes within go to a folder of their own, which is deleted at the end, after an error too.

    A frame that reads such a table can't be used afterwards: write it with ``kept`` first.
    """
    folder = f"{shared_dir(spark)}/fieldmark-scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, kept: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    Within ``scratch`` the table goes with the others of its scope, unless ``kept``.  Outside of it, or kept, it belongs to the
    caller: tables are named fieldmark-..., and may go once the result is read.
    """
    spark = df.sparkSession
    folder = None if kept else _SCRATCH.get()
    path = f"{folder or shared_dir(spark)}/fieldmark-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that a task turns into Python objects at once.
AT_ONCE = 1 << 20


def give_back() -> None:
    """Returns what a task has freed to the system, as Python workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it keeps the memory
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of at most ``most`` bytes in ``column`` (a longer row is a run of its own)."""
    try:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(ends):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
                yield b.slice(at, upto - at)
                at = upto
    finally:
        give_back()


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that no column in ``taken`` has, whatever its case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
