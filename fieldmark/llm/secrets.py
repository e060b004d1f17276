"""Secret scans over an incremental blob ledger.

Every version of every text is addressed by the sha256 of its content.  A blob
is scanned once per rule version: a ledger of (blob, rule version) pairs tells
what was seen, only the rest is scanned, and findings are joined back to all
rows (paths) that hold the blob.  Blobs travel compressed, once per blob and
task, so that copies add next to nothing; a hot blob is a hot key of an
equi-join only, which adaptive execution splits.

Nulls: a null text is the empty blob; a null doc_id keeps its row.  Repeated
rows stay.  Findings that start together stand in the order of the kinds.
Texts are scanned whole, every rule in time linear in the text.  An empty table
gives an empty result.  Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import AT_ONCE, documents, fresh, materialise, slices

#: Fixed by the contract: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),  # the runs of [0-9a-f]+ that are long enough
)
#: What this scanner adds.
MORE = (
    ("github", re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"), 0, 20),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?"), 0, 27),
    ("slack", re.compile(r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 15),
    ("url", re.compile(r"://[^\s/:@]{1,256}:[^\s/@]{3,256}@"), 0, 8),
)
RULE_VERSION = "1"
_ORDER = {kind: i for i, (kind, *_) in enumerate(BASE + MORE)}
FINDINGS = "blob string, rule_version string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def find(text: str, rules=BASE + MORE) -> list[tuple[int, str, int]]:
    """(start, kind, end) of each finding, by start and then by kind as listed."""
    out = []
    for kind, pattern, group, least in rules:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda x: (x[0], _ORDER[x[1]], x[2]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def _row(blob: str, text: str) -> tuple:
    spans = find(text)
    base = [s for s in spans if _ORDER[s[1]] < len(BASE)]
    n = [sum(s[1] == k for s in base) for k, *_ in BASE]
    return (blob, RULE_VERSION, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))


def _pack(batches):
    """Blobs of a task, each once, compressed."""
    seen, z = set(), zstandard.ZstdCompressor(level=1)
    for b in slices(batches):
        blobs, texts = b.column("blob").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()
        new = [(k, z.compress(t or b"")) for k, t in zip(blobs, texts, strict=True) if k not in seen and not seen.add(k)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in new], pa.string()), pa.array([t for _, t in new], pa.binary())], names=["blob", "packed"])


def _scan(batches):
    """All rows of a blob are in one partition: each is scanned once."""
    seen, z = set(), zstandard.ZstdDecompressor()
    for b in slices(batches, "packed", AT_ONCE // 4):
        rows = []
        for k, t in zip(b.column("blob").to_pylist(), b.column("packed").to_pylist(), strict=True):
            if k not in seen:
                seen.add(k)
                rows.append(_row(k, z.decompress(t).decode("utf-8", "surrogatepass")))
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in FINDINGS.split(", ")])


def paths(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and ``blob``, the content address, for each row."""
    return docs.select(*keep, F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))


def _once(book: DataFrame) -> DataFrame:
    """A row a blob and rule version: runs that wrote to one ledger at once may have scanned the same blob."""
    return book.dropDuplicates(["blob", "rule_version"])


def kept_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept below ``path``; None before the first run."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(FINDINGS).parquet(path)


def scan_with_ledger(docs: DataFrame, path: str) -> DataFrame:
    """A row of findings for each doc_id; blobs that the ledger below ``path`` holds are not scanned, all others are and join it."""
    spark = docs.sparkSession
    new = materialise(scan_new(docs, kept_ledger(spark, path)), "ledger-new")
    new.write.mode("append").parquet(path)
    return _findings(docs, _once(spark.read.schema(FINDINGS).parquet(path)))


def scan_new(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Findings of the blobs in docs that the ledger doesn't hold for this rule version; append them to the ledger."""
    texts = paths(docs, ["text"])
    if ledger is not None:  # addresses alone tell what is new; only such texts go on
        done = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob")
        unseen = materialise(paths(docs, []).distinct().join(done, "blob", "left_anti"), "unseen")
        texts = texts.join(unseen, "blob", "left_semi")
    return texts.mapInArrow(_pack, "blob string, packed binary").repartition("blob").mapInArrow(_scan, FINDINGS)


def _findings(docs: DataFrame, book: DataFrame) -> DataFrame:
    hits = book.where((F.col("rule_version") == RULE_VERSION) & (F.col("spans") != "")).drop("rule_version")
    found = paths(docs, ["doc_id"]).join(hits, "blob", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")}
    return found.select("doc_id", *zero.values(), F.coalesce("base_sha256", F.lit(EMPTY_SHA)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row of findings for each doc_id, the ledger with what was new)."""
    book = materialise(scan_new(docs, ledger), "ledger")
    if ledger is not None:
        book = _once(ledger.select(book.columns).unionByName(book))
    return _findings(docs, book), book


def redact(text: str, spans: str) -> str:
    """The text with each run of found characters replaced by the name of its first kind."""
    out, at, end, kind = [], 0, -1, ""
    for s in spans.split(","):
        k, a, b = s.split(":")
        if int(a) < end:
            end = max(end, int(b))
            continue
        if end >= 0:
            out.append(f"[{kind}]")
            at = end
        out.append(text[at : int(a)])
        end, kind = int(b), k
    return "".join(out) + f"[{kind}]" + text[end:]


def redacted(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """docs with every finding replaced in ``text``, and n_chars to match; other columns and rows stay as they are.

    Texts meet their findings compressed, as they have to move.
    """
    book = materialise(scan_new(docs, ledger), "ledger")
    if ledger is not None:
        book = _once(ledger.select(book.columns).unionByName(book))
    names = docs.columns
    blob, spans, packed = (fresh(n, names) for n in ("_blob", "_spans", "_packed"))
    hits = book.where((F.col("rule_version") == RULE_VERSION) & (F.col("spans") != "")).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    rest = [f for f in docs.schema if f.name != "text"]
    packed_schema = T.StructType([*rest, T.StructField(blob, T.StringType()), T.StructField(packed, T.BinaryType())])
    schema = T.StructType([*rest, T.StructField(spans, T.StringType()), T.StructField("text", T.StringType())])
    others = [f.name for f in rest]

    def pack(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            texts = [None if t is None else z.compress(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in [*others, blob]] + [pa.array(texts, pa.binary())], names=packed_schema.names)

    def clean(batches):
        z = zstandard.ZstdDecompressor()
        for b in slices(batches, packed, AT_ONCE // 4):
            texts = []
            for t, found in zip(b.column(packed).to_pylist(), b.column(spans).to_pylist(), strict=True):
                t = None if t is None else z.decompress(t).decode("utf-8", "surrogatepass")
                texts.append(t if t is None or found is None else redact(t, found))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in [*others, spans]] + [pa.array(texts, pa.string())], names=schema.names)

    tagged = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)).mapInArrow(pack, packed_schema)
    out = tagged.join(hits, blob, "left").select(*others, spans, packed).mapInArrow(clean, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))[0]
