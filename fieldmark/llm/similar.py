"""Near-duplicate groups by Jaccard similarity of word shingles, on top of SimHash links.

Texts of similarity 0.8 differ in up to some 14 of 64 fingerprint bits, which
no segment index can reach.  So candidates are texts with equal or near
fingerprints and, beyond them, texts that share one of BANDS keys of ROWS least
shingle hashes each (a pair of similarity 0.8 does with probability 0.9996).
Every candidate is judged on its whole shingle sets; a sketch of four bits of
each least hash only spares those far below the similarity.

A bucket of candidates is worked off in three rounds, each on what the links
so far leave in different groups:

1. every text against the bucket's smallest one, which is the same in most
   buckets of a group of copies;
2. small buckets: all pairs; large ones: every text against two that the
   bucket picks by its own hash;
3. large buckets still apart: up to CROWD texts all with all.  Texts of larger
   ones are dealt into finer buckets, one for each of the rare shingles of which
   two similar texts must share one, and these go through the rounds in their
   turn; what is large and apart there as well goes all with all, in blocks of
   about CROWD texts, two blocks a task.

So texts that share boilerplate but little else part without being compared.
No link is lost to a bucket's size, no row is made for a pair that is no
candidate, and a group of copies costs a row a text however large it is.

Texts are known by their 128-bit digest; copies are one text.  A null text is
an empty one; texts without words only have copies.  A null doc_id takes part.
Repeated rows come out as often.  An empty table gives an empty result.  Very
long texts are taken whole.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, give_back, materialise, slices
from .components import connected_components
from .simhash import near_links, shingle_hashes, simhash

BANDS, ROWS = 20, 5
#: Buckets up to PAIRED texts are paired; CROWD texts of a larger one make a block.
PAIRED, CROWD = 16, 512
#: Parts that a frequent shingle's texts are counted in.
SALTS = 64
#: Bits of each least hash that the sketch keeps: planes of HALF bits each.
DEPTH, HALF = 4, BANDS * ROWS // 2
SKETCH = [f"s{i}" for i in range(2 * DEPTH)]
_MIXERS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHTS = np.uint64(1) << np.arange(HALF, dtype=np.uint64)


def text_key(text: Column) -> Column:
    """The 128-bit digest of a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of the distinct hashes under each mixer."""
    least = np.full(len(_MIXERS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        x = hashes[i : i + 1024, None] * _MIXERS
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(0), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """A key for each band: equal with probability similarity ** ROWS."""
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def planes(least: np.ndarray) -> list[int]:
    """The sketch: the bits of one weight of half the least hashes, as an integer."""
    return [int((((half >> np.uint64(d)) & np.uint64(1)) * _WEIGHTS).sum()) for half in (least[:HALF], least[HALF:]) for d in range(DEPTH)]


def least_agreement(similarity: float) -> int:
    """Equal places of two sketches that a pair of this similarity has but for one time in a million."""
    p = similarity + (1 - similarity) / (1 << DEPTH)
    n = 2 * HALF
    return max(0, math.floor(n * p - 5 * math.sqrt(n * p * (1 - p))))


def agreement(x: list, y: list) -> Column:
    """Equal places of two sketches given as columns."""
    out = F.lit(2 * HALF)
    for half in (0, DEPTH):
        differ = x[half].bitwiseXOR(y[half])
        for d in range(1, DEPTH):
            differ = differ.bitwiseOR(x[half + d].bitwiseXOR(y[half + d]))
        out = out - F.bit_count(differ)
    return out


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """text_key, fp, bands and the sketch for each row; one narrow pass over the texts."""
    long = T.LongType()
    schema = T.StructType([T.StructField("text_key", T.BinaryType()), T.StructField("fp", long), T.StructField("bands", T.ArrayType(long)), *(T.StructField(s, long) for s in SKETCH)])

    def run(batches):
        for b in slices(batches):
            fps, keys, sketches = [], [], []
            for raw in b.column("text").cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(raw, width)
                fps.append(simhash(hashes) if len(hashes) else 0)
                least = least_hashes(np.unique(hashes))
                keys.append(bands(least) if len(hashes) else [])
                sketches.append(planes(least))
            cols = [pa.array([s[i] for s in sketches], pa.int64()) for i in range(len(SKETCH))]
            yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *cols], names=schema.names)

    return docs.select(text_key(F.col("text")).alias("text_key"), "text").mapInArrow(run, schema)


def named(texts: DataFrame) -> DataFrame:
    """texts with a 64-bit ``node``; a digest that shares its node with a smaller one gets another."""
    first = texts.withColumn("node", F.xxhash64("text_key"))
    twice = first.groupBy("node").agg(F.min("text_key").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.when(F.col("text_key") > F.col("least"), F.xxhash64("text_key", F.lit(1))).otherwise(F.col("node"))
    return first.join(twice, "node", "left").withColumn("node", again).drop("least")


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and compressed text of the texts in wanted(text_key, node); a task sends a text once."""

    def pack(batches):
        z, seen = zstandard.ZstdCompressor(level=1), set()
        for b in slices(batches):
            keys = b.column("text_key").to_pylist()
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            texts = b.column("text").cast(pa.binary()).take(pa.array(new, pa.int64())).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("text_key").take(pa.array(new, pa.int64())), pa.array([z.compress(t or b"") for t in texts], pa.binary())], names=["text_key", "packed"])

    sent = docs.select(text_key(F.col("text")).alias("text_key"), "text").mapInArrow(pack, "text_key binary, packed binary")
    return sent.join(wanted, "text_key").dropDuplicates(["text_key"]).select("node", "packed")


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b), a > b, whose sketches don't rule the similarity out."""
    side = lambda n: nodes.select(F.col("node").alias(n), *[F.col(s).alias(f"{n}_{s}") for s in SKETCH])
    pairs = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    near = agreement([F.col(f"a_{s}") for s in SKETCH], [F.col(f"b_{s}") for s in SKETCH]) >= least_agreement(similarity)
    return both.where(near).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have the similarity."""

    def check(batches):
        z, held = zstandard.ZstdDecompressor(), {}

        def of(node, packed):
            if node not in held:
                if len(held) > 64:  # a small cache: pairs of one text come together
                    held.clear()
                held[node] = np.unique(shingle_hashes(z.decompress(packed), width))
            return held[node]

        for b in slices(batches, "text_a"):
            keep = []
            for x, y, s, t in zip(*(b.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                u, v = of(x, s), of(y, t)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both > 0 and both >= similarity * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda n: texts.select(F.col("node").alias(n), F.col("packed").alias(f"text_{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of all linked nodes, when links come to those that roots stands for."""
    if roots is None:
        return materialise(connected_components(links), "similar-roots")
    links = materialise(links, "similar-links")
    if not links.limit(1).count():
        return roots
    by = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
    across = links.join(by("a"), "a", "left").join(by("b"), "b", "left")
    last = connected_components(across.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    last = materialise(last, "similar-groups").withColumnRenamed("root", "last")
    ends = roots.unionByName(last.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
    ends = ends.join(last.select(F.col("node").alias("root"), "last"), "root", "left")
    return materialise(ends.select("node", F.coalesce("last", "root").alias("root")), "similar-roots")


def apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (key, node, n) of buckets whose texts are in different groups, with each one's ``root``."""
    held = materialise(met.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "similar-held")
    split = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return materialise(held.join(materialise(split, "similar-split"), "key"), "similar-apart")


def compared(i: int, j: int, blocks: list[int], nodes: list[int], roots: list[int], sketches: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between block i and block j (or within i) that join groups which ``roots`` and the links before leave apart."""
    group = np.unique(np.array(roots, np.int64), return_inverse=True)[1]
    block, out, enough = np.array(blocks), [], least_agreement(similarity)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(left) or not len(right):
        return out
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    span = np.concatenate([ids[starts[r] : starts[r] + sizes[r]] for r in right])
    at = np.cumsum(sizes[right]) - sizes[right]
    mark = np.zeros(len(distinct), bool)
    for x in left:
        differ = sketches[right] ^ sketches[x]
        far = sum(np.bitwise_count(np.bitwise_or.reduce(differ[:, h : h + DEPTH], axis=1)).astype(int) for h in (0, DEPTH))
        if not ((group[right] != group[x]) & (2 * HALF - far >= enough)).any():
            continue
        own = ids[starts[x] : starts[x] + sizes[x]]  # shared shingles with the whole block at once
        mark[own] = True
        both = np.add.reduceat(mark[span], at, dtype=np.int64)
        mark[own] = False
        for k in right[(both > 0) & (both >= similarity * (sizes[x] + sizes[right] - both))]:
            if group[k] != group[x]:
                out.append((nodes[x], nodes[k]))
                group[group == group[k]] = group[x]
    return out


def rare_shingles(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """texts(node, packed) -> (key, node): the shingles of which a text must share one with any similar one, as keys.

    Of n shingles a similar text has ceil(similarity * n) at least, so two such
    texts share one among the first n - ceil(similarity * n) + 1 of each, in any
    order that is the same for both.  The order is from rare to frequent: what
    many texts have in common comes last.
    """

    def shingles(batches):
        z = zstandard.ZstdDecompressor()
        for b in slices(batches, "packed"):
            for node, packed in zip(b.column("node").to_pylist(), b.column("packed").to_pylist(), strict=True):
                own = np.unique(shingle_hashes(z.decompress(packed), width))
                need = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node, np.int64)), pa.array(own.view(np.int64)), pa.array(np.full(len(own), need, np.int32))], names=["node", "key", "need"])

    each = texts.mapInArrow(shingles, "node bigint, key bigint, need int").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    each = materialise(each, "similar-shingles")
    parts = each.groupBy("key", "salt").agg(F.count("*").alias("part"))
    often = parts.join(parts.groupBy("key").agg(F.sum("part").alias("often")), "key").drop("part")
    order = Window.partitionBy("node").orderBy("often", "key")
    ranked = each.join(often, ["key", "salt"]).withColumn("rank", F.row_number().over(order))
    return ranked.where("rank <= need and often > 1").select("key", "node")


def in_buckets(keyed: DataFrame, label: str) -> DataFrame:
    """(key, node) with the size ``n`` and the smallest node ``low`` of each key that more than one node has.

    Sizes are stored first: a join in the stage of their aggregate would read all of a bucket in one task.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1")
    return materialise(keyed.join(materialise(sizes, f"{label}-sizes"), "key"), label)


def rounds(met: DataFrame, roots: DataFrame | None, judge: Callable[[DataFrame], DataFrame], near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The first two rounds over met(key, node, n, low), and links to judge beside them -> roots, and the rows of large buckets still apart."""
    # 1: each with the bucket's smallest
    stars = met.select(F.col("node").alias("a"), F.col("low").alias("b"))
    roots = joined(roots, judge(stars if near is None else stars.unionByName(near)))
    # 2: small buckets pair by pair, large ones with two of their own choice
    left = apart(met, roots)
    few, many = left.where(F.col("n") <= PAIRED), left.where(F.col("n") > PAIRED)
    side = lambda n: few.select("key", F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
    pairs = side("a").join(side("b"), "key").where("a > b and root_a <> root_b").select("a", "b")
    picked = many.groupBy("key").agg(*[F.min_by(F.struct("node", "root"), F.xxhash64("node", "key", F.lit(i))).alias(f"p{i}") for i in range(2)])
    picked = materialise(picked, "similar-picked")
    stars = many.join(picked.select("key", F.explode(F.array("p0", "p1")).alias("p")), "key").where("root <> p.root").select(F.col("node").alias("a"), F.col("p.node").alias("b"))
    roots = joined(roots, judge(pairs.unionByName(stars)))
    return roots, apart(many.select("key", "node", "n"), roots)


def lined_up(many: DataFrame) -> tuple[DataFrame, int]:
    """The buckets of many(key, node, n): key, ``count`` of blocks and ``start``, the place of its rows on a line of all; and the line's length.

    A row is on the line as often as its bucket has blocks, since it meets each of them.
    """
    each = many.groupBy("key").agg(F.max("n").alias("n")).withColumn("count", F.ceil(F.col("n") / CROWD).cast("int"))
    each = each.withColumn("rows", F.col("n") * F.col("count")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    each = materialise(each, "crowd-buckets")
    sums = dict(each.groupBy("salt").agg(F.sum("rows")).collect())
    ends = list(itertools.accumulate((sums.get(k, 0) for k in range(SALTS)), initial=0))
    before = Window.partitionBy("salt").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.array(*[F.lit(x).cast("long") for x in ends])[F.col("salt")] + F.coalesce(F.sum("rows").over(before), F.lit(0))
    return each.withColumn("start", start), ends[-1]


def crowd_links(many: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """many(key, node, n, root) of large buckets -> links (a, b) that join what is apart in one.

    A bucket of n texts falls into n / CROWD blocks by a hash of the node (one,
    if it has no more), and every two blocks meet in a group of their own, so a task holds two blocks
    at once whatever the size of the bucket.  Groups are laid end to end and the line is cut into equal parts, as
    by hash several of the largest may fall to one task.
    """
    buckets, total = lined_up(many)
    parts = max(1, min(int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / CROWD)))
    members = many.join(buckets.select("key", "count", "start"), "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), "count").cast("int"))
    met = members.join(nodes.select("node", *SKETCH), "node").join(texts, "node")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    # blocks in the groups (0, 0), (0, 1), ..., (1, 1), ... before this one: (i, i) has one, others have two
    ahead = F.expr("2L * i * count - 1L * i * i + greatest(0, 2 * (j - i) - 1)")
    place = F.col("start") + ahead * F.col("n") / F.col("count")
    met = met.withColumn("part", F.floor(place * parts / max(1, total)).cast("int"))
    met = met.select("part", "key", "i", "j", "block", "node", "root", "packed", *SKETCH).repartitionById(parts, "part")

    def compare(table):
        z = zstandard.ZstdDecompressor()
        col = {c: table.column(c).to_pylist() for c in ("i", "j", "block", "node", "root", "packed")}
        sets = [np.unique(shingle_hashes(z.decompress(x), width)) for x in col["packed"]]
        sketches = np.stack([table.column(s).to_numpy() for s in SKETCH], 1)
        found = compared(col["i"][0], col["j"][0], col["block"], col["node"], col["root"], sketches, sets, similarity)
        give_back()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return met.groupBy("part", "key", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """text_key and ``root``, the name of its group, for each distinct text of docs."""
    each = materialise(sketched(docs, width).dropDuplicates(["text_key"]), "sketches")
    each = materialise(named(each), "texts")
    nodes = each.where(F.size("bands") > 0)
    # buckets: bands, and equal fingerprints as one more
    keyed = nodes.select("node", F.explode(F.concat("bands", F.array(F.xxhash64("fp", F.lit("fp"))))).alias("key"))
    met = in_buckets(keyed, "buckets")
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fp-first")
    by = lambda n: first.select(F.col("fp").alias(n), F.col("first").alias(f"node_{n}"))
    near = near_links(first.select("fp")).join(by("a"), "a").join(by("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    near = materialise(near, "fp-near")
    ends = met.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    texts = materialise(packed_texts(docs, each.join(ends, "node", "left_semi").select("text_key", "node")), "candidate-texts")
    judge = lambda pairs: verified(likely(pairs, nodes, similarity), texts, width, similarity)
    roots, crowded = rounds(met, None, judge, near)
    # 3: what is still apart in large buckets, by finer ones where it is more than a block
    links = crowd_links(crowded.where(F.col("n") <= CROWD), nodes, texts, width, similarity)
    vast = crowded.where(F.col("n") > CROWD)
    if vast.limit(1).count():
        rare = materialise(rare_shingles(texts.join(vast, "node", "left_semi"), width, similarity), "rare-shingles")
        finer = in_buckets(rare, "finer-buckets")
        roots, rest = rounds(finer, roots, judge)
        links = links.unionByName(crowd_links(rest, nodes, texts, width, similarity))
    roots = joined(roots, links)
    return each.join(roots, "node", "left").select("text_key", F.coalesce("root", "node").alias("root"))


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key and component_id (the smallest doc_id of its group) for each row of docs."""
    groups = materialise(similar_texts(docs, width, similarity), "similar-names")
    rows = materialise(docs.select("doc_id", text_key(F.col("text")).alias("text_key")).join(groups, "text_key"), "similar-rows")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", "text_key", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, null ids last; of its texts the one of least digest.

    Rows are told apart by id and text, so a different text stays whatever id
    it shares; of rows that repeat both, any one stays.
    """
    key, id_, text_id = (fresh(n, docs.columns) for n in ("_text_key", "_kept_id", "_kept_text"))
    groups = materialise(similar_texts(docs, width, similarity), "similar-names")
    # each text's best row first, so that copies of a hot text never meet in one task
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key")).groupBy("text_key", "doc_id").agg(F.count("*").alias("n"))
    each = rows.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("r"))
    best = each.join(groups, "text_key").groupBy("root").agg(F.min(F.struct("r.none", "r.doc_id", "text_key", "r.n")).alias("r"))
    kept = materialise(best.select(F.col("r.doc_id").alias(id_), F.col("r.text_key").alias(text_id), F.col("r.n").alias("n")), "similar-kept")
    again = kept.where("n > 1").limit(1).count()
    keyed = docs.withColumn(key, text_key(F.col("text")))
    kept = kept.drop("n")
    left = keyed.join(kept, (F.col(key) == F.col(text_id)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
    return (left.dropDuplicates(["doc_id", key]) if again else left).drop(key)
