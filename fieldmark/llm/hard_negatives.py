"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

Each split of the tree has several split points, and a row goes to the nearest.
For each pair (split point, sibling subtree) the least and greatest distance of
the subtree's rows to that point are stored.  A search for scores (integer
inner products) in a window is one for distances in an annulus about the anchor,
as norms are known to lie within a subtree's range; a sibling goes where its
range at any split point misses what the annulus allows there.  Ranges cover
every row, and leaves are scored exactly, so results are exact.

The upper tree is grown on the driver from at most ``SAMPLE`` rows drawn by
hash, which decides only where rows lie; all rows are routed down it and all
count in its ranges.  A leaf's rows are cut into blocks of bounded bytes, so a
crowded leaf, or one vector that a third of all rows share, is many tasks'
work.  Each block goes on as a tree of its own inside its task.  Anchors meet
blocks in parts of bounded bytes, those of neighbouring leaves together.  A
search first looks through an anchor's own leaf; what it finds there narrows
the annulus for all other leaves.

Rows with a null id, label or vector, or any null or non-finite component take
no part, nor do those whose product with themselves is not below 2^62 (no score
of the others leaves 64 bits).  Vectors of different lengths are padded with
zeros.  An anchor's other rows are those with another id.  Rows that repeat id
and score count once in a list; of rows that repeat an anchor's id the one with
the smallest label and vector is the anchor.  Ties of a score go to the smaller
id.  A positive whose window is empty has no rows.  An empty table gives an
empty result.  Columns other than id, label and vector are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, materialise

#: Rows of which the upper tree is grown, at most; and the bytes of their vectors, at most.
SAMPLE, SAMPLE_BYTES = 8192, 64 << 20
#: Bytes of vectors in a block, and of anchors in a part.
BLOCK_BYTES = 8 << 20
#: Split points of a node; rows of a leaf within a block.
FANOUT, LEAF = 16, 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Findings that a task holds before it keeps only the best.
PENDING = 200_000


# ---------------------------------------------------------------- tree


@dataclass
class Node:
    """A split: low and high are (split point, child) ranges of distance, small and large the ranges of norms."""

    points: np.ndarray
    children: list  # a node, or a leaf's number
    low: np.ndarray
    high: np.ndarray
    small: np.ndarray
    large: np.ndarray


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def split_points(rows: np.ndarray, k: int) -> np.ndarray | None:
    """k rows far apart, chosen greedily among 3k spread over the rows; None if all are alike."""
    some = np.unique(rows[np.linspace(0, len(rows) - 1, min(len(rows), 3 * k)).astype(int)], axis=0)
    if len(some) < 2:
        some = np.unique(rows, axis=0)[: 3 * k]
        if len(some) < 2:
            return None
    d = distances(some, some)
    took = [int(d.sum(1).argmax())]
    away = d[took[0]].copy()
    while len(took) < min(k, len(some)):
        took.append(int(away.argmax()))
        away = np.minimum(away, d[took[-1]])
    return some[took]


def ranges(d: np.ndarray, norms: np.ndarray, nearest: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """low, high, small, large over rows at distances d (rows, split points), each in its child."""
    low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    small, large = np.full(k, np.inf), np.full(k, -np.inf)
    for j in np.unique(nearest):
        there = nearest == j
        low[:, j], high[:, j] = d[there].min(0), d[there].max(0)
        small[j], large[j] = norms[there].min(), norms[there].max()
    return low, high, small, large


def survivors(node: Node, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(anchors, children): where a row with a score in [lo, hi] may be.  Distances carry rounding errors, so ranges are widened by far more."""
    norm = np.sqrt((q * q).sum(1))[:, None]
    with np.errstate(invalid="ignore"):
        far = np.sqrt(np.maximum(norm**2 + node.large**2 - 2 * lo.astype(float)[:, None], 0))
        near = np.sqrt(np.maximum(norm**2 + node.small**2 - 2 * hi.astype(float)[:, None], 0))
    delta = distances(q, node.points)[:, :, None]
    slack = 1e-6 * (1 + norm + np.max(node.large))[:, :, None]
    far, near = far[:, None], near[:, None]
    inside = (node.low <= delta + far + slack) & (node.high >= np.maximum(delta - far, near - delta) - slack)
    return inside.all(1)


def grow(sample: np.ndarray, rows_each: float, block: int, k: int = FANOUT) -> tuple[Node | int, int]:
    """(the upper tree, the number of its leaves) over a sample of which each row stands for ``rows_each``."""
    leaves = 0

    def down(rows):
        nonlocal leaves
        points = split_points(rows, k) if len(rows) >= 4 * k and len(rows) * rows_each > block else None
        if points is None:
            leaves += 1
            return leaves - 1
        nearest = distances(rows, points).argmin(1)
        n = len(points)
        return Node(points, [down(rows[nearest == j]) for j in range(n)], np.full((n, n), np.inf), np.full((n, n), -np.inf), np.full(n, np.inf), np.full(n, -np.inf))

    tree = down(sample)
    return tree, leaves


def nodes_of(tree: Node | int) -> list[Node]:
    """All splits, each before those below it."""
    out = [tree] if isinstance(tree, Node) else []
    for n in out:
        out += [c for c in n.children if isinstance(c, Node)]
    return out


def walk(tree: Node | int, rows: np.ndarray, met=None) -> np.ndarray:
    """The leaf of each row; met(node, d, nearest, places) is told of every split on the way."""
    out = np.zeros(len(rows), np.int32)
    todo = [(tree, np.arange(len(rows)))]
    while todo:
        at, which = todo.pop()
        if not isinstance(at, Node):
            out[which] = at
            continue
        if not len(which):
            continue
        d = distances(rows[which], at.points)
        nearest = d.argmin(1)
        if met:
            met(at, d, nearest, which)
        todo += [(c, which[nearest == j]) for j, c in enumerate(at.children)]
    return out


def leaves_for(tree: Node | int, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(leaf, anchors whose window it may hold rows of)."""
    out, todo = [], [(tree, np.arange(len(q)))]
    while todo:
        at, which = todo.pop()
        if not isinstance(at, Node):
            out.append((at, which))
        elif len(which):
            alive = survivors(at, q[which], lo[which], hi[which])
            todo += [(c, which[alive[:, j]]) for j, c in enumerate(at.children) if alive[:, j].any()]
    return out


# ---------------------------------------------------------------- search within a block


def best(window: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first k (highest score, smallest id) of each window, each id and score once; in order of windows."""
    order = np.lexsort((ident, -score, window))
    window, score, ident = window[order], score[order], ident[order]
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1]) | (score[1:] != score[:-1]) | (ident[1:] != ident[:-1])
    window, score, ident = window[new], score[new], ident[new]
    first = np.searchsorted(window, window, side="left")
    keep = np.arange(len(window)) - first < k
    return window[keep], score[keep], ident[keep]


@dataclass
class Anchors:
    """Anchors, and windows of scores each of which belongs to one (owner)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    owner: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def search_block(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, anchors: Anchors, k: int, same: bool, exact: type, fanout: int = 8, leaf: int = LEAF) -> tuple[np.ndarray, ...]:
    """(window, score, id) of the first k of each window among the block's rows with the anchor's label and another id (same), or another label.

    The block's tree is grown while it is searched: only below children where windows are left.
    """
    lo, norms = anchors.lo.copy(), np.sqrt((rows * rows).sum(1))
    q, r = anchors.vectors.astype(exact), rows.astype(exact)
    held, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    todo = [(np.arange(len(rows)), np.flatnonzero(lo <= anchors.hi))]

    def settle():
        found = best(*(np.concatenate([h[i] for h in held]) for i in range(3)), k)
        if len(full := np.flatnonzero(np.bincount(found[0], minlength=len(lo)) == k)):
            last = np.searchsorted(found[0], full, side="right") - 1
            lo[full] = np.maximum(lo[full], found[1][last])
        held[:] = [found]

    while todo:
        which, windows = todo.pop()
        points = split_points(rows[which], fanout) if len(which) > leaf else None
        if points is None:  # alike rows may be many
            for at in range(0, len(which), 4 * leaf):
                part = which[at : at + 4 * leaf]
                owner, place = np.unique(anchors.owner[windows], return_inverse=True)
                score = (q[owner] @ r[part].T).astype(np.int64)
                fits = ((labels[part][None] == anchors.labels[owner][:, None]) == same) & (ids[part][None] != anchors.ids[owner][:, None])
                each = score[place]
                w, x = np.nonzero(fits[place] & (each >= lo[windows][:, None]) & (each <= anchors.hi[windows][:, None]))
                held.append((windows[w], each[w, x], ids[part][x]))
                waiting += len(w)
                if waiting > PENDING:
                    settle()
                    waiting = 0
            continue
        d = distances(rows[which], points)
        nearest = d.argmin(1)
        node = Node(points, [], *ranges(d, norms[which], nearest, len(points)))
        alive = survivors(node, anchors.vectors[anchors.owner[windows]], lo[windows], anchors.hi[windows])
        for j in range(len(points)):
            if alive[:, j].any() and len(below := which[nearest == j]):
                todo.append((below, windows[alive[:, j]]))
    settle()
    return held[0]


# ---------------------------------------------------------------- Spark


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """(rows, dim) of list values, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(flat) == len(column) * dim:
        return flat.reshape(len(column), dim)
    size = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


@dataclass
class Index:
    """Stored rows (id, label, vec, leaf, block) and what is known of them."""

    rows: DataFrame
    blocks: DataFrame  # leaf, blocks: a row a leaf
    tree: Node | int
    dim: int
    exact: type  # of the arithmetic in which scores are exact
    per_block: int


def quantised(table: DataFrame, ident: str, label: Column, vector: str, scale: int = 256) -> DataFrame:
    """id, label, vec (whole numbers, floor(scale * x)) of the rows that take part."""
    ok = F.col(ident).isNotNull() & label.isNotNull() & F.col(vector).isNotNull()
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double")) if scale else F.col(vector)
    rows = table.where(ok & F.coalesce(finite, F.lit(False))).select(F.col(ident).cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec"))
    return rows.where(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x) < float(1 << 62))


def build(vectors: DataFrame, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES, fanout: int = FANOUT) -> Index:
    """The index over vectors (id, label, vec)."""
    spark = vectors.sparkSession
    raw = materialise(vectors, "gnat-vectors")
    size = raw.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("most")).first()
    n, dim, most = size["n"], max(1, size["dim"] or 1), size["most"] or 0.0
    exact = np.float64 if dim * most * most < 1 << 53 else np.int64
    per_block = max(LEAF, block_bytes // (8 * dim))
    drawn = raw.orderBy(F.xxhash64("id", "vec"), "id").limit(min(sample, max(4 * fanout, SAMPLE_BYTES // (8 * dim)))).select("vec").toArrow()
    tree, _ = grow(matrix(drawn.column("vec"), dim), n / max(1, drawn.num_rows), per_block, fanout)

    def route(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "vec")), pa.array(walk(tree, matrix(b.column("vec"), dim)), pa.int32())], names=["id", "label", "vec", "leaf"])

    kind = raw.schema["vec"].dataType.simpleString()
    routed = materialise(raw.mapInArrow(route, f"id bigint, label bigint, vec {kind}, leaf int").withColumn("row", F.monotonically_increasing_id()), "gnat-routed")

    def measure(batches):
        """A task's ranges: (node, child, split point or -1 for norms, low, high)."""
        number = {id(x): i for i, x in enumerate(nodes_of(tree))}
        got: dict[int, list[np.ndarray]] = {}
        for b in batches:
            rows = matrix(b.column("vec"), dim)
            norms = np.sqrt((rows * rows).sum(1))

            def met(node, d, nearest, which, norms=norms):
                new, i = ranges(d, norms[which], nearest, len(node.points)), number[id(node)]
                old = got.get(i, new)
                got[i] = [f(a, c) for f, a, c in zip((np.minimum, np.maximum, np.minimum, np.maximum), old, new, strict=True)]

            walk(tree, rows, met)
        out = []
        for i, (low, high, small, large) in got.items():
            for j in np.flatnonzero(np.isfinite(small)).tolist():
                out += [(i, j, s, float(low[s, j]), float(high[s, j])) for s in range(len(small))] + [(i, j, -1, float(small[j]), float(large[j]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=["node", "child", "point", "low", "high"])

    nodes = nodes_of(tree)
    told = routed.select("vec").mapInArrow(measure, "node int, child int, point int, low double, high double")
    for r in told.groupBy("node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # bounded by the sample
        x = nodes[r["node"]]
        if r["point"] < 0:
            x.small[r["child"]], x.large[r["child"]] = r["low"], r["high"]
        else:
            x.low[r["point"], r["child"]], x.high[r["point"], r["child"]] = r["low"], r["high"]
    for x in nodes:
        x.large = np.where(np.isfinite(x.large), x.large, 0.0)  # an empty child has no range at any point, and so is never met
    counts = {r["leaf"]: r["count"] for r in routed.groupBy("leaf").count().collect()}  # a row a leaf
    blocks = spark.createDataFrame([(leaf, -(-c // per_block)) for leaf, c in counts.items()], "leaf int, blocks bigint")
    rows = routed.join(F.broadcast(blocks), "leaf").select("id", "label", "vec", "leaf", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"))
    return Index(rows, blocks, tree, dim, exact, per_block)


def parts_of(counts: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(leaf, its first part, its number of parts): small leaves share a part with their neighbours, large ones have several."""
    out, part, filled = [], 0, 0
    for leaf, n in sorted(counts.items()):
        if filled and filled + n > most:
            part, filled = part + 1, 0
        out.append((leaf, part, max(1, -(-n // most))))
        if n > most:
            part, filled = part + -(-n // most), 0
        else:
            filled += n
    return out


def anchors_of(index: Index, chosen: Column) -> DataFrame:
    """id, label, vec, leaf, part of the rows that are anchors, once each; stored."""
    spark = index.rows.sparkSession
    one = index.rows.where(chosen).groupBy("id").agg(F.min(F.struct("label", "vec", "leaf")).alias("r")).select("id", "r.*")
    one = materialise(one, "gnat-anchors")
    counts = {r["leaf"]: r["count"] for r in one.groupBy("leaf").count().collect()}  # a row a leaf
    parts = spark.createDataFrame(parts_of(counts, index.per_block), "leaf int, first int, parts int")
    return one.join(F.broadcast(parts), "leaf").select("id", "label", "vec", "leaf", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part"))


FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, score bigint, id bigint"


def _visit(index: Index, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """FOUND: the first k of each window in each block of the leaves that asked (anchors with leaf, part and windows) names."""
    dim, exact = index.dim, index.exact
    # blocks move only to the parts that ask for them
    asked = materialise(asked, "gnat-asked")
    there = index.rows.join(asked.select("leaf", "part").distinct(), "leaf").select(*[F.col(c).alias(c) for c in ("leaf", "block", "part", "id", "label", "vec")])
    here = asked.join(F.broadcast(index.blocks), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        windows = right.column("windows").combine_chunks()
        size = np.asarray(pa.compute.list_value_length(windows), dtype=np.int64)
        flat = windows.flatten()
        col = lambda c: np.asarray(flat.field(c), dtype=np.int64)
        ints = lambda t, c: np.asarray(t.column(c), dtype=np.int64)
        anchors = Anchors(ints(right, "id"), ints(right, "label"), matrix(right.column("vec"), dim), np.repeat(np.arange(len(size)), size), col("lo"), col("hi"))
        rows = matrix(left.column("vec"), dim) if left.num_rows else np.zeros((0, dim))
        w, score, ident = search_block(ints(left, "id"), ints(left, "label"), rows, anchors, k, same, exact)
        took = pa.array(w)
        return pa.table([pa.array(anchors.ids[anchors.owner[w]]), flat.field("positive_id").take(took), flat.field("positive_score").take(took), pa.array(score), pa.array(ident)], names=["anchor_id", "positive_id", "positive_score", "score", "id"])

    key = ["leaf", "block", "part"]
    return there.groupBy(*key).cogroup(here.select(*key, "id", "label", "vec", "windows").groupBy(*key)).applyInArrow(search, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """FOUND and rank: the first k of each window."""
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= k)
    return ranked.groupBy("anchor_id", "positive_id", "rank").agg(*[F.first(c).alias(c) for c in ("positive_score", "score", "id")])


def search(index: Index, anchors: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """FOUND and rank, stored: of each window (anchor_id, positive_id, positive_score, lo, hi) the first k rows with the anchor's label (same) or with another."""
    tree, dim = index.tree, index.dim
    asked = lambda w: anchors.join(w.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score", "lo", "hi")).alias("windows")).withColumnRenamed("anchor_id", "id"), "id")
    home = materialise(_first(_visit(index, asked(windows), k, same), k), "gnat-home")
    if not isinstance(tree, Node):  # one leaf
        return home
    known = home.groupBy(F.col("anchor_id").alias("a"), F.col("positive_id").alias("p")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    tight = windows.join(known, (F.col("anchor_id") == F.col("a")) & F.col("positive_id").eqNullSafe(F.col("p")), "left").withColumn("lo", F.greatest("lo", "least"))  # greatest() skips nulls
    rest = asked(tight.select(*windows.columns))

    def plan(batches):
        for b in batches:
            windows = b.column("windows")
            size = np.asarray(pa.compute.list_value_length(windows), dtype=np.int64)
            starts = np.cumsum(size) - size
            lo, hi = (np.asarray(windows.flatten().field(c), dtype=np.int64) for c in ("lo", "hi"))
            own = np.asarray(b.column("leaf"))
            for leaf, which in leaves_for(tree, matrix(b.column("vec"), dim), np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)) if len(size) else []:
                which = which[own[which] != leaf]
                took = b.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), leaf), pa.int32()) if n == "leaf" else took.column(n) for n in b.schema.names], schema=b.schema)
        give_back()

    far = _visit(index, rest.mapInArrow(plan, rest.schema), k, same)
    return materialise(_first(home.drop("rank").unionByName(far), k), "gnat-found")


def _ceil(p: Column, part: tuple[int, int]) -> Column:
    """p * part rounded up, without leaving 64 bits."""
    a, b = part
    rest = F.pmod(p, F.lit(b))
    return F.call_function("div", p - rest, F.lit(b)) * a + F.ceil(rest * a / b)


def hard_negatives(vectors: DataFrame, chosen: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), **how) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over vectors (id, label, vec of whole numbers).

    chosen: which rows (by id, label) are anchors.  Of an anchor's first
    ``positives`` rows of its label each has its first ``negatives`` rows of other
    labels whose score lies between the parts low and high of the positive's.
    """
    index = build(vectors, **how)
    anchors = anchors_of(index, chosen)
    none = F.lit(None).cast("long")
    every = anchors.select(F.col("id").alias("anchor_id"), none.alias("positive_id"), none.alias("positive_score"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
    found = search(index, anchors, every, positives, True).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = found.withColumns({"lo": _ceil(F.col("positive_score"), low), "hi": -_ceil(-F.col("positive_score"), high)}).where("lo <= hi")
    out = search(index, anchors, windows, negatives, False)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantised(table, "vec_id", label, "embedding"), F.col("id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10"""
