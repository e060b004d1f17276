import math
import random

import numpy as np
import pytest
from fieldmark.llm import hard_negatives as H
from pyspark.sql import functions as F


def plain(rows, chosen, positives=5, negatives=10):
    """The contract with plain loops over (id, label, vec)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    anchors = {}
    for i, lab, v in rows:
        if chosen(i):
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for i, (lab, v) in anchors.items():
        scored = sorted({(-dot(v, w), j) for j, o, w in rows if j != i and o == lab})[:positives]
        others = sorted({(-dot(v, w), j) for j, o, w in rows if j != i and o != lab})
        for s, p in scored:
            fits = [(n, j) for n, j in others if 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out += [(i, p, r, j, -s, -n) for r, (n, j) in enumerate(fits, 1)]
    return sorted(out)


def made(n, dim, clusters=6, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    at = rng.integers(clusters, size=n)
    return [(i, int(rng.integers(4)), np.floor(20 * (centres[at[i]] + spread * rng.normal(size=dim))).tolist()) for i in range(n)]


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "id bigint, label bigint, vec array<double>").repartition(3)
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("id") % 9 == 0, **how).collect())


@pytest.mark.parametrize("how", [{}, {"block_bytes": 8 * 6 * 40, "fanout": 3}])
def test_the_same_as_all_pairs(spark, how, monkeypatch):
    monkeypatch.setattr(H, "LEAF", 16)
    rows = made(400, 6)
    rows += [rows[9], rows[10], (18, 3, rows[18][2])]  # repeated rows, and an anchor's id with another label
    rows += [(1000 + i, i % 3, rows[40][2]) for i in range(80)]  # one vector that many rows share
    assert mined(spark, rows, **how) == plain(rows, lambda i: i % 9 == 0)


def test_block_search_prunes_and_stays_exact():
    rows = made(3000, 5, clusters=30, spread=0.05, seed=3)
    ids, labels, vecs = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    chosen = ids % 50 == 0
    score = (vecs[chosen] @ vecs.T).astype(np.int64)
    n = int(chosen.sum())
    hi = np.sort(score, 1)[:, -40]
    anchors = H.Anchors(ids[chosen], labels[chosen], vecs[chosen], np.arange(n), hi - 20, hi)
    scored = []
    real = H.survivors
    try:
        H.survivors = lambda *a: scored.append((out := real(*a)).mean()) or out
        w, s, i = H.search_block(ids, labels, vecs, anchors, 7, False, np.float64, leaf=32)
    finally:
        H.survivors = real
    want = []
    for a in range(n):
        fits = [(-score[a, j], ids[j]) for j in range(len(ids)) if labels[j] != anchors.labels[a] and hi[a] - 20 <= score[a, j] <= hi[a]]
        want += [(a, -x, y) for x, y in sorted(fits)[:7]]
    assert list(zip(w.tolist(), s.tolist(), i.tolist(), strict=True)) == [(a, int(x), int(y)) for a, x, y in want]
    assert np.mean(scored) < 0.5  # most siblings are eliminated where rows lie in clusters


def test_upper_tree_covers_every_row():
    rows = np.array([r[2] for r in made(2000, 4, clusters=12, seed=5)])
    tree, leaves = H.grow(rows[::4], 4.0, 100, 4)
    nodes = H.nodes_of(tree)
    got = {}
    H.walk(tree, rows, lambda node, d, nearest, which: got.__setitem__(id(node), H.ranges(d, np.sqrt((rows[which] ** 2).sum(1)), nearest, len(node.points))))
    for x in nodes:
        x.low, x.high, x.small, x.large = got[id(x)]
        x.large = np.where(np.isfinite(x.large), x.large, 0.0)
    at = H.walk(tree, rows)
    assert leaves > 8 and at.max() < leaves
    score = (rows[:50] @ rows.T).astype(np.int64)
    lo = np.sort(score, 1)[:, -15]
    hi = lo + 5
    met = np.zeros((50, leaves), bool)
    for leaf, which in H.leaves_for(tree, rows[:50], lo, hi):
        met[which, leaf] = True
    a, x = np.nonzero((score >= lo[:, None]) & (score <= hi[:, None]))
    assert met[a, at[x]].all() and met.mean() < 0.9


def test_rows_that_take_no_part_and_odd_lengths(spark):
    inf, nan = float("inf"), float("nan")
    table = [(i, 1 + i % 2, [0.5, i / 50]) for i in range(20)]
    table += [(100, None, [1.0, 1.0]), (101, 1, None), (102, 1, [1.0, None]), (103, 2, [inf, 0.0]), (104, 2, [nan, 0.0]), (None, 1, [1.0, 1.0]), (105, 1, []), (106, 2, [0.25]), (107, 1, [-0.1, 0.3, 0.7]), (108, 1, [3e38, 0.0])]
    df = spark.createDataFrame(table, "vec_id bigint, label int, embedding array<float>")
    rows = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in table if None not in (i, lab, v) and all(x is not None and abs(x) < 1e38 for x in v)]
    assert {i for i, _, _ in rows} == {*range(20), 105, 106, 107}
    got = H.hard_negatives(H.quantised(df, "vec_id", F.col("label"), "embedding"), F.col("id") % 4 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 4 == 0)


def test_scores_beyond_53_bits(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, [rng.randrange(-(1 << 29), 1 << 29) * 1.0 + i for _ in range(3)]) for i in range(60)]
    assert mined(spark, rows) == plain([(i, lab, [int(x) for x in v]) for i, lab, v in rows], lambda i: i % 9 == 0)


def test_no_rows_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert mined(spark, [(9, 1, [1.0, 2.0])]) == []
