import math
import zlib
from collections import Counter

import numpy as np
from fieldmark.llm import lm_scoring as L
from fieldmark.llm.common import fold_of
from pyspark.sql import functions as F

from .helpers import documents, empty


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def is_train(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


def test_base_and_model_against_brute_force(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    uni, pairs, contexts = Counter(), Counter(), Counter()
    for r in rows:
        if is_train(r.doc_id):
            t = [*tokens(r.text), None]
            uni.update(t)
            contexts.update(["<s>", *t[:-1]])
            pairs.update(zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(uni.values()), len(uni)
    seen = {}
    learn, L_learn = [], L.learn_weights
    L.learn_weights = lambda *a: learn.append(L_learn(*a)) or learn[-1]
    try:
        for size, fan in ((1 << 22, 4096), (2000, 4096), (2000, 2)):
            got = L.interpolated_scores(docs, fold_of(F.col("doc_id"), 5) != 1, size, fan).collect()
            seen[fan] = sorted(((g.doc_id is None, g.doc_id or 0, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6), round(g.score, 6)) for g in got))
            lam = learn[-1]
            want = []
            for r in rows:
                t = [*tokens(r.text), None]
                base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
                score = 0.0
                for h, w in zip(["<s>", *t[:-1]], t, strict=True):
                    c = contexts[h]
                    b = 1 + int(math.log2(c)) if c else 0
                    score += math.log10(lam[b][0] * pairs[h, w] / max(c, 1) + lam[b][1] * uni[w] / n + lam[b][2] / (v + 1))
                want.append((r.doc_id is None, r.doc_id or 0, len(t), sum(uni[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
            assert [x[:5] for x in seen[fan]] == [x[:5] for x in sorted(want)]
            assert np.allclose([x[5:] for x in seen[fan]], [x[5:] for x in sorted(want)], atol=2e-5)
    finally:
        L.learn_weights = L_learn
    assert seen[4096] == seen[2]


def test_weights_sum_to_one_and_follow_the_evidence():
    lam = L.learn_weights(np.array([5, 2, 0]), np.array([1000.0, 1000.0, 10.0]), np.array([0.5, 0.0, 0.0]), np.array([1e-4, 1e-3, 1e-3]), 1e6)
    assert np.allclose(lam.sum(1), 1) and lam[0, 0] == 0
    assert lam[5, 0] > 0.9 and lam[2, 1] > 0.9


def test_cells_give_the_weights_of_single_occurrences():
    rng = np.random.default_rng(3)
    vocabulary, n = 3000, 60_000
    nxt = rng.zipf(1.3, (vocabulary, 6)) % vocabulary
    seq = np.zeros(n, np.int64)
    for i in range(1, n):
        seq[i] = nxt[seq[i - 1], rng.integers(6)] if rng.random() < 0.6 else rng.zipf(1.2) % vocabulary
    uni, pairs = np.bincount(seq, minlength=vocabulary), Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True))
    h, w = seq[:-1], seq[1:]
    c_h, c_hw, c_w = uni[h] - 1, np.array([pairs[a, b] for a, b in zip(h.tolist(), w.tolist(), strict=True)]) - 1, uni[w] - 1
    f1, f2, bucket = c_hw / np.maximum(c_h, 1), c_w / (n - 1), L._bucket(c_h)
    exact = L.learn_weights(bucket, np.ones(len(w)), f1, f2, vocabulary)
    cell = (bucket * (L.DEPTH + 1) + L._level(f1)) * (L.DEPTH + 1) + L._level(f2)
    cells, at = np.unique(cell, return_inverse=True)
    count = np.bincount(at).astype(float)
    near = L.learn_weights(cells // (L.DEPTH + 1) ** 2, count, np.bincount(at, f1) / count, np.bincount(at, f2) / count, vocabulary)
    assert len(cells) < len(w) / 10 and np.abs(near - exact).max() < 0.001


def test_empty(spark):
    assert L.interpolated_scores(empty(spark), F.lit(True)).count() == 0
