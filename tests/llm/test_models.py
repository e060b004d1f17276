"""Language ID, quality rules, quality classifier and mixing."""

import math
import random
import re
from collections import Counter

import numpy as np
from fieldmark.llm import language_id as I
from fieldmark.llm import mixing as M
from fieldmark.llm import quality_classifier as C
from fieldmark.llm import quality_rules as R
from fieldmark.llm import text_stats as X
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .helpers import documents, empty

STEMS = {"aa": ["lorun", "mave", "teri", "sulo", "nari"], "bb": ["kryx", "vzto", "grzk", "plych", "dzwn"]}


def spoken(rng, lang, n):
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(STEMS[lang])[:3] for _ in range(n))


def labelled(spark, n=400):
    rng = random.Random(2)
    rows = [(i, spoken(rng, lang, rng.randrange(1, 60)), lang) for i in range(n) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(n, None, "aa"), (n + 1, "", "aa"), (n + 2, "123 ,. !", "bb"), (n + 3, spoken(rng, "aa", 30), None), (None, spoken(rng, "bb", 30), None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_languages(spark):
    docs = labelled(spark)
    out = I.with_language(docs, I.fit(docs, per_lang=100), ["doc_id", "lang"]).collect()
    assert len(out) == docs.count()
    known = [r for r in out if r.doc_id is not None and r.doc_id < 400]
    assert sum(r.lang == r.lang_pred for r in known) / len(known) > 0.99
    assert [(r.lang_pred, r.score, r.accepted) for r in out if r.doc_id in (400, 401, 402)] == [("und", 0.0, False)] * 3
    assert {r.doc_id: r.lang_pred for r in out}[None] == "bb"
    assert all(0 <= r.score <= 1 for r in out)
    assert I.with_language(empty(spark), I.fit(empty(spark)), ["doc_id"]).count() == 0
    assert {r.lang_pred for r in I.with_language(docs, I.fit(docs.withColumn("lang", F.lit(None).cast("string"))), ["doc_id"]).collect()} == {"und"}


def test_subwords_stay_within_words():
    s = I.Subwords()
    assert s("12 -") is None and s(None) is None
    assert sorted(s("ab  cd")) == sorted([*s("ab"), *s("cd")])


def slow_repeat_words(words, n=8):
    counts = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    covered = {i + k for i in range(len(words) - n + 1) if counts[tuple(words[i : i + n])] > 1 for k in range(n)}
    return len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b  é#|!."), max_size=120), st.integers(1, 4))
def test_base_counts(text, times):
    text *= times
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    got = dict(zip(X.FIELDS, X.stats(text), strict=True))
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
    assert got["n_dup_lines"] == len(lines) - len(set(lines))
    assert got["n_repeat_words"] == slow_repeat_words(words)


def noisy(spark, n=300):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        clean = spoken(rng, "aa", rng.randrange(25, 80)) + "."
        bad = [clean, " ".join(w + "%%%" for w in clean.split()), clean.upper().replace(" ", "!! "), " ".join(["same words"] * 40)][i % 4 if i % 3 == 0 else 0]
        rows.append((i, bad, int(bad == clean), 0))
    rows += [(n, None, None, None), (n + 1, "", 1, 0), (None, "no id here", None, None), (0, rows[0][1], rows[0][2], 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int")


def test_rules_find_defects_and_keep_clean_texts(spark):
    docs = noisy(spark)
    out = R.weak_quality(docs, keep=("doc_id", "quality")).collect()
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is not None and r.doc_id < 300:
            assert r.passed == bool(r.quality)
    assert R.weak_quality(empty(spark)).count() == 0


def test_votes_against_plain_expectation_maximisation():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.8
    votes = np.where(rng.random((4000, 4)) < 0.3, 1, np.where((rng.random((4000, 4)) < 0.9) == y[:, None], 2, 0))
    pattern, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, table = R.fit_votes(pattern, counts.astype(float))
    assert abs(share - 0.8) < 0.04
    accuracy = table[1, :, 2] / (table[1, :, 2] + table[1, :, 0])
    assert (abs(accuracy - 0.9) < 0.04).all()
    p = R.posterior(pattern, share, table)[inverse.ravel()]
    assert ((p > 0.5) == y).mean() > 0.9


def test_classifier_against_dense_formulas(spark):
    docs = noisy(spark)
    labels = docs.select("doc_id", "quality").distinct()
    out = C.quality_scores(docs.select("doc_id", "text"), labels).collect()
    rows = docs.collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    want = {r.doc_id: r.quality for r in rows}
    held = [r for r in out if r.held_out and want.get(r.doc_id) is not None and r.doc_id < 300]
    assert held and sum(r.predicted == want[r.doc_id] for r in held) / len(held) > 0.97
    rng = np.random.default_rng(1)
    x = {1: rng.normal(0, 1, (200, C.D)), 0: rng.normal(1, 2, (50, C.D))}
    model = C.QuadraticDiscriminant({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()}, shrink=0.3, ridge=0.1)
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in x.values()) / 250
    logs = []
    z = rng.normal(0.5, 1, (5, C.D))
    for c in (0, 1):
        cov = 0.7 * np.cov(x[c].T, bias=True) + 0.3 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(C.D)
        d = z - x[c].mean(0)
        logs.append(math.log(len(x[c]) / 250) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.score(z), 1 / (1 + np.exp(logs[0] - logs[1])))
    assert C.quality_scores(empty(spark).select("doc_id", "text"), labels).count() == 0
    assert {r.score for r in C.quality_scores(docs.select("doc_id", "text"), labels.limit(0)).collect()} == {0.5}


def test_mixing_meets_targets_and_drops_nothing(spark):
    docs = noisy(spark)
    labels = docs.select("doc_id", "quality", "toxic").distinct()
    out, found = M.mixing_rates(docs, labels, {"good": 0.6, "junk": 0.4}, rates=(1.0, 4.0))
    rows = out.collect()
    assert len(rows) == docs.count()
    reached = [sum(r.tokens * r.rate * r.p[i] for r in rows) for i in range(len(found["domains"]))]
    assert np.allclose(reached, found["reached"], rtol=1e-6) and np.allclose(reached, found["target"], rtol=0.01)
    assert all(1 <= r.rate <= 4 and math.floor(r.rate) <= r.copies <= math.ceil(r.rate) and abs(sum(r.p) - 1) < 1e-9 for r in rows)
    mixed = M.mixed(docs, labels, {"good": 0.6, "junk": 0.4}, (1.0, 4.0))
    assert mixed.columns == docs.columns
    assert mixed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert mixed.count() > docs.count()
    assert M.mixed(empty(spark), labels).count() == 0
    assert M.mixing_rates(docs, labels.limit(0))[0].where("rate <> 1 or copies <> 1").count() == 0


def test_free_rates_solve_least_squares(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(1, 100)), (lambda a: [float(a), float(1 - a)])(rng.random())) for i in range(200)]
    scored = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, p array<double>")
    steps, target, reached = M.solve(scored, ["a", "b"], {"a": 0.7, "b": 0.3}, (0.0, 10.0), rounds=200)
    assert np.allclose(reached, target, rtol=1e-3)
    rate = {r.doc_id: r.rate for r in scored.withColumn("rate", M._rate(steps, 0.0, 10.0)).collect()}
    assert min(rate.values()) >= 0
    total = np.array([sum(t * rate[i] * p[k] for i, t, p in rows) for k in range(2)])
    assert np.allclose(total, target, rtol=1e-3)


def test_slow_fit_comes_near_the_least_squares_solution(spark):
    rng = np.random.default_rng(0)
    x = rng.beta(2, 2, 200)
    p, tokens, target = np.stack([x, 1 - x], 1), rng.integers(1, 100, 200), None
    scored = spark.createDataFrame([(i, int(t), [float(a) for a in q]) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "doc_id bigint, tokens bigint, p array<double>")
    _, target, reached = M.solve(scored, ["a", "b"], {"a": 0.7, "b": 0.3}, (1.0, 4.0))
    gram = np.einsum("n,ni,nj->ij", tokens, p, p)
    scale = np.linalg.inv(gram + 0.01 * np.trace(gram) / 2 * np.eye(2))
    miss = lambda now: (now - target) @ scale @ (now - target)
    rate = np.ones(200)
    for _ in range(5000):
        rate = np.clip(rate - p @ (scale @ ((tokens * rate) @ p - target)), 1, 4)
    assert miss(reached) <= 1.02 * miss((tokens * rate) @ p)


def test_posteriors_below_a_thousandth_count(spark):
    docs = noisy(spark)
    labels = docs.select("doc_id", "quality", "toxic").distinct()
    rows = M.posteriors(docs, labels)[0].collect()
    assert any(0 < x < 0.0005 for r in rows for x in r.p)
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in rows)


def test_rates_rise_to_what_the_targets_need(spark):
    rows = [(i, 10, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(100)]
    scored = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, p array<double>")
    steps, target, reached = M.solve(scored, ["a", "b"], {"a": 0.9, "b": 0.1}, (1.0, math.inf))
    assert np.allclose(reached, target, rtol=0.01) and target.sum() > 3 * 1000
    steps, target, reached = M.solve(scored, ["a", "b"], {"a": 1.0, "b": 0.0})
    assert np.allclose(reached, target, atol=1) and abs(target.sum() - 1000) < 1


def test_posteriors_against_plain_formulas(spark):
    docs = noisy(spark)
    labels = docs.select("doc_id", "quality", "toxic").distinct()
    out, model = M.posteriors(docs, labels)
    words = M.typical_words(docs, M.labelled(labels, M.DOMAINS))
    assert words == model.typical
    domain = {r.doc_id: "junk" if r.quality == 0 else "toxic" if r.toxic == 1 else "good" for r in labels.collect() if r.doc_id is not None and (r.quality is not None or r.toxic == 1)}

    def plain(text):
        text = text or ""
        n = max(1.0, len(re.findall(r"[^\x20\x09-\x0D]+", text)))
        each = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        f = [math.log1p(len(each)), math.log((len(text) + 1) / (n + 1)), math.sqrt(len(set(each)) / n)]
        f += [math.sqrt(sum(test(c) for c in text) / n) for test in (str.isupper, lambda c: c in "0123456789", lambda c: not (c.isalnum() or c in " \t\n\x0b\f\r.,;:?'()\"-"), lambda c: c in ".,;:?")]
        for _, w in sorted(words.items()):
            if w:
                f.append(math.log1p(sum(x in w for x in re.findall(r"[^\x20\x09-\x0D]+", text.lower()))))
        return f

    rows = [(r.doc_id, r.text, plain(r.text)) for r in docs.collect()]
    known = [(domain[i], f) for i, t, f in rows if i in domain and (t or "").split()]
    names = sorted({d for d, _ in known})
    assert names == model.names
    logs = {}
    for name in names:
        x = np.array([f for d, f in known if d == name])
        logs[name] = (x.mean(0), x.var(0) + 0.01, math.log(len(x) / len(known)))
    want = []
    for i, t, f in rows:
        z = np.array([prior - 0.5 * (((np.array(f) - m) ** 2 / v) + np.log(v)).sum() if (t or "").split() else prior for m, v, prior in logs.values()])
        p = np.exp(z - z.max())
        want.append((-1 if i is None else i, *np.round(p / p.sum(), 6)))
    got = [(-1 if r.doc_id is None else r.doc_id, *np.round(r.p, 6)) for r in out.collect()]
    assert np.allclose(sorted(got), sorted(want), atol=2e-6)
