import hashlib
import random

import numpy as np
import xxhash
from fieldmark.llm import suffix_dedup as S

from .helpers import documents, empty, words


def slow(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256) by a table of all windows."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - S.SPAN + 1):
            w = raw[s : s + S.SPAN]
            if w in seen:
                gone[s : s + S.SPAN] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=11):
    rng = random.Random(seed)
    passages = [words(rng, rng.randrange(15, 60)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [words(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages)[rng.randrange(20) :], words(rng, rng.randrange(0, 10))]
        texts.append(rng.choice([" ", "", "\n"]).join(parts))
    texts += texts[:5] + [t[:50] + "Ü" + t[50:] for t in texts[5:15]]
    texts += ["a" * 350, "a" * 99, "a" * 100, "ab" * 300, ("x" * 99 + "y") * 4, None, "", "\0" * 250, words(rng, 3000)]
    texts += [texts[0] + "\0" + passages[0] + "\0" * 3, passages[0], passages[0] + "\0"]
    return [(i * 7 % 997, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = slow(rows)
    for hot, size, fan in ((5000, 1 << 22, 4096), (5000, 6000, 2), (3, 6000, 4096), (1, 6000, 2), (1, 1 << 22, 4096)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.substring_dedup(docs, hot=hot, size=size, fan=fan).collect()}
        assert got == want, (hot, size, fan)


def test_many_occurrences_of_a_string(spark):
    """20 000 occurrences in differing surroundings, more than a tree may hold: the trees are divided, no member is left out."""
    rng = random.Random(4)
    passage = words(rng, 30)[:140]
    rows = [(i, f"{rng.getrandbits(60):x} {passage[rng.randrange(3) :]} {rng.getrandbits(60):x}") for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = slow(rows)
    for hot, size in ((S.HOT, 200_000), (10**9, 1 << 22)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.substring_dedup(docs, hot=hot, size=size).collect()}
        assert got == want, hot


def occurrences(raws, w):
    out = set()
    for i, raw in raws:
        at = raw.find(w)
        while at >= 0:
            out.add((i, at))
            at = raw.find(w, at + 1)
    return out


def test_repeat_groups_have_all_occurrences(spark):
    rows = corpus(5)
    raws = [(i, (t or "").encode()) for i, t in rows]
    by_id = dict(raws)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    windows = {}
    for i, raw in raws:
        for s in range(len(raw) - S.SPAN + 1):
            windows.setdefault(raw[s : s + S.SPAN], []).append((i, s))
    twice = {p for v in windows.values() if len(v) > 1 for p in v}
    for hot, size in ((5000, 1 << 22), (5000, 6000), (3, 6000), (1, 6000)):
        groups, covered = {}, set()
        for r in S.repeat_groups(docs, hot=hot, size=size).collect():
            groups.setdefault((r.group, r.length), []).append((r.doc_id, r.start))
            covered.update((r.doc_id, s) for s in range(r.start, r.start + r.length - S.SPAN + 1))
        assert covered == twice, (hot, size)
        for (name, length), places in groups.items():
            i, s = places[0]
            w = by_id[i][s : s + length]
            assert len(w) == length >= S.SPAN and name == f"{xxhash.xxh64_intdigest(w):016x}"
            assert len(places) == len(set(places)) > 1 and set(places) == occurrences(raws, w), (hot, size, name)


def test_groups_are_maximal_around_a_place():
    """Occurrences that go on alike on one side come as the longer group alone."""
    rng = random.Random(8)
    core = words(rng, 40)[:110]
    text = [f"{a}{core}{b}" for a, b in (("xq", "r1"), ("yq", "r2"), ("z", "r3"))]
    at = 30
    key = np.full(3, 9, np.uint64)
    pad = lambda b, n: np.array([c + 1 for c in b[:n]] + [0] * (n - len(b[:n])), np.uint8)
    raw = [t.encode() for t in text]
    place = [len(a) + at for a in ("xq", "yq", "z")]
    right = np.array([pad(r[p:], S.SPAN) for r, p in zip(raw, place, strict=True)])
    left = np.array([pad(r[:p][::-1], S.REACH) for r, p in zip(raw, place, strict=True)])
    n_right = np.array([min(S.SPAN, len(r) - p) for r, p in zip(raw, place, strict=True)])
    n_left = np.array([min(S.REACH, p) for p in place])
    m, a, b, g, first = S.repeats(key, left, right, n_left, n_right, np.arange(3), whole=True)
    found = sorted((int(a[g == k][0]), int(b[g == k][0]), sorted(m[g == k].tolist())) for k in set(g.tolist()))
    # all three share the core and the letter after it; two share the letter before it, too
    assert found == [(30, 81, [0, 1, 2]), (31, 81, [0, 1])]
    assert first.sum() == len(found)


def test_rows_of_one_id_stand_in_the_order_of_their_texts(spark):
    rng = random.Random(2)
    shared = words(rng, 60)
    texts = [f"{words(rng, 5)} {shared} {words(rng, 5)}" for _ in range(4)]
    rows = [(7, t) for t in texts] + [(7, texts[0]), (None, texts[1]), (None, shared)]
    want = None
    for parts in (1, 3, 7):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in S.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts), size=600).collect())
        assert want is None or got == want
        want = got
    first = min(texts, key=lambda t: xxhash.xxh64_intdigest(t.encode()))
    assert [r for r in want if r[2] == 0] == [("7", len(first.encode()), 0)]


def test_intervals():
    # suffixes of "banana" in order: a ana anana banana na nana
    assert sorted(S.intervals([1, 3, 0, 0, 2], 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_awkward_rows(spark):
    docs = documents(spark)
    got = S.substring_dedup(docs, texts=True).collect()
    assert len(got) == docs.count()
    same = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").collect()
    for r in same:  # of rows that repeat, one keeps its text
        kept = [g for g in got if g.doc_id == r.doc_id]
        assert sum(g.n_removed < g.n_bytes or g.n_bytes < S.SPAN for g in kept) >= 1
    assert S.substring_dedup(empty(spark)).count() == 0
    assert S.repeat_groups(empty(spark)).count() == 0
    assert S.repeat_groups(docs).where("length < 100 or start < 0").count() == 0
