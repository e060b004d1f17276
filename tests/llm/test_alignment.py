import collections
import hashlib
import random

import pytest
from fieldmark.llm import alignment as A

from .helpers import documents, empty


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner(A.byte_bpe(), A.piece_bpe())


def plain_groups(al, text):
    """Token by token over the whole text; None where tokens don't give it."""
    if not text:
        return None
    want = (" " + text).encode()
    a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    if b"".join(al.a_bytes[i] for i in a) != want or b"".join(al.b_bytes[i] for i in b) != want:
        return None
    groups, i, j, x, y, now = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            now[0].append(a[i])
            x += len(al.a_bytes[a[i]])
            i += 1
        else:
            now[1].append(b[j])
            y += len(al.b_bytes[b[j]])
            j += 1
        if x == y and now[0] and now[1]:
            groups.append(now)
            now = ([], [])
    return groups


def plain(al, rows):
    """The contract's columns by plain loops."""
    every, seen = [plain_groups(al, t) for _, t in rows], collections.Counter()
    for groups in every:
        seen.update({(a, b) for g in groups or [] for a in g[0] for b in g[1]})
    most = collections.Counter()
    for (a, _), n in seen.items():
        most[a] = max(most[a], n)
    out = []
    for (doc_id, _), groups in zip(rows, every, strict=True):
        links = [(a, b) for g in groups or [] for a in g[0] for b in g[1]]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups or [])
        out.append((doc_id, sum(len(g[0]) for g in groups or []), sum(len(g[1]) for g in groups or []), len(groups or []), len(links), hashlib.sha256(text.encode()).hexdigest() if text else "", sum(seen[p] == most[p[0]] for p in links), sum(seen[p] for p in links)))
    return sorted(out, key=str)


ODD = [
    "  two  spaces and\n\nlines\tand tabs \n", "x", " ", "\n", " lead", "trail ", "a  b c", "<|endoftext|> plain <s> <0x41> </s>", "U+2581 ▁ is a space to B", "naïve café straße Привет мир 你好 世界 🙂🙂 a b c　d e f",
    "word" * 300, "=" * 500 + " " + "-" * 77, "don't we've I'm", "1234567 89 0.5%", "\x00 nul \x1c sep \x85 nel", "é combining", "ab" * 40 + " " + "é" * 90,
]


def random_text(rng, n):
    return "".join(rng.choice(["the", " ", " ", "  ", "\n", "é", "你", "🙂", "ab", "'s", "7", ",", " ", "Tok", "en"]) for _ in range(n))


def test_units_are_tokenised_like_whole_texts(aligner):
    rng = random.Random(5)
    for text in [*ODD, *(random_text(rng, 200) for _ in range(60))]:
        want = plain_groups(aligner, text)
        counts, groups, _, key, times = aligner.documents([text])
        spelt = "".join(f"{','.join(map(str, x))}|{','.join(map(str, y))};" for x, y in want or [])
        assert groups[0] == spelt
        links = collections.Counter(a << A.B_BITS | b for g in want or [] for a in g[0] for b in g[1])
        assert dict(zip(key.tolist(), times.tolist(), strict=True)) == links
        assert counts[0].tolist() == [sum(len(g[0]) for g in want or []), sum(len(g[1]) for g in want or []), len(want or []), sum(links.values())]


def test_fragments_are_an_associative_monoid(aligner):
    rng = random.Random(9)

    def same(x, y):
        return (x.prefix, x.suffix, x.closed.keys.tolist(), x.closed.times.tolist(), x.closed.n_groups, x.closed.n_links, x.closed.valid) == (y.prefix, y.suffix, y.closed.keys.tolist(), y.closed.times.tolist(), y.closed.n_groups, y.closed.n_links, y.closed.valid)

    for text in [*(o.replace("▁", "_") for o in ODD), *(random_text(rng, 40) for _ in range(80))]:
        data = text.encode()
        i, j = sorted(rng.randrange(len(data) + 1) for _ in range(2))
        (x, tx), (y, ty), (z, tz) = (A.fragment(d, aligner) for d in (data[:i], data[i:j], data[j:]))
        xy, t1 = A.compose(x, y, aligner)
        left, t2 = A.compose(xy, z, aligner)
        yz, t3 = A.compose(y, z, aligner)
        right, t4 = A.compose(x, yz, aligner)
        whole, text_of_whole = A.fragment(data, aligner)
        assert same(left, right) and same(left, whole)
        assert tx + t1 + ty + t2 + tz == tx + t4 + ty + t3 + tz == text_of_whole
        nothing, _ = A.fragment(b"", aligner)
        assert same(A.compose(nothing, x, aligner)[0], x) and same(A.compose(x, nothing, aligner)[0], x)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"span": 700, "fan": 3, "size": 4000, "blocks": 3}])
def test_rows_are_those_of_plain_loops(spark, aligner, how):
    docs = documents(spark)
    more = [(7000 + i, t, *[None] * 7) for i, t in enumerate([*ODD, ODD[9], ODD[0] * 30])]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(4)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert told(A.aligned(docs, **how)) == plain(aligner, rows)


def test_no_rows(spark):
    assert told(A.aligned(empty(spark))) == []


def test_a_small_cache_changes_nothing():
    rng = random.Random(3)
    texts = [random_text(rng, 60) for _ in range(30)]
    big, small = A.Aligner(A.byte_bpe(), A.piece_bpe()), A.Aligner(A.byte_bpe(), A.piece_bpe(), keep=5)
    for at in range(0, 30, 5):
        one, two = (x.documents(texts[at : at + 5]) for x in (big, small))
        assert one[1] == two[1] and all((p == q).all() for p, q in zip(one[2:], two[2:], strict=True))
