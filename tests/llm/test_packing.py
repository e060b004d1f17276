import tracemalloc
import zlib

import numpy as np
import pytest
from fieldmark.llm import packing as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from .helpers import documents, empty


@pytest.fixture(scope="module")
def tokens():
    return P.Tokens(P.word_tokenizer(), keep=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=255), st.sampled_from("ab é'sKİſ<|ΣΩ中́")), max_size=40), min_size=1, max_size=4))
def test_ids_are_the_tokenizers(texts):
    t = test_ids_are_the_tokenizers.tokens
    assert t.encode(texts) == [np.array(t.model.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


test_ids_are_the_tokenizers.tokens = P.Tokens(P.word_tokenizer(), keep=50)


def test_repeated_characters(tokens):
    words = ["a" * n for n in range(1, 60)] + ["!" * n for n in range(1, 60)] + ["hahaha" * n for n in range(1, 9)] + ["<|endoftext|> x", "x<|y"]
    assert tokens.encode(words) == [np.array(tokens.model.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in words]


def one_by_one(lengths, limit):
    """Best-two-fit without repeated fillings."""
    left, out = sorted(lengths), []
    while left:
        bin_, gap = [], limit
        while fit := [x for x in left if x <= gap]:
            bin_.append(fit[-1])
            left.remove(fit[-1])
            gap -= fit[-1]
        small = bin_[-1]
        if gap and len(bin_) > 1:
            best = max(((a + b, a, b) for i, a in enumerate(left) for b in left[:i] if small < a + b <= gap + small), default=None)
            if best:
                bin_[-1:] = best[1:]
                left.remove(best[1])
                left.remove(best[2])
                left = sorted([*left, small])
        out.append(sum(bin_))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_is_packing_one_by_one(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, int)
    plan = P.best_two_fit(counts, 40)
    used = np.zeros(41, int)
    for times, filling in plan:
        assert 0 < sum(filling) <= 40 and times > 0
        np.add.at(used, filling, times)
    assert (used == counts).all()
    assert sum(t for t, _ in plan) == len(one_by_one(lengths, 40))


def test_documents(spark):
    docs = documents(spark)
    model = Tokenizer.from_file(P.word_tokenizer())
    got = P.packed_documents(docs, limit=64).collect()
    want = []
    for r in docs.collect():
        ids = [*model.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 64)):
            want.append((r.doc_id is None, r.doc_id or 0, k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())))
    assert sorted((g.doc_id is None, g.doc_id or 0, g.piece, g.start, g.length, g.ids_crc32) for g in got) == sorted(want)
    places = {}
    for g in got:
        places.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 64
    assert len(places) <= 1.03 * sum(g.length for g in got) / 64 + 1
    assert P.packed_documents(empty(spark)).count() == 0


def test_equal_rows_are_ranked_in_as_many_tasks_as_partitions_hold_them(spark, monkeypatch):
    stored, plain = {}, P.materialise
    monkeypatch.setattr(P, "materialise", lambda df, label, *kept: stored.setdefault(label, plain(df, label, *kept)))
    docs = spark.range(0, 4000, 1, 8).selectExpr("cast(null as bigint) as doc_id", "'' as text")
    got = P.packed_documents(docs, limit=64).collect()
    salts = stored["pieces"].groupBy("salt").count().collect()
    assert len(salts) > 4 and max(r["count"] for r in salts) < 1600
    assert sorted((g.sequence_id, g.offset) for g in got) == [(i, k) for i in range(63) for k in range(64 if i < 62 else 4000 - 62 * 64)]


WIDE = [
    "Привет, мир! ЁЖИК в тумане №5", "“curly” – dashes — and ‘quotes’ don’t", "你好，世界。今天天气很好！", "こんにちは 世界 カタカナ", "ภาษาไทยไม่มีช่องว่าง", "ΟΔΥΣΣΕΥΣ ὈΔΥΣΣΕΎΣ Σ ς", "İstanbul ışık KELVIN K Å", "한국어 한글 \u1112\u1161\u11ab",
    "e\u0301 combining n\u0303 ﬁ ligature ǅ", "emoji 🙂🙂 and 👩‍👩‍👧 zwj", "٣٤٥ عربي शून्य १२३", "a\u200bb\u00a0c\u2003d\u3000e\u2028f\u1680g", "x\x1cy\x1dz", "①②③ Ⅻ ½ 二", "Ⴀა Ა Ꭰꭰ", "\U0001d54f \U00020000 \U0001e900", "<|startoftext|> Ж <|", "it’s I'M ‘tis 'Ж'S",
]


def test_every_script_is_split_as_the_tokenizer_does(tokens):
    model = Tokenizer.from_file(P.word_tokenizer())
    texts = WIDE + [" ".join(WIDE)]
    for t, ids in zip(texts, tokens.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t, add_special_tokens=False).ids, t
    assert sum(tokens._words(t) is None for t in WIDE) <= 4  # controls, special tokens, young letters


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=4))
def test_ids_of_any_characters(texts):
    model = MODEL
    for t, ids in zip(texts, SHARED.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=0x100, max_codepoint=0x2FFF), max_size=30), min_size=1, max_size=4))
def test_ids_of_living_scripts(texts):
    for t, ids in zip(texts, SHARED.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == MODEL.encode(t, add_special_tokens=False).ids


MODEL, SHARED = Tokenizer.from_file(P.word_tokenizer()), P.Tokens(P.word_tokenizer(), keep=50)


def test_white_space_is_the_tokenizers(tokens):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    settled = [c for c in every if tokens._words(c) is not None]
    parts = P.pc.list_value_length(P.pc.utf8_split_whitespace(P.pa.array([f"a{c}b" for c in settled]))).to_pylist()
    spaces = [c for c, n in zip(settled, parts, strict=True) if n == 2]
    assert spaces == [c for c in settled if P.regex.match(r"\s", c)]
    texts = [x for c in spaces for x in (f"a{c}b", f"{c}", f"{c}{c}a {c}!b{c}")]
    for t, ids in zip(texts, tokens.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == MODEL.encode(t, add_special_tokens=False).ids, t


def test_repeated_words_are_no_python_objects():
    tokens = P.Tokens(P.word_tokenizer())
    text = " ".join(f"word{i % 997}" for i in range(300_000))
    want = b"".join(np.array(MODEL.encode(f"word{i}", add_special_tokens=False).ids, "<u4").tobytes() for i in range(997))
    tokens.encode([text[:100]])
    tracemalloc.start()
    try:
        (got,) = tokens.encode([text])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[: len(want)] == want and got[len(want) : 2 * len(want)] == want
    assert peak - 2 * len(got) - len(text) < 4 << 20  # 35 MB when each word was a string


@pytest.mark.parametrize("keep, most", [(10**6, 16 << 20), (20, 16 << 20), (10**6, 700), (0, 0)])
def test_what_a_full_cache_drops_is_worked_out_again(keep, most):
    asked = []

    def find(keys):
        asked.extend(keys.to_pylist())
        return P.pa.array([k.encode() * 2 for k in keys.to_pylist()], P.pa.large_binary())

    known = P.Known(find, keep, most)
    for first in (0, 5, 10, 10, 40, 0):
        keys = [f"k{i}" for i in range(first, first + 15)]
        assert known(P.pa.array(keys, P.pa.large_string())).to_pylist() == [k.encode() * 2 for k in keys]
        assert len(known.keys) <= keep and known.keys.nbytes + known.ids.nbytes <= most
    assert known.joined(P.pa.array([["k1", "k2"], [], ["k1"]], P.pa.list_(P.pa.large_string()))).to_pylist() == [b"k1k1k2k2", b"", b"k1k1"]
    assert len(asked) == len(set(asked)) if keep == 10**6 and most > 700 else len(asked) > 45
