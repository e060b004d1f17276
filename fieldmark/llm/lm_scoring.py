"""Language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood bigram and unigram
estimates and a uniform one.  The mixture weights depend on how often the
context was seen (a bucket per power of two) and are learned by
expectation-maximisation on held-out counts: each training occurrence is
scored by the counts with itself deleted.

Counts cover all training documents.  Every chunk of documents sends its
distinct keys with its own counts to the key ranges, gets the corpus totals
back, and scores its documents with them; the learning pass sums deleted
counts and estimates over cells of (bucket, bigram, unigram estimate by eighths
of an octave), whose number is bounded whatever the corpus size.  A cell stands
for its occurrences with their mean estimates; on the corpora of the tests the
weights come within 0.001 of those learned from single occurrences.

Nulls: a null text is an empty text (one end token); a null doc_id counts as
training.  Repeated rows are learned from and scored as often as they occur.
An empty table gives an empty result; without training rows only the uniform
part is left.  Nothing is ordered, so there are no ties.  A text is never cut: a
very long one is a chunk of its own.  Columns other than doc_id and text are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import CHUNK_BYTES, FAN, chunked, corpus_totals, pack_ints, ranges_for, salts_for, segments, unpack_ints, unseal
from .common import documents, fold_of, give_back

#: Neither can be a word, as both hold a space.
START, END = b" <s>", b" </s>"
BITS = {1: 64, 2: 56}
OCTAVE = 8  # cells in a power of two
DEPTH = 60 * OCTAVE


class Tokens:
    """A chunk's tokens: ids of word and context, document and fold of each, and the sorted distinct keys."""

    def __init__(self, table: pa.Table):
        self.doc_ids = table.column("doc_id")
        train = np.array(table.column("train").to_pylist(), bool)
        known: dict[bytes, int] = {START: 0, END: 1}
        number, ids, sizes = known.setdefault, [], []
        for text in table.column("text").cast(pa.binary()).to_pylist():
            words = (text or b"").lower().split()
            ids.append(0)
            ids += [number(w, len(known)) for w in words]
            ids.append(1)
            sizes.append(len(words) + 1)
        seq = np.array(ids, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        ends = np.cumsum(self.sizes + 1)
        last = np.ones(len(seq), bool)
        last[ends - 1] = False
        self.context = seq[last]
        first = np.ones(len(seq), bool)
        first[ends - self.sizes - 1] = False
        self.word = seq[first]
        self.train = train[self.doc] if len(train) else np.zeros(0, bool)
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(w) for w in known], np.uint64)
        order = np.argsort(hashes)
        self.keys = {1: hashes[order]}
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.place = place  # of an id among the sorted unigram keys
        with np.errstate(over="ignore"):
            k = (hashes[self.context] ^ (hashes[self.word] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xBF58476D1CE4E5B9)
        k ^= k >> np.uint64(32)
        self.keys[2], self.pair = np.unique(k >> np.uint64(64 - BITS[2]), return_inverse=True)

    def counts(self, order: int) -> np.ndarray:
        at = self.place[self.word] if order == 1 else self.pair
        return np.bincount(at[self.train], minlength=len(self.keys[order]))


def corpus_counts(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """Corpus totals of a chunk's sorted n-grams (``corpus_totals``); a part is the n-gram's length and its key range."""
    ranges = ranges_for(chunks)

    def send(batches):
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload").to_pylist(), strict=True):
                tokens, rows = Tokens(unseal(payload)), []
                for n in BITS:
                    keys, counts = tokens.keys[n], tokens.counts(n)
                    rows += [(n << 40 | p, pack_ints(keys[x:y], True), pack_ints(counts[x:y])) for p, x, y in segments(keys, ranges, BITS[n])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary())))],
                    names=["chunk", "part", "keys", "counts"],
                )
        give_back()

    sent = chunks.select("chunk", "payload").mapInArrow(send, "chunk string, part bigint, keys binary, counts binary")
    return corpus_totals(sent, salts_for(chunks, fan), "ngram-totals")


def _totals(answers: pa.Table) -> dict[int, np.ndarray]:
    got = {n: [] for n in BITS}
    for part, data in zip(*(answers.column(c).to_pylist() for c in ("part", "data")), strict=True):
        got[part >> 40].append((part, data))
    return {n: np.concatenate([unpack_ints(d) for _, d in sorted(x)]).astype(float) if x else np.zeros(0) for n, x in got.items()}


def _bucket(seen: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one for each power of two."""
    return np.where(seen > 0, 1 + np.floor(np.log2(np.maximum(seen, 1))), 0).astype(np.int64)


def _level(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else its step of the scale."""
    return np.where(p > 0, np.clip(1 + np.rint(-OCTAVE * np.log2(np.maximum(p, 1e-300))), 1, DEPTH), 0).astype(np.int64)


def deleted_cells(tokens: Tokens, totals: dict[int, np.ndarray], n_all: float) -> tuple[np.ndarray, ...]:
    """(cell, bucket, occurrences, sums of bigram and unigram estimates) of training occurrences, each scored without itself."""
    at = np.flatnonzero(tokens.train)
    c_w = totals[1][tokens.place[tokens.word[at]]] - 1
    end = totals[1][tokens.place[1]]
    c_h = np.where(tokens.context[at] == 0, end, totals[1][tokens.place[tokens.context[at]]]) - 1
    c_hw = totals[2][tokens.pair[at]] - 1
    f1 = c_hw / np.maximum(c_h, 1)
    f2 = c_w / max(n_all - 1, 1)
    cell = (_bucket(c_h) * (DEPTH + 1) + _level(f1)) * (DEPTH + 1) + _level(f2)
    cells, at = np.unique(cell, return_inverse=True)
    return cells, cells // (DEPTH + 1) ** 2, np.bincount(at, minlength=len(cells)), np.bincount(at, f1, len(cells)), np.bincount(at, f2, len(cells))


def learn_weights(bucket: np.ndarray, weights: np.ndarray, bigram: np.ndarray, unigram: np.ndarray, vocabulary: float, rounds: int = 60) -> np.ndarray:
    """(buckets, 3) mixture weights of bigram, unigram and uniform by expectation-maximisation.

    Each bucket is drawn to the weights of all buckets together with the
    strength of ten occurrences, so that sparse buckets stay sound; an unseen
    context has no bigram weight.
    """
    n = 66
    f = np.stack([bigram, unigram, np.full(len(bucket), 1 / (vocabulary + 1))], 1)
    everywhere = np.full(3, 1 / 3)
    lam = np.tile(everywhere, (n, 1))
    lam[0] = (0, 0.5, 0.5)
    for _ in range(rounds if len(bucket) else 0):
        part = lam[bucket] * f
        part *= (weights / np.maximum(part.sum(1), 1e-300))[:, None]
        got = np.stack([np.bincount(bucket, part[:, k], n) for k in range(3)], 1)
        everywhere = got.sum(0) / got.sum()
        lam = got + 10 * everywhere
        lam[0, 0] = 0
        lam /= lam.sum(1, keepdims=True)
    lam = np.maximum(lam, 1e-7)
    lam[0, 0] = 0
    return lam / lam.sum(1, keepdims=True)


OUT = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]


def _scores(tokens: Tokens, totals: dict[int, np.ndarray], n_all: float, vocabulary: float, lam: np.ndarray) -> list[np.ndarray]:
    docs = len(tokens.sizes)
    c_w = totals[1][tokens.place[tokens.word]]
    c_h = np.where(tokens.context == 0, totals[1][tokens.place[1]], totals[1][tokens.place[tokens.context]])
    base = np.log10((c_w + 0.5) / (n_all + 0.5 * (vocabulary + 1)))
    w = lam[_bucket(c_h)]
    p = w[:, 0] * totals[2][tokens.pair] / np.maximum(c_h, 1) + w[:, 1] * c_w / max(n_all, 1) + w[:, 2] / (vocabulary + 1)
    per_doc = lambda x: np.bincount(tokens.doc, x, docs)
    return [tokens.sizes, per_doc(c_w > 0).astype(np.int64), per_doc(base), per_doc(np.log10(p))]


def interpolated_scores(docs: DataFrame, train, size: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for each row; train: which rows to learn from."""
    chunks = chunked(docs.select("doc_id", "text", train.alias("train")), "lm-chunks", size)
    counts = corpus_counts(chunks, fan)
    whole = counts.where(F.col("chunk").isNull() & (F.shiftright("part", 40) == 1)).agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    n_all, vocabulary = float(whole["n"] or 0), float(whole["v"] or 0)
    answers = counts.where("chunk is not null")
    texts = chunks.select("chunk", "payload")

    def histogram(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens = Tokens(unseal(left.column("payload")[0].as_py()))
        cell, bucket, n, f1, f2 = deleted_cells(tokens, _totals(right), n_all)
        return pa.table({"cell": pa.array(cell, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "n": pa.array(n, pa.int64()), "f1": pa.array(f1), "f2": pa.array(f2)})

    both = lambda f, schema: texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(f, schema)
    cells = both(histogram, "cell bigint, bucket bigint, n bigint, f1 double, f2 double").groupBy("cell", "bucket").agg(*[F.sum(c).alias(c) for c in ("n", "f1", "f2")])
    got = cells.select("bucket", "n", "f1", "f2").toArrow()  # a row a cell
    bucket, n, f1, f2 = (got.column(c).to_numpy() for c in ("bucket", "n", "f1", "f2"))
    lam = learn_weights(bucket, n.astype(float), f1 / np.maximum(n, 1), f2 / np.maximum(n, 1), vocabulary)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("train", T.BooleanType())] + [T.StructField(n, t) for n, t in OUT])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        table = unseal(left.column("payload")[0].as_py())
        cols = _scores(Tokens(table), _totals(right), n_all, vocabulary, lam)
        return pa.table([table.column("doc_id"), table.column("train"), *map(pa.array, cols)], names=schema.names)

    return both(score, schema).withColumn("train_tokens", F.lit(int(n_all)).cast("long"))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    out = interpolated_scores(documents(spark, sf_dir), fold_of(F.col("doc_id"), 5) != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
