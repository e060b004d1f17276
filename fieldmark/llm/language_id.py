"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its character 2- to 4-grams (within
words, a space marking either end), and a linear softmax over that mean names
the language.  It is trained by stochastic gradient descent in numpy on a
bounded sample: about ``per_lang`` labelled texts of each language outside the
held-out fold, drawn by their hash.  A fifth of the sample is kept from
training to fit the temperature and the rejection threshold, set so that at
most ``loss`` of the rightly named texts fall below it.

As mean and softmax weights are both linear, embeddings times weights is one
small table, so scoring is a look-up and a sum over the whole text.

Nulls: a null text, or one without a letter, is ``und`` with score 0 and not
accepted; a row with a null lang is never learned from; a null doc_id keeps
its row.  Without labelled rows everything is ``und``.  Repeated rows come out
as often; copies are learned from once.  Of languages with equal scores the
first by name is taken.  Very long texts are scored whole.  An empty table
gives an empty result.  Other columns are neither read nor changed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, fold_of, slices

BITS = 16
DIM = 16
GRAMS = (2, 3, 4)
UNKNOWN = "und"
_SPACE = np.uint32(32)


class Subwords:
    """Bucket numbers of all subwords of a text."""

    def __init__(self):
        self.letter = np.array([chr(c).isalpha() for c in range(1 << 16)])

    def __call__(self, text: str | None) -> np.ndarray | None:
        """None if there is no letter."""
        if not text:
            return None
        c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        keep = self.letter[np.minimum(c, 0xFFFF)]
        for i in np.flatnonzero(c > 0xFFFF):
            keep[i] = chr(c[i]).isalpha()
        if not keep.any():
            return None
        c = np.where(keep, c, _SPACE)
        out = []
        for n in GRAMS:
            if len(c) < n:
                break
            h = np.full(len(c) - n + 1, n, np.uint32)
            ok = c[: len(h)] != c[n - 1 :] if n == 2 else np.ones(len(h), bool)
            for k in range(n):
                part = c[k : k + len(h)]
                h = h * np.uint32(16777619) ^ part
                if 0 < k < n - 1:
                    ok &= part != _SPACE
            if n == 2:
                ok |= c[: len(h)] != _SPACE
            h ^= h >> np.uint32(15)
            out.append((h[ok] * np.uint32(2654435761)) >> np.uint32(32 - BITS))
        return np.concatenate(out)


class Model:
    """languages, the table of summed-up scores by bucket, bias, temperature and rejection threshold."""

    def __init__(self, langs, table, bias, temperature=1.0, threshold=0.0):
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, temperature, threshold

    def logits(self, buckets: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        if counts is None:
            total = np.zeros(len(self.langs))
            for i in range(0, len(buckets), 1 << 15):
                total += self.table[buckets[i : i + (1 << 15)]].sum(0, dtype=np.float64)
            return total / len(buckets) + self.bias
        return (counts @ self.table[buckets]) / counts.sum() + self.bias

    def predict(self, buckets: np.ndarray | None) -> tuple[str, float]:
        if buckets is None or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.logits(buckets) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(rows: list[tuple[str, np.ndarray, np.ndarray, bool]], epochs: int = 12, rate: float = 0.5, loss: float = 0.002, seed: int = 1) -> Model:
    """rows: (language, buckets, counts, kept for calibration) -> Model."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    index = {k: i for i, k in enumerate(langs)}
    learn = [r for r in rows if not r[3]] or rows
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1, 1, (1 << BITS, DIM)) / DIM
    weight, bias = rng.normal(0, 1 / DIM, (DIM, len(langs))), np.zeros(len(langs))
    share = np.zeros(len(langs))
    for r in learn:
        share[index[r[0]]] += 1
    pull = np.sqrt(len(learn) / (len(langs) * np.maximum(share, 1)))  # rare languages count for more
    steps, step = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            lang, buckets, counts, _ = learn[i]
            f = counts / counts.sum()
            hidden = f @ embed[buckets]
            g = softmax(hidden @ weight + bias)
            y = index[lang]
            g[y] -= 1
            g *= pull[y] * rate * (1 - step / steps)
            back = weight @ g
            weight -= np.outer(hidden, g)
            bias -= 0.1 * g
            embed[buckets] -= 10 * f[:, None] * back
            step += 1
    model = Model(langs, (embed @ weight).astype(np.float32), bias)
    held = [r for r in rows if r[3]] or rows
    z = np.array([model.logits(b, c) for _, b, c, _ in held])
    y = np.array([index[r[0]] for r in held])

    def cross(t):
        s = z / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y]).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 60)), key=cross)
    p = np.array([softmax(s / model.temperature).max() for s in z])
    right = p[z.argmax(1) == y]
    model.threshold = float(np.quantile(right, loss)) if len(right) else 0.0
    return model


def sample(docs: DataFrame, per_lang: int, most: int | None = None) -> list[tuple[str, np.ndarray, np.ndarray, bool]]:
    """Bucket counts of about per_lang texts of each language, never over twice as many; docs has text, lang.

    Texts are drawn by their own hash and copies count once, so neither null or
    repeated ids nor a hot text can swell the sample.  A text counts with all its
    buckets, of which there are no more than the table has, however long it is;
    with its ``most`` most frequent ones alone if a caller asks for that (no query does).
    """
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return []
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (draw < min(1.0, per_lang / n) * (1 << 20)))

    def run(batches):
        subwords = Subwords()
        for b in slices(batches):
            rows = []
            for lang, text, key in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "key")), strict=True):
                if (found := subwords(text)) is not None:
                    u, n = np.unique(found, return_counts=True)
                    if most is not None and len(u) > most:
                        top = np.sort(np.lexsort((u, -n))[:most])
                        u, n = u[top], n[top]
                    rows.append((lang, key, u.astype("<u2").tobytes(), n.astype("<f4").tobytes()))
            types = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["lang", "key", "b", "n"])

    drawn = known.where(chosen).select("lang", "text", F.xxhash64("text").alias("key")).mapInArrow(run, "lang string, key bigint, b binary, n binary").dropDuplicates(["lang", "key"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    got = drawn.withColumn("rank", rank).where(F.col("rank") <= 2 * per_lang).withColumn("held", F.pmod(F.xxhash64("key", F.lit("calibration")), F.lit(5)) == 0).collect()
    rows = [(r["lang"], np.frombuffer(r["b"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<f4").astype(float), r["held"]) for r in got]
    return sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))


def fit(docs: DataFrame, per_lang: int = 600, modulus: int = 3, held: int = 1) -> Model:
    return train(sample(docs.select("doc_id", "text", "lang").where(fold_of(F.col("doc_id"), modulus) != held), per_lang))


def with_language(docs: DataFrame, model: Model, keep: list[str], told: tuple[str, ...] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """keep, and under the names ``told`` the language, its probability and whether it is accepted, for each row of docs."""
    names = [*keep, *told]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in zip(told, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)])

    def run(batches):
        subwords = Subwords()
        for b in slices(batches):
            got = [model.predict(subwords(t)) for t in b.column("text").to_pylist()]
            ok = [lang != UNKNOWN and score >= model.threshold for lang, score in got]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(ok, pa.bool_())], names=names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = with_language(docs, fit(docs), ["doc_id"])
    return out.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")
