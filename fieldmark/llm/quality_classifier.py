"""Quality classifier: regularised quadratic discriminant analysis.

Statistics of whole texts are transformed (logs and ratios), class means and
covariances come from partial sums that Spark adds up (one row per class, so
all labelled rows take part), covariances are shrunk towards the pooled one
and its diagonal, and each text is scored by the difference of the two log
densities, with Cholesky factors computed once.

Nulls: a null text is an empty text, a null label is no label.  Labels that
repeat for a doc_id count once (the smallest).  With fewer than two classes to
learn from, every score is the share of label 1 (0.5 without labels).  Repeated
rows come out as often, and count as often in the moments.  A score of exactly
one half predicts 1.  Texts are taken whole, whatever their length.  An empty
table gives an empty result.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fold_of, materialise
from .text_stats import FIELDS, with_stats

D = 12


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, D) transformed statistics."""
    f = {k: np.asarray(v, float) for k, v in s.items()}
    words, chars = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1)
    log_share = lambda a, b: np.log((f[a] + 0.5) / (b + 1))
    return np.stack([
        np.log1p(f["n_words"]),
        np.log((chars + 1) / (words + 1)),
        np.sqrt(f["n_symbols"] / words),
        np.sqrt(f["n_upper"] / np.maximum(f["n_ascii_letters"], 1)),
        np.sqrt(f["n_bang"] / words),
        np.sqrt(f["n_repeat_words"] / words),
        np.sqrt(f["n_dup_lines"] / np.maximum(f["n_lines"], 1)),
        log_share("n_distinct", words),
        np.sqrt(f["n_digits"] / chars),
        np.sqrt(f["n_stops"] / words),
        np.sqrt(f["n_high"] / chars),
        np.log1p(f["longest_word"]),
    ], axis=1)


class QuadraticDiscriminant:
    """Two Gaussian classes from their sums; shrink in [0, 1] moves covariances to the pooled one, ridge to its diagonal."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.2, ridge: float = 0.05):
        total = sum(s[0] for s in sums.values())
        self.prior = sums[1][0] / total if 1 in sums and total else (0.0 if total else 0.5)
        self.parts = {}
        if len(sums) < 2 or min(s[0] for s in sums.values()) < 2:
            return
        mean = {c: s[1] / s[0] for c, s in sums.items()}
        scatter = {c: s[2] - s[0] * np.outer(mean[c], mean[c]) for c, s in sums.items()}
        pooled = sum(scatter.values()) / total
        for c, (n, _, _) in sums.items():
            cov = (1 - shrink) * scatter[c] / n + shrink * pooled
            cov = (1 - ridge) * cov + ridge * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(pooled))
            low = np.linalg.cholesky(cov)
            self.parts[c] = (mean[c], low, 2 * np.log(np.diag(low)).sum(), np.log(n / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not self.parts:
            return np.full(len(x), self.prior)
        logs = {}
        for c, (mean, low, logdet, prior) in self.parts.items():
            z = np.linalg.solve(low, (x - mean).T)
            logs[c] = prior - 0.5 * ((z * z).sum(0) + logdet)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def class_sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and outer-product sum of the features for each class; partial sums per partition, then one row a class."""

    def partial(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            x = features({f: b.column(f).to_numpy(zero_copy_only=False) for f in FIELDS})
            x = np.hstack([np.ones((len(x), 1)), x])
            y = b.column("label").to_numpy(zero_copy_only=False)
            for c in np.unique(y):
                m = x[y == c]
                acc[int(c)] = acc.get(int(c), 0) + m.T @ m
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc)), pa.array([a.ravel().tolist() for a in acc.values()])], names=["label", "m"])

    parts = labelled.mapInArrow(partial, "label bigint, m array<double>")
    size = (D + 1) ** 2
    rows = parts.groupBy("label").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(size)]).alias("m")).collect()
    out = {}
    for r in rows:
        m = np.array(r["m"]).reshape(D + 1, D + 1)
        out[int(r["label"])] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1, shrink: float = 0.2) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; learns only from rows outside the held-out fold."""
    stat = materialise(with_stats(docs, ["doc_id"]), "stats")
    fold = stat.withColumn("held_out", fold_of(F.col("doc_id"), modulus) == held)
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("long").alias("label"))
    model = QuadraticDiscriminant(class_sums(fold.where(~F.col("held_out")).join(known, "doc_id").select("label", *FIELDS)), shrink)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches):
        for b in batches:
            p = model.score(features({f: b.column(f).to_numpy(zero_copy_only=False) for f in FIELDS}))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype("int32"))], names=schema.names)

    return fold.mapInArrow(score, schema)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
