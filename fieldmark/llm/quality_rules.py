"""Quality rules by weak supervision.

Each rule votes good (2), bad (0) or abstains (1) on the statistics of a whole
text.  Spark counts the vote patterns; their number is bounded by
3 ** len(RULES) whatever the corpus size, so expectation-maximisation of the
rules' accuracies and of the class share runs on that table, and the posterior
of each pattern is joined back by broadcast (at most 19 683 rows).

Nulls: a null text is an empty text; a null doc_id stays null.  Repeated rows
are judged one by one.  A posterior of exactly the threshold passes.  Texts are
taken whole, whatever their length.  An empty table gives an empty result.
Columns other than text and those to keep are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .text_stats import with_stats

GOOD, ABSTAIN, BAD = 2, 1, 0


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _rule(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def _above(value: Column, good_to: float, bad_from: float) -> Column:
    """Small values are good, large ones bad, those between abstain."""
    return _rule(value, value >= bad_from, value <= good_to)


def rules() -> dict[str, Column]:
    """Name -> vote over the statistics' columns.  Texts under 20 words say too little: every rule abstains."""
    some = lambda v: F.when(F.col("n_words") >= 20, v)
    mean_word = some(_ratio("word_chars", "n_words"))
    variety = some(_ratio("n_distinct", "n_words"))
    long_text = F.col("n_words") > 2000
    return {
        "symbols": _above(some(_ratio("n_symbols", "word_chars")), 0.01, 0.05),
        "symbol_words": _above(some(_ratio("n_symbols", "n_words")), 0.05, 0.25),
        "upper": _above(some(_ratio("n_upper", "n_ascii_letters")), 0.15, 0.4),
        "bangs": _above(some(_ratio("n_bang", "n_words")), 0.05, 0.25),
        "repeats": _above(some(_ratio("n_repeat_words", "n_words")), 0.1, 0.3),
        "dup_lines": _above(some(_ratio("n_dup_lines", "n_lines")), 0.1, 0.5),
        "variety": _rule(variety, variety < 0.15, (variety > 0.35) & ~long_text),
        "word_length": _rule(mean_word, (mean_word < 2.5) | (mean_word > 14), mean_word.between(3, 10)),
        "digits": _above(some(_ratio("n_digits", "word_chars")), 0.05, 0.3),
    }


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, tol: float = 1e-7) -> tuple[float, np.ndarray]:
    """Class share and, for each class and rule, the probabilities of the three votes.

    votes: (patterns, rules) of 0, 1, 2; counts: (patterns,).  Starts from "any
    bad vote is a defect"; one pseudo count a cell keeps unseen votes possible.
    The classes can't swap: a rule whose good votes turn likelier under the
    bad class says nothing in that round.
    """
    k = votes.shape[1]
    onehot = votes[:, :, None] == np.arange(3)
    q = np.where((votes == BAD).any(1), 0.05, 0.95)
    share = 0.5
    table = np.full((2, k, 3), 1 / 3)
    last = -np.inf
    for _ in range(rounds):
        for c, w in ((1, q), (0, 1 - q)):
            n = np.einsum("p,pkv->kv", w * counts, onehot) + np.array([1, 1, 1])
            table[c] = n / n.sum(1, keepdims=True)
        good, bad = table[1, :, GOOD] / (table[1, :, GOOD] + table[1, :, BAD]), table[0, :, GOOD] / (table[0, :, GOOD] + table[0, :, BAD])
        for r in np.where(good < bad)[0]:
            table[:, r] = (table[0, r] + table[1, r]) / 2
        share = float(np.clip((q * counts).sum() / counts.sum(), 1e-6, 1 - 1e-6))
        rows = np.arange(k)
        log1 = np.log(share) + np.log(table[1][rows, votes]).sum(1)
        log0 = np.log(1 - share) + np.log(table[0][rows, votes]).sum(1)
        q = 1 / (1 + np.exp(np.clip(log0 - log1, -500, 500)))
        now = float((np.logaddexp(log0, log1) * counts).sum())
        if abs(now - last) <= tol * abs(now):
            break
        last = now
    return share, table


def posterior(votes: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    rows = np.arange(votes.shape[1])
    log1 = np.log(share) + np.log(table[1][rows, votes]).sum(1)
    log0 = np.log(1 - share) + np.log(table[0][rows, votes]).sum(1)
    return 1 / (1 + np.exp(np.clip(log0 - log1, -500, 500)))


def weak_quality(docs: DataFrame, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the statistics, ``posterior`` (probability of good quality), ``rule_votes`` and ``passed`` for each row."""
    named = rules()
    k = len(named)
    code = sum((v.cast("int") * 3**i for i, v in enumerate(named.values())), F.lit(0))
    voted = materialise(with_stats(docs, list(keep)).withColumn("rule_votes", code.cast("int")), "votes")
    got = voted.groupBy("rule_votes").count().collect()  # at most 3 ** k rows
    spark = docs.sparkSession
    if got:
        codes = np.array([r[0] for r in got])
        votes = codes[:, None] // 3 ** np.arange(k) % 3
        share, table = fit_votes(votes, np.array([r[1] for r in got], float))
        rows = list(zip(codes.tolist(), posterior(votes, share, table).tolist(), strict=True))
    else:
        rows = []
    table = spark.createDataFrame(rows, "rule_votes int, posterior double")
    return voted.join(F.broadcast(table), "rule_votes", "left").withColumn("passed", F.col("posterior") >= threshold)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    out = weak_quality(documents(spark, sf_dir))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("passed")).alias("kept"), F.round("posterior", 6).alias("posterior"),
    )
