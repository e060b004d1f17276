"""Mixing sources to target weights by soft membership, with DataFrame functions only.

A Gaussian naive Bayes classifier over text statistics, learned from a labelled
table, gives each document a posterior over the domains.  Besides lengths and
shares of kinds of characters, its statistics count words that are typical of a
domain; these are learned, too, from at most about ``per_domain`` labelled
documents of each domain, drawn by a hash of the id.  A document's tokens count
for a domain as far as it belongs there.  Document rates r >= 0 then minimise
the squared distance of the expected token totals A r to the targets by
projected gradient steps, r <- clip(r - p . step), scaled by the inverse of the
small matrix sum(tokens p p') so that few steps are needed.  Each step is one
aggregate over the stored tokens and posteriors, which are not rounded; a rate
is a fold of the steps so far, so no document leaves its partition.

Nulls: a null text has no tokens; without tokens, or without labelled rows, a
posterior is the prior.  A null doc_id keeps its row.  Labels that repeat for a
doc_id count once (the smallest).  A domain that no label names gets no
posterior, and its target is left out.  Repeated rows count as often as they
occur; equal texts have equal rates, but copies are drawn by id.  Ties between
words go by the word.  Very long texts are taken whole.  An empty table gives
an empty result.  Columns of docs that share a name with ours stay as they are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh, materialise

#: Domain -> condition over the labelled table, the first that holds.
DOMAINS = {"junk": "quality = 0", "toxic": "toxic = 1", "good": "quality = 1"}
#: Domain -> share of the mixed tokens.
WEIGHTS = {"good": 0.78, "toxic": 0.11, "junk": 0.11}
#: Rates are not negative; nothing else bounds them unless the caller does.
RATES = (0.0, math.inf)
#: Kinds of characters whose share of a text's words is a statistic.
KINDS = {"f_capital": r"\p{Lu}", "f_digit": r"[0-9]", "f_symbol": r"[^\p{L}\p{N}\s.,;:?'()\"-]", "f_stop": r"[.,;:?]"}
PER_DOMAIN, TYPICAL = 2000, 30


def words_of(text: Column) -> Column:
    """The lower-case words of a text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def labelled(labels: DataFrame, domains: dict[str, str]) -> DataFrame:
    """doc_id and its domain, once."""
    domain = F.lit(None).cast("string")
    for name, condition in reversed(domains.items()):
        domain = F.when(F.expr(condition), name).otherwise(domain)
    known = labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null")
    return materialise(known.groupBy("doc_id").agg(F.min("domain").alias("domain")), "mix-labels")


def typical_words(docs: DataFrame, known: DataFrame, per_domain: int = PER_DOMAIN, most: int = TYPICAL) -> dict[str, list[str]]:
    """Domain -> at most ``most`` words that are over four times as frequent in its documents as in the others."""
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}  # a row a domain
    draw = F.pmod(F.xxhash64("doc_id", F.lit("words")), F.lit(1 << 20))
    chosen = F.lit(False)
    for name, n in sizes.items():
        chosen = chosen | ((F.col("domain") == name) & (draw < min(1.0, per_domain / n) * (1 << 20)))
    texts = docs.select("doc_id", "text").join(known.where(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    each = materialise(texts.select("domain", F.array_distinct(words_of(F.col("text"))).alias("words")), "mix-words")
    n = {r["domain"]: r["count"] for r in each.groupBy("domain").count().collect()}
    seen = each.select("domain", F.explode("words").alias("word")).groupBy("word").pivot("domain", sorted(n)).count().na.fill(0)
    seen = materialise(seen, "mix-word-counts") if n else None
    found = {}
    for name in sorted(n):
        rest = sum(n.values()) - n[name]
        here = (F.col(f"`{name}`") + 0.5) / (n[name] + 1)
        there = (sum((F.col(f"`{o}`") for o in n if o != name), F.lit(0)) + 0.5) / (rest + 1)
        ranked = seen.where((F.col(f"`{name}`") >= 5) & (here > 4 * there)).orderBy((here * F.log(here / there)).desc(), "word")
        found[name] = [r["word"] for r in ranked.limit(most).select("word").collect()]  # at most ``most`` words
    return found


def names_of(typical: dict[str, list[str]]) -> list[str]:
    """The classifier's statistics."""
    return ["f_words", "f_mean", "f_distinct", *KINDS, *(f"f_typical_{i}" for i, (_, words) in enumerate(sorted(typical.items())) if words)]


def _among(words: str, some: list[str]) -> Column:
    return F.filter(words, lambda w: w.isin(*some))


def with_statistics(df: DataFrame, typical: dict[str, list[str]], stats: str) -> DataFrame:
    """df with a struct ``stats``: ``tokens`` (words of the whole text) and the statistics.  Words are cut once, typical ones looked up once."""
    words, hits = (fresh(n, [*df.columns, stats]) for n in ("_words", "_hits"))
    every = sorted({w for some in typical.values() for w in some})
    df = df.withColumn(words, words_of(F.col("text")))
    df = df.withColumn(hits, _among(words, every) if every else F.array().cast("array<string>"))
    text, tokens = F.coalesce(F.col("text"), F.lit("")), F.size(words).cast("long")
    n = F.greatest(tokens.cast("double"), F.lit(1.0))
    found = {"tokens": tokens, "f_words": F.log1p(tokens.cast("double")), "f_mean": F.log((F.length(text) + 1) / (n + 1)), "f_distinct": F.sqrt(F.size(F.array_distinct(words)) / n)}
    found |= {name: F.sqrt(F.regexp_count(text, F.lit(kind)) / n) for name, kind in KINDS.items()}
    for i, (_, some) in enumerate(sorted(typical.items())):
        if some:
            found[f"f_typical_{i}"] = F.log1p(F.size(_among(hits, some)).cast("double"))
    return df.withColumn(stats, F.struct(*[c.alias(x) for x, c in found.items()])).drop(words, hits)


class Membership:
    """The classifier: typical words, and means and variances of the statistics by domain (``rows``, a row a domain)."""

    def __init__(self, typical: dict[str, list[str]], rows: list, spread: float = 0.01):
        self.typical, self.rows, self.spread = typical, rows, spread
        self.names, self.total = [r["domain"] for r in rows], sum(r["n"] for r in rows)

    def _density(self, row, stats: Column) -> Column:
        """Log density of the statistics under one domain's means and variances."""
        out = F.lit(math.log(row["n"] / self.total))
        for f in names_of(self.typical):
            var = (row[f"{f}_var"] or 0.0) + self.spread
            out = out - (stats[f] - row[f"{f}_avg"]) * (stats[f] - row[f"{f}_avg"]) / (2 * var) - 0.5 * math.log(var)
        return out

    def scored(self, df: DataFrame, stats: str, p: str) -> DataFrame:
        """df with the posteriors as an array ``p``, from its struct of statistics."""
        prior = F.array(*[F.lit(r["n"] / self.total) for r in self.rows]) if self.rows else F.array().cast("array<double>")
        if not self.rows:
            return df.withColumn(p, prior)
        logs, e = fresh("_logs", [*df.columns, p]), fresh("_e", [*df.columns, p])
        df = df.withColumn(logs, F.array(*[self._density(r, F.col(stats)) for r in self.rows]))
        df = df.withColumn(e, F.transform(logs, lambda x: F.exp(x - F.array_max(logs))))
        share = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        return df.withColumn(p, F.when(F.col(stats)["tokens"] > 0, share).otherwise(prior)).drop(logs, e)


def posteriors(docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS) -> tuple[DataFrame, Membership]:
    """(doc_id, tokens and an array ``p`` of posteriors, stored; the classifier, whose ``names`` are in the order of p)."""
    known = labelled(labels, domains)
    typical = typical_words(docs, known)
    stats = materialise(with_statistics(docs.select("doc_id", "text"), typical, "stats").select("doc_id", "stats.*"), "mix-stats")
    moments = [f(x).alias(f"{x}_{n}") for x in stats.columns[2:] for n, f in (("avg", F.avg), ("var", F.var_pop))]
    rows = stats.where("tokens > 0").join(known, "doc_id").groupBy("domain").agg(F.count("*").alias("n"), *moments).orderBy("domain").collect()  # a row a domain
    model = Membership(typical, rows)
    held = stats.select("doc_id", "tokens", F.struct(*stats.columns[1:]).alias("stats"))
    return materialise(model.scored(held, "stats", "p").drop("stats"), "posteriors"), model


def _rate(steps: list[np.ndarray], low: float, high: float, p: str = "p") -> Column:
    """The rate after the steps so far: each moves it along the document's posteriors and clips it."""
    start = F.lit(max(low, min(high, 1.0)))
    if not steps:
        return start
    given = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])

    def move(rate, step):
        along = F.aggregate(F.zip_with(p, step, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.least(F.lit(high), F.greatest(F.lit(low), rate - along))

    return F.aggregate(given, start, move)


def solve(scored: DataFrame, names: list[str], weights: dict[str, float], rates: tuple[float, float] = RATES, rounds: int = 40, tol: float = 1e-6) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps, targets, totals reached): totals and the matrix have a row a domain, whatever the corpus size.

    Targets are the weights' shares of the least total for which no domain
    must shrink below the rates' lower bound.
    """
    d = len(names)
    low, high = rates
    if not d:
        return [], np.zeros(0), np.zeros(0)

    def sums(*extra):
        return scored.agg(*[F.coalesce(x, F.lit(0.0)) for x in extra]).first()

    pick = lambda i: F.col("p")[i]
    first = sums(*[F.sum(F.col("tokens") * pick(i)) for i in range(d)], *[F.sum(F.col("tokens") * pick(i) * pick(j)) for i in range(d) for j in range(d)])
    have, gram = np.array(first[:d], float), np.array(first[d:], float).reshape(d, d)
    w = np.array([weights.get(n, 0.0) for n in names])
    if not have.sum() or not w.sum():
        return [], have, have
    w = w / w.sum()
    total = max(low * max((h / x for h, x in zip(have, w, strict=True) if x > 0), default=0.0), have.sum() * min(1.0, high))
    target = np.where(w > 0, w * total, low * have)
    scale = np.linalg.inv(gram + 0.01 * np.trace(gram) / d * np.eye(d))  # damped where domains are hard to tell apart
    steps: list[np.ndarray] = []
    best, reached = np.inf, have
    for _ in range(rounds):
        now = sums(*[F.sum(F.col("tokens") * pick(i) * _rate(steps, low, high)) for i in range(d)])
        now = np.array(now, float)
        off = now - target
        miss = float(off @ scale @ off)
        if miss >= best * (1 - 1e-3):  # no longer nearer: keep what was reached before
            steps = steps[:-1]
            break
        best, reached = miss, now
        if np.abs(off).sum() <= tol * target.sum():
            break
        steps.append(scale @ off)
    else:
        steps = steps[:-1]  # the last one's effect was not looked at
    return steps, target, reached


def copies(rate: Column, doc_id: Column, seed: int = 7) -> Column:
    """Whole copies whose expectation is the rate: its fraction is drawn by a hash of the id."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, domains: dict[str, str] = DOMAINS, rates: tuple[float, float] = RATES) -> tuple[DataFrame, dict]:
    """(doc_id, tokens, p, rate and copies for each row of docs; domains, targets, totals reached, steps and the classifier)."""
    scored, model = posteriors(docs, labels, domains)
    steps, target, reached = solve(scored, model.names, weights, rates)
    out = scored.withColumn("rate", _rate(steps, *rates)).withColumn("copies", copies(F.col("rate"), F.col("doc_id")))
    return out, {"domains": model.names, "target": target.tolist(), "reached": reached.tolist(), "steps": steps, "model": model}


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, rates: tuple[float, float] = RATES) -> DataFrame:
    """docs with each row repeated (or left out) as its rate says; columns stay.

    A row's rate follows from its own text, so texts are read again but never moved.
    """
    _, found = mixing_rates(docs, labels, weights, rates=rates)
    names = docs.columns
    stats, p, n, at = (fresh(x, names) for x in ("_stats", "_p", "_copies", "_at"))
    held = with_statistics(docs, found["model"].typical, stats)
    held = found["model"].scored(held, stats, p)
    held = held.withColumn(n, copies(_rate(found["steps"], *rates, p), F.col("doc_id")))
    some = F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n))).otherwise(F.array().cast("array<int>"))
    return held.withColumn(at, F.explode(some)).select(*names)


def op7_soft_mixing(spark, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of each document; beside them each domain's target and the expected total reached, the same in all rows."""
    out, found = mixing_rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    each = [F.round(F.col("p")[i], 6).alias(f"p_{n}") for i, n in enumerate(found["domains"])]
    totals = [F.lit(found[k][i]).alias(f"{k}_{n}") for k in ("target", "reached") for i, n in enumerate(found["domains"])]
    return out.select("doc_id", "tokens", *each, F.round("rate", 6).alias("rate"), "copies", *totals)
