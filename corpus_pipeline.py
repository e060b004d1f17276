"""The corpus pipeline: language ID, near-dedup, secret scans, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and returns the columns of documents; the last returns packed pieces.

For every stage: an empty table gives an empty result; texts are taken whole,
however long; rows may repeat a doc_id or all columns; columns beyond those of
documents go through as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import language_id, mixing, packing, secrets, similar
from fieldmark.llm.common import fresh, materialise, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language the calibrated model rejects; sets ``lang`` to what it found.

    A null or empty text has no letter.  Rows of equal text fare alike; of languages that tie the first by name is taken.
    Where no row has a language to learn from, all documents are rejected.
    """
    names = docs.columns
    lang, score, ok = (fresh(n, names) for n in ("_lang", "_score", "_ok"))
    told = language_id.with_language(docs, language_id.fit(docs), names, (lang, score, ok))
    return told.where(F.col(ok)).withColumn("lang", F.col(lang)).select(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the smallest doc_id (null ids last); rows are told apart by id and text.

    Null and empty texts are one group.  Of texts that share the smallest id the one of least digest stays; of rows that repeat
    both, any one.
    """
    return similar.one_of_each(docs, width=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by the name of its kind; keeps all documents.

    A null text stays null, an empty one empty.  Where secrets overlap, the whole of them is replaced at once.
    """
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that expected domain totals meet the target weights; none is dropped, as no rate is below 1.

    Null and empty texts have no tokens and add to no total.  How often a row is repeated follows from its id and text alone, so equal
    rows fare alike.
    """
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rates=(1.0, math.inf))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, each with its sequence and its place there.

    Null and empty texts are a piece of the end token.  Pieces of one length are placed in the order of salts and ids; equal rows
    in any order among themselves.
    """
    return packing.packed_documents(docs)


STAGES = [("language ID", language), ("near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing", mixing_stage), ("packing", pack)]

#: Language ID and redaction are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each on the written result of the one before.

    A stage's own tables go once its result is written; the last one's stay, as its result is read later.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), kept=True)
    return STAGES[-1][1](spark, docs, sf_dir)
