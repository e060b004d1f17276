"""Rows at the door: which rules they break, how badly, and where they go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_path

#: Worst first: a row with an error is rejected, one with warnings only is good.
SEVERITIES = ("error", "warning")


@dataclass(frozen=True)
class Rule:
    """A row that isn't known to be ``ok`` breaks the rule."""

    code: str
    ok: Column
    severity: str = "error"


def present(*names: str) -> list[Rule]:
    return [Rule(f"{n}_missing", F.col(n).isNotNull()) for n in names]


def in_range(name: str, low: float, high: float, severity: str = "error") -> Rule:
    """A null is no breach; ``present`` says whether it may be one."""
    return Rule(f"{name}_range", F.col(name).isNull() | F.col(name).between(low, high), severity)


def not_after(name: str, day: Column) -> Rule:
    return Rule(f"{name}_future", F.col(name).isNull() | (F.col(name) <= day))


def judged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with ``codes`` (of the rules broken, in their order), ``severity`` (the worst, or null) and ``verdict`` (good, rejected); one pass, whatever the number of rules."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(r.ok, F.lit(False)), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))) for r in rules]), lambda x: x.isNotNull())
    worst = F.coalesce(*[F.when(F.array_contains("_broken.severity", s), s) for s in SEVERITIES])
    told = df.withColumn("_broken", broken).withColumns({"codes": F.col("_broken.code"), "severity": worst}).drop("_broken")
    return told.withColumn("verdict", F.when(F.col("severity") == "error", "rejected").otherwise("good"))


def quarantined(df: DataFrame, rules: list[Rule], path: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good rows, rejected rows, counts): one pass over df writes both sinks below ``path``; what went where is counted from two narrow columns of what was written.

    (An Observation would count on the way, but leaves the session unable to
    ship some later plans: they carry it, and it can't be serialised.)
    """
    path = path or shared_path(df.sparkSession, "ingested")
    told = judged(df, rules)
    told.write.partitionBy("verdict").parquet(path)
    stored = df.sparkSession.read.schema(told.schema).parquet(path)
    n = lambda on: F.count(F.when(on, 1))
    seen = stored.agg(F.count("*").alias("rows"), n(F.col("verdict") == "good").alias("good"), n(F.col("verdict") == "rejected").alias("rejected"), n(F.col("severity") == "warning").alias("warned")).first().asDict()
    return stored.where("verdict = 'good'").drop("verdict"), stored.where("verdict = 'rejected'").drop("verdict"), seen
