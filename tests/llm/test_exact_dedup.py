import collections
import hashlib
import random
import string

import pytest
from fieldmark.llm import exact_dedup as E

from .helpers import documents, empty

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r["text"] or "").translate(LOWER).encode()).hexdigest()].append(r["doc_id"])
    return {d: (len(ids), max((i for i in ids if i is not None), default=None)) for d, ids in groups.items()}


@pytest.mark.parametrize("share", [0.001, 0.05, 0.5])
def test_groups_are_those_of_a_dictionary_whatever_is_heavy(spark, share):
    docs = documents(spark)
    extra = spark.createDataFrame([(5000 + i, ["ÀB Word", "Àb wORD", "àb word"][i % 3], None, None, None, None, None, None, None) for i in range(60)], docs.schema)
    docs = docs.unionByName(extra).repartition(5)
    rows = docs.select("doc_id", "text").collect()
    want = plain(rows)
    got = E.grouped(E.addressed(docs), share).collect()
    assert len(got) == len(rows)
    assert {r["digest"]: (r["n"], r["best"]["doc_id"]) for r in got} == want
    kept = collections.Counter(r["digest"] for r in got if r["row"] == r["best"]["row"])
    assert set(kept) == set(want) and set(kept.values()) == {1}  # one row of each group, copies of its id included


@pytest.mark.parametrize("share", [0.001, 0.05])
def test_whole_rows_stay_once_each(spark, share):
    docs = documents(spark)
    stay = E.deduplicated(docs, share)
    assert stay.columns == docs.columns
    got = sorted((hashlib.sha256((r["text"] or "").translate(LOWER).encode()).hexdigest(), -1 if r["doc_id"] is None else r["doc_id"]) for r in stay.collect())
    assert got == sorted((d, -1 if i is None else i) for d, (_, i) in plain(docs.collect()).items())


def test_the_sketch_names_every_heavy_digest_and_winners_are_verified(spark):
    rng = random.Random(1)
    hot = [f"h{i}" for i in range(8)]
    digests = [rng.choice(hot) if rng.random() < 0.4 else f"x{i}" for i in range(20_000)]
    rows = spark.createDataFrame([(i, d, i) for i, d in enumerate(digests)], "doc_id bigint, digest string, row bigint").repartition(7)
    assert {r["digest"] for r in E.candidates(rows, 0.02, shards=3).collect()} >= set(hot)
    count = collections.Counter(digests)
    got = {r["digest"]: r["n"] for r in E.winners(rows, 0.02).collect()}
    assert got == {h: count[h] for h in hot}
    assert {r["digest"] for r in E.winners(rows, 0.05).collect()} == {h for h in hot if count[h] >= 1000}


def test_no_rows(spark):
    assert E.grouped(E.addressed(empty(spark))).count() == 0
    assert E.deduplicated(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = E.grouped(E.addressed(documents(spark)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_tasks_without_rows_bring_no_empty_sketch(spark):
    rows = spark.createDataFrame([(i, f"d{i % 3}", i) for i in range(30)], "doc_id bigint, digest string, row bigint").repartition(20, "digest")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r["digest"] for r in E.candidates(rows, 0.1).collect()} == {"d0", "d1", "d2"}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
