import os
import random

import corpus_pipeline
from fieldmark.llm import secrets
from fieldmark.llm.common import materialise, scratch

from .test_models import spoken


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, spoken(rng, lang, rng.randrange(40, 120)), lang, "s", 0, 1.0))
    rows += [(200 + i, rows[i][1], rows[i][2], "s", 0, 1.0) for i in range(10)]
    rows += [(300, "token = abcdefgh12345 " + spoken(rng, "aa", 60), "aa", "s", 0, 1.0), (301, "12 34 5", "aa", "s", 0, 1.0), (302, None, "aa", "s", 0, 1.0), rows[0], (None, spoken(rng, "aa", 60), None, "s", 0, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-dedup", "secret scans", "mixing", "packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], str(tmp_path)).persist())
    assert all(d.columns == docs.columns for d in seen[:-1])
    ids = [sorted((r.doc_id is None, r.doc_id or 0) for r in d.select("doc_id").collect()) for d in seen[:-1]]
    assert set(ids[0]) - set(ids[1]) == {(False, 301), (False, 302)}
    assert ids[2] == sorted({*((False, i) for i in range(120)), (False, 300), (True, 0)})
    assert ids[3] == ids[2] and set(ids[4]) == set(ids[3]) and len(ids[4]) >= len(ids[3])
    assert secrets.scan(seen[3])[0].where("spans <> ''").count() == 0
    packed = seen[5].collect()
    assert {(r.doc_id is None, r.doc_id or 0) for r in packed} == set(ids[4])
    assert sum(r.length for r in packed) == sum(r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_awkward_tables(spark, tmp_path):
    """No rows; no labelled language; a text of megabytes, in which a secret lies far behind, among columns with clashing names."""
    rng = random.Random(3)
    long = spoken(rng, "aa", 200_000) + " token = abcdefgh12345"
    rows = [(i, spoken(rng, lang, 60), lang, "s", 0, "c", 1) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(900, long, "aa", "s", 0, "c", 1), (901, "", "aa", "s", 0, "c", 1), (902, None, None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _ok string, length int"
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    for name, some in (("long", rows), ("none", []), ("unlabelled", [(*r[:2], None, *r[3:]) for r in rows[:5]])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        (labels if name == "long" else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        packed = corpus_pipeline.run(spark, folder).collect()
        assert bool(packed) == (name == "long")
        if packed:
            pieces = [r for r in packed if r.doc_id == 900]
            assert len(pieces) > 20 and {r.length for r in pieces if r.piece < max(p.piece for p in pieces)} == {4096}


def test_scratch_goes(spark):
    with scratch(spark) as folder:
        inner = materialise(spark.range(3).toDF("x"), "inner")
        kept = materialise(inner, "outer", kept=True)
        assert os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:")) and kept.count() == 3
