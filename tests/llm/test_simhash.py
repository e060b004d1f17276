import random

import xxhash
import zstandard
from fieldmark.llm import similar as N
from fieldmark.llm import simhash as S
from pyspark.sql import functions as F

from .helpers import documents, empty


def slow_fingerprint(text, width):
    words, lower = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in __import__("re").findall(r"[^\x20\x09-\x0D]+", lower):
        words.append(piece)
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    bits = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def components(ids, fps, radius=2):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[root(i)] for i in range(len(fps))]


def test_documents_against_brute_force(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    for width in (3, 5):
        fps = [slow_fingerprint(r.text, width) for r in rows]
        want = sorted((r.doc_id is None, r.doc_id or 0, f, c) for r, f, c in zip(rows, fps, components([r.doc_id for r in rows], fps), strict=True))
        got = sorted((r.doc_id is None, r.doc_id or 0, r.fp, r.component_id) for r in S.near_duplicates(docs, width).collect())
        assert got == want


def test_links_against_brute_force_in_small_and_hot_buckets(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(40)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps | {0, (1 << 64) - 1, 1 << 63, 1})
    want = components(fps, fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for bucket in (2, 64):
        links = S.near_links(frame, bucket).distinct().collect()
        assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2 for r in links)
        got = {r.node: r.root for r in S.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
        assert [got.get(f, f) for f in fps] == want


def test_long_chain(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)]
    got = {r.node: r.root for r in S.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_empty(spark):
    assert S.near_duplicates(empty(spark)).count() == 0


def jaccard(x, y, width):
    sets = []
    for t in (x, y):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 0.0


def test_similar_documents_against_brute_force(spark, monkeypatch):
    rng = random.Random(21)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 150))) for _ in range(40)]
    texts = list(base)
    for b in base:
        for _ in range(rng.randrange(4)):
            w = b.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += base[:6] + ["", None, " ", "one two"] + [base[0] + f" tail{i}" for i in range(40)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (None, base[1])], "doc_id bigint, text string").repartition(3)
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in rows:
        for j, y in rows:
            if i < j and ((x or "") == (y or "") or jaccard(x, y, 5) >= 0.8):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    want = sorted([(i, root(i)) for i, _ in [*rows, rows[0]]] + [(-1, root(next(i for i, t in rows if t == base[1])))])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in N.similar_documents(docs).collect()) == want
    assert N.similar_documents(empty(spark)).count() == 0


def edited_copies(n, at, rng):
    """n edited copies of a text which has the id ``at``: similar to it, but not to each other."""
    base = [f"v{rng.randrange(9000)}" for _ in range(300)]
    rows = [(at, " ".join(base))]
    for i in range(n):
        w = list(base)
        for p in rng.sample(range(4, 296), 5):
            w[p] = f"edit{i}x{p}"
        rows.append((i if i < at else i + 1, " ".join(w)))
    return rows


def test_copies_of_a_text_that_represents_no_bucket(spark, monkeypatch):
    rng = random.Random(5)
    rows = edited_copies(300, 150, rng)
    assert sum(jaccard(rows[0][1], t, 5) >= 0.8 for _, t in rows[1:]) == 300
    assert max(jaccard(rows[1][1], t, 5) for _, t in rows[2:]) < 0.8
    rows += [(1000 + i, t) for i, t in edited_copies(60, 30, rng)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = sorted((i, i // 1000 * 1000) for i, _ in rows)
    for crowd in (512, 20):
        monkeypatch.setattr(N, "CROWD", crowd)
        assert sorted((r.doc_id, r.component_id) for r in N.similar_documents(docs).collect()) == want


def test_texts_that_share_boilerplate_part_by_rare_shingles(spark, monkeypatch):
    rng = random.Random(13)
    plate = [f"p{i}" for i in range(120)]
    rows = [(i, " ".join(plate + [f"u{i}x{k}" for k in range(rng.randrange(36, 48))])) for i in range(150)]
    for i in range(0, 60, 5):  # similar to one of the others each
        rows.append((1000 + i, rows[i][1].rsplit(" ", 3)[0] + f" other{i}"))
    want = {i: i % 1000 for i, _ in rows}
    for i, x in rows:
        for j, y in rows:
            assert i >= j or (jaccard(x, y, 5) >= 0.8) == (i % 1000 == j % 1000)
    monkeypatch.setattr(N, "CROWD", 20)
    blocks, plain = [], N.crowd_links
    monkeypatch.setattr(N, "crowd_links", lambda many, *rest: blocks.append(many.where("n > 20").count()) or plain(many, *rest))
    finer, dealt = [], N.rare_shingles
    monkeypatch.setattr(N, "rare_shingles", lambda texts, *rest: finer.append(texts.count()) or dealt(texts, *rest))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in N.similar_documents(docs).collect()} == want
    assert finer and finer[0] > 20, "buckets above a block are dealt anew"
    assert blocks == [0, 0], "and nothing is left to compare in several blocks"


def test_a_large_bucket_is_dealt_over_several_tasks(spark):
    rows = spark.range(0, 40_000, 1, 8).selectExpr("xxhash64(id) node", "if(id % 4 > 0, 0, id div 8) key")
    roots = rows.selectExpr("node", "node root")
    small = {"autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "shuffle.partitions": "20"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        met = N.in_buckets(rows, "some")
        n, low, least = met.where("key = 0").agg(F.min("n"), F.max("low"), F.min("node")).first()
        assert met.count() == 40_000 and n == 30_002 and low == least
        left = N.apart(met.select("key", "node", "n"), roots)
        assert left.count() == 40_000
        for df in (met, left):
            most = df.groupBy(F.input_file_name()).count().agg({"count": "max"}).first()[0]
            assert most < 15_000, "a task's file holds a part of the bucket only"
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)


def test_groups_of_crowded_texts_are_dealt_evenly(spark, monkeypatch):
    """20 buckets of a block and one of three: 26 groups, of which no two fall to one task, whatever their hashes."""
    monkeypatch.setattr(N, "CROWD", 20)
    keys = [k for k in range(20) for _ in range(20)] + [99] * 60
    packed = [zstandard.ZstdCompressor().compress((" ".join(f"w{i}" for i in range(60)) + f" end{node}").encode()) for node in range(len(keys))]
    many = spark.createDataFrame([(k, node, keys.count(k), node) for node, k in enumerate(keys)], "key bigint, node bigint, n bigint, root bigint")
    nodes = many.select("node", *[F.lit(0).cast("long").alias(s) for s in N.SKETCH])
    texts = spark.createDataFrame(list(enumerate(packed)), "node bigint, packed binary")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = N.crowd_links(many, nodes, texts, 5, 0.8).withColumn("task", F.spark_partition_id()).collect()
        assert N.crowd_links(many.limit(0), nodes, texts, 5, 0.8).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(keys[r.a] == keys[r.b] for r in links)
    tasks = {k: {r.task for r in links if keys[r.a] == k} for k in set(keys)}
    found = {k: sum(keys[r.a] == k for r in links) for k in tasks}
    assert found == {99: 174, **dict.fromkeys(range(20), 19)}, "every two blocks are joined"
    assert sum(map(len, tasks.values())) == len(set.union(*tasks.values())) == 26


def test_rare_shingles_of_similar_texts_meet(spark):
    z = zstandard.ZstdCompressor()
    rng = random.Random(3)
    texts = []
    for n in (1, 3, 5, 6, 9, 14, 19, 24, 40, 100):
        for _ in range(4):
            w = [f"w{rng.randrange(60)}" for _ in range(n)]
            texts += [" ".join(w), " ".join(w[:-1]), " ".join(w + ["end"]), " ".join(["start"] + w)]
    texts = sorted({t for t in texts if t})
    rows = [(i, z.compress(t.encode())) for i, t in enumerate(texts)]
    met = N.rare_shingles(spark.createDataFrame(rows, "node bigint, packed binary"), 5, 0.8).collect()
    keys = [{r.key for r in met if r.node == i} for i in range(len(texts))]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j], 5) >= 0.8]
    assert len(near) > 20 and all(keys[i] & keys[j] for i, j in near)


def test_one_row_of_each_group_whatever_the_ids(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(6)]
    rows = [(1, base[0]), (1, base[1]), (1, base[0]), (2, base[1] + " tail"), (None, base[2]), (None, base[2] + " tail"), (9, base[3]), (None, base[3]), (4, None), (3, ""), (5, base[4]), (5, base[4] + " tail"), (None, base[5]), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, text_key string, root int").repartition(3)
    got = sorted((str(r.doc_id), (r.text or "")[:12]) for r in N.one_of_each(docs).collect())
    assert N.one_of_each(docs).columns == docs.columns
    assert got == sorted([("1", base[0][:12]), ("1", base[1][:12]), ("None", base[2][:12]), ("9", base[3][:12]), ("3", ""), ("5", base[4][:12]), ("None", base[5][:12])])
    assert N.one_of_each(empty(spark)).count() == 0
