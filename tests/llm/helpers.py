"""Small documents with the awkward cases: nulls, empty and very long texts, copies, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, blob string, fp string, score double, kind string"


def words(rng, n, vocab=400):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(2 + rng.randrange(5))) + str(rng.randrange(vocab)) for _ in range(n))


def documents(spark, texts=None, partitions=3):
    rng = random.Random(7)
    if texts is None:
        base = [words(rng, rng.randrange(1, 120)) for _ in range(24)]
        near = [b.replace(" ", "  ", 1) for b in base[:4]] + [b + " tail" for b in base[4:10]]
        texts = base + near + [base[0]] * 5 + [None, "", " \n\t ", "one", "one two", words(rng, 5000), "ÄÖ ñandú x 𝒳 é"]
    rows = [(i * 3 % 1001, t, ["en", "de", None][i % 3], "s", len(t or ""), "b", "f", 1.0, "k") for i, t in enumerate(texts)]
    rows += rows[:2] + [(None, "null id text of words", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
