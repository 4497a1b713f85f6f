"""Stages of the corpus pipeline against plain versions."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(100_000)}" for _ in range(n))


def test_mixing_meets_the_targets_on_a_skewed_table(spark, sf):
    # One language has 1 % of the tokens beside a hot one; the topic is the same.
    text = "equal " * 20
    rows = [(i, text, "rare" if i % 100 == 0 else "hot", "s", len(text)) for i in range(20_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = corpus_pipeline.mix(spark, docs, sf)
    many = {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
    target = 0.01**0.5 / (0.01**0.5 + 0.99**0.5)
    assert abs(many["rare"] / (many["rare"] + many["hot"]) - target) < 0.01
    assert abs(sum(many.values()) / 20_000 - 0.5) < 0.02


def test_dedup_keeps_one_row_each_also_without_ids(spark, sf):
    texts = [prose(i, 120) for i in range(5)]
    shared = prose(9, 60)
    keys = [
        (None, texts[0]),  # alone
        (None, texts[1]), (None, texts[1]),  # copies without an id
        (3, texts[2]), (3, texts[2]), (None, texts[2]),  # copies under one id
        (4, texts[3] + " " + shared), (4, shared + " " + texts[4]),  # one id, two documents
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in keys], SCHEMA)
    # Plainly: of equal texts the row with the smallest id, null ids last.
    want = {}
    for k, t in keys:
        want[t] = min(want.get(t, (True, 0)), (k is None, k or 0))
    first = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in first)
    assert got == sorted((*k, t) for t, k in want.items())

    kept = spark.createDataFrame(first, SCHEMA)
    left = corpus_pipeline.substring_dedup(spark, kept, sf).collect()
    assert len(left) == len(want)
    assert sum(shared in r["text"] for r in left) == 1
    words = sum(len(r["text"].split()) for r in left)
    assert words == sum(len(t.split()) for t in want) - 60
