"""Ranked search against plain scoring of every pair."""

import math
import random
import re
from collections import Counter

import pytest

from scorewright.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n string, block string, score string"
ITEMS = "item_id long, text string, rank string"


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def plain(docs, items, best):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    some = [b for _, b in bags if b]
    total, tokens = len(some), sum(sum(b.values()) for b in some)
    df = Counter(t for b in some for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            n = sum(bag.values())
            m = 50 + (50 * n * total) // tokens if tokens else 0
            score = 0
            for t in set(plain_terms(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scored)[:best], 1):
            out.append((item, rank, None if none else i, -score))
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    left = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(*i, "r") for i in items], ITEMS)
    rows = lexical.search(left, right, **options)
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows.collect()), key=str)


@pytest.mark.parametrize("best", [3, 50])
def test_the_best_documents_are_those_of_plain_scoring(spark, best):
    rng = random.Random(best)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)]
    items = [(i, ", ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(12)]
    assert found(spark, docs, items, best=best) == plain(docs, items, best)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, "!!! ... \n"), (4, "Straße straße STRASSE ß"), (4, "other straße"),
        (None, "straße"), (5, "rare " + "filler " * 30_000), (6, "a-b_c 世界 x\x00y"), (6, "a-b_c 世界 x\x00y"),
    ]
    items = [(1, None), (2, ""), (3, "Straße, rare"), (4, "b 世界"), (4, "y"), (None, "c"), (7, "absent")]
    assert found(spark, docs, items) == plain(docs, items, 50)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 40)
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(30))) for i in range(60)]
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(6))) for i in range(9)]
    assert found(spark, docs, items, best=5) == plain(docs, items, 5)
