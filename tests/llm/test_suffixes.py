"""Suffix arrays against sorting, and removed bytes against a set of all strings."""

import hashlib
import random

import numpy as np
import pytest

from scorewright.llm import suffixes

SCHEMA = "doc_id long, text string, route string, body string, none string"


def plain(rows, length=100):
    """Removed bytes, runs and checksum, by every string seen so far."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for a in range(len(body) - length + 1):
            if body[a : a + length] in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(body[a : a + length])
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out.append((doc_id is None, doc_id or 0, len(body), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removed(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    out = suffixes.without_repeats(df, **options).collect()
    for r in out:
        assert r["n_removed"] == sum(s["high"] - s["low"] for s in r["spans"])
    return sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        for r in out
    )


def prose(rng, n, pool=5000):
    return " ".join(f"w{rng.randrange(pool)}é" for _ in range(n))


def corpus():
    rng = random.Random(8)
    shared = [prose(rng, 60) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(5, 40))]
        for _ in range(rng.randrange(3)):
            words = rng.choice(shared).split()
            words[rng.randrange(60)] = "changed"
            parts += [" ".join(words), prose(rng, rng.randrange(1, 30))]
        rows.append((i, " ".join(parts)))
    return rows + [(100 + i, rows[3][1]) for i in range(20)] + [(90, rows[5][1][:300]), (91, rows[5][1][150:])]


def test_suffix_arrays_are_sorted():
    rng = random.Random(1)
    texts = [[rng.randrange(k) for _ in range(rng.randrange(60))] for k in (1, 2, 3, 5) for _ in range(300)]
    texts += [[0] * 300, [1, 0] * 200, [0, 1] * 200, [0, 0, 1] * 100, b"mississippi", b""]
    for text in texts:
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_strings_that_stand_earlier_go(spark):
    rows = corpus()
    assert removed(spark, rows) == plain(rows)


def test_anchors_with_many_segments_are_compared_by_string(spark):
    rows = corpus()
    assert removed(spark, rows, most=2) == plain(rows)


def test_other_lengths(spark):
    rows = corpus()[:30]
    assert removed(spark, rows, length=47) == plain(rows, 47)
    with pytest.raises(ValueError):
        suffixes.without_repeats(spark.createDataFrame([], SCHEMA), length=20)


def test_odd_texts(spark):
    rng = random.Random(2)
    text = prose(rng, 60)
    rows = [
        (1, None), (2, ""), (3, "a" * 99), (4, "a" * 100), (5, "a" * 101), (6, "ab" * 3000), (7, "é" * 50),
        (8, "line of words\n" * 40), (9, text), (9, text), (9, text), (None, text), (None, None),
        (10, "x\x00" * 80), (11, prose(rng, 9000)), (12, "a" * 99), (13, " " + text),
    ]
    assert removed(spark, rows) == plain(rows)


def test_an_empty_table(spark):
    assert removed(spark, []) == []


def test_parts_hold_every_common_string():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 100_000 // 500).astype(np.uint8).tobytes()
    bodies, anchor_at = [], []
    for _ in range(30):
        own = bytearray(base[:168])
        own[int(rng.integers(0, 60))] ^= 1
        low, high = int(rng.integers(0, 20)), int(rng.integers(130, 168))
        bodies.append(bytes(own[low:high]))
        anchor_at.append(68 - low)
    anchor_at = np.array(anchor_at)
    which, low, high = suffixes.parts(bodies, np.full(30, 7), anchor_at, 100)
    strings = {}
    for i, b in enumerate(bodies):
        for a in range(len(b) - 99):
            if a <= anchor_at[i] and anchor_at[i] + 32 <= a + 100:
                strings.setdefault(b[a : a + 100], []).append((i, a))
    inside = {(i, a) for i, x, y in zip(which, low, high) for a in range(x, y + 1)}
    assert all(set(v) <= inside for v in strings.values() if len(v) > 1)
