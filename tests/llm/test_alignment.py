"""Alignments and pair scores against a plain walk over both token sequences."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from scorewright.llm import alignment
from scorewright.llm.blocks import SLOTS

SCHEMA = "doc_id long, text string, block string, pair string, n_a string"


@pytest.fixture(scope="module")
def pair():
    files = [open(f"{alignment.TOKENIZERS}/{f}", "rb").read() for f in (alignment.FIRST, alignment.SECOND)]
    return alignment.Pair(*files)


def walk(text, first, pair):
    """Groups and links of one text, token by token."""
    if not text:
        return [], []
    a, b = first.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(pair.a_bytes[i] for i in a) != whole or b"".join(pair.b_bytes[i] for i in b) != whole:
        return [], []
    links, groups, i, j = [], [], 0, 0
    a_end, b_end = len(pair.a_bytes[a[0]]), len(pair.b_bytes[b[0]])
    own = ([a[0]], [b[0]])
    while True:
        links.append((a[i], b[j]))
        if a_end == b_end:
            groups.append("|".join(",".join(map(str, side)) for side in own))
            i, j = i + 1, j + 1
            if i == len(a):
                return groups, links
            own = ([a[i]], [b[j]])
            a_end += len(pair.a_bytes[a[i]])
            b_end += len(pair.b_bytes[b[j]])
        elif a_end < b_end:
            i += 1
            own[0].append(a[i])
            a_end += len(pair.a_bytes[a[i]])
        else:
            j += 1
            own[1].append(b[j])
            b_end += len(pair.b_bytes[b[j]])


def check(spark, pair, rows):
    from tokenizers import Tokenizer

    first = Tokenizer.from_str(pair.source)
    first.encode_special_tokens = True
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    aligned, pairs = alignment.align(df)
    walked = [(i, *walk(t, first, pair)) for i, t in rows]
    counts = Counter(x for _, _, links in walked for x in links)
    held = Counter(x for _, _, links in walked for x in set(links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = sorted(
        (i is None, i or 0, ";".join(groups), len(groups), len(links), sum(counts[x] for x in links),
         sum(counts[x] == best[x[1]] for x in links))
        for i, groups, links in walked
    )
    got = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["groups"], r["n_groups"], r["n_links"], r["count_sum"], r["n_best"])
        for r in aligned.collect()
    )
    assert got == want
    got = {(r["a"], r["b"]): (r["n_docs"], r["n_links"], r["best"]) for r in pairs.collect()}
    assert got == {x: (held[x], n, n == best[x[1]]) for x, n in counts.items()}


def test_groups_links_and_scores_are_those_of_a_plain_walk(spark, pair):
    rng = random.Random(4)
    pool = ["the", "Übung", "naïve", "  ", "\n", "123", "don't", "日本語", "<|endoftext|>", "😀", "a\tb", "=====", "</s>"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    check(spark, pair, rows)


def test_odd_texts(spark, pair):
    odd = [
        (1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (4, "b"), (None, "a"), (None, None),
        (5, "word " * 20_000), (6, "▁ already there"), (7, "x\x00y"), (8, "a" * 5000), (9, "\n\n  \n"),
    ]
    check(spark, pair, odd)


def test_an_empty_table(spark):
    aligned, pairs = alignment.align(spark.createDataFrame([], SCHEMA))
    assert aligned.count() == 0 and pairs.count() == 0


def test_containers_open_to_what_they_were_made_of():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 40, 20_000) ** 2 * SLOTS + rng.integers(0, SLOTS, 20_000))
    times = rng.integers(1, 12, len(key))
    pairs, planes, cells = alignment.containers(key // SLOTS, key % SLOTS, times)
    ends = alignment.pa.array(np.concatenate([[0], np.cumsum(planes)]).astype(np.int32))
    column = alignment.pa.ListArray.from_arrays(ends, cells)
    assert {len(c) for c in cells.to_pylist()} & {SLOTS // 8}
    for part, offset in ((column, 0), (column.slice(7, 11), 7)):
        row, plane, slot = alignment.opened(part)
        back = Counter()
        for r, p, s in zip(row, plane, slot):
            back[(pairs[r + offset] * SLOTS + s)] += 1 << p
        inside = np.isin(key // SLOTS, pairs[offset : offset + len(part)])
        assert back == dict(zip(key[inside].tolist(), times[inside].tolist()))


def test_the_faster_encoder_gives_the_ids_of_the_file(pair):
    from tokenizers import Tokenizer

    first = Tokenizer.from_str(pair.source)
    first.encode_special_tokens = True
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x250)]
    for _ in range(300):
        text = "".join(rng.choice(letters + [" "] * 200) for _ in range(rng.randrange(1, 200)))
        assert pair.first(text) == first.encode(text, add_special_tokens=False).ids
    assert hashlib.sha256(b"").hexdigest() and pair.fast
