"""Each operator against a plain version, and on odd tables."""

import json
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import (
    common,
    langid,
    licences,
    mixing,
    packing,
    passages,
    quality,
    scoring,
    sharding,
    simhash,
    topk,
)
from scorewright.llm.common import held_out

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (5, "a"), (None, "b c"),
    (6, "word " * 30_000), (7, "Ünï 世界 ñ"), (8, "x\x00y #$% ퟿"),
]
SCHEMA = "doc_id long, text string, slot string, rank string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "s", "r", None, None) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed, n, pool=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


# ------------------------------------------------------------------------ passages


def test_passages_that_repeat_are_found_and_others_left_alone(spark):
    shared = prose(1, 60, 10_000)
    near = shared.split()
    near[30] = "changed"
    rows = [(i, prose(100 + i, 200, 100_000)) for i in range(8)]
    rows[2] = (2, rows[2][1] + " " + shared + " tail")
    rest = rows[5][1]
    rows[5] = (5, "Head " + shared.upper() + " " + rest)
    rows[6] = (6, rows[6][1] + " " + " ".join(near) + " " + prose(7, 100, 100_000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(df)
    exact = [r for r in found.collect() if r["doc_id"] == 5]
    assert [(r["start_word"], r["end_word"], r["first_doc_id"]) for r in exact] == [(1, 61, 2)]
    assert {r["doc_id"] for r in found.collect()} <= {5, 6}
    left = dict(passages.without_passages(df, found).select("doc_id", "text").collect())
    assert left[5] == "Head " + rest
    assert all(left[i] == dict(rows)[i] for i in (0, 1, 2, 3, 4, 7))


def test_compact_windows_hold_every_least_key():
    rng = np.random.default_rng(3)
    keys = (rng.integers(0, 1 << 30, 300).astype(np.uint64) << np.uint64(26)) | np.arange(
        300, dtype=np.uint64
    )
    at, left, right = passages.compact_windows(keys, 20)
    want = {int(np.argmin(keys[i : i + 20])) + i for i in range(281)}
    assert set(at.tolist()) == want
    for c, a, b in zip(at, left, right):
        assert keys[c - a : c + b + 1].min() == keys[c]
        assert a == 19 or c - a == 0 or keys[c - a - 1] < keys[c]
        assert b == 19 or c + b == 299 or keys[c + b + 1] < keys[c]


def test_copies_give_few_rows(spark):
    df = spark.createDataFrame([(i, prose(1, 80, 10_000)) for i in range(50)], "doc_id long, text string")
    found = passages.repeated_passages(df)
    assert {r["doc_id"] for r in found.collect()} == set(range(1, 50))
    assert found.count() < 100


def test_passages_whose_shingles_stand_in_other_texts_too(spark):
    words = prose(3, 50, 100_000).split()
    texts = {8: " ".join(words), 20: " ".join(words)}
    # Each shingle also stands in a text before both, and in one between them.
    for i, start in enumerate(range(0, 50, 7)):
        part = " ".join(words[max(start - 4, 0) : start + 11])
        texts[i] = prose(50 + i, 60, 100_000) + " " + part + " " + prose(70 + i, 60, 100_000)
        texts[10 + i] = prose(80 + i, 60, 100_000) + " " + part + " " + prose(90 + i, 60, 100_000)
    for i in (8, 20):
        texts[i] = prose(1000 + i, 70, 100_000) + " " + texts[i] + " " + prose(1100 + i, 70, 100_000)
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    found = passages.repeated_passages(df).collect()
    got = [(r["doc_id"], r["start_word"], r["end_word"], r["first_doc_id"]) for r in found]
    assert got == [(20, 70, 120, 8)]


def grams(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("copies", [300, 3000])
def test_large_groups_of_near_copies_are_found_in_linear_rows(spark, copies):
    rng = random.Random(9)
    shared, texts, places = prose(2, 60, 100_000).split(), {}, {}
    for doc in range(copies):
        near = list(shared)
        places[doc] = rng.randrange(10, 50)
        near[places[doc]] = f"changed{doc}"
        around = [prose(10_000 + 2 * doc + k, 40, 10_000_000) for k in (0, 1)]
        texts[doc] = " ".join([around[0], *near, around[1]])
    # Whoever has the same place changed, or the next one, is a partner at 0.8.
    seen, want = set(), set()
    for doc, place in places.items():
        if any(abs(place - other) < 2 for other in seen):
            want.add(doc)
        seen.add(place)
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    found = passages.repeated_passages(df).collect()
    # One of 600 such passages has no min-hash value in common with its partner.
    assert len(want - {r["doc_id"] for r in found}) <= len(want) // 300
    assert len(found) < 12 * copies
    for r in found[:: len(found) // 200]:
        a = texts[r["doc_id"]].split()[r["start_word"] : r["end_word"]]
        b = texts[r["first_doc_id"]].split()[r["first_start"] : r["first_end"]]
        assert r["first_doc_id"] < r["doc_id"] and min(len(a), len(b)) >= 50
        both, either = grams(a) & grams(b), grams(a) | grams(b)
        assert len(both) / len(either) == pytest.approx(r["similarity"])
        assert r["similarity"] >= 0.8


def test_a_common_line_links_nothing_and_is_not_met_by_all_pairs(spark, monkeypatch):
    line = prose(4, 12, 100_000)
    rows = [
        (doc, f"{prose(7000 + 2 * doc, 60, 10_000_000)} {line} {prose(7001 + 2 * doc, 60, 10_000_000)}")
        for doc in range(2000)
    ]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    assert passages.repeated_passages(texts).count() == 0
    met, agree = [], passages.agree
    monkeypatch.setattr(passages, "agree", lambda a, *rest: met.append(len(a)) or agree(a, *rest))
    hashed = [passages.shingles(text) for _, text in rows]
    shingle = np.array([list(set(hashed[0]) & set(hashed[1]))[0]])
    marks = [
        passages._around(passages._marks(h), np.flatnonzero(h == shingle)[:1], 46)[0] for h in hashed
    ]
    group = np.zeros(len(rows), dtype=np.int64)
    found = passages._leaders(np.stack(marks), group, np.arange(len(rows)), 46, 8 / 9)
    assert (found < 0).all() and sum(met) < 10 * len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_leaders_leave_out_no_window_with_an_earlier_partner(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 256, (4, 91), dtype=np.uint8)
    marks = base[rng.integers(0, 4, 400)]
    for row in marks:
        for at in rng.integers(0, 91, rng.integers(0, 4)):
            row[at : at + 5] = rng.integers(1, 256, len(row[at : at + 5]))
    marks[:, 45] = 7
    doc = np.sort(rng.integers(0, 300, 400))
    found = passages._leaders(marks, np.zeros(400, dtype=np.int64), doc, 46, 8 / 9)
    for i in range(400):
        others = np.flatnonzero(doc < doc[i])
        more = passages.agree(marks[others], np.repeat(marks[i : i + 1], len(others), 0), 46, 8 / 9)
        assert (found[i] >= 0) == bool((more >= 0).any())
        assert found[i] < 0 or found[i] in others[more >= 0]


def test_equal_texts_give_one_row_each(spark):
    text, short = prose(11, 70, 10_000), prose(12, 20, 10_000)
    rows = [(4, text), (2, text), (9, text), (9, text), (None, text), (1, short), (3, short)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(d, 0, 70, 2, 0, 70, 1.0) for d in (4, 9)]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_passages_with_changed_words_match_brute_force(spark):
    rng, texts = random.Random(5), {}
    for i in range(240):
        # Three of four have 50 words with one of the middle changed, a similarity of 0.8.
        more = i // 4 % 3 if i % 4 == 0 else 0
        words = prose(20_000 + i, 50 + 10 * more, 100_000).split()
        near = list(words)
        for at in rng.sample(range(len(words)) if more else range(20, 30), 1 + more):
            near[at] = f"changed{at}"
        for doc, middle in ((i, words), (1000 + i, near)):
            around = [prose(50_000 + 10 * doc + k, 40, 1_000_000) for k in (0, 1)]
            texts[doc] = " ".join([around[0], *middle, around[1]])

    def runs(doc):
        words = texts[doc].split()
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        return [grams[i : i + 46] for i in range(len(grams) - 45)]

    def same(a, b):
        # A passage goes from a shingle that matches to one that does.
        ends = a[0] == b[0] and a[-1] == b[-1]
        return ends and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))

    want = {
        (1000 + i, i)
        for i in range(240)
        for a in runs(i)
        for b in runs(1000 + i)
        if same(a, b)
    }
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    found = passages.repeated_passages(df).select("doc_id", "first_doc_id").distinct().collect()
    assert len(want) > 150
    assert want <= {tuple(r) for r in found}


def test_cut_out():
    assert passages.cut_out("a b  c\nd e", [(1, 3)]) == "a d e"
    assert passages.cut_out("a b c", [(0, 2)]) == "c"
    assert passages.cut_out(" a b ", [(0, 2)]) is None


# ------------------------------------------------------------------------ language


def test_ngrams_are_counted_like_plainly(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cdé ÉZ世界 1.") for _ in range(60)) for _ in range(20)]

    def plain(text):
        signs = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
        found = Counter()
        for n in (1, 2, 3):
            for i in range(len(signs) - n + 1):
                gram = signs[i : i + n]
                if gram.strip() and (n < 3 or gram[1] != " "):
                    found[gram] += 1
        return sorted(found.values())

    for chunk in (1 << 20, 13):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        seen = {}
        for owners, _, counts in langid.counted(texts):
            for i in set(owners.tolist()):
                seen[i] = sorted(counts[owners == i].tolist())
        assert [seen.get(i, []) for i in range(20)] == [plain(t) for t in texts]


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 4)
    found = langid.with_language(docs, ~held).filter(held)
    assert found.filter("lang = lang_pred").count() > 0.9 * found.count()


# ------------------------------------------------------------------------- quality


def test_word_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for r in quality.with_rules(docs).drop("_words").collect():
        w = r["text"].split()
        lines = [x for x in r["text"].split("\n") if x.split()]
        windows = list(zip(w, w[1:], w[2:]))
        many = Counter(windows)
        covered = {i + j for i, x in enumerate(windows) if many[x] > 1 for j in range(3)}
        assert [r[c] for c in quality.RULES] == [
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r["text"]),
            len(lines) - len(set(lines)), len(covered),
        ]


def test_best_threshold():
    assert quality.best_threshold([3.0, 4.0], [1.0, 2.0]) == 2.5
    assert quality.best_threshold([3.0], []) == 3.0
    assert quality.best_threshold([], [1.0]) == -math.inf


# -------------------------------------------------------------------------- scoring


def test_base_scores_and_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = scoring.lm_scores(docs, held_out(F.col("doc_id"), 7)).collect()
    held = {r["doc_id"]: r["held_out"] for r in rows}
    texts = {r["doc_id"]: r["text"].encode().lower().split() + [b""] for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["train_tokens"] == n and r["n_tokens"] == len(t)
        assert r["n_known"] == sum(counts[w] > 0 for w in t)
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert r["base_score"] == pytest.approx(want)
        assert r["score"] < 0


def test_attention_sees_nothing_ahead_and_scores_once():
    from scorewright.llm import attention

    weights = attention.start(3)
    weights["out"] = np.random.default_rng(1).normal(size=weights["out"].shape).astype("f4")
    pairs = np.zeros((attention.SYMBOLS, attention.CLASSES), dtype="f4")
    rng = np.random.default_rng(2)
    lengths = np.array([40, 7])
    places, size = attention.laid_out(lengths)
    symbols = np.full(size, attention.PAD, dtype=np.int32)
    symbols[places] = rng.integers(0, 1000, 47)
    targets = np.zeros(size, dtype=np.int32)
    first = attention.log_probabilities(weights, pairs, symbols, targets)[places]
    other = symbols.copy()
    other[places[30:]] = 5
    again = attention.log_probabilities(weights, pairs, other, targets)[places]
    assert np.allclose(first[:30], again[:30], atol=1e-5)
    total = sum(
        np.exp(attention.log_probabilities(weights, pairs, symbols, targets + c)[places])
        for c in range(attention.CLASSES)
    )
    assert np.allclose(total, 1, atol=1e-4)


# ---------------------------------------------------------------- mixing and packing


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame(
        [(a, b, 10 * (i + 1)) for i, (a, b) in enumerate((x, y) for x in "pq" for y in "uv")],
        "_source string, _lang string, tokens long",
    )
    goal = {
        "_source": spark.createDataFrame([("p", 0.7), ("q", 0.3)], "_source string, target double"),
        "_lang": spark.createDataFrame([("u", 0.4), ("v", 0.6)], "_lang string, target double"),
    }
    rows = mixing.rake(cells, goal, close=1e-9).collect()
    total = sum(r["share"] for r in rows)
    for dim, value, want in (("_source", "p", 0.7), ("_lang", "u", 0.4)):
        share = sum(r["share"] for r in rows if r[dim] == value) / total
        assert share == pytest.approx(want, abs=1e-6)
    odds = {(r["_source"], r["_lang"]): r["share"] / r["tokens"] for r in rows}
    ratio = odds["p", "u"] * odds["q", "v"] / odds["p", "v"] / odds["q", "u"]
    assert ratio == pytest.approx(1)


def test_boundaries_are_the_best():
    rng = random.Random(5)
    from itertools import combinations

    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 40), 7))
        counts = [rng.randint(1, 9) for _ in lengths]

        def waste(ends):
            return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts))

        best = min(waste((*c, lengths[-1])) for c in combinations(lengths[:-1], 2))
        assert waste(packing.best_boundaries(lengths, counts, 3)) == best


def test_every_word_is_packed_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, longest=100, buckets=4, batch_tokens=1000).collect()
    want = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
    assert got == want
    places = [(r["bucket"], r["batch"], r["slot"]) for r in rows if r["n_tokens"]]
    assert len(set(places)) == len(places)
    assert all((s + 1) * b <= 1000 for b, _, s in places)


# -------------------------------------------------------------------------- simhash


def test_components_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = simhash.near_duplicates(docs).collect()
    bits = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    lowest = {i: i for i in bits}
    for _ in bits:
        new = {i: min(lowest[j] for j in bits if (bits[i] ^ bits[j]).bit_count() <= 4) for i in bits}
        if new == lowest:
            break
        lowest = new
    assert {r["doc_id"]: r["component_id"] for r in rows} == lowest


def test_tiles_find_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    near = np.concatenate([base, base ^ np.uint64(7), base ^ np.uint64(1 << 40)])
    order = near[np.argsort(np.bitwise_count(near), kind="stable")]
    rows, columns = simhash.tile_links(order, order)
    want = {(i, j) for i in range(150) for j in range(150)
            if int(order[i] ^ order[j]).bit_count() <= 4}
    assert set(zip(rows.tolist(), columns.tolist())) == want


def test_links_compare_only_what_shares_a_block(spark):
    rng = np.random.default_rng(0)
    fps = rng.integers(-(1 << 63), 1 << 63, 20_000)
    # One hot block value over several tiles, and copies at a distance of 4 and 5 bits.
    fps[:3000] &= ~np.int64(0xFFF)
    far = fps[5000:5200] ^ np.int64((1 << 3) | (1 << 20) | (1 << 33) | (1 << 45))
    fps = np.unique(np.concatenate([fps, far, far ^ np.int64(1 << 60)]))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    met = simhash._meetings(df, 4, 512).select("i", "j").distinct().count()
    tiles = 5 * len(fps) / 512
    assert met < 2 * tiles  # not a share of all pairs of tiles
    found = simhash.links(df, 4, 512).collect()
    root = {int(f): int(f) for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in found:
        assert a != b
        root[max(top(a), top(b))] = min(top(a), top(b))
    bits = fps.view(np.uint64)
    want = {int(f): int(f) for f in fps}

    def end(f):
        while want[f] != f:
            f = want[f]
        return f

    for i in range(0, len(fps), 500):
        r, c = np.nonzero(np.bitwise_count(bits[i : i + 500, None] ^ bits[None]) <= 4)
        for a, b in zip(fps[r + i].tolist(), fps[c].tolist()):
            root_a, root_b = end(a), end(b)
            want[max(root_a, root_b)] = min(root_a, root_b)
    assert {f: top(f) for f in root} == {f: end(f) for f in want}


# ------------------------------------------------------------------------- licences


def test_licences(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "under CC BY-NC 4.0. All rights reserved",
        "GNU GENERAL public-license", "mit license", "x. Released under the MIT License.", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licences.scan(df, licences.document_counts(df)).collect()}
    assert rows[0]["labels"] == "apache-2.0" and rows[0]["n_words"] == 8
    assert rows[1]["base_labels"] == "cc-by,reserved"
    assert (rows[1]["first_word"], rows[1]["last_word"], rows[1]["n_base"]) == (1, 6, 2)
    assert (rows[2]["labels"], rows[2]["score"]) == ("gpl", 0.5)
    assert rows[3]["labels"] == "" and rows[4]["labels"] == "mit"
    assert rows[5]["n_words"] == rows[6]["n_words"] == 0 and rows[5]["first_word"] is None


# ----------------------------------------------------------------- search and shards


def test_top_k_leaves_out_unusable_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.9, 0.1]), (3, None), (4, [float("nan"), 1.0]),
            (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.pivot_top_k(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [1, 2, 8]
    assert found[0]["score"] == 256 * 256 + 128 * 128


def test_shards_are_even_and_slots_gapless(spark):
    df = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    slots = {}
    for r in sharding.ring_shards(df, shards=7).collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(s) for s in slots.values()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_more_shard_moves_few_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before, after = (
        {r["doc_id"]: r["shard"] for r in sharding.ring_shards(df, shards=n, slack=0.25).collect()}
        for n in (10, 11)
    )
    moved = sum(before[i] != after[i] for i in before)
    assert moved < 0.3 * len(before)
    assert max(Counter(after.values()).values()) <= math.ceil(1.25 * 5000 / 11)


# ------------------------------------------------------------------------ odd tables


def test_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, quality int")
    runs = {
        "passages": lambda d: passages.repeated_passages(d),
        "langid": lambda d: langid.with_language(d, F.lit(True)),
        "quality": lambda d: quality.quality(d, labels),
        "scoring": lambda d: scoring.lm_scores(d, held_out(F.col("doc_id"), 7)),
        "mixing": lambda d: mixing.mix(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "packing": lambda d: packing.pack(d, longest=100_000),
        "licences": lambda d: licences.scan(d, licences.document_counts(d)),
        "sharding": lambda d: sharding.ring_shards(d, shards=3),
    }
    sizes = {}
    for name, run in runs.items():
        assert run(none).count() == 0, name
        sizes[name] = len(run(odd).collect())
    assert sizes.pop("passages") == 0
    assert set(sizes.values()) == {len(ODD)}, json.dumps(sizes)


def test_whole_threshold_is_that_of_lists(spark, monkeypatch):
    monkeypatch.setattr(quality, "SCORE_CELLS", 4)
    rng = random.Random(2)
    for good, bad in (
        ([3.0, 4.0], [1.0, 2.0]),
        ([3.0], []),
        ([], [1.0]),
        ([1.0, 1.0], [1.0]),
        ([round(rng.gauss(1, 1), 1) for _ in range(300)], [round(rng.gauss(0, 1), 1) for _ in range(200)]),
    ):
        rows = [(1, x) for x in good] + [(0, x) for x in bad]
        got = quality.whole_threshold(spark.createDataFrame(rows, "quality int, llr double").repartition(3))
        want = quality.best_threshold(good, bad)
        assert got == want or got == pytest.approx(want)


def test_every_labelled_row_counts(spark):
    """More than 20,000 trusted rows, all of which are keys."""
    labels = spark.range(80_000).selectExpr("id as doc_id", "1 as quality")
    trusted, known = quality.trusted_ids(labels), quality.held_back(labels)
    assert trusted.count() + known.count() == 80_000 and trusted.count() > 50_000


def test_every_learnt_text_is_in_one_lesson(spark):
    rows = spark.range(100).selectExpr("id as doc_id", "id % 10 = 0 as held_out", "'t' || id as text")
    lessons = [{r["doc_id"] for r in scoring._lesson(rows, t).collect()} for t in range(scoring.ROUNDS)]
    assert sorted(i for x in lessons for i in x) == [i for i in range(100) if i % 10]


def test_few_rows_besides_the_wanted_are_moved(spark, monkeypatch):
    """A bitmap drops most rows without a key, and none with one, however full it is."""
    rows = spark.range(20_000).selectExpr("if(id = 7, null, id) as doc_id", "'a b' as text")
    keys = spark.range(500).selectExpr("id * 30 as doc_id")
    for most, fewest, largest in ((common.MOST_PIECES, 500, 2_000), (0, 20_000, 20_000)):
        if not most:
            keys = keys.select(F.col("doc_id").cast("int"))
        left = common.maybe_among(rows, keys).filter("_maybe")
        assert fewest <= left.count() <= largest
        assert left.join(keys, "doc_id").count() == 500
    none = common.maybe_among(rows, spark.createDataFrame([], "doc_id long"))
    assert none.columns == ["doc_id", "text", "_maybe"] and none.filter("_maybe").count() == 0
    moved = []
    monkeypatch.setattr(quality, "maybe_among", lambda d, k: moved.append(common.maybe_among(d, k)) or moved[-1])
    labels = spark.range(0, 20_000, 100).selectExpr("id as doc_id", "int(id % 200 = 0) as quality")
    quality.quality(rows, labels).count()
    assert len(moved) == 2 and all(m.filter("_maybe").count() < 2_000 for m in moved)


def test_windows_go_on_where_their_first_partner_is_not_alike(spark):
    """Rows of one word meet many others that agree; each is cut off elsewhere."""
    rng, rows, wanted, seen = random.Random(4), [], [], set()
    for doc in range(120):
        parts, at, new = [], 0, set()
        for w in rng.sample(range(12), 4):
            many = rng.randint(20, 90)
            if many >= passages.WORDS and w in seen:
                wanted.append((doc, at, at + many))
            if many >= passages.WORDS:
                new.add(w)
            parts, at = parts + [f"w{w}"] * many, at + many
        seen |= new
        rows.append((doc, " ".join(parts)))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = [(r["doc_id"], r["start_word"], r["end_word"]) for r in found.collect()]
    assert len(wanted) > 200
    for doc, a, b in wanted:
        held = {w for d, x, y in spans if d == doc for w in range(max(a, x), min(b, y))}
        assert len(held) >= passages.WORDS, (doc, a, b)


@pytest.mark.parametrize("seed", range(12))
def test_a_passage_is_found_where_no_likely_stretch_is_similar(seed):
    """One side has words more, so fewer than 8 / 9 of its shingles have a partner."""
    rng = np.random.default_rng(seed)
    mine = rng.integers(1, 1 << 30, 150).astype(np.uint32)
    more = int(rng.integers(4, 14))
    other = np.delete(mine, 60 + np.sort(rng.choice(46, more, replace=False)))
    far = np.r_[0:55, 115 : 150 - more]
    other[far] = rng.integers(1 << 30, 1 << 31, len(far))
    found = passages.alike(mine, other, 0, 46, 0.8)
    assert found
    for i, j, x, y, score in found:
        left, right = set(mine[i:j].tolist()), set(other[x:y].tolist())
        assert min(j - i, y - x) >= 46
        assert score == pytest.approx(len(left & right) / len(left | right)) and score >= 0.8


def test_only_windows_that_share_a_value_are_moved_with_their_marks(spark):
    rng = random.Random(5)
    alone = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(400))) for i in range(50)]
    twice = [(i, "a b c " + alone[i - 50][1]) for i in (50, 51)]
    texts = spark.createDataFrame(alone + twice, "doc long, text string")
    every, some = passages._windows(texts, 46), passages._shared_windows(texts, 46)
    shared = every.groupBy("v").agg(F.count_distinct("doc").alias("k")).filter("k > 1")
    assert every.join(shared, "v", "left_semi").exceptAll(some).count() == 0
    assert some.count() < every.count() / 5


def test_written_tables_leave_no_shuffle_files_and_no_inner_tables(spark, tmp_path):
    """Shuffles end with the write that needed them; tables of a step with the step."""
    from scorewright import session

    before = spark.conf.get(session.FILE_CLEANUP)
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return sum(1 for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f)

    spark.range(9).repartition(3, "id").collect()
    there = shuffles()
    table = session.materialise(spark.range(1_000).repartition(7, "id"), "rows")
    for _ in range(50):
        if shuffles() <= there:
            break
        time.sleep(0.1)
    assert shuffles() <= there and table.count() == 1_000
    inner = []

    def make():
        inner.append(session.materialise(table.filter("id < 10"), "inner"))
        return inner[0].selectExpr("id * 2 as id")

    assert session.settled(spark, "outer", make).agg(F.sum("id")).first()[0] == 90
    with pytest.raises(Exception):
        inner[0].count()
    assert spark.conf.get(session.FILE_CLEANUP) == before


def test_only_texts_that_may_be_copies_have_their_words_counted(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i % 40}x{k}" for k in range(60))) for i in range(50)] + [(60, "a b"), (61, "a b")]
    texts = spark.createDataFrame(rows, "doc long, text string")
    counted = []
    monkeypatch.setattr(passages, "maybe_among", lambda d, k: counted.append(common.maybe_among(d, k)) or counted[-1])
    copies, left = passages._copies(texts, 50)
    assert counted[0].filter("_maybe").count() < 20
    assert sorted(tuple(r)[:4] for r in copies.collect()) == [(i, 0, 60, i - 40) for i in range(40, 50)]
    assert sorted(r["doc"] for r in left.collect()) == [*range(40), 60, 61]


def test_all_words_are_encoded_in_one_call(monkeypatch):
    """With the ids each word has alone; long words in parts of 200."""
    encoder, calls = scoring._encoder(scoring.TOKENIZERS), []

    class Counted:
        encode_single_token = encoder.encode_single_token

        def encode_to_numpy(self, text):
            calls.append(text)
            return encoder.encode_to_numpy(text)

    monkeypatch.setattr(scoring, "_encoder", lambda folder: Counted())
    long = "é" * 450 + "x" * 31
    words = ["the", "", long, "<|endoftext|>", " a\x85b", "the"]
    ids, many = scoring.subwords([w.encode() for w in words], scoring.TOKENIZERS)
    assert len(calls) == 1
    want = []
    for word in words:
        text = " " + word if word else ""
        parts = [text[a : a + 200] for a in range(0, len(text), 200)]
        want.append([i for p in parts for i in encoder.encode_ordinary(p)] or [scoring.END])
    assert many.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
