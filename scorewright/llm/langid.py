"""Language by rank-order profiles of letter n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.llm.common import even, worker_value

UNKNOWN = "und"
LONGEST_GRAM = 3
RANKS = 300
# Rows of each language that the profiles are counted on, chosen by the hash of the key.
FIT_ROWS = 4_000
# Languages with a profile; the commonest are taken, ties by name.
MOST_LANGUAGES = 256
# Code points of the texts that are counted together, and of one piece of a long text.
CHUNK = 1 << 20
# Bits of a letter number; there are about 140,000 letters.
_LETTER_BITS = 18
_MASK = (1 << _LETTER_BITS) - 1


def letter_numbers() -> np.ndarray:
    """Code point to the number of its small letter, from 1 in order of code points; else 0."""
    return worker_value("letter numbers", _letter_numbers)


def _letter_numbers() -> np.ndarray:
    small = np.zeros(0x110000, dtype=np.int64)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            small[point] = ord(low[0]) if low[0].isalpha() else point
    known, numbers = np.unique(small, return_inverse=True)
    return numbers.astype(np.int32)


def letters(text: str) -> np.ndarray:
    """Numbers of a text's letters; 0 for everything else."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return letter_numbers()[points]


def counted(texts: list[str | None]):
    """Chunks of (text number, n-gram, count), each text in one chunk only.

    A word has a blank at either end: an n-gram of one to three signs holds a letter,
    and blanks at its ends only.  Rows come by text, length of the n-gram, n-gram.
    """
    group: list[tuple[int, np.ndarray]] = []
    held = 0
    for number, text in enumerate(texts):
        if not text:
            continue
        if len(text) > CHUNK:
            yield _long(number, text)
            continue
        codes = np.concatenate([_BLANK, letters(text), _BLANK])
        group.append((number, codes))
        held += len(codes)
        if held > CHUNK:
            yield from _together(group)
            group, held = [], 0
    yield from _together(group)


_BLANK = np.zeros(1, dtype=np.int32)


def _together(group):
    if not group:
        return
    codes = np.concatenate([c for _, c in group] + [_BLANK, _BLANK])
    # Letters renumbered in their order: text and n-gram then share one number.
    present = np.flatnonzero(np.bincount(codes, minlength=1))
    present = present if present[0] == 0 else np.concatenate([[0], present])
    signs = len(present)
    grams = signs + signs**2 + signs**3
    if grams * len(group) >= 1 << 62:
        half = len(group) // 2
        yield from _together(group[:half])
        yield from _together(group[half:])
        return
    renumbered = np.zeros(int(present[-1]) + 1, dtype=np.int64)
    renumbered[present] = np.arange(signs)
    codes = renumbered[codes]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    base = np.repeat(np.arange(len(group)) * grams, [len(x) for _, x in group])
    two = a * signs + b
    keep_one, keep_two, keep_three = a > 0, two > 0, b > 0
    both = np.concatenate(
        [
            (base + a)[keep_one],
            (base + (two + signs))[keep_two],
            (base + (two * signs + c + (signs + signs**2)))[keep_three],
        ]
    )
    if not len(both):
        return
    both.sort()
    starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    counts = np.diff(np.r_[starts, len(both)])
    both = both[starts]
    owners = both // grams
    values = _canonical(both - owners * grams, present)
    yield np.array([n for n, _ in group])[owners], values, counts


def _canonical(values: np.ndarray, present: np.ndarray) -> np.ndarray:
    """n-gram numbers that do not depend on the other texts: its letters, then its length."""
    signs = len(present)
    two, three = values >= signs, values >= signs + signs**2
    rest = values - np.where(three, signs + signs**2, np.where(two, signs, 0))
    a = present[np.where(three, rest // signs**2, np.where(two, rest // signs, rest))]
    b = present[np.where(three, rest // signs % signs, np.where(two, rest % signs, 0))]
    c = present[np.where(three, rest % signs, 0)]
    pair = a << _LETTER_BITS | b
    return np.where(
        three,
        (pair << _LETTER_BITS | c) + (1 << 3 * _LETTER_BITS),
        np.where(two, pair + (1 << 2 * _LETTER_BITS), a),
    )


def _long(number: int, text: str):
    """One text in pieces: each counts the n-grams that start in it."""
    values, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    codes = np.concatenate([_BLANK, letters(text), _BLANK])
    for at in range(0, len(codes), CHUNK):
        piece = codes[at : at + CHUNK + 2]
        found = [(v, n) for _, v, n in _together([(0, piece)])]
        if at + CHUNK < len(codes):
            # Those that start in the two signs of overlap belong to the next piece.
            found += [(v, -n) for _, v, n in _together([(0, piece[CHUNK:])])]
        for own, many in found:
            values, place = np.unique(np.concatenate([values, own]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([counts, many]))
            counts = total.astype(np.int64)
    left = counts > 0
    return np.full(int(left.sum()), number), values[left], counts[left]


def ranked(owners: np.ndarray, values: np.ndarray, counts: np.ndarray, ranks: int):
    """Of each text the commonest n-grams with their ranks from 0; ties by n-gram."""
    starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    most, n = int(counts.max()) + 1, len(owners)
    place = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    first = place * most + (most - 1 - counts)
    if len(starts) * most * n < 1 << 62:
        order = np.sort(first * n + np.arange(n)) % n
    else:
        order = np.argsort(first, kind="stable")
    rank = np.arange(n) - starts[place]
    keep = order[rank < ranks]
    return owners[keep], values[keep], rank[rank < ranks]


def fit_profiles(
    rows: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    ranks: int = RANKS,
    fit_rows: int = FIT_ROWS,
) -> dict[str, dict[int, int]]:
    """For each language its n-grams by rank, from at most ``fit_rows`` rows of it."""
    labelled = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MOST_LANGUAGES)
    share = F.lit(0.0)
    for row in sizes.collect():
        share = F.when(F.col(lang) == row[lang], min(1.0, fit_rows / row["count"])).otherwise(share)
    at = F.shiftrightunsigned(F.xxhash64(key, text), 11) / F.lit(float(1 << 53))
    chosen = labelled.filter(at < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for owners, values, counts in counted(batch.column("text").to_pylist()):
                langs, place = np.unique(np.array(names)[owners], return_inverse=True)
                for i, name in enumerate(langs):
                    own, inner = np.unique(values[place == i], return_inverse=True)
                    many = np.bincount(inner, weights=counts[place == i]).astype(np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array([str(name)] * len(own)), "gram": own, "n": many}
                    )

    found = even(chosen).mapInArrow(count, "lang string, gram long, n long")
    totals = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < ranks)
    profiles: dict[str, dict[int, int]] = {}
    for row in top.collect():
        profiles.setdefault(row["lang"], {})[row["gram"]] = row["rank"]
    return profiles


def identify(
    df: DataFrame,
    profiles: dict[str, dict[int, int]],
    text: str = "text",
    ranks: int = RANKS,
) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to each row.

    The distance to a language adds up, over the text's ``ranks`` commonest n-grams,
    how far each one's rank is from its rank in the profile, and ``ranks`` where the
    profile has none.  The nearest language is the answer, ties by name; ``score`` is
    1 less the share of the largest possible distance.  A text that is null or has no
    letters gives ``und`` and 0, as do all texts without any profile.  Texts are
    taken whole: a long one is counted in pieces that overlap.
    """
    names = sorted(profiles)
    known = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.int64)
    places = np.full((len(known) + 1, len(names)), -1, dtype=np.int64)
    for column, name in enumerate(names):
        for gram, rank in profiles[name].items():
            places[np.searchsorted(known, gram), column] = rank
    kept = [f for f in df.schema if f.name not in ("lang_pred", "score")]
    schema = T.StructType(
        [
            *kept,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def guess(texts):
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for found in counted(texts) if names else ():
            owners, values, at = ranked(*found, ranks)
            row = np.searchsorted(known, values)
            hit = (row < len(known)) & (known[np.minimum(row, len(known) - 1)] == values)
            place = places[np.where(hit, row, len(known))]
            off = np.where(place < 0, ranks, np.abs(place - at[:, None]))
            starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            distance = np.add.reduceat(off, starts, axis=0)
            most = np.diff(np.r_[starts, len(owners)]) * ranks
            best = distance.argmin(axis=1)
            for text, b, d, m in zip(owners[starts], best, distance.min(axis=1), most):
                langs[text], scores[text] = names[b], 1 - d / m
        return langs, scores

    def run(batches):
        for batch in batches:
            langs, scores = guess(batch.column(text).to_pylist())
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return even(df).mapInArrow(run, schema)


def with_language(
    df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id"
) -> DataFrame:
    """Fit on the rows that ``learn`` selects, and identify all of them."""
    return identify(df, fit_profiles(df.filter(learn), text, lang, key), text)
