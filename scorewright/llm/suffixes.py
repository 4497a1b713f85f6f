"""Suffix-array dedup: remove the bytes of strings that stand earlier in the corpus.

A string of ``LENGTH`` bytes is named by its anchor, the 32 bytes in it with the least
hash (the first, if several have it).  Neighbouring strings with the same anchor form a
segment, so equal strings lie at equal places of segments with equal anchors, and only
anchors that occur again matter.  Equal segments are counted once; the parts of distinct
segments that can hold a common string are put into one text, whose suffix array brings
equal strings together.

The suffix array is built by grouping, without renaming: suffixes with equal Lyndon
prefixes form groups, found from the highest to the lowest by pointers to the previous
smaller suffix, and the order inside each group then follows in one pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.blocks import shuffles_end
from scorewright.llm.common import even, written

LENGTH = 100
ANCHOR = 32
# Bytes that are worked on together: texts in a task, and text of one suffix array.
SLICE = 250_000
BUCKET = 8_000_000
ARRAY = 1_000_000
LEAST_BUCKETS = 64
# Anchors that a task compares before it hands them on, and what it says of them.
HELD = 1_000_000
SINGLE, WORD, KNOWN = 0, 1, 2
# Segments of an anchor that may share one suffix array; beyond, strings are compared
# one by one, spread by their content.
MOST = 20_000
CLASSES = 16
_SEED = 13
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------- suffix array


def suffix_array(text: list[int] | bytes) -> list[int]:
    """Places of all suffixes in ascending order, the empty one left out."""
    n = len(text)
    if not n:
        return []
    # Places count from 1; 0 is before the text and never done.  Groups by first letter:
    # ``group`` of each place, ``size``, ``under`` and ``over`` of each group.
    letters = sorted(set(text))
    number = {c: g for g, c in enumerate(letters)}
    group = [-1, *(number[c] for c in text)]
    members: list[list[int]] = [[] for _ in letters]
    for i in range(1, n + 1):
        members[group[i]].append(i)
    size = [len(m) for m in members]
    under = list(range(-1, len(letters) - 1))
    over = [*range(1, len(letters)), -1]
    start = [0] * len(letters)
    previous = [0] * (n + 1)
    done = bytearray(n + 1)
    end = n + 1
    now = len(letters) - 1
    # First: from the highest group down, each place finds the nearest place before it
    # that is still in a lower group; that place's prefix grows by this group's.
    while now >= 0:
        inside = members[now]
        if size[now] < len(inside):
            inside = [i for i in inside if group[i] == now]
        end -= len(inside)
        start[now] = end
        for i in inside:
            done[i] = 1
        # Places of a group that grow alike move together, those that grow more higher.
        moved: dict[int, list[int]] = {}
        last, times = 0, 0
        for i in inside:
            j = i - 1
            while done[j]:
                j = previous[j]
            previous[i] = j
            if j != last:
                if last:
                    way = group[last] * n + times - 1
                    if way in moved:
                        moved[way].append(last)
                    else:
                        moved[way] = [last]
                last, times = j, 1
            else:
                times += 1
        if last:
            moved.setdefault(group[last] * n + times - 1, []).append(last)
        for way in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            old = way // n
            places = moved[way]
            if len(places) == size[old]:
                # All that is left of the group grows alike: it stays what it is.
                continue
            new = len(members)
            members.append(places)
            size[old] -= len(places)
            size.append(len(places))
            start.append(0)
            for j in places:
                group[j] = new
            # Directly over the group they leave; smaller numbers of times come after.
            above = over[old]
            under.append(old)
            over.append(above)
            over[old] = new
            if above >= 0:
                under[above] = new
        now = under[now]
    # Then: in ascending order, each suffix places those that end their prefix before it.
    order = [n + 1] * (n + 1)
    placed = bytearray(n + 1)
    placed[0] = 1
    for k in range(n + 1):
        j = order[k] - 1
        while not placed[j]:
            placed[j] = 1
            g = group[j]
            at = start[g]
            start[g] = at + 1
            order[at] = j
            j = previous[j]
    return [i - 1 for i in order[1:]]


# ------------------------------------------------------------------------- segments


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    w = data.astype(np.uint64)
    for step in (1, 2, 4):
        w = w[:-step] | (w[step:] << np.uint64(8 * step))
    return w


def _cut(texts: list[bytes], length: int):
    """Text, first byte, number of strings, anchor and its place, for all segments of some texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if len(data) < length:
        return [np.array([], dtype=np.int64)] * 5
    eight = _words(data)
    many = len(data) - ANCHOR + 1
    hashed = np.zeros(many, dtype=np.uint64)
    for step in range(0, ANCHOR, 8):
        hashed ^= eight[step : step + many]
        hashed *= _ODD
        hashed ^= hashed >> np.uint64(32)
    # The least hash of a window, and of equal ones the first: place in the lower half.
    least = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(many, dtype=np.uint64)
    span, width = 1, length - ANCHOR + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= ends[text]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new & whole)
    # A segment goes on to the next one, or to the last whole string of its text.
    after = np.append(np.flatnonzero(new), len(anchor))
    stop = np.minimum(after[np.searchsorted(after, first, "right")], ends[text[first]] - length + 1)
    start = first - (ends - sizes)[text[first]]
    return text[first], start, stop - first, hashed[anchor[first]].view(np.int64), anchor[first] - first


def _slices(texts: list[bytes]):
    at = 0
    while at < len(texts):
        size, upto = 0, at
        while upto < len(texts) and (size == 0 or size < SLICE):
            size += len(texts[upto])
            upto += 1
        yield at, texts[at:upto]
        at = upto


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """``anchor, route``: the texts in which an anchor of theirs, or of others, occurs again."""

    def found(batches):
        held, many = [], 0
        for batch in batches:
            route = batch.column("route").to_numpy()
            for at, some in _slices(batch.column("body").to_pylist()):
                text, _, _, anchor, _ = _cut(some, length)
                held.append((anchor, route[at + text]))
                many += len(anchor)
                if many >= HELD:
                    yield _told_apart(held)
                    held, many = [], 0
        if held:
            yield _told_apart(held)

    def again(batches):
        # Sorted by anchor; the last anchor of a batch waits for the next one.
        waits = np.zeros((3, 0), dtype=np.int64)
        before = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("anchor", "route", "kind")])
            known = rows[2] == KNOWN
            yield pa.RecordBatch.from_arrays([pa.array(x[known]) for x in rows[:2]], ["anchor", "route"])
            waits = np.concatenate([waits, rows[:, ~known]], axis=1)
            if waits.shape[1] > 1:
                yield _met(waits, before, False)
                before, waits = waits[0, -2], waits[:, -1:]
        if waits.shape[1]:
            yield _met(waits, before, True)

    rows = texts.select("route", "body").mapInArrow(found, "anchor long, route long, kind long")
    # What is known already need not meet, so no anchor has more rows to meet than there
    # are tasks, however many texts it stands in.
    goes_to = F.when(F.col("kind") == KNOWN, F.col("route")).otherwise(F.col("anchor"))
    rows = rows.repartition(goes_to).sortWithinPartitions("anchor")
    return rows.mapInArrow(again, "anchor long, route long")


def _told_apart(held: list) -> pa.RecordBatch:
    """Rows of anchor and text: known to occur again here, or single; and word of the known."""
    anchor, route = (np.concatenate([x[i] for x in held]) for i in range(2))
    order = np.lexsort((route, anchor))
    anchor, route = anchor[order], route[order]
    equal = np.r_[False, anchor[1:] == anchor[:-1]]
    known = equal | np.r_[equal[1:], False]
    repeated = equal & np.r_[False, route[1:] == route[:-1]]
    told = anchor[known & ~equal]
    return pa.RecordBatch.from_pydict(
        {
            "anchor": np.concatenate([anchor[~repeated], told]),
            "route": np.concatenate([route[~repeated], np.zeros(len(told), dtype=np.int64)]),
            "kind": np.concatenate([np.where(known, KNOWN, SINGLE)[~repeated], np.full(len(told), WORD)]),
        }
    )


def _met(rows: np.ndarray, before: int | None, last: bool) -> pa.RecordBatch:
    """The single rows whose anchor stands next to an equal one; the last only at the end."""
    anchor, route, kind = rows
    twice = np.r_[anchor[1:] == anchor[:-1], False]
    twice[1:] |= twice[:-1]
    if before is not None:
        twice |= anchor == before
    twice &= kind == SINGLE
    twice[-1] &= last
    return pa.RecordBatch.from_arrays([pa.array(anchor[twice]), pa.array(route[twice])], ["anchor", "route"])


def _segments(texts: DataFrame, anchors: DataFrame, buckets: int, length: int) -> DataFrame:
    """Segments of shared anchors; each bucket gives the bytes of equal ones once."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = (
        f"anchor long, body_hash long, none boolean, doc_id {kind}, route long, route2 long, "
        "first long, strings long, anchor_at long, body binary"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        order = [("none", "ascending"), ("doc_id", "ascending"), ("route", "ascending"), ("route2", "ascending")]
        left = left.sort_by(order)
        keys = list(zip(left.column("route").to_pylist(), left.column("route2").to_pylist()))
        seen: set = set()
        once = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
        left = left.take(pa.array(once, pa.int64()))
        shared = np.unique(right.column("anchor").to_numpy())
        bodies = left.column("body").to_pylist()
        met: set = set()
        row, anchors, hashes, firsts, strings, places, parts = [], [], [], [], [], [], []
        for at, some in _slices(bodies):
            text, first, many, anchor, place = _cut(some, length)
            near = np.searchsorted(shared, anchor)
            near[near == len(shared)] = 0
            keep = np.flatnonzero(shared[near] == anchor) if len(shared) else []
            for t, f, m, a, p in zip(*(x[keep].tolist() for x in (text, first, many, anchor, place))):
                part = some[t][f : f + m + length - 1]
                mark = (a, xxhash.xxh3_64_intdigest(part, _SEED))
                row.append(at + t)
                anchors.append(a)
                hashes.append(mark[1])
                firsts.append(f)
                strings.append(m)
                places.append(p)
                parts.append(None if mark in met else part)
                met.add(mark)
        rows = left.select(["none", "doc_id", "route", "route2"]).take(pa.array(row, pa.int64()))
        columns = {
            "anchor": pa.array(anchors, pa.int64()),
            "body_hash": pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)),
            **{n: rows.column(n) for n in rows.column_names},
            "first": pa.array(firsts, pa.int64()),
            "strings": pa.array(strings, pa.int64()),
            "anchor_at": pa.array(places, pa.int64()),
            "body": pa.array(parts, pa.binary()),
        }
        return pa.table({n: columns[n] for n in names})

    bucket = F.pmod(F.col("route"), F.lit(buckets))
    here = texts.withColumn("bucket", bucket).groupBy("bucket")
    there = anchors.withColumn("home", bucket).groupBy("home")
    return here.cogroup(there).applyInArrow(cut, schema)


def parts(bodies: list[bytes], anchor: np.ndarray, anchor_at: np.ndarray, length: int):
    """Segment, first and last string of the parts that can share a string with another.

    The strings of a segment are told apart by how far they begin before the anchor, in
    classes; those of a class have a core in common, and a string can only stand in
    two segments if the cores of its class are equal.
    """
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    eight = _words(np.frombuffer(b"".join(bodies) + bytes(8), np.uint8))
    spread = length - ANCHOR
    step = -(-(spread + 1) // CLASSES)
    least = anchor_at - (sizes - length)
    found = []
    for c in range(CLASSES):
        # Strings of this class begin from low to high bytes before the anchor.
        low, high = np.maximum(least, c * step), np.minimum(anchor_at, min((c + 1) * step - 1, spread))
        here = np.flatnonzero(low <= high)
        begin = starts[here] + anchor_at[here] - c * step
        core = ANCHOR + c * step + max(0, spread - (c + 1) * step + 1)
        key = anchor[here].view(np.uint64).copy()
        for at in [*range(0, core - 7, 8), core - 8]:
            key = (key ^ eight[begin + at]) * _ODD
            key ^= key >> np.uint64(29)
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        here = here[times[which] > 1]
        found.append((here, (anchor_at - np.minimum(high, anchor_at))[here], (anchor_at - low)[here]))
    segment, first, last = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((first, segment))
    segment, first, last = segment[order], first[order], last[order]
    new = np.r_[True, (segment[1:] != segment[:-1]) | (first[1:] > last[:-1] + 1)][: len(segment)]
    at = np.flatnonzero(new)
    return segment[at], first[at], last[np.r_[at[1:], len(segment)].astype(np.int64)[: len(at)] - 1]


def repeats(bodies: list[bytes], document: np.ndarray, first: np.ndarray, length: int):
    """Segment and place of every string that an earlier segment has, by a suffix array.

    ``document`` rises with the order of documents; ``first`` is where a segment starts.
    """
    if not bodies:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    # Letters from 1; a 0 after each segment.
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1)
    data[ends - 1] = 0
    order = np.array(suffix_array(data.tolist()), dtype=np.int64)
    segment = np.searchsorted(ends, order, "right")
    whole = order + length < ends[segment]
    order, segment = order[whole], segment[whole]
    if not len(order):
        return order, segment
    eight = _words(np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8))
    same = np.ones(len(order) - 1, dtype=bool)
    for step in [*range(0, length - 7, 8), length - 8]:
        part = eight[order + step]
        same &= part[1:] == part[:-1]
    run = np.cumsum(np.r_[True, ~same]) - 1
    place = order - (ends - sizes - 1)[segment]
    by = np.lexsort((first[segment] + place, document[segment], run))
    earlier = np.r_[False, run[by][1:] == run[by][:-1]]
    return segment[by][earlier], place[by][earlier]


def _runs(segment: np.ndarray, place: np.ndarray, length: int):
    """Segment, first and last byte of the strings of each segment, neighbours joined."""
    by = np.lexsort((place, segment))
    segment, place = segment[by], place[by]
    new = np.r_[True, (segment[1:] != segment[:-1]) | (place[1:] > place[:-1] + length)]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(place)] - 1
    return segment[at], place[at], place[last] + length


def _inner(distinct: DataFrame, buckets: int, length: int) -> DataFrame:
    """Of first segments: the bytes of strings that an earlier distinct segment has."""

    def order(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("none", "doc_id", "route", "route2", "first")])
        routes = [rows.column(c).to_numpy() for c in ("route", "route2")]
        new = np.r_[False, (routes[0][1:] != routes[0][:-1]) | (routes[1][1:] != routes[1][:-1])]
        first = rows.column("first").to_numpy()
        bodies = rows.column("body").to_pylist()
        which, low, high = parts(
            bodies, rows.column("anchor").to_numpy(), rows.column("anchor_at").to_numpy(), length
        )
        some = [bodies[i][a : b + length] for i, a, b in zip(which.tolist(), low.tolist(), high.tolist())]
        document, first, route = np.cumsum(new)[which], first[which] + low, routes[0][which]
        segment, place = repeats(some, document, first, length)
        at, low, high = _runs(segment, place, length) if len(segment) else (segment,) * 3
        return pa.table({"route": route[at], "low": first[at] + low, "high": first[at] + high})

    grouped = distinct.withColumn("bucket", F.pmod("anchor", F.lit(buckets))).groupBy("bucket")
    return grouped.applyInArrow(order, "route long, low long, high long")


def _inner_by_string(distinct: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many segments: each string by itself."""
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.col("strings") - 1))
    strings = distinct.withColumn("_at", place)
    string = F.substring("body", F.col("_at").cast("int") + 1, F.lit(length))
    at = F.struct("none", "doc_id", "route", "route2", (F.col("first") + F.col("_at")).alias("low"))
    keyed = strings.select(
        F.xxhash64(string).alias("_1"), F.xxhash64(F.lit(_SEED), string).alias("_2"), at.alias("at")
    )
    least = keyed.groupBy("_1", "_2").agg(F.min("at").alias("least"))
    later = keyed.join(least, ["_1", "_2"]).filter(F.col("at") > F.col("least"))
    return later.select("at.route", "at.low", (F.col("at.low") + length).alias("high"))


# --------------------------------------------------------------------------- results


def without_repeats(
    docs: DataFrame, length: int = LENGTH, most: int = MOST, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``, one row for each row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a
    document with a smaller id (null ids last, equal ids by a hash of the text), or
    earlier in the same.  Strings are judged on the input.  ``spans`` lists the removed
    runs as (first byte, byte after the last).  Null texts are empty.  A row that repeats
    id and text of another is a later document.  Extra columns are left out.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"length has to be {ANCHOR + 8} at least")
    with shuffles_end(docs.sparkSession):
        keyed, result = _judged(docs, length, most, key, text)

    # The first document of each text has its result; later ones go whole.
    joined = keyed.join(result, ["route", "route2"], "left")
    time = F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))
    joined = joined.withColumn("_time", time)
    leads_here = F.col("doc_id").eqNullSafe(F.col("lead")) & (F.col("_time") == 1)
    long_ = F.col("n_bytes") >= length
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n_bytes").alias("high")))
    nothing = F.array().cast("array<struct<low: long, high: long>>")

    def chosen(mine, whole, kept):
        return F.when(~long_, kept).when(leads_here, mine).otherwise(whole)

    return joined.select(
        "doc_id",
        "n_bytes",
        chosen(F.col("n_removed"), F.col("n_bytes"), F.lit(0).cast("long")).alias("n_removed"),
        chosen(F.col("n_spans"), F.lit(1).cast("long"), F.lit(0).cast("long")).alias("n_spans"),
        chosen(F.col("kept_sha256"), F.sha2(F.lit(""), 256), F.col("short")).alias("kept_sha256"),
        chosen(F.col("spans"), all_, nothing).alias("spans"),
    )


def _judged(docs: DataFrame, length: int, most: int, key: str, text: str):
    """Counted (id, text hash) keys, and the result of the first document of each text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = even(docs.select(F.col(key).alias("doc_id"), whole.alias("text")))
    size = F.octet_length("text").cast("long")
    short = F.when(size < length, F.sha2("text", 256))
    rows = rows.select(
        "doc_id",
        F.col("doc_id").isNull().alias("none"),
        F.xxhash64("text").alias("route"),
        F.xxhash64(F.lit(_SEED), "text").alias("route2"),
        size.alias("n_bytes"),
        short.alias("short"),
        F.encode("text", "UTF-8").alias("body"),
    )
    # Documents of equal text and id are one row with a count.
    keyed = rows.groupBy("doc_id", "none", "route", "route2", "n_bytes", "short").count()
    keyed = written(keyed, "keys")
    order = F.struct("none", "doc_id")
    leads = keyed.filter(F.col("n_bytes") >= length).groupBy("route", "route2").agg(F.min(order).alias("lead"))
    texts = rows.filter(F.col("n_bytes") >= length).join(leads, ["route", "route2"])
    texts = texts.filter(F.col("doc_id").eqNullSafe(F.col("lead.doc_id")))
    texts = written(texts.select("route", "route2", "none", "doc_id", "body"), "texts")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, size // BUCKET)

    anchors = written(_anchors(texts, length), "anchors")
    segments = written(_segments(texts, anchors, buckets, length), "segments")
    at = F.struct("none", "doc_id", "route", "route2", "first", "body", "strings", "anchor_at")
    firsts = segments.groupBy("anchor", "body_hash").agg(F.min(at).alias("at"))
    firsts = written(firsts.select("anchor", "body_hash", "at.*"), "firsts")
    counts = firsts.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("size"))
    counts = written(counts.filter("n > 1"), "counts")
    size = counts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    distinct = firsts.join(counts.drop("size"), "anchor")
    few, many = distinct.filter(F.col("n") <= most), distinct.filter(F.col("n") > most)
    inner = _inner(few, max(LEAST_BUCKETS, size // ARRAY), length)
    inner = written(inner.unionByName(_inner_by_string(many, length)), "inner")

    # Every later occurrence of a segment goes whole.
    lead = firsts.select(
        "anchor", "body_hash", F.col("route").alias("_r"), F.col("route2").alias("_r2"), F.col("first").alias("_f")
    )
    other = segments.drop("body").join(lead, ["anchor", "body_hash"])
    other = other.filter("route <> _r or route2 <> _r2 or first <> _f")
    copies = other.select("route", F.col("first").alias("low"), (F.col("first") + F.col("strings") + length - 1).alias("high"))
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"route long, route2 long, lead {kind}, n_removed long, n_spans long, kept_sha256 string,"
        " spans array<struct<low: long, high: long>>"
    )

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        spans: dict[int, list] = {}
        order = pc.sort_indices(right, sort_keys=[("route", "ascending"), ("low", "ascending")])
        right = right.take(order)
        for r, a, b in zip(*(right.column(c).to_pylist() for c in ("route", "low", "high"))):
            own = spans.setdefault(r, [])
            if own and a <= own[-1][1]:
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
        seen: set = set()
        out = []
        columns = (left.column(c).to_pylist() for c in ("route", "route2", "doc_id", "body"))
        for route, route2, doc_id, body in zip(*columns):
            if (route, route2) in seen:
                continue
            seen.add((route, route2))
            own = spans.get(route, [])
            digest, at = hashlib.sha256(), 0
            for a, b in own:
                digest.update(body[at:a])
                at = b
            digest.update(body[at:])
            gone = sum(b - a for a, b in own)
            out.append((route, route2, doc_id, gone, len(own), digest.hexdigest(), [{"low": a, "high": b} for a, b in own]))
        types = [pa.int64(), pa.int64(), left.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(),
                 pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))]
        names = ("route", "route2", "lead", "n_removed", "n_spans", "kept_sha256", "spans")
        return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(zip(names, types))})

    bucket = F.pmod(F.col("route"), F.lit(buckets))
    here = texts.withColumn("bucket", bucket).groupBy("bucket")
    there = inner.unionByName(copies).withColumn("home", bucket).groupBy("home")
    result = written(here.cogroup(there).applyInArrow(removed, schema), "removed")
    return keyed, result
