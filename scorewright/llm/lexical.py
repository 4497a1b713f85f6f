"""Ranked lexical search: item bundles pass from term owner to term owner.

The terms of the items are dealt to owners by weight, rare ones first.  An item bundle
is a block of items before a block of documents; it carries one number for each pair of
item and document that may still be among the best.  At an owner it meets the postings
of that owner's terms in its documents (a cogroup), adds their contributions, and goes
on to the next.  Contributions are whole numbers, so their order does not matter.

What is given up on the way cannot come back: with the most that later owners can add,
a pair below the 50th best of its item so far is out, and from some owner on no new
pairs can start.  So the bundles stay sparse and the result is exact.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.blocks import SLOTS, lists, numbered_blocks, packed, unpacked
from scorewright.llm.common import even, written

# Letters and digits of ASCII, and every character beyond; only A-Z change their case.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
    for c in range(256)
)
# Bytes of item text searched for in one pass over the documents.
ITEM_BYTES = 1_000_000
# What each owner holds of all postings; the first have the rarest terms.
SHARES = (1 / 32, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2)
# Cells of the dense sheet an item bundle is added up in.
SHEET = 4_000_000
CARRIED = "block long, items binary, slots binary, scores binary"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def _matched(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """block, slot, doc_id, n, and the searched terms of each document with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        place = shared.value.get
        for block, ids, texts in numbered_blocks(batches):
            n, sizes, found, counts = [], [], [], []
            for text in texts:
                all_terms = terms(text)
                n.append(len(all_terms))
                at = np.fromiter((x for x in map(place, all_terms) if x is not None), np.int32)
                some, times = np.unique(at, return_counts=True)
                sizes.append(len(some))
                found.append(some)
                counts.append(times)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": np.full(len(n), block),
                    "slot": np.arange(len(n), dtype=np.int32),
                    "doc_id": ids.combine_chunks(),
                    "n": pa.array(n, pa.int64()),
                    "terms": lists(sizes, np.concatenate([*found, []]), pa.int32()),
                    "tfs": lists(sizes, np.concatenate([*counts, []]), pa.int64()),
                }
            )

    kind = docs.schema[0].dataType.simpleString()
    schema = f"block long, slot int, doc_id {kind}, n long, terms array<int>, tfs array<long>"
    return written(docs.mapInArrow(run, schema), "matched")


def _postings(batch, with_terms: int, tokens: int):
    """Of a batch of matched documents: row, term and impact of each posting."""
    found, counts = batch.column("terms"), batch.column("tfs")
    sizes = np.diff(found.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = found.flatten().to_numpy(zero_copy_only=False)
    tf = counts.flatten().to_numpy(zero_copy_only=False)
    n = batch.column("n").to_numpy(zero_copy_only=False)
    spread = 50 + (50 * n * with_terms) // max(tokens, 1)
    return row, term, (10**9 * tf) // (1000 * tf + 20 * spread[row])


def _statistics(matched: DataFrame, size: int, with_terms: int, tokens: int):
    """For each term the number of documents that hold it, and its greatest impact."""

    def run(batches):
        held = np.zeros(size, dtype=np.int64)
        most = np.zeros(size, dtype=np.int64)
        for batch in batches:
            _, term, impact = _postings(batch, with_terms, tokens)
            held += np.bincount(term, minlength=size)
            np.maximum.at(most, term, impact)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": some, "df": held[some], "most": most[some]})

    rows = matched.mapInArrow(run, "term long, df long, most long")
    held, most = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    # One row for each term of this block of items.
    for r in rows.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")).collect():
        held[r["term"]], most[r["term"]] = r["df"], r["most"]
    return held, most


def _owned(matched: DataFrame, owner: np.ndarray, with_terms: int, tokens: int) -> DataFrame:
    """The inverted index: for each owner and block of documents, packed postings."""

    def run(batches):
        for batch in batches:
            row, term, impact = _postings(batch, with_terms, tokens)
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            slots = batch.column("slot").to_numpy(zero_copy_only=False)
            out = []
            for block in np.unique(blocks):
                inside = np.flatnonzero(blocks[row] == block)
                for own in np.unique(owner[term[inside]]):
                    some = inside[owner[term[inside]] == own]
                    out.append((own, block, term[some], slots[row[some]], impact[some]))
            yield pa.RecordBatch.from_pydict(
                {
                    "owner": pa.array([x[0] for x in out], pa.int32()),
                    "block": pa.array([x[1] for x in out], pa.int64()),
                    "terms": pa.array([packed(x[2], "<i4") for x in out], pa.binary()),
                    "slots": pa.array([packed(x[3], "<i2") for x in out], pa.binary()),
                    "impacts": pa.array([packed(x[4], "<i4") for x in out], pa.binary()),
                }
            )

    schema = "owner int, block long, terms binary, slots binary, impacts binary"
    return written(matched.mapInArrow(run, schema), "index")


def _kept(score: np.ndarray, item: np.ndarray, best: int) -> np.ndarray:
    """Places of the ``best`` highest scores of each item, ties to what comes first."""
    order = np.lexsort((np.arange(len(item)), -score, item))
    starts = np.r_[0, np.flatnonzero(np.diff(item[order])) + 1]
    sizes = np.diff(np.r_[starts, len(order)])
    return order[np.arange(len(order)) - np.repeat(starts, sizes) < best] if len(order) else order


def _bundles_of(groups: list[list[int]], weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Term to items, as starts into one array of items."""
    pairs = sorted((t, i) for i, found in enumerate(groups) for t in found)
    at = np.array([t for t, _ in pairs], dtype=np.int64)
    return np.searchsorted(at, np.arange(len(weight) + 1)), np.array([i for _, i in pairs], dtype=np.int64)


def _stage(carried, postings, starts, items, weight, floors, rest, later, best) -> DataFrame:
    """Bundles of one owner: what they carried, with this owner's contributions.

    ``floors`` has the ``best``-th highest score of each item so far, ``rest`` the most
    that this and later owners add, ``later`` the same without this one; None after it.
    """
    width = max(1, SHEET // SLOTS)
    n_items = len(floors)

    def add(key, left: pa.Table, right: pa.Table) -> pa.Table:
        old_item = unpacked(right.column("items").to_pylist(), "<i4").astype(np.int64)
        old_slot = unpacked(right.column("slots").to_pylist(), "<i2").astype(np.int64)
        old = unpacked(right.column("scores").to_pylist(), "<i8")
        term = unpacked(left.column("terms").to_pylist(), "<i4")
        slot = unpacked(left.column("slots").to_pylist(), "<i2").astype(np.int64)
        impact = unpacked(left.column("impacts").to_pylist(), "<i4").astype(np.int64)
        times = starts[term + 1] - starts[term]
        which = np.repeat(np.arange(len(term)), times)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        item = items[starts[term][which] + inside]
        where, gain = slot[which], (weight[term] * impact)[which]
        out = []
        for low in range(0, n_items, width):
            high = min(low + width, n_items)
            sheet = np.zeros((high - low) * SLOTS, dtype=np.int64)
            there = np.zeros(len(sheet), dtype=bool)
            mine = (old_item >= low) & (old_item < high)
            cell = (old_item[mine] - low) * SLOTS + old_slot[mine]
            sheet[cell] = old[mine]
            there[cell] = True
            # Pairs may only start where they can still get among the best.
            new = (item >= low) & (item < high)
            cell = (item[new] - low) * SLOTS + where[new]
            open_ = rest[item[new]] >= floors[item[new]]
            some = open_ | there[cell]
            np.add.at(sheet, cell[some], gain[new][some])
            full = np.flatnonzero(sheet)
            at, score = full // SLOTS + low, sheet[full]
            order = _kept(score, at, best)
            if later is None:
                keep = order
            else:
                # The 50th best of this block alone is a floor already.
                own = np.zeros(n_items, dtype=np.int64)
                sizes = np.bincount(at, minlength=n_items)
                least = np.full(n_items, np.iinfo(np.int64).max)
                np.minimum.at(least, at[order], score[order])
                own[sizes >= best] = least[sizes >= best]
                floor = np.maximum(floors, own)
                keep = np.flatnonzero(score + later[at] >= floor[at])
            out.append((at[keep], full[keep] % SLOTS, score[keep]))
        at, where, score = (np.concatenate([x[i] for x in out]) for i in range(3))
        return pa.table(
            {
                "block": pa.array([key[0].as_py()], pa.int64()),
                "items": pa.array([packed(at, "<i4")], pa.binary()),
                "slots": pa.array([packed(where, "<i2")], pa.binary()),
                "scores": pa.array([packed(score, "<i8")], pa.binary()),
            }
        )

    met = postings.groupBy("block").cogroup(carried.groupBy("block"))
    return met.applyInArrow(add, CARRIED)


def _entries(carried: DataFrame, best: int) -> DataFrame:
    """Item, block, slot and score of the best pairs of each bundle."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                item = unpacked(one.column("items").to_pylist(), "<i4")
                slot = unpacked(one.column("slots").to_pylist(), "<i2")
                score = unpacked(one.column("scores").to_pylist(), "<i8")
                keep = _kept(score, item, best)
                yield pa.RecordBatch.from_pydict(
                    {
                        "item": item[keep],
                        "block": np.full(len(keep), one.column("block")[0].as_py()),
                        "slot": slot[keep].astype(np.int32),
                        "score": score[keep],
                    }
                )

    return carried.mapInArrow(run, "item int, block long, slot int, score long")


def _floors(carried: DataFrame, n_items: int, best: int) -> np.ndarray:
    """The ``best``-th highest score of each item so far; 0 where there are fewer."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), "block", "slot")
    ranked = _entries(carried, best).withColumn("rank", F.row_number().over(order))
    floors = np.zeros(n_items, dtype=np.int64)
    for row in ranked.filter(F.col("rank") == best).collect():
        floors[row["item"]] = row["score"]
    return floors


def _search_block(docs: DataFrame, found: list[list[bytes]], best: int, shares) -> DataFrame:
    """item (place in ``found``), doc_id, score: the best documents of these items."""
    spark = docs.sparkSession
    words = {w: i for i, w in enumerate(sorted({w for x in found for w in x}))}
    groups = [sorted({words[w] for w in x}) for x in found]
    matched = _matched(docs, words)
    total = matched.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    with_terms, tokens = int(total[0]), int(total[1])
    df, most = _statistics(matched, len(words), with_terms, tokens)
    weight = np.array(
        [math.floor(1000 * math.log((2 * with_terms + 2) / (2 * int(x) + 1))) for x in df],
        dtype=np.int64,
    )
    # Owners by weight; each takes on until it has its share of the postings.
    order = np.lexsort((np.arange(len(words)), -weight))
    ends = np.cumsum(shares) * df.sum()
    owner = np.empty(len(words), dtype=np.int32)
    owner[order] = np.minimum(np.searchsorted(ends, np.cumsum(df[order]) - df[order], "right"), len(shares) - 1)
    index = _owned(matched, owner, with_terms, tokens)
    n_items = len(found)
    starts, items = _bundles_of(groups, weight)
    # The most that owner o and later ones add to an item.
    rest = np.zeros((len(shares) + 1, n_items), dtype=np.int64)
    for i, group in enumerate(groups):
        np.add.at(rest[:, i], owner[group], weight[group] * most[group])
    rest = np.cumsum(rest[::-1], axis=0)[::-1]
    carried = spark.createDataFrame([], CARRIED)
    floors = np.zeros(n_items, dtype=np.int64)
    for own in range(len(shares)):
        later = rest[own + 1] if own + 1 < len(shares) else None
        owned = index.filter(F.col("owner") == own).drop("owner")
        stage = _stage(carried, owned, starts, items, weight, floors, rest[own], later, best)
        carried = written(stage, "carried")
        if later is not None:
            floors = _floors(carried, n_items, best)
    places = matched.select("block", "slot", "doc_id")
    return _entries(carried, best).join(places, ["block", "slot"]).select("item", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    best: int = 50,
    shares: tuple[float, ...] = SHARES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` documents with a score above 0 of each item.

    Terms, weights and scores are those of the module; equal scores go to the smaller
    doc_id, null ids last.  Null and empty texts, of documents or items, have no terms;
    items without terms have no rows.  Rows that repeat an id, of either table, are
    documents or items of their own.  Extra columns are left out.  Items are searched
    in blocks of a megabyte of text, each in one pass over all documents.
    """
    spark = docs.sparkSession
    scan = even(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    asked = items.select(F.col(item_key).alias("item_id"), F.col("text").alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + size // ITEM_BYTES
    kind = items.schema[item_key].dataType.simpleString()
    out = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r["item_id"], terms(r["text"])) for r in own.collect()]
        rows = [r for r in rows if r[1]]
        if not rows:
            continue
        hits = _search_block(scan, [r[1] for r in rows], best, shares)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        hits = hits.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        id_kind = docs.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {id_kind}, score long")
    return out


ORACLE = r"""
    with parts as (
        select doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from documents
    ), tf as (
        select doc_id, term, count(*)::bigint as tf from parts group by all
    ), size as (
        select doc_id, sum(tf)::bigint as n from tf group by doc_id
    ), totals as (
        select count(*)::bigint as docs, sum(n)::bigint as tokens from size
    ), asked as (
        select distinct item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark
    ), weights as (
        select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w
        from tf, totals group by term, docs
    ), scores as (
        select item_id, doc_id, sum(
            w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // tokens)))
        )::bigint as score
        from asked join tf using (term) join weights using (term) join size using (doc_id), totals
        group by item_id, doc_id
    ), ranked as (
        select item_id, doc_id, score, (row_number() over (
            partition by item_id order by score desc, doc_id))::int as rank
        from scores where score > 0
    )
    select item_id, rank, doc_id, score from ranked where rank <= 50
"""
