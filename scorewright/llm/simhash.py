"""Near-duplicates by SimHash fingerprints; those that share a block of bits are compared exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import even, written
from scorewright.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 32_768
# The driver holds the range of each tile, and no more tiles than this.
MOST_TILES = 4096
# Rows of a tile that are compared at once.
STRIP = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if over half of the shingles' hashes have it; as a signed number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        blanks = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        starts = [0, *(blanks[: len(words) - shingle] + 1).tolist()]
        ends = [*blanks[shingle - 1 :].tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts, ends)),
            dtype=np.uint64,
            count=len(starts),
        )
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id and fp of every row."""
    named = even(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    schema = named.select("doc_id", F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in batches:
            found = [fingerprint(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp"])

    return named.mapInArrow(run, schema)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """First bit and width of radius + 1 blocks that make up the 64 bits.

    Fingerprints within the radius differ in no bit of one block at least.
    """
    ends = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _block_values(distinct: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint once for each block; ``value`` tells the blocks and their bits apart."""
    blocks = _blocks(radius)
    first = 1 << max(w for _, w in blocks)
    values = [
        F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1).cast("long")) + i * first
        for i, (at, width) in enumerate(blocks)
    ]
    return distinct.select("fp", F.explode(F.array(*values)).alias("value"))


def _tiles(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """Fingerprints in order of their blocks' values, cut into tiles: lo, hi, first, body.

    The range exchange deals equal parts, so a value that many share is several tiles.
    """
    n = distinct.count() * (radius + 1)
    size = max(tile, -(-n // MOST_TILES))
    rows = _block_values(distinct, radius).withColumn("pc", F.bit_count("fp"))
    parts = rows.repartitionByRange(max(1, -(-n // size)), "value", "pc", "fp")

    def cut(batches):
        kept = [(b.column("value").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if sum(len(fps) for _, fps in kept):
            values, fps = (np.concatenate(k) for k in zip(*kept))
            order = np.lexsort((fps, np.bitwise_count(fps.view(np.uint64)), values))
            body = np.stack([values[order], fps[order]]).astype("<i8")
            yield pa.RecordBatch.from_pydict(
                {
                    "lo": pa.array(body[0, :1], pa.int64()),
                    "hi": pa.array(body[0, -1:], pa.int64()),
                    "first": pa.array(body[1, :1], pa.int64()),
                    "body": pa.array([body.tobytes()], pa.binary()),
                }
            )

    schema = "lo long, hi long, first long, body binary"
    return written(parts.select("value", "fp").mapInArrow(cut, schema), "tiles")


def tile_links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple:
    """Pairs (position left, position right) within the radius.

    Both sides are in order of their population counts, which differ by no more
    than the distance; so each strip meets one stretch of the other side.
    """
    here, there = np.bitwise_count(left), np.bitwise_count(right).astype(np.int64)
    rows, columns = [], []
    for at in range(0, len(left), STRIP):
        strip = left[at : at + STRIP]
        a = np.searchsorted(there, int(here[at]) - radius, "left")
        b = np.searchsorted(there, int(here[at + len(strip) - 1]) + radius, "right")
        near = np.bitwise_count(strip[:, None] ^ right[None, a:b]) <= radius
        r, c = np.nonzero(near)
        rows.append(r + at)
        columns.append(c + a)
    return np.concatenate(rows or [[]]).astype(int), np.concatenate(columns or [[]]).astype(int)


def _stars(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """The smallest node each of n nodes is connected with by these links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[rows], root[columns])
        before = root.copy()
        np.minimum.at(root, root[rows], low)
        np.minimum.at(root, root[columns], low)
        root = root[root]
        if (root == before).all():
            return root


def _meetings(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """Tiles that meet: i, j, and their bodies, one row for each of them."""
    tiles = _tiles(distinct, radius, tile).withColumn("pc", F.bit_count("first"))
    bounds = tiles.select("lo", "hi", "pc", "first").orderBy("lo", "pc", "first").collect()
    lo = np.array([b["lo"] for b in bounds], dtype=np.int64)
    hi = np.array([b["hi"] for b in bounds], dtype=np.int64)
    ends = np.searchsorted(lo, hi, "right") - 1
    starts = np.searchsorted(hi, lo, "left")
    plan = distinct.sparkSession.createDataFrame(
        [(b["lo"], b["first"], i, int(starts[i]), int(ends[i])) for i, b in enumerate(bounds)],
        "lo long, first long, tile int, from_tile int, to_tile int",
    )
    placed = tiles.join(F.broadcast(plan), ["lo", "first"])
    as_left = placed.select(
        F.col("tile").alias("i"), F.explode(F.sequence("tile", "to_tile")).alias("j"), "tile", "body"
    )
    as_right = placed.filter("from_tile < tile").select(
        F.explode(F.sequence("from_tile", F.col("tile") - 1)).alias("i"),
        F.col("tile").alias("j"),
        "tile",
        "body",
    )
    return as_left.union(as_right)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between fingerprints that connect whatever is within the radius.

    Of radius + 1 blocks of bits two such fingerprints share one at least.  So only those
    with an equal block are compared, bit by bit: tiles stand in order of the blocks'
    values, and a tile meets itself and those that go on with its last value.  Of each
    pair's matches only a star for each connected group is returned, so the links are no
    more than the fingerprints that were compared.
    """

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bodies = [np.frombuffer(b, dtype="<i8").reshape(2, -1) for b in group.sort_values("tile")["body"]]
        (left, fps), (right, there) = bodies[0], bodies[-1]
        rows, columns = [], []
        for value in np.intersect1d(left, right):
            (a, b), (c, d) = (np.searchsorted(v, [value, value + 1]) for v in (left, right))
            r, k = tile_links(fps[a:b].view("<u8"), there[c:d].view("<u8"), radius)
            rows.append(r + a)
            columns.append(k + c)
        rows, columns = (np.concatenate(k or [[]]).astype(int) for k in (rows, columns))
        if len(bodies) > 1:
            columns = columns + len(fps)
            fps = np.concatenate([fps, there])
        # A fingerprint is there once for each of its blocks; one root leads all of these.
        fps, node = np.unique(fps, return_inverse=True)
        root = _stars(node[rows], node[columns], len(fps))
        apart = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[root[apart]], "b": fps[apart]}, dtype="int64")

    return _meetings(distinct, radius, tile).groupBy("i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """One row for each row: key, fingerprint (16 hex digits), component_id, copies.

    Fingerprints link at ``radius`` or fewer differing bits, equal ones included;
    ``component_id`` is the smallest key that links lead to, the row's own included.
    ``copies`` counts the rows with the same fingerprint.

    Texts are lower-cased in A-Z only.  Rows with equal fingerprints are one node, so
    a group of copies costs no more than one text.  A null or blank text has
    fingerprint zero and links like any other.  A null key counts as no candidate for
    ``component_id``; a component with null keys only has a null one.  Repeated rows
    stay.  An empty table gives no rows.
    """
    rows = written(fingerprints(df, key, text), "fingerprints")
    nodes = written(
        rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")),
        "nodes",
    )
    roots = components(links(nodes.select("fp"), radius))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(joined.join(least, "root").select("fp", "component_id", "copies"), "named")
    return rows.join(named, "fp").select(
        F.col("doc_id").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "copies",
    )
