"""Shards on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import written

# The ring is a grid of so many cells: a virtual node sits at the end of a cell,
# and the rows of a cell are counted together.
CELLS = 1 << 16
VIRTUAL_NODES = 256
FIXED_BYTES = 16


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """For each cell, the shards with a virtual node there.

    A node's place follows from the shard's and its own number alone, so one more
    shard adds nodes and moves none.
    """
    nodes: list[list[int]] = [[] for _ in range(CELLS)]
    for shard in range(shards):
        for replica in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}/{replica}".encode(), digest_size=8).digest()
            nodes[int.from_bytes(digest, "big") % CELLS].append(shard)
    return nodes


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard: an even deal at slack 0, else that share of the mean on top."""
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def flow(counts: dict[int, int], nodes: list[list[int]], room: list[int]) -> list[tuple]:
    """Pieces (cell, first, last, shard, slot, home): where the rows of each cell go.

    Rows go clockwise, in ring order, to the first virtual node whose shard has
    room.  What a full shard turns away queues up for the next node, before the
    rows that lie between; a second round serves what has come past the end.
    """
    room, used = list(room), [0] * len(room)
    queue: deque = deque()
    waiting: deque = deque()
    pieces = []
    for step in range(2 * CELLS):
        cell = step % CELLS
        if step < CELLS and counts.get(cell):
            waiting.append([cell, 0, counts[cell], None])
        for shard in nodes[cell]:
            for piece in waiting:
                piece[3] = shard
            queue.extend(waiting)
            waiting.clear()
            while queue and room[shard]:
                cell_of, first, last, home = queue.popleft()
                taken = min(room[shard], last - first)
                pieces.append((cell_of, first, first + taken, shard, used[shard], home))
                room[shard] -= taken
                used[shard] += taken
                if first + taken < last:
                    queue.appendleft([cell_of, first + taken, last, home])
        if step >= CELLS and not queue and not waiting:
            break
    return pieces


def ring_shards(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = 40,
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = 0.0,
) -> DataFrame:
    """One row for each row: key, size, text_crc32, shard, slot and home_shard.

    A row's place on the ring is the hash of its key; ``home_shard`` is the owner of
    that place and ``shard`` the first shard from there on with room.  No shard gets
    more than its capacity: at slack 0 row counts are at most one apart, with slack
    fewer rows leave home and fewer move when shards are added.  ``slot`` numbers a
    shard's rows from 0.

    The driver sees row counts of the 65,536 cells and sends back one piece for each
    and one for each time a shard fills up.  Rows of a cell are sorted together: a
    65,536th of all, as keys are ids.  Rows with a null key take their place from
    size and checksum; a null text counts as empty.  Equal rows get slots in any
    order.  An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("_key"),
        (F.octet_length(body) + FIXED_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    place = F.when(F.col("_key").isNotNull(), F.xxhash64("_key")).otherwise(
        F.xxhash64("size", "text_crc32")
    )
    rows = written(rows.withColumn("_place", place), "ring")
    rows = rows.withColumn("_cell", F.shiftrightunsigned("_place", 48).cast("int"))
    counts = {r["_cell"]: r["count"] for r in rows.groupBy("_cell").count().collect()}
    room = capacities(sum(counts.values()), shards, slack)
    pieces = flow(counts, ring(shards, virtual_nodes), room)
    schema = "_cell int, _first long, _last long, shard int, _slot long, home_shard int"
    plan = F.broadcast(df.sparkSession.createDataFrame(pieces, schema))
    inside = Window.partitionBy("_cell").orderBy("_place", "_key", "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    here = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last"))
    return (
        ranked.join(plan, "_cell")
        .filter(here)
        .select(
            F.col("_key").alias(key),
            "size",
            "text_crc32",
            "shard",
            (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot"),
            "home_shard",
        )
    )
