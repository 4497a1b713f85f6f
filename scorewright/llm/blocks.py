"""Documents in numbered blocks of bounded size, and sparse arrays packed in cells.

Bitmaps and accumulators name a document by its block and its slot in it.  A block is
a run of documents of one task; what it holds is written out before it is used twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Documents of a block, and the bytes of text from which on it is closed.
SLOTS = 2048
BLOCK_BYTES = 8_000_000


def numbered_blocks(batches, slots: int = SLOTS, size: int = BLOCK_BYTES) -> Iterator[tuple]:
    """(block number, ids, texts) for batches of (id, text), ids ascending, null ids last.

    Numbers are those of the task and of the block in it.  A text is never divided, so
    a block has more than ``size`` bytes if its last text brings it there.
    """
    first = TaskContext.get().partitionId() << 32
    count, held, bytes_held = 0, [], 0

    def closed():
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows.column(0), null_placement="at_end"))
        return first + count, rows.column(0), rows.column(1).to_pylist()

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(batch):
            room = slots - sum(map(len, held))
            full = np.searchsorted(np.cumsum(sizes[at : at + room]), size - bytes_held) + 1
            take = int(min(full, room, len(batch) - at))
            held.append(batch.slice(at, take))
            bytes_held += int(sizes[at : at + take].sum())
            at += take
            if bytes_held >= size or sum(map(len, held)) >= slots:
                yield closed()
                count, held, bytes_held = count + 1, [], 0
    if held:
        yield closed()


def packed(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def unpacked(cells, kind: str) -> np.ndarray:
    """The arrays of several cells, one after the other."""
    return np.frombuffer(b"".join(cells), dtype=kind)


def lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow column of lists of these sizes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table written inside go as soon as it is written.

    For chains of written tables, each of which is made once: without it the files of
    all steps lie on the executors' disks until the driver collects its garbage.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
