"""Batches from length buckets whose boundaries waste the least padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import gapless, word_count, written

LONGEST = 2048
BUCKETS = 16
BATCH_TOKENS = 65_536


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascend and are positive.  ``least[j]`` is the padding of the first j
    lengths in the buckets so far; a bucket from i to j pads all of them to the last.
    At equal padding the earliest start wins.
    """
    size = np.asarray(lengths, dtype=np.int64)
    many = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
    tokens = np.concatenate([[0], np.cumsum(size * np.asarray(counts, dtype=np.int64))])
    n = len(size)
    if n == 0:
        return []
    # cost[i, j]: padding of lengths i .. j in one bucket
    cost = size[None, :] * (many[None, 1:] - many[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    never = np.iinfo(np.int64).max // 4
    cost[np.tril_indices(n, -1)] = never
    least, starts = cost[0].copy(), []
    for _ in range(min(buckets, n) - 1):
        total = np.concatenate([[0], least[:-1]])[:, None] + cost
        start = total.argmin(axis=0)
        starts.append(start)
        least = total[start, np.arange(n)]
    ends, j = [], n - 1
    for start in reversed(starts):
        ends.append(int(size[j]))
        j = int(start[j]) - 1
        if j < 0:
            break
    else:
        ends.append(int(size[j]))
    return sorted(ends)


def pack(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """One row for each sequence: key, piece, start, n_tokens, bucket, batch, slot, padding.

    Tokens are words.  A text of over ``longest`` words becomes several sequences of
    that length and a rest, so nothing is cut off and the histogram of lengths that
    the driver sees has ``longest`` rows at most.  ``bucket`` is the length to which
    a sequence is padded; a batch of a bucket holds as many sequences as the budget
    of tokens allows, one at least, and all but a bucket's last are full.  Sequences
    meet in hashed order.

    A text without words gives one row of length 0 with null bucket, batch and slot.
    Repeated rows are packed one by one.  An empty table gives no rows.
    """
    if longest < 1 or buckets < 1 or batch_tokens < 1:
        raise ValueError("longest, buckets and batch_tokens must be positive")
    counted = df.select(F.col(key).alias("_key"), word_count(F.col(text)).alias("_words"))
    last = F.floor((F.greatest(F.col("_words"), F.lit(1)) - 1) / longest)
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece") * longest
    pieces = pieces.withColumns(
        {"start": start, "n_tokens": F.least(F.col("_words") - start, F.lit(longest).cast("long"))}
    ).drop("_words")
    pieces = written(pieces, "sequences")
    histogram = (
        pieces.filter("n_tokens > 0").groupBy("n_tokens").count().orderBy("n_tokens").collect()
    )
    ends = best_boundaries(
        [r["n_tokens"] for r in histogram], [r["count"] for r in histogram], buckets
    )
    bucket = F.lit(None).cast("long")
    for end in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end)).otherwise(bucket)
    bucket = F.when(F.col("n_tokens") > 0, bucket).cast("long")
    pieces = pieces.withColumn("bucket", bucket)
    ranked = gapless(pieces.filter("n_tokens > 0"), "bucket", "_key", "piece", "n_tokens")
    each = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("bucket")))
    placed = ranked.withColumns(
        {
            "batch": F.floor(F.col("rank") / each),
            "slot": F.col("rank") % each,
            "padding": F.col("bucket") - F.col("n_tokens"),
        }
    ).drop("rank")
    empty = pieces.filter("n_tokens = 0")
    return placed.unionByName(empty, allowMissingColumns=True).select(
        F.col("_key").alias(key),
        "piece",
        "start",
        "n_tokens",
        "bucket",
        "batch",
        "slot",
        "padding",
    )
