"""Exact top-k by inner product with a pivot table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import written

SCALE = 256
PIVOTS = 32
# Rows that may become pivots; the driver holds no more than these.
PIVOT_SAMPLE = 2048
QUERY_BLOCK = 16_384
ROW_BLOCK = 8_192
# Candidates of one query that are scored between two looks at the stopping rule.
STEP = 256
# Distances are doubles of whole numbers; bounds get this much room for their rounding.
ROOM = 1e-6

_FOUND = "query_id long, vec_id long, score long"


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of each component, or null where the vector takes no part.

    A null or empty vector and one with a null, NaN or infinite component take none.
    """
    usable = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf"))
    )
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & usable, whole)


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots of each dimension: of a bounded sample, each the farthest from those before."""
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOT_SAMPLE).select("v")
    by_size: dict[int, list] = {}
    for row in sample.collect():
        by_size.setdefault(len(row["v"]), []).append(row["v"])
    chosen = {}
    for size, vectors in by_size.items():
        points = np.array(vectors, dtype=np.float64)
        picked, near = [0], np.full(len(points), np.inf)
        while len(picked) < min(pivots, len(points)):
            near = np.minimum(near, ((points - points[picked[-1]]) ** 2).sum(axis=1))
            picked.append(int(near.argmax()))
        chosen[size] = points[picked]
    return chosen


def _block(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.int64) for v in vectors], dtype=np.int64)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: from each point to each pivot."""
    return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _search(queries, query_ids, rows, row_ids, pivots, k):
    """The k best rows of the block for each query, in bound order.

    By |q - x|² = |q|² + |x|² - 2 q·x a lower bound of the distance is an upper bound
    of the score.  Scoring stops when no bound left reaches the k-th best score; a
    bound equal to it goes on, as a smaller id may tie.
    """
    exact = rows.astype(np.float64)
    table, square = _distances(exact, pivots), (exact**2).sum(axis=1)
    found = []
    for q, own in zip(queries, query_ids):
        point = q.astype(np.float64)
        to_pivots = np.sqrt(((pivots - point) ** 2).sum(axis=1))
        least = np.abs(table - to_pivots).max(axis=1)
        bound = (square + (point**2).sum() - np.maximum(least - ROOM, 0) ** 2) / 2 + ROOM
        bound[row_ids == own] = -np.inf
        order = np.argsort(-bound, kind="stable")
        best_scores = np.empty(0, dtype=np.int64)
        best_ids = np.empty(0, dtype=np.int64)
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            if len(best_scores) == k and bound[part[0]] < best_scores[-1]:
                break
            part = part[bound[part] > -np.inf]
            best_scores = np.concatenate([best_scores, rows[part] @ q])
            best_ids = np.concatenate([best_ids, row_ids[part]])
            top = np.lexsort((best_ids, -best_scores))[:k]
            best_scores, best_ids = best_scores[top], best_ids[top]
        found.append((np.full(len(best_ids), own), best_ids, best_scores))
    return found


def pivot_top_k(
    df: DataFrame,
    query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
) -> DataFrame:
    """The k rows with the highest integer inner products for each query row.

    Columns query_id, rank (from 1), vec_id, score; ties to the smaller id.  ``query``
    says which rows ask; every row but the query's own answers.  Blocks of queries
    meet blocks of rows of the same dimension, one pair a task, so a task's memory
    is bounded; each pair returns k rows for a query, and the best of them stay.

    Vectors that are null, empty, or hold a null or non-finite component take no
    part, nor do rows with a null id.  Rows that repeat an id are all compared and may
    all be returned, but none answers to its own id.  No rows give no rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = df.select(
        F.col(key).cast("long").alias("vec_id"),
        whole_numbers(F.col(vector)).alias("v"),
        F.coalesce(query, F.lit(False)).alias("asks"),
    )
    rows = written(rows.filter("v is not null and vec_id is not null"), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    pivots = choose_pivots(rows)
    row_blocks = -(-size["n"] // ROW_BLOCK) or 1
    query_blocks = -(-size["q"] // QUERY_BLOCK) or 1

    def block(seed: int, blocks: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(blocks)).cast("int")

    def all_of(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    flat = rows.withColumn("dim", F.size("v"))
    asking = flat.filter("asks").select(
        "dim", block(1, query_blocks).alias("qb"), all_of(row_blocks).alias("rb"), "vec_id", "v"
    )
    answering = flat.select(
        "dim", all_of(query_blocks).alias("qb"), block(2, row_blocks).alias("rb"), "vec_id", "v"
    )

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            found = _search(
                _block(left["v"]),
                left["vec_id"].to_numpy(),
                _block(right["v"]),
                right["vec_id"].to_numpy(),
                pivots.get(int(key[0]), np.zeros((1, int(key[0])))),
                k,
            )
        columns = [np.concatenate([f[i] for f in found]) if found else [] for i in range(3)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)), dtype="int64")

    keys = ["dim", "qb", "rb"]
    pairs = asking.groupBy(*keys).cogroup(answering.groupBy(*keys)).applyInPandas(meet, _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
