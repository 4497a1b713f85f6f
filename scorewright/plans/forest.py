"""A random forest whose trees grow until their leaves are pure.

A tree's node with many rows is split by Spark: the table is read once for all large
nodes of a depth, each task draws its rows' samples, sends them down the tree and adds
up their class weights in slices of each input.  As soon as a node has few rows they go
to one task, packed, which grows the rest of the tree over all cuts; a pure node is a
leaf without that.  Nodes are named by the way that leads to them, so depth has no limit.
The driver holds the cuts of the large nodes, fewer than one for each ``FEW`` / 4 sampled
rows; all else stays in tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.session import materialise, new_path, spread

TREES = 100
# Rows of a node from which on it is split by Spark, not in a task.
FEW = 200_000
# Slices of an input, at quantiles of all rows; where they do not tell a node's rows
# apart, at quantiles of its own.
QUANTILES = 512
SLICES = QUANTILES + 2
# Large nodes whose slices are added up in one pass, so that a task's sums stay small.
OPEN_NODES = 1_024
# Rows that are drawn, sent down and packed together.
CHUNK = 200_000
SCORE_CHUNK = 32_768
MOST_PARTS = 2_000
# Votes are added as whole numbers, so that their order does not matter.
VOTE = 1 << 40
_DRAWS = 12

SPLITS = "tree int, path string, feature int, threshold double, gain double"
CELLS = (
    "tree int, path string, feature array<int>, threshold array<double>,"
    " left array<int>, right array<int>, p array<double>, gain array<double>"
)


@dataclass
class Forest:
    """A grown forest: the tables ``splits`` and ``cells`` in a folder."""

    spark: SparkSession
    path: str
    inputs: list[str]

    @property
    def splits(self) -> DataFrame:
        return self.spark.read.schema(SPLITS).parquet(f"{self.path}/splits")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.schema(CELLS).parquet(f"{self.path}/cells")

    def save(self, path: str) -> None:
        self.splits.write.mode("overwrite").parquet(f"{path}/splits")
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")

    def depth(self) -> int:
        """The longest way from a root to a leaf."""

        def run(batches):
            for batch in batches:
                most = [
                    len(r["path"]) + _depth(np.array(r["left"]), np.array(r["right"]))
                    for r in batch.select(["path", "left", "right"]).to_pylist()
                ]
                yield pa.RecordBatch.from_pydict({"depth": pa.array([max(most, default=0)], pa.int64())})

        cells = self.cells.select("path", "left", "right").mapInArrow(run, "depth long")
        return cells.agg(F.max("depth")).first()[0]

    def importances(self) -> DataFrame:
        """``feature, importance``: mean share of each input in the gain of a tree."""
        inside = self.cells.select("tree", F.posexplode("gain").alias("feature", "gain"))
        gains = inside.unionByName(self.splits.select("tree", "feature", "gain"))
        names = F.array(*[F.lit(n) for n in self.inputs])
        gains = gains.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        whole = F.sum("gain").over(Window.partitionBy("tree"))
        shares = gains.withColumn("share", F.coalesce(F.col("gain") / F.nullif(whole, F.lit(0.0)), F.lit(0.0)))
        shares = shares.groupBy("feature").agg(F.sum("share").alias("share"))
        # One row for each input.
        total = F.sum("share").over(Window.partitionBy())
        return shares.select(
            F.get(names, "feature").alias("feature"),
            F.coalesce(F.col("share") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("importance"),
        )


def _depth(left: np.ndarray, right: np.ndarray) -> int:
    depth = np.zeros(len(left), dtype=np.int64)
    for node in range(len(left)):  # children have larger numbers
        if left[node] >= 0:
            depth[left[node]] = depth[right[node]] = depth[node] + 1
    return int(depth.max(initial=0))


# --------------------------------------------------------------------- in one task


def _new(sorted_: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.concatenate([[True], sorted_[1:] != sorted_[:-1]])


def _best_cuts(rank, values, seg, ones, w, ask):
    """Node, score, cut and last rank below it of each asking node's best split on one input.

    ``rank`` numbers the sorted distinct ``values``; an asking node has two of them at least.
    """
    rows = np.flatnonzero(ask[seg])
    key = seg[rows] * len(values) + rank[rows]
    order = np.argsort(key)
    rows, key = rows[order], key[order]
    s = seg[rows]
    one, all_ = np.cumsum(ones[rows]), np.cumsum(w[rows])
    new = _new(s)
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(s)) - 1
    base_one, base_all = np.append(0, one[last[:-1]]), np.append(0, all_[last[:-1]])
    whole_one, whole_all = one[last] - base_one, all_[last] - base_all
    # Only where the next row of the node has another value is there a cut.
    cuts = np.flatnonzero((key[1:] > key[:-1]) & ~new[1:])
    group = (np.cumsum(ask) - 1)[s[cuts]]
    left_one, left_all = one[cuts] - base_one[group], all_[cuts] - base_all[group]
    right_one, right_all = whole_one[group] - left_one, whole_all[group] - left_all
    with np.errstate(divide="ignore", invalid="ignore"):
        value = (left_one**2 + (left_all - left_one) ** 2) / left_all
        value += (right_one**2 + (right_all - right_one) ** 2) / right_all
    starts = np.flatnonzero(_new(group))
    best = np.maximum.reduceat(value, starts)
    at = np.flatnonzero(value == np.repeat(best, np.diff(starts, append=len(group))))
    first = at[_new(group[at])] if len(at) else at
    at = cuts[first]
    below, above = rank[rows[at]], rank[rows[at + 1]]
    low, high = values[below], values[above]
    middle = low + (high - low) / 2
    # Two neighbouring numbers have no other between them.
    return s[at], value[first], np.where(middle >= high, low, middle), below


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, tries: int, seed: int) -> dict:
    """One tree over these rows, all nodes of a depth at a time, until no node can be split.

    Each node tries ``tries`` inputs that are not constant in it, and takes the cut that
    leaves the least weighted Gini impurity.
    """
    order = np.lexsort((w, y, *x.T))
    x, y, w = x[order], y[order], w[order]
    ones = w * y
    rng = np.random.default_rng(seed)
    inputs = x.shape[1]
    sorted_ = [np.unique(x[:, f], return_inverse=True) for f in range(inputs)]
    values, ranks = [v for v, _ in sorted_], np.stack([r for _, r in sorted_]).astype(np.int32)
    feature, threshold, left, right, p = [[-1]], [[0.0]], [[-1]], [[-1]], []
    gain = np.zeros(inputs)
    seg, many, first = np.zeros(len(y), dtype=np.int64), 1, 0
    while True:
        one, all_ = np.bincount(seg, ones, many), np.bincount(seg, w, many)
        p.append(one / all_)
        positive, count = np.bincount(seg, y, many), np.bincount(seg, minlength=many)
        mixed = (positive > 0) & (positive < count)
        # Rows of mixed nodes, node by node; numbers of two bytes sort in linear time.
        here, nodes = np.flatnonzero(mixed[seg]), np.flatnonzero(mixed)
        small = np.uint16 if many <= 1 << 16 else np.int64
        here = here[np.argsort(seg[here].astype(small), kind="stable")]
        starts = np.cumsum(count[nodes]) - count[nodes]
        varied = np.zeros((len(nodes), inputs), dtype=bool)
        for f in range(inputs if len(nodes) else 0):
            found = ranks[f][here]
            varied[:, f] = np.maximum.reduceat(found, starts) > np.minimum.reduceat(found, starts)
        # The first ``tries`` of the varied inputs, in an order drawn for each node.
        rank = np.where(varied, rng.random((many, inputs))[nodes], 2.0).argsort(axis=1).argsort(axis=1)
        ask = np.zeros((many, inputs), dtype=bool)
        ask[nodes] = varied & (rank < tries)
        best, which, cut = np.full(many, -np.inf), np.full(many, -1), np.zeros(many)
        below = np.zeros(many, dtype=np.int64)
        for f in np.flatnonzero(ask.any(axis=0)):
            node, score, *at = _best_cuts(ranks[f], values[f], seg, ones, w, ask[:, f])
            better = np.flatnonzero(score > best[node])
            node = node[better]
            best[node], which[node] = score[better], f
            cut[node], below[node] = at[0][better], at[1][better]
        split = np.flatnonzero(which >= 0)
        np.add.at(gain, which[split], best[split] - (one**2 + (all_ - one) ** 2)[split] / all_[split])
        feature[-1], threshold[-1] = which, np.where(which >= 0, cut, 0.0)
        children = np.full(many, -1)
        children[split] = first + many + 2 * np.arange(len(split))
        left[-1], right[-1] = children, np.where(children >= 0, children + 1, -1)
        if not len(split):
            break
        goes = np.flatnonzero(which[seg] >= 0)
        ranks, y, w, ones, seg = ranks.take(goes, axis=1), y[goes], w[goes], ones[goes], seg[goes]
        side = ranks[which[seg], np.arange(len(seg))] > below[seg]
        first, seg = first + many, children[seg] + side - (first + many)
        many = 2 * len(split)
        for table in (feature, threshold, left, right):
            table.append(None)
    names = ("feature", "threshold", "left", "right", "p")
    tree = {n: np.concatenate(t) for n, t in zip(names, (feature, threshold, left, right, p))}
    return tree | {"gain": gain}


def _walk(cell: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf probability of each row in one packed subtree."""
    feature, threshold, left, right, p = (
        cell[n] for n in ("feature", "threshold", "left", "right", "p")
    )
    at = np.zeros(len(x), dtype=np.int64)
    inner = np.flatnonzero(feature[at] >= 0)
    while len(inner):
        node = at[inner]
        low = x[inner, feature[node]] <= threshold[node]
        at[inner] = np.where(low, left[node], right[node])
        inner = inner[feature[at[inner]] >= 0]
    return p[at]


# ------------------------------------------------------------------------ in Spark

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(z: np.ndarray, by: int) -> np.ndarray:
    return (z << np.uint64(by)) | (z >> np.uint64(64 - by))


def _hash_end(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(33))) * _P2
    z = (z ^ (z >> np.uint64(29))) * _P3
    return z ^ (z >> np.uint64(32))


def _hash_long(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of each whole number of eight bytes, as Spark's ``xxhash64`` has it."""
    z = seed + _P5 + np.uint64(8)
    z = z ^ (_turned(values.astype(np.uint64) * _P2, 31) * _P1)
    return _hash_end(_turned(z, 27) * _P1 + _P4)


def _hash_int(value: int, seed: np.ndarray) -> np.ndarray:
    """XXH64 of one whole number of four bytes, with each seed."""
    part = np.uint64(value & 0xFFFFFFFF)
    z = (seed + _P5 + np.uint64(4)) ^ (np.full(1, part) * _P1)
    return _hash_end(_turned(z, 23) * _P2 + _P3)


_SHARES = np.cumsum([exp(-1) / factorial(k) for k in range(_DRAWS)])


def _drawn(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's sample, drawn with replacement, holds each row.

    ``rows`` are the hashes of the rows' numbers.
    """
    h = _hash_int(seed, _hash_int(tree, rows))
    u = (h & np.uint64((1 << 53) - 1)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_SHARES, u, "right")


def _hashed(rows: np.ndarray) -> np.ndarray:
    return _hash_long(rows, np.full(1, 42, dtype=np.uint64))


@dataclass
class _Top:
    """The large nodes of a tree and what hangs from them, numbered as they come.

    A node's ``feature`` is -1 where it is no split; ``slices`` names the edges that cut
    its inputs.
    """

    path: list[str] = field(default_factory=lambda: [""])
    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    slices: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        self.feature[node], self.threshold[node] = feature, threshold
        self.left[node], self.right[node] = len(self.path), len(self.path) + 1
        for side in "LR":
            self.path.append(self.path[node] + side)
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.slices.append(self.slices[node])
        return self.left[node], self.right[node]

    def packed(self) -> dict[str, np.ndarray]:
        names = ("feature", "threshold", "left", "right")
        return {n: np.array(getattr(self, n)) for n in names}


def _ends(top: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The node each row ends in."""
    return _walk(top | {"p": np.arange(len(top["feature"]))}, x)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The batches put together to tables of about ``size`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _draws(batches, inputs: int, trees: list[int], seed: int):
    """(x, y, samples) of a chunk of rows at a time; samples are (tree, rows, their weight)."""
    for chunk in _chunks(batches, CHUNK):
        x, y = _matrix(chunk.column("x"), inputs), chunk.column("y").to_numpy()
        w, hashes = chunk.column("w").to_numpy(), _hashed(chunk.column("row").to_numpy())

        def samples():
            for tree in trees:
                times = _drawn(hashes, tree, seed)
                rows = np.flatnonzero(times)
                yield tree, rows, w[rows] * times[rows]

        yield x, y, samples()


def _samples(batches, inputs: int, trees: list[int], seed: int):
    """(tree, x, y, weight) of each tree's sample, a chunk of rows at a time."""
    for x, y, samples in _draws(batches, inputs, trees, seed):
        for tree, rows, w in samples:
            yield tree, x[rows], y[rows], w


def _quantiles(inputs: int) -> list:
    shares = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    return [F.percentile_approx(F.get("x", F.lit(f)), shares, 10_000).alias(f"_{f}") for f in range(inputs)]


def _edges(row, inputs: int) -> list[np.ndarray]:
    return [np.unique(np.array(row[f"_{f}"] or [], dtype=np.float64)) for f in range(inputs)]


def _own_edges(numbered: DataFrame, tops: dict, nodes: list[tuple[int, int]], inputs: int, seed: int) -> dict:
    """Edges at quantiles of the nodes' own rows."""
    wanted: dict[int, list[int]] = {}
    for tree, node in nodes:
        wanted.setdefault(tree, []).append(node)
    packed = {tree: tops[tree].packed() for tree in wanted}

    def run(batches):
        for tree, x, _, _ in _samples(batches, inputs, list(wanted), seed):
            at = _ends(packed[tree], x)
            rows = np.flatnonzero(np.isin(at, wanted[tree]))
            ends = np.arange(len(rows) + 1, dtype=np.int32) * inputs
            yield pa.RecordBatch.from_pydict({
                "tree": np.full(len(rows), tree, dtype=np.int32), "node": at[rows].astype(np.int32),
                "x": pa.ListArray.from_arrays(pa.array(ends), pa.array(x[rows].ravel())),
            })

    rows = numbered.mapInArrow(run, "tree int, node int, x array<double>").groupBy("tree", "node")
    found = rows.agg(*_quantiles(inputs)).collect()
    return {(r["tree"], r["node"]): _edges(r, inputs) for r in found}


def _sums(numbered: DataFrame, tops: dict, nodes: list[tuple[int, int]], edges: list, inputs: int, seed: int):
    """For each node and slice of an input the rows, the ones, their weight and that of all."""
    wanted: dict[int, list[int]] = {}
    for tree, node in nodes:
        wanted.setdefault(tree, []).append(node)
    packed = {tree: tops[tree].packed() for tree in wanted}
    named = {(tree, node): tops[tree].slices[node] for tree, node in nodes}
    used = {s: edges[s] for s in set(named.values())}

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for x, y, samples in _draws(batches, inputs, list(wanted), seed):
            # Most nodes have the common edges, so a row's slices there are found once for all trees.
            common = [np.searchsorted(edges, x[:, f]) for f, edges in enumerate(used.get(0, []))]
            ones = y.astype(np.float64)
            for tree, rows, w in samples:
                mine = wanted[tree]
                place = np.full(len(packed[tree]["feature"]), -1)
                place[mine] = np.arange(len(mine))
                at = place[_ends(packed[tree], x[rows])] if len(place) > 1 else np.zeros(len(rows), dtype=np.int64)
                if len(place) > 1:
                    here = np.flatnonzero(at >= 0)
                    at, rows, w = at[here], rows[here], w[here]
                sums = totals.setdefault(tree, np.zeros((len(mine), inputs, SLICES, 4)))
                cut = np.array([named[tree, node] for node in mine])
                for s in set(cut.tolist()):
                    some = np.flatnonzero(cut[at] == s) if (cut != s).any() else slice(None)
                    base, mass, chosen = at[some] * SLICES, w[some], rows[some]
                    one = ones[chosen]
                    for f in range(inputs):
                        slices = common[f][chosen] if s == 0 else np.searchsorted(used[s][f], x[chosen, f])
                        for k, each in enumerate((None, one, mass * one, mass)):
                            found = np.bincount(base + slices, each, len(mine) * SLICES)
                            sums[:, f, :, k] += found.reshape(-1, SLICES)
        for tree, sums in totals.items():
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([tree] * len(sums), pa.int32()), "node": pa.array(wanted[tree], pa.int32()),
                "sums": pa.array([s.tobytes() for s in sums], pa.binary()),
            })

    return numbered.mapInArrow(run, "tree int, node int, sums binary")


_CHOSEN = (
    "tree int, node int, n long, ones long, p double, feature int, slice int, gain double,"
    " left_n long, left_ones long, left_p double, right_p double"
)


def _purity(ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
    return (ones**2 + (all_ - ones) ** 2) / all_


def _best_split(sums: np.ndarray, path: str, tree: int, tries: int, seed: int) -> dict:
    """The best cut of one node; one that is pure, or in a single slice of each input, has none."""
    whole = sums[0].sum(axis=0)
    n, ones, one, all_ = whole
    found = {"n": int(n), "ones": int(ones), "p": one / all_ if n else None, "feature": -1}
    varied = np.flatnonzero((sums[:, :, 0] > 0).sum(axis=1) > 1)
    if ones in (0, n) or not len(varied):
        return found
    order = np.random.default_rng([seed, tree, len(path), *path.encode()]).random(len(sums))
    score = -np.inf
    for f in sorted(varied[np.argsort(order[varied])][:tries]):
        left = np.cumsum(sums[f], axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = _purity(left[:, 2], left[:, 3]) + _purity(one - left[:, 2], all_ - left[:, 3])
        value = np.where((left[:, 0] > 0) & (left[:, 0] < n), value, -np.inf)
        at = int(value.argmax())
        if value[at] > score:
            score, mine = value[at], left[at]
            found |= {
                "feature": int(f), "slice": at, "gain": score - _purity(one, all_),
                "left_n": int(mine[0]), "left_ones": int(mine[1]), "left_p": mine[2] / mine[3],
                "right_p": (one - mine[2]) / (all_ - mine[3]),
            }
    return found


def _best_splits(sums: DataFrame, tops: dict[int, _Top], inputs: int, tries: int, seed: int) -> list:
    """What ``_best_split`` says of each node; one row for each of a bounded number of nodes."""
    schema = pa.schema([
        (f["name"], {"integer": pa.int32(), "long": pa.int64(), "double": pa.float64()}[f["type"]])
        for f in sums.sparkSession.createDataFrame([], _CHOSEN).schema.jsonValue()["fields"]
    ])
    paths = {tree: top.path for tree, top in tops.items()}

    def run(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        tree, node = key[0].as_py(), key[1].as_py()
        total = np.zeros((inputs, SLICES, 4))
        for body in parts.column("sums").to_pylist():
            total += np.frombuffer(body).reshape(total.shape)
        best = _best_split(total, paths[tree][node], tree, tries, seed)
        return pa.Table.from_pylist([best | {"tree": tree, "node": node}], schema)

    return sums.groupBy("tree", "node").applyInArrow(run, _CHOSEN).collect()


def grow_forest(
    rows: DataFrame,
    inputs: list[str],
    path: str | None = None,
    trees: int = TREES,
    tries: int = 2,
    seed: int = 42,
    few: int = FEW,
) -> Forest:
    """Grow a forest on ``inputs``, ``label`` (0 or 1) and ``weight``; other columns are not read.

    Each tree sees its own sample of the rows, drawn with replacement.  Without rows the
    forest has no trees.  Sums of a large node are added in any order, so that its equal
    cuts may be told apart by their last digits.
    """
    spark = rows.sparkSession
    path = path or new_path(spark, "forest")
    wide = len(inputs)
    x = F.array(*[F.col(c).cast("double") for c in inputs]).alias("x")
    numbered = materialise(
        rows.select(x, F.col("label").cast("int").alias("y"), F.col("weight").alias("w")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "rows",
    )
    tops = {tree: _Top() for tree in range(trees)}
    # Ends that are leaves, with their probability; the others' rows go to tasks.
    leaves: dict[tuple[int, int], float] = {}
    splits = []
    open_ = [(tree, 0) for tree in tops] if numbered.count() > few else []
    numbered = spread(numbered)
    own: set[tuple[int, int]] = set()
    edges = [_edges(numbered.agg(*_quantiles(wide)).first(), wide)] if open_ else []
    while open_:
        later, stuck = [], []
        for at in range(0, len(open_), OPEN_NODES):
            sums = _sums(numbered, tops, open_[at : at + OPEN_NODES], edges, wide, seed)
            for r in _best_splits(sums, tops, wide, tries, seed):
                top, node, n, ones = tops[r["tree"]], r["node"], r["n"], r["ones"]
                if n <= few and ones not in (0, n):
                    continue
                if r["feature"] < 0 and ones not in (0, n) and (r["tree"], node) not in own:
                    stuck.append((r["tree"], node))
                    continue
                if r["feature"] < 0:
                    leaves[r["tree"], node] = r["p"]
                    continue
                cut = float(edges[top.slices[node]][r["feature"]][r["slice"]])
                splits.append((r["tree"], top.path[node], r["feature"], cut, r["gain"]))
                left = (r["left_n"], r["left_ones"], r["left_p"])
                right = (n - left[0], ones - left[1], r["right_p"])
                for child, (many, one, p) in zip(top.split(node, r["feature"], cut), (left, right)):
                    if one in (0, many):
                        leaves[r["tree"], child] = p
                    elif many > few:
                        later.append((r["tree"], child))
        for at in range(0, len(stuck), OPEN_NODES):
            fresh = _own_edges(numbered, tops, stuck[at : at + OPEN_NODES], wide, seed)
            for (tree, node), found in fresh.items():
                tops[tree].slices[node] = len(edges)
                own.add((tree, node))
                edges.append(found)
        open_ = sorted(later + stuck)
    none, no_gain = [-1], [0.0] * wide
    closed = [(tree, tops[tree].path[node], none, [0.0], none, none, [p], no_gain) for (tree, node), p in leaves.items()]
    spark.createDataFrame(splits, SPLITS).write.parquet(f"{path}/splits")
    spark.createDataFrame(closed, CELLS).write.parquet(f"{path}/cells")

    packed, paths = {t: top.packed() for t, top in tops.items()}, {t: top.path for t, top in tops.items()}
    shut = {t: [node for tree, node in leaves if tree == t] for t in tops}
    going = [t for t, top in tops.items() if top.feature.count(-1) > len(shut[t])]

    def ship(batches):
        for tree, x, y, w in _samples(batches, wide, going, seed):
            at = _ends(packed[tree], x)
            rows = np.flatnonzero(~np.isin(at, shut[tree])) if shut[tree] else np.arange(len(at))
            rows = rows[np.argsort(at[rows], kind="stable")]
            ends, first = np.unique(at[rows], return_index=True)
            bodies = [np.c_[x[r], y[r], w[r]].T.tobytes() for r in np.split(rows, first[1:])]
            if len(rows):
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([tree] * len(ends), pa.int32()),
                    "path": pa.array([paths[tree][e] for e in ends], pa.string()),
                    "body": pa.array(bodies, pa.binary()),
                })

    def finish(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
        tree, name = key[0].as_py(), key[1].as_py()
        bodies = [np.frombuffer(b).reshape(wide + 2, -1) for b in cell.column("body").to_pylist()]
        whole = np.concatenate(bodies, axis=1)
        way = [b"LR".index(c) for c in name.encode()]
        grown = grow(np.ascontiguousarray(whole[:wide].T), whole[wide], whole[wide + 1], tries, [seed, tree, *way])
        lists = {}
        for n, values in grown.items():
            kind = pa.int32() if n in ("feature", "left", "right") else pa.float64()
            lists[n] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        return pa.table({"tree": pa.array([tree], pa.int32()), "path": [name]} | lists)

    if going:
        # A part for each node, as long as they are not too many: their work differs.
        nodes = sum(top.feature.count(-1) for top in tops.values()) - len(leaves)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(nodes, MOST_PARTS))
        dealt = numbered.mapInArrow(ship, "tree int, path string, body binary").repartition(parts, "tree", "path")
        dealt.groupBy("tree", "path").applyInArrow(finish, CELLS).write.mode("append").parquet(f"{path}/cells")
    return Forest(spark, path, inputs)


def _tops(forest: Forest, trees: list[int]) -> dict[int, _Top]:
    """The large nodes of each tree, from its splits."""
    tops = {tree: _Top() for tree in trees}
    nodes = {(tree, ""): 0 for tree in trees}
    for r in forest.splits.orderBy(F.length("path"), "tree", "path").collect():
        top, tree, path = tops[r["tree"]], r["tree"], r["path"]
        left, right = top.split(nodes[tree, path], r["feature"], r["threshold"])
        nodes[tree, path + "L"], nodes[tree, path + "R"] = left, right
    return tops


def forest_probability(forest: Forest, df: DataFrame, name: str = "predicted_prob") -> DataFrame:
    """``df`` with the mean probability of class 1 over all trees; null where there are none.

    Rows meet the subtree they end in, packed, tree by tree, so no task holds a whole
    forest; where that is a single leaf they have its vote at once.
    """
    x = F.array(*[F.col(c).cast("double") for c in forest.inputs]).alias("x")
    rows = materialise(df.select("*", x).withColumn("_row", F.monotonically_increasing_id()), "scored")
    wide, leaf = len(forest.inputs), F.size("feature") == 1
    # As many rows as there are ends of large nodes.
    ends = forest.cells.select("tree", "path", F.when(leaf, F.get("p", F.lit(0))).alias("p")).collect()
    trees = sorted({r["tree"] for r in ends})
    if not trees:
        return rows.select(*df.columns, F.lit(None).cast("double").alias(name))
    tops = _tops(forest, trees)
    packed, paths = {t: top.packed() for t, top in tops.items()}, {t: top.path for t, top in tops.items()}
    known = {(r["tree"], r["path"]): r["p"] for r in ends if r["p"] is not None}
    leaves = {t: np.array([known.get((t, p), np.nan) for p in paths[t]], dtype=np.float64) for t in trees}
    # Rows of a subtree in one group, about.
    shares = 1 + rows.count() * len(trees) // (FEW * len(ends))

    def go(batches):
        part = TaskContext.get().partitionId()
        for number, chunk in enumerate(_chunks(batches, SCORE_CHUNK)):
            x, home = _matrix(chunk.column("x"), wide), part << 32 | number
            votes, out = np.zeros(len(x), dtype=np.int64), []
            for tree in trees:
                at = _ends(packed[tree], x)
                p = leaves[tree][at]
                votes += np.round(np.nan_to_num(p) * VOTE).astype(np.int64)
                some = np.flatnonzero(np.isnan(p))
                some = some[np.argsort(at[some], kind="stable")]
                ends, first = np.unique(at[some], return_index=True)
                for end, mine in zip(ends, np.split(some, first[1:])):
                    body = mine.astype(np.int32).tobytes() + x[mine].T.tobytes()
                    out.append((tree, paths[tree][end], home % shares, home, body))
            # The chunk's own rows and votes, in a group by themselves.
            out.append((-1, str(home), 0, home, chunk.column("_row").to_numpy().tobytes() + votes.tobytes()))
            for at in range(0, len(out), 500):
                columns = zip(*out[at : at + 500])
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "path", "share", "chunk", "body"]
                )

    def vote(some: pa.Table, cell: pa.Table) -> pa.Table:
        names, found = ["chunk", "kind", "body"], []
        packed = {n: cell.column(n).combine_chunks().flatten().to_numpy() for n in cell.column_names[3:]}
        for r in some.to_pylist():
            if r["tree"] < 0:
                found.append((r["chunk"], 1, r["body"]))
                continue
            many = len(r["body"]) // (4 + 8 * wide)
            values = np.frombuffer(r["body"], np.float64, offset=4 * many).reshape(wide, many).T
            votes = np.round(_walk(packed, values) * VOTE).astype(np.int64)
            found.append((r["chunk"], 0, r["body"][: 4 * many] + votes.tobytes()))
        columns = zip(*found) if found else ([], [], [])
        kinds = (pa.int64(), pa.int32(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def gather(table: pa.Table) -> pa.Table:
        parcels = sorted(table.select(["kind", "body"]).to_pylist(), key=lambda r: -r["kind"])
        ids, total = np.frombuffer(parcels[0]["body"], np.int64).reshape(2, -1).copy()
        for r in parcels[1:]:
            many = len(r["body"]) // 12
            total[np.frombuffer(r["body"], np.int32, many)] += np.frombuffer(r["body"], np.int64, offset=4 * many)
        return pa.table({"_row": ids, "vote": total})

    sent = spread(rows.select("_row", "x")).mapInArrow(go, "tree int, path string, share int, chunk long, body binary")
    cells = forest.cells.drop("gain").filter(~leaf).withColumnsRenamed({"tree": "_tree", "path": "_path"})
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share")
    cells = cells.select("_tree", "_path", every, *[c for c in cells.columns if c[0] != "_"])
    met = sent.groupBy("tree", "path", "share").cogroup(cells.groupBy("_tree", "_path", "_share"))
    votes = met.applyInArrow(vote, "chunk long, kind int, body binary").groupBy("chunk")
    votes = votes.applyInArrow(gather, "_row long, vote long")
    mean = (F.col("vote") / F.lit(len(trees)) / F.lit(float(VOTE))).alias(name)
    return rows.join(votes.select("_row", mean), "_row", "left").select(*df.columns, name)
