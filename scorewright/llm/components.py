"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import written


def _order(name: str, turn: int) -> Column:
    """Another random order of the nodes each turn, the same in every run."""
    return F.struct(F.xxhash64(F.col(name), F.lit(turn)).alias("h"), F.col(name).alias("node"))


def components(links: DataFrame) -> DataFrame:
    """For links (a, b): node and root, one row for each node with a link.

    Nodes of a component share their root, which is one of them.  Each turn every
    node joins the neighbour that comes first in a random order, if that comes before
    itself, and links are drawn between what the nodes have become; expected turns
    are logarithmic in the size of the largest component.  A node's first neighbour
    is a minimum, combined before the shuffle, so a hub is one row for each task.
    Tables are written out each turn.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b")
    edges = written(both.distinct(), "links")
    roots = written(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "roots")
    turn = 0
    while not edges.isEmpty():
        first = edges.groupBy("a").agg(F.min(_order("b", turn)).alias("b"))
        own = _order("a", turn)
        hop = written(
            first.select("a", F.when(F.col("b") < own, F.col("b.node")).otherwise(F.col("a")).alias("to")),
            "hops",
        )
        # Two steps at once: where the neighbour itself has gone.
        far = hop.select(F.col("a").alias("to"), F.col("to").alias("far"))
        hop = written(
            hop.join(far, "to", "left").select("a", F.coalesce("far", "to").alias("to")), "hops"
        )
        roots = written(
            roots.join(hop, roots["root"] == hop["a"], "left").select(
                "node", F.coalesce("to", "root").alias("root")
            ),
            "roots",
        )
        moved = edges.join(hop, "a").select(F.col("to").alias("a"), F.col("b").alias("_b"))
        moved = moved.join(hop.select(F.col("a").alias("_b"), F.col("to").alias("b")), "_b")
        edges = written(moved.select("a", "b").filter("a <> b").distinct(), "links")
        turn += 1
    return roots
