"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmeter.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); nodes reach each other iff labels are equal.

    Every node moves to its smallest neighbour if that is smaller than itself; edges move along, and
    those inside one node vanish. Nodes should be hashes: the number of edges then falls by a constant
    factor a round on average, whatever the shape. A hub is one key of a partial aggregate and of
    joins whose sides are plain tables, so that adaptive execution can split it.
    """
    edges = materialize(edges.where("a <> b").select("a", "b"), "links")
    moves = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        move = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        move = materialize(move.select("node", F.least("node", "least").alias("to")), "moves")
        moves.append(move)
        there = {c: move.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab"}
        moved = edges.join(there["a"], "a").join(there["b"], "b").where("a_to <> b_to")
        edges = materialize(
            moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(),
            "links",
        )
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))

    def follow(labels: DataFrame, move: DataFrame) -> DataFrame:
        step = move.select(F.col("node").alias("label"), "to")
        return labels.join(step, "label", "left").select(
            "node", F.coalesce("to", "label").alias("label")
        )

    first = moves[0].withColumnRenamed("to", "label")
    return materialize(reduce(follow, moves[1:], first), "components")
