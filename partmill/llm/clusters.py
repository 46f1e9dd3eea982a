"""Correlation clustering of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.session import durable


def correlation_clusters(edges: DataFrame) -> DataFrame:
    """node, cluster of the nodes that have links (a, b): pivots in random order, as the order of a hash; nodes whose name
    begins with ``?`` (incomplete ones) come after all others, so that those linked with a complete node join it.

    In each round every node that comes before all its linked nodes still unassigned is a pivot; its unassigned linked
    nodes join the first of their pivots.  With a random order the number of rounds grows with the logarithm of the
    number of links.  Every round's state is written to the shared checkpoint folder; the driver only asks whether
    nodes are left.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    rank = lambda c: F.struct(F.col(c).startswith("?").alias("open"), F.xxhash64(c, F.lit(7)).alias("hash"), F.col(c).alias("node"))
    open_edges = durable(both)
    nodes_left = durable(open_edges.select(F.col("a").alias("node")).distinct())
    done: DataFrame | None = None
    while not nodes_left.isEmpty():
        first = open_edges.groupBy("a").agg(F.min(rank("b")).alias("other"))
        pivots = nodes_left.join(first, nodes_left.node == first.a, "left").where(F.col("other").isNull() | (rank("node") < F.col("other"))).select("node")
        joined = open_edges.join(pivots, open_edges.b == pivots.node).groupBy("a").agg(F.min(rank("b")).alias("p")).select(F.col("a").alias("node"), F.col("p.node").alias("cluster"))
        taken = durable(pivots.select("node", F.col("node").alias("cluster")).unionByName(joined))
        done = taken if done is None else done.unionByName(taken)
        nodes_left = durable(nodes_left.join(taken, "node", "left_anti"))
        gone = taken.select("node")
        open_edges = durable(open_edges.join(gone, open_edges.a == gone.node, "left_anti").join(gone, open_edges.b == gone.node, "left_anti"))
    return done if done is not None else open_edges.select(F.col("a").alias("node"), F.col("b").alias("cluster"))
