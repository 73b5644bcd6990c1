"""Connected components of a link table by randomised contraction.

In a round every node takes the node of least hash among itself and its neighbours
(another hash each round); nodes that take the same one become one node, and links
are rewritten, so that links inside a group vanish.  A round leaves a constant
fraction of the nodes at most, in expectation, whatever the shape, so all rounds
together handle little more rows than the first.  Nodes and links stay distributed;
each round's tables are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (columns ``a, b``); label = least node linked.

    Nodes without a link to another node, and links with a null end, are left out.
    """
    edges = materialize(_undirected(links), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        step = materialize(_taken(edges, len(steps)), "taken")
        steps.append(step)
        a = step.select(F.col("node").alias("a"), F.col("label").alias("x"))
        b = step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        ends = edges.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = materialize(_undirected(ends), "links")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # from the last and smallest round back to the first
    placed = steps.pop()
    for step in reversed(steps):
        later = placed.select(F.col("node").alias("label"), F.col("label").alias("last"))
        joined = step.join(later, "label", "left")
        placed = materialize(joined.select("node", F.coalesce("last", "label").alias("label")), "placed-nodes")
    least = materialize(placed.groupBy("label").agg(F.min("node").alias("least")), "least")
    return placed.join(least, "label").select("node", F.col("least").alias("label"))


def _undirected(links: DataFrame) -> DataFrame:
    """Each link between two nodes once, the lesser end first."""
    ends = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ends.distinct()


def _taken(edges: DataFrame, turn: int) -> DataFrame:
    """``node, label``: the node of least hash among each node and its neighbours."""

    def ranked(c: str) -> Column:
        return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))

    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("node")).agg(F.min(ranked("b")).alias("near"))
    return near.select("node", F.least(ranked("node"), F.col("near"))["v"].alias("label"))
