"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b) that is not itself the lowest of its component;
    the label is the lowest.

    Each node with a lower neighbour moves to its lowest one, chains of moves are followed to their end by
    doubling, and the edges between the nodes left are contracted until none is left. Every step is a
    grouping or a join against one row per node, so a node of very many edges is never held together.
    """
    pair = [F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")]
    edges = written(edges.where("a <> b").select(*pair).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        moves = written(edges.groupBy("hi").agg(F.min("lo").alias("to")), "moves")
        while True:
            onward = moves.select(F.col("hi").alias("at"), F.col("to").alias("further"))
            jumped = moves.join(onward, F.col("to") == F.col("at"), "left")
            jumped = written(jumped.select("hi", F.coalesce("further", "to").alias("to"), F.col("at").isNotNull().alias("moved")), "moves")
            moves = jumped.select("hi", "to")
            if jumped.where("moved").isEmpty():
                break
        stepped = moves.select(F.col("hi").alias("node"), F.col("to").alias("label"))
        if labels is not None:
            moved = labels.join(moves, F.col("label") == F.col("hi"), "left").select("node", F.coalesce("to", "label").alias("label"))
            stepped = moved.unionByName(stepped)
        labels = written(stepped, "labels")
        left = moves.select(F.col("hi").alias("from_hi"), F.col("to").alias("hi_to"))
        right = moves.select(F.col("hi").alias("from_lo"), F.col("to").alias("lo_to"))
        ends = edges.join(left, F.col("hi") == F.col("from_hi"), "left").join(right, F.col("lo") == F.col("from_lo"), "left")
        ends = ends.select(F.coalesce("hi_to", "hi").alias("a"), F.coalesce("lo_to", "lo").alias("b"))
        edges = written(ends.where("a <> b").select(*pair).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    return labels
