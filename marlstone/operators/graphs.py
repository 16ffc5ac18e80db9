"""Connected components of a graph that is spread over the cluster.

In every round each node that still has edges moves to the neighbour, or itself,
that comes first in an order shuffled anew; the graph is contracted along these
moves and its edges made distinct, so the tables shrink geometrically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (smallest node that is reachable) of every node that has an edge; edges: u, v in any direction."""
    def contracted(df: DataFrame) -> DataFrame:
        return materialize(df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u != v").distinct(), "edges")

    rest = contracted(edges)
    ends = lambda df: df.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    where = materialize(ends(rest).withColumn("at", F.col("node")), "where")
    for turn in range(most_rounds):
        if rest.isEmpty():
            smallest = where.groupBy("at").agg(F.min("node").alias("component"))
            return where.join(smallest, "at").select("node", "component")
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("node"))
        seen = rest.select("u", order("v").alias("o")).unionAll(rest.select(F.col("v"), order("u"))).unionAll(ends(rest).select("node", order("node")))
        moves = materialize(seen.groupBy("u").agg(F.min("o")["node"].alias("to")), "moves")
        moved = rest.join(moves, "u").select(F.col("to").alias("x"), "v").join(moves.withColumnRenamed("u", "v"), "v").select(F.col("x").alias("u"), F.col("to").alias("v"))
        following = contracted(moved), materialize(where.join(moves.withColumnRenamed("u", "at"), "at", "left").select("node", F.coalesce("to", "at").alias("at")), "where")
        discard(rest, where, moves)
        rest, where = following
    raise RuntimeError("the components did not settle")
