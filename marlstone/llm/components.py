"""Connected components of a graph that is spread over the cluster.

Every round maps each node to the neighbour (or itself) that comes first in an
order shuffled anew, and contracts the graph along that map. Only nodes that
still have edges take part in a round, so the tables shrink geometrically; edges
are distinct after each round. Minima are combined before their shuffle, and the
joins that relabel edges are plain equi-joins, which adaptive execution splits
where a hub holds many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge.

    edges has columns u and v; direction, repeats and loops do not matter, rows
    with a null are ignored.
    """
    clean = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u is not null and v is not null and u != v").distinct()
    left = materialize(clean, "edges")
    nodes = left.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    names = materialize(nodes.select("node", F.col("node").alias("name")), "names")
    for turn in range(most_rounds):
        if left.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("id"))
        both = left.select("u", rank("v").alias("other"), rank("u").alias("own")).unionAll(left.select(F.col("v").alias("u"), rank("u").alias("other"), rank("v").alias("own")))
        first = materialize(both.groupBy("u").agg(F.least(F.min("other"), F.min("own"))["id"].alias("to")), "first")
        moved = left.join(first, "u").select(F.col("to").alias("a"), "v").join(first.withColumnRenamed("u", "v"), "v").select(F.col("a"), F.col("to").alias("b"))
        before = left, names, first
        left = materialize(moved.filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        names = materialize(names.join(first.withColumnRenamed("u", "name"), "name", "left").select("node", F.coalesce("to", "name").alias("name")), "names")
        discard(*before)
    else:
        raise RuntimeError("the components did not settle")
    smallest = names.groupBy("name").agg(F.min("node").alias("component"))
    return names.join(smallest, "name").select("node", "component")
