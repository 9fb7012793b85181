"""Connected components by contraction: distributed in every step, also for hubs that hold a third of all edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrid.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs -> one row (node, root) per node that has an edge to another node.

    Each round points every node at the neighbour of least random rank (or itself), replaces the edges' ends by
    what they point at, and drops loops and repeats. The ranks change each round, so that a round keeps a constant
    fraction of the nodes at most, in expectation, whatever the ids and the shape. A star needs two rounds.
    Minima are combined map-side, and a hub's rows meet its single new name in plain joins, which adaptive
    execution splits. `root` is some node of the component, not the least one.
    """
    edges = cut(edges.where("u <> v").select("u", "v").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("r"), F.col(c).alias("n"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.select("u", rank("v").alias("to")).groupBy("u").agg(F.min("to").alias("to"))
        step = cut(least.select(F.col("u").alias("node"), F.least(F.col("to"), rank("u"))["n"].alias("root")))
        steps.append(step)
        edges = (
            edges.join(step.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u")
            .join(step.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
            .where("ru <> rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct()
        )
        edges = cut(edges)
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        then = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return cut(out)
