"""Global positions without a global task, and lower bounds by a tree of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrid.sources.shared import materialise

#: Keys in a node of the key tree.
NODE = 512


def positions(df: DataFrame, order: list[str], name: str = "pos") -> tuple[DataFrame, int]:
    """df with its row number from 0 by `order`, written once; and the number of rows.

    Rows are range-partitioned, sorted and written; a row's number is its place in its partition plus the sizes of
    those before. Only one number a partition is gathered, which goes back as a constant, and what is written is
    what a retry reads, so the numbers hold.
    """
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part, row = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    starts = F.split(F.lit(",".join(map(str, before)) or "0"), ",").cast("array<bigint>")
    return placed.withColumn(name, F.get(starts, part.cast("int")) + row).drop("_row"), total


def key_tree(index: DataFrame, n: int) -> list[DataFrame]:
    """index (key, pos) of n rows -> levels (node, keys): nodes of NODE keys in order, then nodes of those nodes' first keys, up to one node."""
    level = index.select("key", F.col("pos").alias("at"))
    out: list[DataFrame] = []
    while True:
        node = F.floor(F.col("at") / NODE).alias("node")
        keys = F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"])
        out.append(materialise(level.groupBy(node).agg(keys.alias("keys"))))
        n = -(-n // NODE)
        if n <= 1:
            return out
        level = out[-1].select(F.get("keys", 0).alias("key"), F.col("node").alias("at"))


def lower_bounds(probes: DataFrame, tree: list[DataFrame]) -> DataFrame:
    """probes (id, key, ...) -> with lb: the number of index rows with a smaller key.

    A probe goes down the tree by one equi-join a level and counts the smaller keys of one node in each, so nothing of
    the index is sorted or gone through, however often it is asked.
    """
    found = probes.withColumn("_node", F.lit(0).cast("bigint"))
    for depth, level in enumerate(reversed(tree)):
        last = depth + 1 == len(tree)
        smaller = F.size(F.filter("keys", lambda k: k < F.col("key"))).cast("bigint")
        found = found.join(level.withColumnRenamed("node", "_node"), "_node", "left")
        found = found.withColumn("_c", F.when(F.col("keys").isNull(), F.lit(0).cast("bigint")).otherwise(smaller)).drop("keys")
        child = F.col("_c") if last else F.greatest(F.col("_c") - 1, F.lit(0).cast("bigint"))
        found = found.withColumn("_node", F.col("_node") * NODE + child).drop("_c")
    return found.withColumnRenamed("_node", "lb")
