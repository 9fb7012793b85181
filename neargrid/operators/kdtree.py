"""KD-tree leaves by median splits, level by level, and the exact search over them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neargrid.functions import morton
from neargrid.operators.ranks import positions
from neargrid.operators.search import EXACT_K, QUERY, VECTOR, _top, box_distance, boxes, spread
from neargrid.sources.shared import materialise

LEAF = 64
#: Levels with so many nodes or fewer are ranked by a global sort: their nodes are too large for a window each.
LARGE_NODES = 1024
#: Rows of a node that one task splits down to its leaves: some 25 MB.
SUBTREE = 1 << 19


def widest(prefix_lo: str = "min", prefix_hi: str = "max") -> Column:
    """The first dimension with the largest range."""
    widths = F.array(*(F.col(f"{prefix_hi}{i}").cast("int") - F.col(f"{prefix_lo}{i}").cast("int") for i in range(len(VECTOR))))
    return (F.array_position(widths, F.array_max(widths)) - 1).cast("int")


def split(rows: DataFrame, nodes: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Rows with `node`, and their nodes' boxes: nodes of over `leaf` rows become 2 node + 1 (the first n div 2 rows by
    the widest dimension's value and ref_id) and 2 node + 2."""
    plan = nodes.select("node", "n", widest().alias("dim"))
    joined = rows.join(plan, "node")
    value = F.get(F.array(*VECTOR), F.col("dim"))
    joined = joined.withColumn("value", value)
    if nodes.count() <= LARGE_NODES:
        before = plan.select("node", F.coalesce(F.sum("n").over(Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        ranked = positions(joined, ["node", "value", "ref_id"], "at")[0].join(F.broadcast(before), "node").withColumn("rn", F.col("at") - F.col("before")).drop("at", "before")
    else:
        ranked = joined.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("value", "ref_id")) - 1)
    left = F.col("rn") < F.floor(F.col("n") / 2)
    child = F.when(F.col("n") <= leaf, F.col("node")).when(left, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
    return ranked.withColumn("node", child).drop("n", "dim", "value", "rn")


def leaf_nodes(node: int, vectors: np.ndarray, ref_id: np.ndarray, leaf: int) -> np.ndarray:
    """The leaf of each row below `node`, by the splits of `split` taken one after the other."""
    out = np.empty(len(ref_id), np.int64)
    stack = [(node, np.argsort(ref_id, kind="stable"))]  # rows of a node, by ref_id
    while stack:
        at, rows = stack.pop()
        if len(rows) <= leaf:
            out[rows] = at
            continue
        part = vectors[rows]
        dim = int((part.max(axis=0).astype(np.int32) - part.min(axis=0)).argmax())
        left = np.zeros(len(rows), bool)
        left[np.argsort(part[:, dim], kind="stable")[: len(rows) // 2]] = True
        stack += [(2 * at + 1, rows[left]), (2 * at + 2, rows[~left])]
    return out


def build(refs: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """refs (ref_id, v0..v13, label) -> rows with `node`, and the leaves' boxes (node, n, min*, max*).

    Nodes of over SUBTREE rows are split level by level, one aggregation and one sort for all nodes of a level; all
    that is below a smaller node is split in one task, so a table of SUBTREE rows takes one pass.
    """
    rows = materialise(refs.select("ref_id", *VECTOR, "label").withColumn("node", F.lit(0).cast("bigint")))
    done: list[DataFrame] = []
    while True:
        nodes = materialise(boxes(rows, F.col("node"), VECTOR, VECTOR))
        small = nodes.where(F.col("n") <= max(leaf, SUBTREE)).select("node")
        done.append(rows.join(small, "node", "left_semi"))
        big = nodes.where(F.col("n") > max(leaf, SUBTREE))
        if big.isEmpty():
            break
        rows = materialise(split(rows, big, leaf))

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        vectors = np.stack([table.column(v).to_numpy() for v in VECTOR], axis=1)
        found = leaf_nodes(key[0].as_py(), vectors, table.column("ref_id").to_numpy(), leaf)
        return table.set_column(table.schema.get_field_index("node"), "node", pa.array(found))

    out = reduce(DataFrame.unionByName, done)
    out = materialise(out.groupBy("node").applyInArrow(finish, out.schema))
    return out, materialise(boxes(out, F.col("node"), VECTOR, VECTOR))


#: Levels of the tree that one step of the search goes down.
STEP = 6


def _above(node: Column, depth: int) -> Column:
    """The node's ancestor at that depth, or itself if it is not deeper."""
    own = F.floor(F.log2(node + 1.5)).cast("int")
    return F.when(own <= depth, node).otherwise(F.expr("shiftright(node + 1, cast(floor(log2(node + 1.5)) as int) - {d})".format(d=depth)) - 1)


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """What runs inside has no method so large that the JVM interprets it, which box distances would else be."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    was = spark.conf.get(limit)
    spark.conf.set(limit, str(min(int(was), 8000)))
    try:
        yield
    finally:
        spark.conf.set(limit, was)


def knn(queries: DataFrame, rows: DataFrame, leaves: DataFrame, k: int = EXACT_K) -> DataFrame:
    """id, rank, ref_id, d, label: exact.

    A distinct query first goes down to one near node of k rows at least; its k-th distance there bounds the answer.
    With that bound it goes down the tree again, STEP levels at a time, by equi-joins with its nodes' descendants,
    and drops nodes whose nearest point is beyond it, and at last leaves beyond the least far corner of one; a node at
    the very bound is kept for its ties. The rows of the leaves that remain are measured, and only those within the
    bound are ranked.
    """
    queries = materialise(queries.select("id", *QUERY))
    asked = materialise(queries.groupBy(*QUERY).agg(F.min("id").alias("id")))
    last, least = leaves.agg(F.max("node"), F.min("n")).first()
    deepest = (last + 1).bit_length() - 1 if last is not None else 0
    # 2^j leaves hold k rows, and a node has as many j + 1 levels above the deepest, where some leaves are one level up
    seeds = deepest if least is None or least >= k else max(0, deepest - 1 - (-(-k // least) - 1).bit_length())
    low, high = ([f"{m}{i}" for i in range(len(VECTOR))] for m in ("min", "max"))
    made: dict[tuple[int, int], DataFrame] = {}

    def met(live: DataFrame, depth: int, above: int) -> DataFrame:
        """live (up, ...) with the boxes at that depth below their nodes `up`."""
        if (depth, above) not in made:
            at = leaves.withColumn("at", _above(F.col("node"), depth))
            level = boxes(at, F.col("at"), low, high).drop("n").join(at.groupBy(F.col("at").alias("node")).agg(F.sum("n").alias("n")), "node")
            made[depth, above] = materialise(level.withColumn("up", _above(F.col("node"), above)))
        level = made[depth, above]
        return live.join(F.broadcast(level), "up") if depth <= 2 * STEP else spread(live, "up").join(level, "up")

    def steps(to: int) -> list[tuple[int, int]]:
        depths = [0, *range(STEP, to, STEP), to]
        return list(zip(depths[1:], depths, strict=False))

    root = spread(asked, "id").withColumn("up", F.lit(0).cast("bigint"))
    near = root
    for depth, above in steps(seeds):
        tightest = box_distance(QUERY) * float(1 << 36) + box_distance(QUERY, least=False)  # of the nearest: boxes overlap
        pairs = met(near, depth, above).select("id", *QUERY, "node", tightest.alias("near"))
        near = pairs.groupBy("id", *QUERY).agg(F.min_by("node", "near").alias("up"))
    vectors = rows.select("ref_id", *VECTOR, "label", "node")
    first = spread(near, "up").join(vectors.withColumn("up", _above(F.col("node"), seeds)), "up")
    first = _top(first.select("id", morton.l2(VECTOR, QUERY).alias("d")), k, "d")
    bound = first.groupBy("id").agg(F.when(F.count(F.lit(1)) == k, F.max("d")).alias("bound"))
    with compiled(asked.sparkSession):
        live = spread(materialise(asked.join(bound, "id", "left")), "id").withColumn("up", F.lit(0).cast("bigint"))
    for depth, above in steps(deepest):
        live = met(live, depth, above).withColumn("near", box_distance(QUERY)).where("bound IS NULL OR near <= bound")
        if depth == deepest:  # a leaf of k rows has them within its far corner, which is close by where rows are equal
            far = F.min(F.when(F.col("n") >= k, box_distance(QUERY, least=False))).over(Window.partitionBy("id"))
            live = live.withColumn("far", far).where("far IS NULL OR near <= far")
        live = live.select("id", *QUERY, "bound", F.col("node").alias("up"))
    with compiled(asked.sparkSession):
        live = materialise(live)
    found = spread(live, "up").join(vectors.withColumnRenamed("node", "up"), "up").select("id", "ref_id", morton.l2(VECTOR, QUERY).alias("d"), "label", "bound")
    top = _top(found.where("bound IS NULL OR d <= bound").drop("bound"), k, "d", "ref_id")
    same = queries.join(asked.withColumnRenamed("id", "_as"), QUERY).select("id", "_as")
    return same.join(top.withColumnRenamed("id", "_as"), "_as").drop("_as")
