"""Nearest labelled neighbours: the Morton window, and the exact search by bounding boxes."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neargrid.functions import morton
from neargrid.operators.ranks import key_tree, lower_bounds, positions
from neargrid.sources.schemas import QUERY, VECTOR
from neargrid.sources.shared import materialise

#: Half-width of the Morton window, unless the environment says otherwise.
WINDOW = int(os.environ["MORTON_WINDOW"]) if os.environ.get("MORTON_WINDOW", "").isdigit() else 512
FAST_K = 11
FAST_LIMIT = 5000
EXACT_K = 5
#: Index rows in a run, by which band joins meet.
RUN = 512
#: Index rows in a block, and blocks or boxes in the box above.
FAN = 64
#: Half-width of the window that gives exact search its first bound.
BOUND_WINDOW = 16
#: Dimensions whose partial distance is looked at first.
EARLY = 8


@dataclass
class Index:
    """rows (ref_id, v0..v13, label, key, pos) in key order, n of them; the tree of keys; the levels of boxes."""

    rows: DataFrame
    n: int
    keys: list[DataFrame]
    boxes: list[DataFrame]


def build_index(refs: DataFrame) -> Index:
    """refs (ref_id, v0..v13, label) -> the index, by key and ref_id. All of it is written, so each search only reads."""
    refs = materialise(refs.select("ref_id", *VECTOR, "label"))  # a range partitioning reads its input twice
    rows, n = positions(morton.with_key(refs, VECTOR), ["key", "ref_id"])
    return Index(rows, n, key_tree(rows, n), box_levels(rows, n))


def as_queries(vectors: DataFrame, id_: str) -> DataFrame:
    """(id, v0..v13) -> id, q0..q13, key."""
    return morton.with_key(vectors.select(F.col(id_).alias("id"), *(F.col(v).alias(q) for v, q in zip(VECTOR, QUERY, strict=True))), QUERY)


def with_bounds(queries: DataFrame, index: Index) -> DataFrame:
    """queries with lb, unless they have it."""
    return queries if "lb" in queries.columns else lower_bounds(queries, index.keys)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Over all shuffle partitions, however few bytes: each row stands for very many pairs, which bytes don't tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def band(queries: DataFrame, index: Index, width: int = WINDOW) -> DataFrame:
    """queries (id, q0..q13, key) with every index row at positions lb - width .. lb + width, lb the key's lower bound.

    Positions are cut into runs; a query meets the few runs of its window in an equi-join.
    """
    probed = with_bounds(queries, index)
    low, high = F.greatest(F.col("lb") - width, F.lit(0).cast("bigint")), F.least(F.col("lb") + width, F.lit(max(index.n - 1, 0)).cast("bigint"))
    step = min(RUN, max(1, 2 * width))
    probed = spread(probed.drop("key").withColumn("run", F.explode(F.sequence(F.floor(low / step), F.floor(F.greatest(high, low) / step)))), "run")
    rows = index.rows.select("ref_id", *VECTOR, "label", "pos").withColumn("run", F.floor(F.col("pos") / step))
    return probed.join(rows, "run").where(F.col("pos").between(F.col("lb") - width, F.col("lb") + width))


def _top(pairs: DataFrame, k: int, *order: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def window_top(queries: DataFrame, index: Index, k: int = FAST_K, width: int = WINDOW) -> DataFrame:
    """id, rank, ref_id, pos, d, label: the k nearest by L1 in the window; ties go to the earlier position."""
    pairs = band(queries, index, width).select("id", "ref_id", "pos", morton.l1(VECTOR, QUERY).alias("d"), "label")
    return _top(pairs, k, "d", "pos")


def window_vote(top: DataFrame, k: int = FAST_K, limit: int = FAST_LIMIT) -> DataFrame:
    """id, frauds, reach (the k-th distance), fast_score: 0 or 1 if k neighbours are within `limit` and agree, else null."""
    votes = top.groupBy("id").agg(F.sum(F.col("label").cast("int")).cast("int").alias("frauds"), F.max("d").alias("reach"), F.count(F.lit(1)).alias("n"))
    dense = (F.col("n") == k) & (F.col("reach") <= limit)
    return votes.select("id", "n", "frauds", "reach", F.when(dense & (F.col("frauds") == 0), 0.0).when(dense & (F.col("frauds") == k), 1.0).alias("fast_score"))


def boxes(rows: DataFrame, group: Column, lo: list[str], hi: list[str]) -> DataFrame:
    """Per group: n and the least and greatest of each dimension."""
    return rows.groupBy(group.alias("node")).agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(f"min{i}") for i, c in enumerate(lo)), *(F.max(c).alias(f"max{i}") for i, c in enumerate(hi)))


def box_levels(rows: DataFrame, n: int, fan: int = FAN) -> list[DataFrame]:
    """Boxes of runs of `fan` of the n index rows, boxes of runs of `fan` boxes, and so on to one level of `fan` at most."""
    low, high = ([f"{m}{i}" for i in range(len(VECTOR))] for m in ("min", "max"))
    levels = [materialise(boxes(rows, F.floor(F.col("pos") / fan), VECTOR, VECTOR))]
    while (n := -(-n // fan)) > fan:
        levels.append(materialise(boxes(levels[-1], F.floor(F.col("node") / fan), low, high)))
    return levels


def box_distance(q: list[str], least: bool = True) -> Column:
    """Squared distance from a query to a box: to its nearest point, or to its farthest corner."""
    part = "greatest(cast(min{i} AS int) - {c}, cast({c} AS int) - max{i}, 0)" if least else "greatest(cast({c} AS int) - min{i}, cast(max{i} AS int) - {c})"
    return F.expr(" + ".join(f"power({part.format(i=i, c=c)}, 2)" for i, c in enumerate(q)))


def knn_exact(queries: DataFrame, index: Index, k: int = EXACT_K, fan: int = FAN) -> DataFrame:
    """id, rank, ref_id, d, label: the k least (squared L2, ref_id) over the whole index.

    The k-th distance in a narrow Morton window bounds the answer. From the top level down a query keeps the boxes
    that come as near as that, and meets their children in an equi-join; only the rows of kept blocks are measured.
    Nothing that could be among the k is left out, and a box at the very bound is kept for its ties.
    """
    near = _top(band(queries, index, BOUND_WINDOW).select("id", "ref_id", morton.l2(VECTOR, QUERY).alias("d")), k, "d", "ref_id")
    bound = near.groupBy("id").agg(F.when(F.count(F.lit(1)) == k, F.max("d")).alias("bound"))
    live = materialise(queries.join(bound, "id", "left").select("id", *QUERY, "bound"))
    within = F.col("bound").isNull() | (box_distance(QUERY) <= F.col("bound"))
    live = live.withColumn("up", F.lit(0).cast("bigint"))
    for depth, level in enumerate(reversed(index.boxes)):
        child = level.withColumn("up", F.lit(0).cast("bigint") if not depth else F.floor(F.col("node") / fan))
        live = live.join(child, "up").where(within).select("id", *QUERY, "bound", F.col("node").alias("up"))
    rows = index.rows.select("ref_id", *VECTOR, "label", F.floor(F.col("pos") / fan).alias("up"))
    pairs = spread(live, "up").join(rows, "up").where(F.col("bound").isNull() | (morton.l2(VECTOR[:EARLY], QUERY[:EARLY]) <= F.col("bound")))
    pairs = pairs.select("id", "ref_id", morton.l2(VECTOR, QUERY).alias("d"), "label", "bound").where("bound IS NULL OR d <= bound")
    return _top(pairs.drop("bound"), k, "d", "ref_id")


def exact_votes(queries: DataFrame, top: DataFrame, k: int = EXACT_K) -> DataFrame:
    """id, frauds, fraud_score for every query; the denominator is k however few neighbours there are."""
    votes = top.groupBy("id").agg(F.sum(F.col("label").cast("int")).cast("int").alias("frauds"))
    frauds = F.coalesce("frauds", F.lit(0))
    return queries.select("id").join(votes, "id", "left").select("id", frauds.alias("frauds"), (frauds / F.lit(float(k))).alias("fraud_score"))
