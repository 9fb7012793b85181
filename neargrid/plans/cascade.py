"""The decision cascade: the Morton window where it is dense and unanimous, exact search for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrid.operators import search
from neargrid.sources.schemas import VECTOR
from neargrid.sources.shared import materialise


def decide(vectors: DataFrame, index: search.Index) -> DataFrame:
    """(request_id, v0..v13) -> request_id, frauds (of 5; null on the fast path), fraud_score, approved, source.

    Equal vectors are searched once, which also keeps a vector that very many requests share from being a hot key.
    The window's result is written before the undecided rows are taken from it, so neither branch computes it twice.
    """
    vectors = materialise(vectors.select("request_id", *VECTOR))  # else each join on the 14 columns computes them anew
    distinct = materialise(search.with_bounds(search.as_queries(vectors.groupBy(*VECTOR).agg(F.min("request_id").alias("id")), "id"), index))
    voted = materialise(distinct.select("id").join(search.window_vote(search.window_top(distinct, index)), "id", "left").select("id", "fast_score"))
    residue = distinct.join(voted.where("fast_score IS NULL").select("id"), "id", "left_semi")
    exact = search.exact_votes(residue, search.knn_exact(residue, index))
    fast = voted.where("fast_score IS NOT NULL").select("id", F.lit(None).cast("int").alias("frauds"), F.col("fast_score").alias("fraud_score"), F.lit("Morton").alias("source"))
    scored = fast.unionByName(exact.withColumn("source", F.lit("KdTree")))
    approved = F.when(F.col("source") == "Morton", F.col("fraud_score") == 0).otherwise(F.col("frauds") < 3)
    scored = scored.withColumn("approved", approved).join(distinct.select("id", *(F.col(q).alias(v) for q, v in zip(search.QUERY, VECTOR, strict=True))), "id").drop("id")
    return vectors.join(scored, VECTOR).select("request_id", "frauds", "fraud_score", "approved", "source")
