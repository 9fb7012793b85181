"""Evaluation of decisions against expectations: per-path mismatches, confusion matrix, scores."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrid.sources.shared import materialise

#: Bins of one step of the search for a percentile.
BINS = 4096

# Fixed values of the scoring rules.
P99_BEST_MS, P99_CUT_MS, CUT_SCORE = 1.0, 2000.0, -3000.0
FAILURE_CUT, LEAST_EPSILON, ERROR_PENALTY = 0.15, 0.001, 300.0
WEIGHT_FN, WEIGHT_ERR = 3, 5


def diagnose(results: DataFrame) -> DataFrame:
    """(source, approved, expected_approved) -> per source: cases, mismatches."""
    wrong = (F.col("approved") != F.col("expected_approved")).cast("bigint")
    return results.groupBy("source").agg(F.count(F.lit(1)).alias("cases"), F.sum(wrong).alias("mismatches"))


def report(results: DataFrame) -> DataFrame:
    """One row: entries, elapsed_ms (of the aggregation), and cases and mismatches of each path."""
    began = time.monotonic()
    wrong = F.col("approved") != F.col("expected_approved")
    paths = (("morton", "Morton"), ("kdtree", "KdTree"))
    counts = [F.count_if(F.col("source") == s).alias(f"{p}_cases") for p, s in paths] + [F.count_if((F.col("source") == s) & wrong).alias(f"{p}_mismatches") for p, s in paths]
    row = results.agg(F.count(F.lit(1)).alias("entries"), *counts).first().asDict()
    row = {"entries": row.pop("entries"), "elapsed_ms": int(1000 * (time.monotonic() - began)), **row}
    return results.sparkSession.range(1).select(*(F.lit(v).cast("bigint").alias(k) for k, v in row.items()))


def checksum(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and the exclusive or of all values: touches every column of every row."""
    return rows.agg(F.count(F.lit(1)).alias("records"), *(F.bit_xor(c).cast("int").alias(c) for c in columns))


def nth(rows: DataFrame, value: str, k: int) -> float:
    """The value that k others are below, by histograms of BINS counts each: no sort, and no values on the driver."""
    lo, hi = rows.agg(F.min(value), F.max(value)).first()
    below = 0
    while True:
        width = (hi - lo) / BINS
        if width <= 0 or lo + width == lo:
            return lo
        bins = rows.where(F.col(value).between(lo, hi)).groupBy(F.least(F.floor((F.col(value) - lo) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        for r in sorted(bins, key=lambda r: r["bin"]):
            if below + r["n"] > k:
                break
            below += r["n"]
        if r["lo"] == r["hi"]:
            return r["lo"]
        lo, hi = r["lo"], r["hi"]


def percentile(rows: DataFrame, value: str, share: float) -> float | None:
    """Exact, interpolated between the two neighbours; None of no values. No task holds the distinct values."""
    rows = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias(value))
    if not (n := rows.count()):
        return None
    rank = share * (n - 1)
    low = nth(rows, value, math.floor(rank))
    return low if rank == math.floor(rank) else low + (nth(rows, value, math.ceil(rank)) - low) * (rank - math.floor(rank))


def confusion(results: DataFrame) -> DataFrame:
    """(approved, expected_approved, http_ok) -> tn, tp, fn, fp, err; positive is denied."""
    ok, a, e = F.col("http_ok"), F.col("approved"), F.col("expected_approved")
    return results.agg(
        F.count_if(ok & a & e).alias("tn"), F.count_if(ok & ~a & ~e).alias("tp"), F.count_if(ok & a & ~e).alias("fn"), F.count_if(ok & ~a & e).alias("fp"), F.count_if(~ok).alias("err")
    )


def scorecard(results: DataFrame) -> DataFrame:
    """One row: totals, weighted error, rates, p99 latency, and the latency, detection and final scores."""
    results = materialise(results.select("approved", "expected_approved", "http_ok", "latency_ms"))  # read more than once
    d = confusion(results).withColumn("p99", F.lit(percentile(results, "latency_ms", 0.99)).cast("double"))
    d = d.withColumn("n", F.expr("tn + tp + fn + fp + err")).withColumn("weighted", F.expr(f"fp + {WEIGHT_FN} * fn + {WEIGHT_ERR} * err"))
    rate = lambda x: F.when(F.col("n") > 0, F.col(x) / F.col("n")).otherwise(0.0)
    d = d.withColumn("failures", F.expr("fp + fn + err"))
    d = d.withColumn("epsilon", rate("weighted")).withColumn("failure_rate", rate("failures"))
    latency = F.when(F.coalesce("p99", F.lit(0.0)) <= 0, 0.0).when(F.col("p99") > P99_CUT_MS, CUT_SCORE).otherwise(1000 * F.log10(1000 / F.greatest("p99", F.lit(P99_BEST_MS))))
    detection = F.when(F.col("failure_rate") > FAILURE_CUT, CUT_SCORE).otherwise(1000 * F.log10(1 / F.greatest("epsilon", F.lit(LEAST_EPSILON))) - ERROR_PENALTY * F.log10(1.0 + F.col("weighted")))
    d = d.withColumn("latency_score", latency).withColumn("detection_score", detection).withColumn("final_score", F.col("latency_score") + F.col("detection_score"))
    return d.select("n", "weighted", "failures", *(F.round(c, 6).alias(c) for c in ("epsilon", "failure_rate", "p99", "latency_score", "detection_score", "final_score")))


def class_balance(labelled: DataFrame) -> DataFrame:
    n, fraud = F.count(F.lit(1)), F.sum(F.col("label").cast("bigint"))
    return labelled.agg(n.alias("total"), fraud.alias("fraud_count"), (n - fraud).alias("legit_count"), F.round(fraud / n, 6).alias("fraud_rate"), F.round((n - fraud) / n, 6).alias("legit_rate"))
