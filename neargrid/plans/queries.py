"""The registered queries of the scoring engine: each runs its operator over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neargrid.functions import features, morton
from neargrid.operators import evaluate, kdtree, requests, search
from neargrid.operators.ranks import lower_bounds
from neargrid.plans import cascade
from neargrid.plans.fixtures import HTTP_BUFFERS, fraud_requests, query_vectors, references
from neargrid.plans.jobs import build_indexes
from neargrid.sources.indexes import read_index, read_kd
from neargrid.sources.schemas import VECTOR
from neargrid.sources.shared import shared_path
from neargrid.sources.tables import read_table, stream_requests
from neargrid.streaming.scorer import score_stream


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, search.Index]:
    f = fraud_requests(spark, sf_dir)
    return search.as_queries(query_vectors(f), "request_id"), search.build_index(references(f))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "request_id")


def q_fraud_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fraud_requests(spark, sf_dir)
    return cascade.decide(query_vectors(f), search.build_index(references(f)))


def q_vectorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = F.lit(0).cast("smallint")
    return features.vectorised(fraud_requests(spark, sf_dir), "request_id").select("request_id", *VECTOR, pad.alias("v14"), pad.alias("v15"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as JSON; some broken in ways that requests are."""
    b, case = F.col("body"), F.col("request_id") % 50
    broken = (
        F.when(case == 7, F.substring(b, F.lit(1), F.length(b) - 30)).when(case == 13, F.regexp_replace(b, '"installments":[^,]*', '"installments":"x"'))
        .when(case == 21, F.concat(F.regexp_replace(b, ',"last_transaction":.*$', ""), F.lit("}"))).when(case == 33, F.concat(b, F.lit(" {}")))
        .when(case == 45, F.regexp_replace(b, '"requested_at":"[0-9]*-', '"requested_at":"20x6-')).otherwise(b)
    )
    return requests.request_json(fraud_requests(spark, sf_dir), "request_id").select("request_id", broken.alias("body"))


def q_parse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.parse_requests(_bodies(spark, sf_dir))[0]


def q_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.parse_requests(_bodies(spark, sf_dir))[1].select("request_id", "reason")


def q_last_tx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("s"))
    return features.history(e, "user_id", "s", "event_id").select("event_id", "minutes_since_last", "tx_count_24h")


def q_mcc_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraud_requests(spark, sf_dir).select("request_id", "mcc", features.mcc_risk(F.col("mcc")).alias("risk"))


def _known(spark: SparkSession, sf_dir: str, test) -> DataFrame:
    raw, m = F.col("known_merchants_raw"), F.col("merchant_id")
    return fraud_requests(spark, sf_dir).select("request_id", test(raw, m).alias("known"), test(raw, F.left(m, F.lit(6))).alias("known_prefix"))


def q_known_merchant_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir, features.merchant_known)


def q_known_merchant_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir, features.merchant_listed)


def q_quantize_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = F.lit(0).cast("smallint")
    return read_table(spark, sf_dir, "embeddings").select("vec_id", *features.quantised_columns("embedding"), pad.alias("v14"), pad.alias("v15"))


def q_morton_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morton.with_key(features.vectorised(fraud_requests(spark, sf_dir), "request_id"), VECTOR).select("request_id", "key")


def q_morton_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[1].rows.select("ref_id", "key", "pos")


def q_morton_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, index = _index(spark, sf_dir)
    return _named(lower_bounds(q.select("id", "key"), index.keys).select("id", "lb"))


def q_morton_window_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = search.band(*_index(spark, sf_dir)).groupBy("id")
    return _named(frame.agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("label").alias("frauds")))


def q_morton_top11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(search.window_top(*_index(spark, sf_dir)).select("id", "rank", "ref_id", "d", F.col("label").cast("int").alias("label")))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, index = _index(spark, sf_dir)
    return q.select("id").join(search.window_vote(search.window_top(q, index)), "id", "left")


def q_morton_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_votes(spark, sf_dir))


def q_residual_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_votes(spark, sf_dir).where("fast_score IS NULL").select("id"))


def _neighbours(top: DataFrame) -> DataFrame:
    return _named(top.select("id", "rank", "ref_id", "d", F.col("label").cast("int").alias("label")))


def q_knn5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(search.knn_exact(*_index(spark, sf_dir)))


def q_knn5_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, index = _index(spark, sf_dir)
    return _named(search.exact_votes(q, search.knn_exact(q, index)))


def q_knn5_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fraud_requests(spark, sf_dir)
    return _neighbours(kdtree.knn(search.as_queries(query_vectors(f), "request_id"), *kdtree.build(references(f))))


def _root(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = references(fraud_requests(spark, sf_dir)).withColumn("node", F.lit(0).cast("bigint"))
    return rows, search.boxes(rows, F.col("node"), VECTOR, VECTOR)


def q_kd_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(spark, sf_dir)[1].drop("node")


def q_kd_widest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(spark, sf_dir)[1].select(kdtree.widest().alias("dim"))


def q_kd_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.split(*_root(spark, sf_dir)).select("ref_id", "node")


def q_kd_leaf_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.build(references(fraud_requests(spark, sf_dir)))[1].groupBy("n").agg(F.count(F.lit(1)).alias("leaves"))


def _whole(x: int | None) -> Column:
    """A whole number as bigint, as SQL has it; one that no bigint holds, for which SQL fails, as decimal(38,0)."""
    return F.lit(x).cast("bigint" if x is None or -(1 << 63) <= x < 1 << 63 else "decimal(38,0)")


def q_index_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job writes both indexes; what their readers give back is counted. Sums of products of millions of rows outgrow
    bigint, so they are taken in decimals and come back whole."""
    path = shared_path(spark)
    build_indexes(references(fraud_requests(spark, sf_dir)), path)
    index, (rows, leaves) = read_index(spark, f"{path}/morton"), read_kd(spark, f"{path}/kd")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    found = index.rows.agg(F.count(F.lit(1)).alias("entries"), F.sum("label").alias("frauds"), F.sum(wide("pos") * wide("ref_id")).alias("places")).first().asDict()
    found |= leaves.agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("kd_records")).first().asDict()
    found |= rows.agg(F.sum(wide("ref_id")).alias("kd_refs")).first().asDict()
    return spark.range(1).select(*(_whole(v).alias(k) for k, v in found.items()))


def q_index_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.checksum(_index(spark, sf_dir)[1].rows, VECTOR)


def q_response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.response_json(q_fraud_score(spark, sf_dir), "request_id")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = fraud_requests(spark, sf_dir).select("request_id", (F.col("label") == 0).alias("expected_approved"))
    measured = [(F.col("request_id") % 500 != 40).alias("http_ok"), (F.col("request_id") % 97 / 10.0).alias("latency_ms")]
    return q_fraud_score(spark, sf_dir).join(expected, "request_id").select("*", *measured)


def q_diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.diagnose(_results(spark, sf_dir))


def q_diagnose_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's row, but for the time it took, which no other run gives again."""
    return evaluate.report(_results(spark, sf_dir)).drop("elapsed_ms")


def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_results(spark, sf_dir))


def q_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scorecard(_results(spark, sf_dir))


def q_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_balance(fraud_requests(spark, sf_dir).where("NOT is_query"))


def q_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)[1].rows
    return index.agg(F.count(F.lit(1)).alias("records"), F.countDistinct(F.floor(F.col("pos") / search.FAN)).alias("blocks"), F.sum("label").alias("frauds"))


def q_http_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.parse_http(spark.sql(HTTP_BUFFERS, events=read_table(spark, sf_dir, "events")))


def q_stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body, valid and broken, as a stream: decisions, and rejects with their reason."""
    inbox, out, state = (shared_path(spark) for _ in range(3))
    f = fraud_requests(spark, sf_dir)
    _bodies(spark, sf_dir).where("request_id % 20 = 0 OR request_id % 50 IN (7, 13, 21, 33, 45)").select("body").repartition(3).write.text(inbox)
    score_stream(stream_requests(spark, inbox, 2), search.build_index(references(f)), out, state).awaitTermination()
    decisions = spark.read.parquet(out).drop("batch").withColumn("reason", F.lit(None).cast("string"))
    rejects = spark.read.parquet(f"{out}-rejects").select(F.regexp_extract("body", '"id":"([^"]*)"', 1).alias("id"), "reason")
    return decisions.unionByName(rejects, allowMissingColumns=True)


QUERIES = {
    "q_fraud_score": q_fraud_score,
    "q_vectorize": q_vectorize,
    "q_parse_requests": q_parse_requests,
    "q_rejects": q_rejects,
    "q_last_tx_features": q_last_tx_features,
    "q_mcc_risk": q_mcc_risk,
    "q_known_merchant_substring": q_known_merchant_substring,
    "q_known_merchant_strict": q_known_merchant_strict,
    "q_quantize_refs": q_quantize_refs,
    "q_morton_key": q_morton_key,
    "q_morton_rank": q_morton_rank,
    "q_morton_lower_bound": q_morton_lower_bound,
    "q_morton_window_frame": q_morton_window_frame,
    "q_morton_top11": q_morton_top11,
    "q_morton_vote": q_morton_vote,
    "q_residual_queries": q_residual_queries,
    "q_knn5_exact": q_knn5_exact,
    "q_knn5_score": q_knn5_score,
    "q_knn5_pruned": q_knn5_pruned,
    "q_kd_bounds": q_kd_bounds,
    "q_kd_widest": q_kd_widest,
    "q_kd_split": q_kd_split,
    "q_kd_leaf_sizes": q_kd_leaf_sizes,
    "q_index_job": q_index_job,
    "q_response_json": q_response_json,
    "q_diagnose": q_diagnose,
    "q_diagnose_report": q_diagnose_report,
    "q_confusion": q_confusion,
    "q_scorecard": q_scorecard,
    "q_class_balance": q_class_balance,
    "q_index_counts": q_index_counts,
    "q_index_checksum": q_index_checksum,
    "q_http_parse": q_http_parse,
    "q_stream_score": q_stream_score,
}
