"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neargrid.llm import chat, langid, licenses, packing, pii, quality, secrets, simhash, vectors, winnowing
from neargrid.llm.common import read_table


def _is(kind: int):
    return lambda s: s["kind"] == kind


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(read_table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.size(F.filter("base", _is(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return out.select("row.doc_id", *counts, F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("secrets").alias("spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(read_table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.size(F.filter("base", _is(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return out.select("row.doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("pii").alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("row.doc_id", "log_weight", "key", "sampled")


def op5_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.learn(docs.where(~langid.held_out("doc_id"))))
    return out.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(read_table(spark, sf_dir, "conversations"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    n_hit = winnowing.covered("spans")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_packing": op2_packing,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_pq": op5_pq,
    "op6_simhash": op6_simhash,
    "op7_langid": op7_langid,
    "op8_licenses": op8_licenses,
    "op9_chat": op9_chat,
    "op10_winnowing": op10_winnowing,
}
ORACLE_SQL: dict[str, str] = {"op5_pq": vectors.ORACLE, "op8_licenses": licenses.oracle(), "op9_chat": chat.ORACLE, "op10_winnowing": winnowing.ORACLE}
