"""Requests and references over the driver's `events` table. The text runs unchanged on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from neargrid.functions.features import vectorised
from neargrid.sources.tables import read_table

FRAUD_REQUESTS = """
WITH e AS (
  SELECT event_id, user_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 16 AS a FROM {events}
)
SELECT
  event_id AS request_id,
  a AS archetype,
  CAST(500 * a AS DOUBLE) + value AS amount,
  CAST((5 * a) % 13 AS DOUBLE) AS installments,
  CAST(1772409600 + (a % 7) * 86400 + ((7 * a) % 24) * 3600 AS BIGINT) AS requested_at_s,
  CAST(100 + 50 * a AS DOUBLE) AS customer_avg_amount,
  CAST(a + user_id % 3 AS DOUBLE) AS tx_count_24h,
  CASE WHEN CAST(floor(a / 4) AS BIGINT) % 2 = 1 THEN 'MERC-X' ELSE concat('MERC-', CAST(a AS STRING), '-A') END AS merchant_id,
  concat('["MERC-', CAST(a AS STRING), '-A","MERC-', CAST(a AS STRING), '-B"]') AS known_merchants_raw,
  CASE a % 12 WHEN 0 THEN '4511' WHEN 1 THEN '5311' WHEN 2 THEN '5411' WHEN 3 THEN '5812' WHEN 4 THEN '5912' WHEN 5 THEN '5944'
    WHEN 6 THEN '5999' WHEN 7 THEN '7801' WHEN 8 THEN '7802' WHEN 9 THEN '7995' WHEN 10 THEN '0000' ELSE 'invalid' END AS mcc,
  CAST(300 * a AS DOUBLE) AS merchant_avg_amount,
  (a % 2 = 1) AS is_online,
  (CAST(floor(a / 2) AS BIGINT) % 2 = 1) AS card_present,
  CAST(60 * a + user_id % 20 AS DOUBLE) AS km_from_home,
  CASE WHEN a % 4 = 0 THEN NULL ELSE CAST(1772409600 + (a % 7) * 86400 + ((7 * a) % 24) * 3600 - (60 * a + user_id % 30) * 60 AS BIGINT) END AS last_at_s,
  CASE WHEN a % 4 = 0 THEN NULL ELSE CAST(40 * a AS DOUBLE) + value / CAST(10 AS DOUBLE) END AS km_from_current,
  CASE WHEN a % 4 = 1 THEN 1 WHEN a % 4 = 3 AND value > 60 THEN 1 ELSE 0 END AS label,
  (event_id % 20 = 0) AS is_query
FROM e
"""


#: Buffers of HTTP requests, whole and broken.
HTTP_BUFFERS = """
WITH e AS (SELECT event_id AS request_id, event_id % 20 AS c, concat('m-', CAST(event_id AS STRING)) AS m, concat('POST /fraud-score HTTP/1.1', chr(13), chr(10), 'Host: x', chr(13), chr(10), 'Content-Length:') AS post,
  concat(chr(13), chr(10)) AS nl, concat(chr(13), chr(10), chr(13), chr(10)) AS hend FROM {events})
SELECT request_id, CASE c
  WHEN 0 THEN concat('GET /ready HTTP/1.1', nl, 'Host: x', hend)
  WHEN 1 THEN concat(post, ' ', CAST(length(m) AS STRING), hend, m, 'GET /ready HTTP/1.1', hend)
  WHEN 2 THEN concat('GET /other HTTP/1.1', hend, 'GET /ready HTTP/1.1', hend)
  WHEN 3 THEN concat(post, ' 5000', hend, 'x')
  WHEN 4 THEN concat(post, ' 5')
  WHEN 5 THEN concat(post, ' 5x', hend, 'abcde')
  WHEN 6 THEN concat(replace(post, 'Content-L', 'content-l'), ' 4', hend, 'abcd')
  WHEN 7 THEN concat(post, ' 99', hend, 'short')
  WHEN 8 THEN concat(post, ' 4 ', hend, 'abcd')
  WHEN 9 THEN concat(post, ' 2', hend, 'é', post, ' 5', hend, 'été')
  WHEN 10 THEN concat('GET /ready HTTP/1.1', nl, 'X: ', repeat('y', 1500), hend)
  WHEN 11 THEN concat(post, repeat('0', 1100))
  WHEN 12 THEN concat(post, hend, 'GET /ready HTTP/1.1', hend)
  WHEN 13 THEN concat(post, ' 1', hend, 'a', post, ' 2', hend, 'bc', 'GET /ready HTTP/1.1', hend, post, ' 9', hend, 'tail')
  WHEN 14 THEN concat(post, ' 0002048', hend, repeat('z', 2048))
  WHEN 15 THEN concat(post, ' 99999999999999999999999', hend, 'x')
  WHEN 16 THEN concat(post, ' -1', hend, 'x')
  WHEN 17 THEN concat('POST /fraud-score', hend, 'x')
  WHEN 18 THEN concat('POST /fraud-score HTTP/1.1', hend, 'abcd')
  ELSE '' END AS raw
FROM e
"""


def fraud_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FRAUD_REQUESTS, events=read_table(spark, sf_dir, "events"))


def references(requests: DataFrame) -> DataFrame:
    """ref_id, v0..v13, label of the rows that are no queries."""
    rows = vectorised(requests.where("NOT is_query"), "request_id", "label")
    return rows.withColumnRenamed("request_id", "ref_id").withColumn("label", rows["label"].cast("tinyint"))


def query_vectors(requests: DataFrame) -> DataFrame:
    return vectorised(requests.where("is_query"), "request_id")
