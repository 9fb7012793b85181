"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations

from neargrid.functions.features import DEFAULT_RISK, MCC_RISK
from neargrid.plans.fixtures import FRAUD_REQUESTS, HTTP_BUFFERS

D = range(14)
V = ", ".join(f"v{i}" for i in D)
_Q = lambda x: f"CAST(round(CAST({x} AS FLOAT) * CAST(10000 AS FLOAT)) AS SMALLINT)"
_C = lambda x: f"CAST(greatest(least({x}, 1.0), 0.0) AS FLOAT)"
RISK = "CASE " + " ".join(f"WHEN regexp_full_match(mcc, '[+]?[0-9]+') AND TRY_CAST(mcc AS INTEGER) = {k} THEN CAST({v} AS DOUBLE)" for k, v in MCC_RISK.items()) + f" ELSE CAST({DEFAULT_RISK} AS DOUBLE) END"
_FEATURES = (
    _C("amount / 10000.0::DOUBLE"), _C("installments / 12.0::DOUBLE"),
    "CASE WHEN customer_avg_amount = 0 THEN CASE WHEN amount > 0 THEN 1.0 ELSE 0.0 END ELSE " + _C("amount / customer_avg_amount / 10.0::DOUBLE") + " END",
    "CAST((requested_at_s % 86400) // 3600 AS DOUBLE) / 23.0::DOUBLE", "CAST((requested_at_s // 86400 + 3) % 7 AS DOUBLE) / 6.0::DOUBLE",
    "CASE WHEN last_at_s IS NULL THEN -1.0 ELSE " + _C("CAST(greatest((requested_at_s - last_at_s) // 60, 0) AS DOUBLE) / 1440.0::DOUBLE") + " END",
    "CASE WHEN km_from_current IS NULL THEN -1.0 ELSE " + _C("km_from_current / 1000.0::DOUBLE") + " END",
    _C("km_from_home / 1000.0::DOUBLE"), _C("tx_count_24h / 20.0::DOUBLE"), "CAST(is_online AS INTEGER)", "CAST(card_present AS INTEGER)",
    "CAST(NOT contains(known_merchants_raw, merchant_id) AS INTEGER)", RISK, _C("merchant_avg_amount / 10000.0::DOUBLE"),
)


def _byte(v: str, optional: bool) -> str:
    if optional:
        return f"((greatest(least({v}::INTEGER + 10000, 20000), 0) * 255 + 10000) // 20000)"
    return f"((greatest(least({v}::INTEGER, 10000), 0) * 255 + 5000) // 10000)"


def _key(v: str = "v") -> str:
    words = []
    for bit in range(7, -1, -1):
        words.append("printf('%04X', " + " + ".join(f"((({_byte(f'{v}{d}', d in (5, 6))}) >> {bit}) & 1) * {1 << (15 - d)}" for d in D) + ")")
    return " || ".join(words)


L1 = " + ".join(f"abs(q.v{i}::INTEGER - r.v{i}::INTEGER)" for i in D)
L2 = " + ".join(f"(q.v{i}::BIGINT - r.v{i}) * (q.v{i}::BIGINT - r.v{i})" for i in D)
FIXTURE = f"f AS ({FRAUD_REQUESTS.format(events='events')})"
VECTORS = f"WITH {FIXTURE}, x AS (SELECT request_id, label, is_query, {', '.join(f'{_Q(e)} AS v{i}' for i, e in enumerate(_FEATURES))} FROM f)"
KEYED = f"{VECTORS}, k AS (SELECT *, {_key()} AS key FROM x), r AS (SELECT *, request_id AS ref_id, row_number() OVER (ORDER BY key, request_id) - 1 AS pos FROM k WHERE NOT is_query), q0 AS (SELECT * FROM k WHERE is_query)"
BOUNDED = f"{KEYED}, q AS (SELECT q0.*, (SELECT count(*) FROM r WHERE r.key < q0.key) AS lb FROM q0)"
TOP = f"""{BOUNDED}, t AS (SELECT * FROM (SELECT q.request_id, r.ref_id, r.pos, {L1} AS d, r.label, row_number() OVER (PARTITION BY q.request_id ORDER BY {L1}, r.pos) AS rank
  FROM q JOIN r ON r.pos BETWEEN q.lb - 512 AND q.lb + 512) WHERE rank <= 11)"""
VOTE = f"""{TOP}, w AS (SELECT q.request_id, n, frauds, reach, CASE WHEN n = 11 AND reach <= 5000 AND frauds = 0 THEN 0.0::DOUBLE WHEN n = 11 AND reach <= 5000 AND frauds = 11 THEN 1.0::DOUBLE END AS fast
  FROM q LEFT JOIN (SELECT request_id, count(*) AS n, CAST(sum(label) AS INTEGER) AS frauds, max(d) AS reach FROM t GROUP BY request_id) USING (request_id))"""
_EXACT = f"""e AS (SELECT * FROM (SELECT q.request_id, r.ref_id, {L2} AS d, r.label, row_number() OVER (PARTITION BY q.request_id ORDER BY {L2}, r.ref_id) AS rank FROM {{q}} q, r) WHERE rank <= 5)"""
EXACT = f"{BOUNDED}, {_EXACT.format(q='q')}"
CASCADE = f"""{VOTE}, u AS (SELECT q.* FROM q JOIN w USING (request_id) WHERE fast IS NULL), {_EXACT.format(q='u')},
  s AS (SELECT u.request_id, CAST(coalesce(sum(e.label), 0) AS INTEGER) AS frauds FROM u LEFT JOIN e USING (request_id) GROUP BY u.request_id),
  c AS (SELECT request_id, NULL::INTEGER AS frauds, fast AS fraud_score, fast = 0 AS approved, 'Morton' AS source FROM w WHERE fast IS NOT NULL
        UNION ALL SELECT request_id, frauds, frauds / 5.0::DOUBLE, frauds < 3, 'KdTree' FROM s)"""
RESULTS = f"{CASCADE}, o AS (SELECT c.*, f.label = 0 AS expected_approved, c.request_id % 500 <> 40 AS http_ok, (c.request_id % 97) / 10.0::DOUBLE AS latency_ms FROM c JOIN f USING (request_id))"
RANGES = "[" + ", ".join(f"max(v{i}) - min(v{i})" for i in D) + "]"
ROOT = f"{KEYED}, b AS (SELECT count(*) AS n, {', '.join(f'min(v{i}) AS min{i}, max(v{i}) AS max{i}' for i in D)}, list_position({RANGES}, list_max({RANGES})) - 1 AS dim FROM r)"
SCORES = """, m AS (SELECT count(*) FILTER (http_ok AND approved AND expected_approved) AS tn, count(*) FILTER (http_ok AND NOT approved AND NOT expected_approved) AS tp,
  count(*) FILTER (http_ok AND approved AND NOT expected_approved) AS fn, count(*) FILTER (http_ok AND NOT approved AND expected_approved) AS fp, count(*) FILTER (NOT http_ok) AS err, quantile_cont(latency_ms, 0.99) AS p99 FROM o),
  g AS (SELECT *, tn + tp + fn + fp + err AS n, fp + 3 * fn + 5 * err AS weighted, fp + fn + err AS failures FROM m),
  h AS (SELECT *, weighted / n::DOUBLE AS epsilon, failures / n::DOUBLE AS failure_rate FROM g),
  l AS (SELECT *, CASE WHEN p99 <= 0 THEN 0.0 WHEN p99 > 2000 THEN -3000.0 ELSE 1000 * log10(1000 / greatest(p99, 1.0)) END AS a,
        CASE WHEN failure_rate > 0.15 THEN -3000.0 ELSE 1000 * log10(1 / greatest(epsilon, 0.001)) - 300 * log10(1.0 + weighted) END AS b FROM h)"""
_BROKEN = "request_id % 50 IN (7, 13, 21, 33, 45)"
_REASON = "CASE request_id % 50 WHEN 7 THEN 'json' WHEN 13 THEN 'json' WHEN 21 THEN 'fields' WHEN 33 THEN 'json' ELSE 'date' END"
_SIZES = f"{KEYED}, sizes AS (WITH RECURSIVE z(n) AS (SELECT count(*) FROM r UNION ALL SELECT unnest([n // 2, n - n // 2]) FROM z WHERE n > 64) SELECT n FROM z WHERE n <= 64)"
#: One request after the other is taken off the hexadecimal digits of a buffer's bytes. The answers come from the bytes alone.
HTTP = f"""
    WITH RECURSIVE b AS ({HTTP_BUFFERS.format(events='events')}
    ), s(request_id, seq, rest, route, content_length, body) AS (
      SELECT request_id, -1, hex(raw), 'score', NULL::BIGINT, NULL::VARCHAR FROM b
      UNION ALL
      SELECT request_id, seq + 1, CASE route WHEN 'score' THEN substr(after, CAST(2 * n + 1 AS BIGINT)) ELSE after END, route, CASE WHEN post AND n IS NOT NULL AND n < 9223372036854775807 THEN CAST(n AS BIGINT) END,
        CASE route WHEN 'score' THEN decode(unhex(substr(after, 1, CAST(2 * n AS BIGINT)))) END
      FROM (SELECT *, CASE WHEN NOT ended THEN CASE WHEN length(rest) >= 2048 THEN 'bad' ELSE 'incomplete' END WHEN starts_with(header, 'GET /ready ') THEN 'ready' WHEN NOT post THEN 'unknown'
          WHEN n IS NULL OR n > 2048 THEN 'bad' WHEN length(after) < 2 * n THEN 'incomplete' ELSE 'score' END AS route
        FROM (SELECT *, ended AND starts_with(header, 'POST /fraud-score ') AS post,
            CASE WHEN ended AND contains(header, chr(13) || chr(10) || 'Content-Length:') AND regexp_full_match(line, '[0-9]*') THEN CAST('0' || line AS HUGEINT) END AS n
          FROM (SELECT *, regexp_replace(split_part(split_part(header || chr(13) || chr(10), chr(13) || chr(10) || 'Content-Length:', 2), chr(13) || chr(10), 1), '^[ \\t]+', '') AS line
            FROM (SELECT request_id, seq, rest, ended, substr(rest, length(head) + 9) AS after, decode(unhex(head)) AS header
              FROM (SELECT *, regexp_matches(rest, '^(?:..)*?0D0A0D0A') AS ended, regexp_extract(rest, '^((?:..)*?)0D0A0D0A', 1) AS head FROM s WHERE route IN ('ready', 'score') AND (rest <> '' OR seq = -1))))))
    )
    SELECT request_id, CAST(seq AS INTEGER) AS seq, route, content_length, body FROM s WHERE seq >= 0"""

ORACLE_SQL = {
    "q_fraud_score": f"{CASCADE} SELECT * FROM c",
    "q_vectorize": f"{VECTORS} SELECT request_id, {V}, 0::SMALLINT AS v14, 0::SMALLINT AS v15 FROM x",
    "q_parse_requests": f"""WITH {FIXTURE} SELECT request_id, 'tx-' || request_id AS id, amount, installments, requested_at_s, customer_avg_amount, tx_count_24h, merchant_id, known_merchants_raw, mcc, merchant_avg_amount,
      is_online, card_present, km_from_home, last_at_s, km_from_current FROM f WHERE NOT {_BROKEN}""",
    "q_rejects": f"WITH {FIXTURE} SELECT request_id, {_REASON} AS reason FROM f WHERE {_BROKEN}",
    "q_last_tx_features": """WITH w AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS p,
      count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS tx_count_24h FROM events)
      SELECT event_id, CASE WHEN p IS NULL THEN -1 ELSE greatest((s - p) // 60, 0) END::BIGINT AS minutes_since_last, tx_count_24h FROM w""",
    "q_mcc_risk": f"WITH {FIXTURE} SELECT request_id, mcc, {RISK} AS risk FROM f",
    "q_known_merchant_substring": f"WITH {FIXTURE} SELECT request_id, contains(known_merchants_raw, merchant_id) AS known, contains(known_merchants_raw, left(merchant_id, 6)) AS known_prefix FROM f",
    "q_known_merchant_strict": f"WITH {FIXTURE} SELECT request_id, list_contains(from_json(known_merchants_raw, '[\"VARCHAR\"]'), merchant_id) AS known, list_contains(from_json(known_merchants_raw, '[\"VARCHAR\"]'), left(merchant_id, 6)) AS known_prefix FROM f",
    "q_quantize_refs": "SELECT vec_id, " + ", ".join(f"{_Q(f'embedding[{i + 1}]')} AS v{i}" for i in D) + ", 0::SMALLINT AS v14, 0::SMALLINT AS v15 FROM embeddings",
    "q_morton_key": f"{KEYED} SELECT request_id, key FROM k",
    "q_morton_rank": f"{KEYED} SELECT ref_id, key, pos FROM r",
    "q_morton_lower_bound": f"{BOUNDED} SELECT request_id, lb FROM q",
    "q_morton_window_frame": f"{BOUNDED} SELECT q.request_id, count(*) AS n, min(r.pos) AS first_pos, max(r.pos) AS last_pos, CAST(sum(r.label) AS BIGINT) AS frauds FROM q JOIN r ON r.pos BETWEEN q.lb - 512 AND q.lb + 512 GROUP BY q.request_id",
    "q_morton_top11": f"{TOP} SELECT request_id, CAST(rank AS INTEGER) AS rank, ref_id, d, label FROM t",
    "q_morton_vote": f"{VOTE} SELECT request_id, n, frauds, reach, fast AS fast_score FROM w",
    "q_knn5_exact": f"{EXACT} SELECT request_id, CAST(rank AS INTEGER) AS rank, ref_id, d, label FROM e",
    "q_knn5_score": f"{EXACT} SELECT q.request_id, CAST(coalesce(sum(e.label), 0) AS INTEGER) AS frauds, coalesce(sum(e.label), 0) / 5.0::DOUBLE AS fraud_score FROM q LEFT JOIN e USING (request_id) GROUP BY q.request_id",
    "q_knn5_pruned": f"{EXACT} SELECT request_id, CAST(rank AS INTEGER) AS rank, ref_id, d, label FROM e",
    "q_kd_bounds": f"{ROOT} SELECT n, {', '.join(f'min{i}, max{i}' for i in D)} FROM b",
    "q_kd_widest": f"{ROOT} SELECT CAST(dim AS INTEGER) AS dim FROM b",
    "q_kd_split": f"{ROOT} SELECT ref_id, CASE WHEN row_number() OVER (ORDER BY [{V}][dim + 1], ref_id) <= n // 2 THEN 1 ELSE 2 END::BIGINT AS node FROM r, b",
    "q_kd_leaf_sizes": f"{_SIZES} SELECT n, count(*) AS leaves FROM sizes GROUP BY n",
    "q_residual_queries": f"{VOTE} SELECT request_id FROM w WHERE fast IS NULL",
    "q_response_json": f"{CASCADE} SELECT request_id, '{{\"approved\":' || approved || ',\"fraud_score\":' || printf('%.1f', fraud_score) || '}}' AS body FROM c",
    "q_diagnose": f"{RESULTS} SELECT source, count(*) AS cases, CAST(sum(CAST(approved <> expected_approved AS INTEGER)) AS BIGINT) AS mismatches FROM o GROUP BY source",
    "q_confusion": f"{RESULTS}{SCORES} SELECT tn, tp, fn, fp, err FROM m",
    "q_scorecard": f"{RESULTS}{SCORES} SELECT n, weighted, failures, round(epsilon, 6) AS epsilon, round(failure_rate, 6) AS failure_rate, round(p99, 6) AS p99, round(a, 6) AS latency_score, round(b, 6) AS detection_score, round(a + b, 6) AS final_score FROM l",
    "q_class_balance": f"""WITH {FIXTURE} SELECT count(*) AS total, CAST(sum(label) AS BIGINT) AS fraud_count, CAST(count(*) - sum(label) AS BIGINT) AS legit_count, round(sum(label) / count(*)::DOUBLE, 6) AS fraud_rate,
      round((count(*) - sum(label)) / count(*)::DOUBLE, 6) AS legit_rate FROM f WHERE NOT is_query""",
    "q_index_counts": f"{KEYED} SELECT count(*) AS records, CAST((count(*) + 63) // 64 AS BIGINT) AS blocks, CAST(sum(label) AS BIGINT) AS frauds FROM r",
    "q_http_parse": HTTP,
    "q_stream_score": f"""{CASCADE} SELECT 'tx-' || request_id AS id, frauds, fraud_score, approved, source, NULL::VARCHAR AS reason FROM c
      UNION ALL SELECT 'tx-' || request_id, NULL, NULL, NULL, NULL, {_REASON} FROM f WHERE {_BROKEN}""",
    "q_diagnose_report": f"""{RESULTS} SELECT count(*) AS entries, count(*) FILTER (source = 'Morton') AS morton_cases, count(*) FILTER (source = 'KdTree') AS kdtree_cases,
      count(*) FILTER (source = 'Morton' AND approved <> expected_approved) AS morton_mismatches, count(*) FILTER (source = 'KdTree' AND approved <> expected_approved) AS kdtree_mismatches FROM o""",
    "q_index_checksum": f"{KEYED} SELECT count(*) AS records, {', '.join(f'CAST(bit_xor(v{i}) AS INTEGER) AS v{i}' for i in D)} FROM r",
    "q_index_job": f"""{_SIZES} SELECT (SELECT count(*) FROM r) AS entries, (SELECT CAST(sum(label) AS BIGINT) FROM r) AS frauds, (SELECT CAST(sum(pos * ref_id) AS BIGINT) FROM r) AS places,
      (SELECT count(*) FROM sizes) AS leaves, (SELECT count(*) FROM r) AS kd_records, (SELECT CAST(sum(ref_id) AS BIGINT) FROM r) AS kd_refs""",
}
