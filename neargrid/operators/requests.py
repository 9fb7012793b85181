"""Requests: JSON bodies to typed rows, rejects, HTTP framing, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neargrid.sources.schemas import REQUEST

MAX_BODY = 2048
MAX_HEADER = 1024
LENGTH = "\r\nContent-Length:"


def timestamp(text: Column) -> Column:
    """Seconds since 1970 of the first 19 characters; zone and fraction are ignored. Null if they are no date."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def parse_requests(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Rows with a JSON body -> (valid rows with flat request columns, rejects with `reason`); other columns stay.

    Keys go by name. Rejected are null and oversize bodies, broken JSON and text after it, wrong types, missing or
    null fields (last_transaction alone may be null, but its key must be there), and dates that are none.
    """
    schema = T.StructType([*REQUEST.fields, T.StructField("_corrupt", T.StringType())])
    b = F.col(body)
    outside = F.regexp_replace(b, r'"(?:[^"\\]|\\.)*+"', "")
    closed = F.trim(b).endswith("}") & (F.length(F.regexp_replace(outside, r"[^{]", "")) == F.length(F.regexp_replace(outside, r"[^}]", ""))) & ~outside.rlike(r"^[^{]*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*+\}\s*\S")
    r = F.from_json(b, schema, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    d = df.withColumn("_r", F.explode(F.array(r)))  # a generator: else the filters below would each parse the text anew, field by field
    req = lambda path: F.col(f"_r.{path}")
    last = req("last_transaction")
    needed = [f"transaction.{x}" for x in ("amount", "installments", "requested_at")] + [f"customer.{x}" for x in ("avg_amount", "tx_count_24h", "known_merchants")]
    needed += [f"merchant.{x}" for x in ("id", "mcc", "avg_amount")] + [f"terminal.{x}" for x in ("is_online", "card_present", "km_from_home")] + ["id"]
    missing = F.lit(False)
    for path in needed:
        missing = missing | req(path).isNull()
    missing = missing | (last.isNotNull() & (req("last_transaction.timestamp").isNull() | req("last_transaction.km_from_current").isNull()))
    missing = missing | ~F.coalesce(F.array_contains(F.json_object_keys(b), "last_transaction"), F.lit(False))
    now, then = timestamp(req("transaction.requested_at")), timestamp(req("last_transaction.timestamp"))
    reason = (
        F.when(b.isNull() | (F.octet_length(b) > MAX_BODY), "size")
        .when(req("_corrupt").isNotNull() | ~F.coalesce(closed, F.lit(False)), "json")
        .when(missing, "fields")
        .when(now.isNull() | (last.isNotNull() & then.isNull()), "date")
    )
    d = d.withColumn("reason", reason)
    keep = [c for c in df.columns if c != body]
    valid = d.where("reason IS NULL").select(
        *keep, req("id").alias("id"), req("transaction.amount").alias("amount"), req("transaction.installments").alias("installments"), now.alias("requested_at_s"),
        req("customer.avg_amount").alias("customer_avg_amount"), req("customer.tx_count_24h").alias("tx_count_24h"), req("merchant.id").alias("merchant_id"),
        req("customer.known_merchants").alias("known_merchants_raw"), req("merchant.mcc").alias("mcc"), req("merchant.avg_amount").alias("merchant_avg_amount"),
        req("terminal.is_online").alias("is_online"), req("terminal.card_present").alias("card_present"), req("terminal.km_from_home").alias("km_from_home"),
        then.alias("last_at_s"), req("last_transaction.km_from_current").alias("km_from_current"),
    )
    return valid, d.where("reason IS NOT NULL").select(*keep, body, "reason")


def request_json(flat: DataFrame, *keep: str) -> DataFrame:
    """Flat requests (request_id, ...) -> keep, body."""
    iso = lambda s: F.date_format(F.timestamp_seconds(F.col(s)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    last = F.when(F.col("last_at_s").isNotNull(), F.to_json(F.struct(iso("last_at_s").alias("timestamp"), F.col("km_from_current"))))
    part = lambda **c: F.to_json(F.struct(*(F.col(v).alias(k) for k, v in c.items())))
    transaction = F.to_json(F.struct("amount", "installments", iso("requested_at_s").alias("requested_at")))
    customer = F.concat(F.lit('{"avg_amount":'), F.col("customer_avg_amount").cast("string"), F.lit(',"tx_count_24h":'), F.col("tx_count_24h").cast("string"), F.lit(',"known_merchants":'), F.col("known_merchants_raw"), F.lit("}"))
    pieces = [
        ("transaction", transaction), ("customer", customer), ("merchant", part(id="merchant_id", mcc="mcc", avg_amount="merchant_avg_amount")),
        ("terminal", part(is_online="is_online", card_present="card_present", km_from_home="km_from_home")), ("last_transaction", F.coalesce(last, F.lit("null"))),
    ]
    body = F.concat(F.lit('{"id":"tx-'), F.col("request_id").cast("string"), F.lit('"'), *(x for n, p in pieces for x in (F.lit(f',"{n}":'), p)), F.lit("}"))
    return flat.select(*keep, body.alias("body"))


def _first_request(rest: Column) -> Column:
    """The first request of a buffer of bytes (a string of one character each): struct (route, content_length, body, used)."""
    end = F.instr(rest, "\r\n\r\n")
    header = F.substring(rest, F.lit(1), end - 1)
    ready, score = header.startswith("GET /ready "), header.startswith("POST /fraud-score ")
    named = F.instr(header, LENGTH)
    line = F.substring_index(F.substring(header, named + len(LENGTH), F.length(header)), "\r\n", 1)
    digits = F.regexp_replace(line, "^[ \t]+", "")
    length = F.when(digits.rlike("^[0-9]*$"), F.coalesce(F.concat(F.lit("0"), digits).try_cast("bigint"), F.lit(-1).cast("bigint")))
    valid = (named > 0) & F.coalesce(length.between(0, MAX_BODY), F.lit(False))
    whole = F.length(rest) >= end + 3 + length
    route = (
        F.when(end == 0, F.when(F.length(rest) >= MAX_HEADER, "bad").otherwise("incomplete"))
        .when(ready, "ready").when(~score, "unknown").when(~valid, "bad").when(~whole, "incomplete").otherwise("score")
    )
    given = F.when((end > 0) & score & (named > 0) & (length >= 0), length)
    body = F.when(route == "score", F.encode(F.substring(rest, (end + 4).cast("int"), length.cast("int")), "ISO-8859-1").cast("string"))
    used = end + 3 + F.when(route == "score", length).otherwise(F.lit(0).cast("bigint"))
    return F.struct(route.alias("route"), given.alias("content_length"), body.alias("body"), used.cast("int").alias("used"))


def parse_http(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Buffers of HTTP/1.1 requests (text or bytes) -> a row a request: seq, route, content_length, body; other columns stay.

    A buffer's requests follow each other; ready and score go on with the next one, unknown and bad end the connection.
    A header is unfinished until an empty line: `incomplete`, or `bad` from MAX_HEADER bytes on; a finished one may be
    longer. A scoring request needs Content-Length, so spelt: blanks before the digits are skipped, no others, and no
    digits are 0. None, another value or one over MAX_BODY is `bad`; a body that has not all come is `incomplete`.
    Lengths count bytes. What is left after the last whole request is a row; an empty buffer is `incomplete`.
    """
    none = F.array().cast("array<struct<route:string,content_length:bigint,body:string,used:int>>")
    text = F.decode(F.col(raw).cast("binary"), "ISO-8859-1")
    state = F.struct(text.alias("rest"), none.alias("found"))
    turns = F.sequence(F.lit(0), F.size(F.split(text, "\r\n\r\n")) - 1)  # each request but the last has an end of its own

    def step(a: Column, _: Column) -> Column:
        last = F.try_element_at(a["found"], F.lit(-1))
        on = F.coalesce(last["route"].isin("ready", "score"), F.lit(True)) & ((F.length(a["rest"]) > 0) | (F.size(a["found"]) == 0))
        more = F.transform(F.array(_first_request(a["rest"])), lambda p: F.struct(F.substring(a["rest"], p["used"] + 1, F.length(a["rest"])).alias("rest"), F.concat(a["found"], F.array(p)).alias("found")))
        return F.when(on, F.get(more, 0)).otherwise(a)

    d = df.withColumn("_found", F.aggregate(turns, state, step)["found"])
    kept = [c for c in df.columns if c != raw]
    return d.select(*kept, F.posexplode("_found").alias("seq", "_p")).select(*kept, "seq", "_p.route", "_p.content_length", "_p.body")


def response_json(decisions: DataFrame, *keep: str) -> DataFrame:
    return decisions.select(*keep, F.to_json(F.struct("approved", "fraud_score")).alias("body"))
