"""Schemas of requests, labelled vectors and evaluation sets."""

from __future__ import annotations

from pyspark.sql import types as T

DIMS = 14
VECTOR = [f"v{i}" for i in range(DIMS)]
QUERY = [f"q{i}" for i in range(DIMS)]

_D, _S, _B = T.DoubleType(), T.StringType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: known_merchants stays raw text, for the substring predicate.
REQUEST = _struct(
    id=_S,
    transaction=_struct(amount=_D, installments=_D, requested_at=_S),
    customer=_struct(avg_amount=_D, tx_count_24h=_D, known_merchants=_S),
    merchant=_struct(id=_S, mcc=_S, avg_amount=_D),
    terminal=_struct(is_online=_B, card_present=_B, km_from_home=_D),
    last_transaction=_struct(timestamp=_S, km_from_current=_D),
)
REFERENCE = _struct(vector=T.ArrayType(T.FloatType()), label=_S)
EVALUATION = _struct(entries=T.ArrayType(_struct(request=_S, expected_approved=_B)))
