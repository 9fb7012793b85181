"""Feature expressions: a transaction's 14 numbers between -1 and 1, quantised to ten-thousandths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neargrid.sources.schemas import DIMS, VECTOR

# The feature space's scales and merchant-category risks.
MAX_AMOUNT = 10000.0
MAX_INSTALLMENTS = 12.0
AMOUNT_VS_AVG_RATIO = 10.0
MAX_MINUTES = 1440.0
MAX_KM = 1000.0
MAX_TX_COUNT_24H = 20.0
MAX_MERCHANT_AVG_AMOUNT = 10000.0
MCC_RISK = {4511: 0.35, 5311: 0.25, 5411: 0.15, 5812: 0.30, 5912: 0.20, 5944: 0.45, 5999: 0.50, 7801: 0.80, 7802: 0.75, 7995: 0.85}
DEFAULT_RISK = 0.5

QUANTUM = 10000


def clamped(x: Column) -> Column:
    """To [0, 1] in single precision; NaN is 0, as it would be once quantised."""
    return F.greatest(F.least(F.nanvl(x, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).cast("float")


def quantised(x: Column) -> Column:
    """Half away from zero, in single precision; out of range saturates, NaN is 0.

    Half is added to the single-precision product in double, which is exact, and the cast cuts: no decimal rounding.
    """
    scaled = F.nanvl((x.cast("float") * F.lit(QUANTUM).cast("float")).cast("double"), F.lit(0.0))
    bounded = F.greatest(F.least(scaled, F.lit(32767.0)), F.lit(-32768.0))
    return (bounded + F.signum(bounded) * 0.5).cast("int").cast("smallint")


def quantised_columns(vector: str) -> list[Column]:
    return [quantised(F.get(vector, F.lit(i))).alias(v) for i, v in enumerate(VECTOR)]


def amount_ratio(amount: Column, average: Column) -> Column:
    """Division by zero as IEEE has it: a positive amount is the maximum, none is 0."""
    return F.when(average == 0, F.when(amount > 0, 1.0).otherwise(0.0)).otherwise(amount / F.when(average != 0, average) / AMOUNT_VS_AVG_RATIO)


def mcc_risk(mcc: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MCC_RISK.items() for x in kv))
    return F.coalesce(F.when(mcc.rlike(r"^[+]?[0-9]+$"), F.element_at(table, mcc.try_cast("int"))), F.lit(DEFAULT_RISK))


def merchant_known(raw: Column, merchant: Column) -> Column:
    """Substring of the list's text: also true for an id that begins a longer one."""
    return raw.contains(merchant)


def merchant_listed(raw: Column, merchant: Column) -> Column:
    return F.array_contains(F.from_json(raw, "array<string>"), merchant)


def minutes_since(now_s: Column, then_s: Column) -> Column:
    """Whole minutes, never negative."""
    return F.greatest(F.floor((now_s - then_s) / 60), F.lit(0)).cast("double")


def history(events: DataFrame, by: str, seconds: str, id_: str) -> DataFrame:
    """events with minutes_since_last (whole minutes since the one before of the same `by`; -1: none) and tx_count_24h (those of the last 24 hours, itself included)."""
    w = Window.partitionBy(by)
    before = F.lag(seconds).over(w.orderBy(seconds, id_))
    minutes = F.when(before.isNull(), -1).otherwise(F.greatest(F.floor((F.col(seconds) - before) / 60), F.lit(0)))
    return events.select("*", minutes.cast("bigint").alias("minutes_since_last"), F.count(F.lit(1)).over(w.orderBy(seconds).rangeBetween(-86400, 0)).alias("tx_count_24h"))


def vectorised(requests: DataFrame, *keep: str) -> DataFrame:
    """Flat requests -> `keep`, v0..v13: one projection of built-in expressions."""
    c = F.col
    hour = F.floor(F.pmod(c("requested_at_s"), F.lit(86400)) / 3600)
    weekday = F.pmod(F.floor(c("requested_at_s") / 86400) + 3, F.lit(7))
    features = (
        clamped(c("amount") / MAX_AMOUNT),
        clamped(c("installments") / MAX_INSTALLMENTS),
        clamped(amount_ratio(c("amount"), c("customer_avg_amount"))),
        hour / F.lit(23.0),
        weekday / F.lit(6.0),
        F.when(c("last_at_s").isNull(), -1.0).otherwise(clamped(minutes_since(c("requested_at_s"), c("last_at_s")) / MAX_MINUTES)),
        F.when(c("km_from_current").isNull(), -1.0).otherwise(clamped(c("km_from_current") / MAX_KM)),
        clamped(c("km_from_home") / MAX_KM),
        clamped(c("tx_count_24h") / MAX_TX_COUNT_24H),
        c("is_online").cast("int"),
        c("card_present").cast("int"),
        (~merchant_known(c("known_merchants_raw"), c("merchant_id"))).cast("int"),
        mcc_risk(c("mcc")),
        clamped(c("merchant_avg_amount") / MAX_MERCHANT_AVG_AMOUNT),
    )
    assert len(features) == DIMS
    return requests.select(*keep, *(quantised(x).alias(v) for x, v in zip(features, VECTOR, strict=True)))
