"""Morton (Z-order) keys: 16 bytes' bits interleaved, as 32 hex digits whose order is that of the 128-bit numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neargrid.sources.schemas import DIMS

#: Dimensions that may be missing (-10000).
OPTIONAL = (5, 6)
LANES = 16


def byte(column: str, optional: bool) -> str:
    """SQL text: texts cost one call to the JVM, where a tree of columns costs one a node."""
    if optional:
        return f"cast((greatest(least(cast({column} AS int) + 10000, 20000), 0) * 255 + 10000) div 20000 AS int)"
    return f"cast((greatest(least(cast({column} AS int), 10000), 0) * 255 + 5000) div 10000 AS int)"


def with_key(df: DataFrame, columns: list[str], name: str = "key") -> DataFrame:
    """Most significant bit first, dimension 0 first; the two padding lanes are 0.

    Half a byte's four bits lie LANES apart in half a key, which is a long: a table of 16 longs spreads them, and a
    shift puts them in the dimension's lane. The bytes are a projection of their own, as each is read twice.
    """
    assert len(columns) == DIMS
    kept = df.columns
    df = df.selectExpr("*", *(f"{byte(c, d in OPTIONAL)} AS _byte{d}" for d, c in enumerate(columns)))
    table = ", ".join(f"{sum((n >> i & 1) << (LANES * i) for i in range(4))}L" for n in range(16))

    def half(shift: int) -> str:
        lanes = " | ".join(f"shiftleft(get(array({table}), shiftright(_byte{d}, {shift}) & 15), {LANES - 1 - d})" for d in range(DIMS))
        return f"lpad(hex({lanes}), 16, '0')"

    return df.select(*kept, F.expr(f"concat({half(4)}, {half(0)})").alias(name))


def l1(a: list[str], b: list[str]) -> Column:
    """Unrolled, so that whole-stage code has no arrays."""
    return F.expr(" + ".join(f"abs(cast({x} AS int) - cast({y} AS int))" for x, y in zip(a, b, strict=True)))


def l2(a: list[str], b: list[str]) -> Column:
    """Squared. power() reads a difference once, which halves the code; sums stay far below 2^53, so they are exact."""
    return F.expr("cast(" + " + ".join(f"power(cast({x} AS int) - {y}, 2)" for x, y in zip(a, b, strict=True)) + " AS bigint)")
