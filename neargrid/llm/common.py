"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neargrid.sources.shared import materialise, shared_root
from neargrid.sources.tables import read_table

__all__ = ["UPPER", "ascii_lower", "cut", "fields", "quoted", "read_table", "row_key", "row_schema", "stored"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder once, so that later actions neither recompute it nor depend on an executor's disk."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like `cut`, for wide rows: a compressed table in the checkpoint folder, of which readers take single columns."""
    return materialise(df, compression="zstd")


def quoted(*path: str) -> Column:
    """A column or field by its exact name, dots and backticks included."""
    return F.col(".".join(f"`{p.replace('`', '``')}`" for p in path))


def fields(names: list[str]) -> Column:
    """A struct of these columns; of a constant if there are none."""
    return F.struct(*(quoted(c).alias(c) for c in names)) if names else F.struct(F.lit(0).alias("_"))


def row_schema(row: T.DataType, rest: str) -> T.StructType:
    """`row` and the fields of a DDL text; field names of `row` may hold any character."""
    return T.StructType([T.StructField("row", row), *T.StructType.fromDDL(rest).fields])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike lower()."""
    return F.translate(text, UPPER, UPPER.lower())


def row_key(*columns: str) -> list[Column]:
    """k1, k2: 128 bits of the given columns, a key for a row that holds after a reread, unlike a running number."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *columns).alias("k2")]
