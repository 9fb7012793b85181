"""Both indexes on storage: written whole with a description, which readers check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neargrid.operators.search import Index
from neargrid.sources.schemas import VECTOR

VERSION = 1
#: Where the indexes are unless a path is given.
MORTON_PATH, KD_PATH = "resources/morton", "resources/kd"
_ROWS = {"ref_id": "bigint", **dict.fromkeys(VECTOR, "smallint"), "label": "tinyint"}
_COLUMNS = {
    "morton": _ROWS | {"key": "string", "pos": "bigint"},
    "kd": _ROWS | {"node": "bigint"},
}


class InvalidIndex(ValueError):
    """What is at the path is no index of this kind, version or length."""


def _describe(spark: SparkSession, path: str, kind: str, **numbers: int) -> None:
    """Last of all, so that an index half written has no description."""
    row = {"kind": kind, "version": VERSION, **numbers}
    spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items())).coalesce(1).write.mode("overwrite").json(f"{path}/about")


def _described(spark: SparkSession, path: str, kind: str) -> dict:
    """The description; the rows must have the columns and be as many as it says."""
    try:
        about = spark.read.json(f"{path}/about").first().asDict()
    except Exception as e:
        raise InvalidIndex(f"no index at {path}") from e
    if about.get("kind") != kind or about.get("version") != VERSION:
        raise InvalidIndex(f"{path} holds {about.get('kind')} of version {about.get('version')}, not {kind} of {VERSION}")
    rows = spark.read.parquet(f"{path}/rows")
    have = {f.name: f.dataType.simpleString() for f in rows.schema}
    if have != _COLUMNS[kind]:
        raise InvalidIndex(f"{path} has other columns: {have}")
    if (n := rows.count()) != about["records"]:  # of Parquet's footers
        raise InvalidIndex(f"{path} has {n} rows, not {about['records']}")
    return about


def write_index(index: Index, path: str = MORTON_PATH) -> None:
    """Range-partitioned and sorted by key, so that Parquet's statistics prune key ranges; with the trees over it."""
    index.rows.select(*_COLUMNS["morton"]).repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(f"{path}/rows")
    for name, levels in (("keys", index.keys), ("boxes", index.boxes)):
        for i, level in enumerate(levels):
            level.write.mode("overwrite").parquet(f"{path}/{name}/{i}")
    _describe(index.rows.sparkSession, path, "morton", records=index.n, keys=len(index.keys), boxes=len(index.boxes))


def read_index(spark: SparkSession, path: str = MORTON_PATH) -> Index:
    about = _described(spark, path, "morton")
    levels = {name: [spark.read.parquet(f"{path}/{name}/{i}") for i in range(about[name])] for name in ("keys", "boxes")}
    return Index(spark.read.parquet(f"{path}/rows"), about["records"], levels["keys"], levels["boxes"])


def write_kd(rows: DataFrame, leaves: DataFrame, path: str = KD_PATH) -> int:
    """Rows sorted by leaf, and the leaves' boxes; the number of leaves."""
    rows.select(*_COLUMNS["kd"]).repartitionByRange("node").sortWithinPartitions("node", "ref_id").write.mode("overwrite").parquet(f"{path}/rows")
    leaves.write.mode("overwrite").parquet(f"{path}/leaves")
    n, records = leaves.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    _describe(rows.sparkSession, path, "kd", records=records, leaves=n)
    return n


def read_kd(spark: SparkSession, path: str = KD_PATH) -> tuple[DataFrame, DataFrame]:
    """Rows with `node`, and the leaves' boxes (node, n, min*, max*)."""
    about = _described(spark, path, "kd")
    leaves = spark.read.parquet(f"{path}/leaves")
    if leaves.count() != about["leaves"]:
        raise InvalidIndex(f"{path} has {leaves.count()} leaves, not {about['leaves']}")
    return spark.read.parquet(f"{path}/rows"), leaves
