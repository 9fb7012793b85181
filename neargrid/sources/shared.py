"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The folder of this application under spark.checkpoint.dir.

    Where that is unset, as in tests, a local master gets a temporary folder, which is deleted at exit. Any other
    master fails: executors would each write to their own disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="neargrid-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession) -> str:
    """A fresh path in that folder; inside `scratch` it is one of those that go at the end."""
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    for paths in getattr(_made, "scopes", []):
        paths.append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes inside are deleted at the end: what is wanted beyond must be written elsewhere by then."""
    scopes = _made.__dict__.setdefault("scopes", [])
    paths: list[str] = []
    scopes.append(paths)
    try:
        yield
    finally:
        scopes[:] = [s for s in scopes if s is not paths]
        for path in paths:
            drop(spark, path)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has left in the shared folder: for the end of a job, when its results are written."""
    if (root := spark.sparkContext.getCheckpointDir()) is not None:
        drop(spark, root)


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` once, as Parquet, and read it back: cuts lineage, fixes what a retry might number anew, keeps statistics."""
    path = shared_path(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
