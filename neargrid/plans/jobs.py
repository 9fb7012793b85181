"""The offline job: references to both indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from neargrid.operators import kdtree, search
from neargrid.sources.indexes import write_index, write_kd


def build_indexes(refs: DataFrame, path: str) -> tuple[int, int]:
    """refs (ref_id, v0..v13, label) -> path/morton and path/kd; the numbers of entries and of leaves written."""
    index = search.build_index(refs)
    write_index(index, f"{path}/morton")
    rows, leaves = kdtree.build(refs)
    return index.n, write_kd(rows, leaves, f"{path}/kd")
