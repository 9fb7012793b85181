import math

import duckdb
import numpy as np
import pytest

from neargrid.llm import queries, vectors


def brute(rows):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        return a / np.sqrt((a * a).sum())

    u = [unit(v) for _, v, _ in rows]
    n, comp = len(rows), list(range(len(rows)))
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if rows[i][2] is not None and rows[i][2] == rows[j][2] and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {c: min(rows[i][0] for i in range(n) if comp[i] == c) for c in set(comp)}
    return sorted((rows[i][0], links[i], least[comp[i]], rows[i][0] == least[comp[i]]) for i in range(n))


@pytest.mark.parametrize("cell, centres", [(1024, 1024), (8, 1024), (3, 4), (8, 1)])
def test_against_brute_force(spark, monkeypatch, cell, centres):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "CENTRES", centres)
    rnd = np.random.default_rng(1)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = []
    for k in range(40):
        c = rnd.normal(size=10)
        rows += [(len(rows) + i, f(c + rnd.normal(size=10) * s), k % 3) for i, s in enumerate([0, 0, 0.1, 0.15, 0.2])]
    v = rows[0][1]
    rows += [(900, v, None), (901, None, 0), (902, [], 0), (903, [0.0] * 10, 0), (904, [*v[:9], None], 0), (905, [*v[:9], float("nan")], 0), (906, [*v[:9], float("inf")], 0), (907, v[:9], 0), (908, [2 * x for x in v], 0), (909, v, 0), (909, v, 0), (910, [1e30 * x for x in v], 0)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    assert sorted(map(tuple, vectors.near_duplicates(frame).collect())) == brute(rows)
    c = duckdb.connect()
    c.register("embeddings", frame.toArrow())
    assert sorted(c.execute(vectors.ORACLE).fetchall()) == brute(rows)


def test_driver_table_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, queries.op5_pq(spark, "/root/testdata/sf0.01").collect())) == brute(rows)  # recall 1


def test_recall_where_not_every_list_is_probed(spark, monkeypatch):
    """Long vectors in many short lists on two levels: at least 0.99 of the links, and none that is none."""
    monkeypatch.setattr(vectors, "CELL", 16)
    monkeypatch.setattr(vectors, "CENTRES", 12)
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(500, 64))
    x = np.concatenate([base, *(base + rnd.normal(size=base.shape) * s for s in (0.05, 0.12, 0.17))]).astype(np.float32)
    assert vectors.reach(0.2, 64) < 0.11
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(axis=1) - 1
    assert all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.99 * want.sum() > 1000


def test_one_class(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in (5, 3, 9)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vectors.near_duplicates(frame).collect())) == [(3, 2, 3, True), (5, 2, 3, False), (9, 2, 3, False)]


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    assert [tuple(r) for r in vectors.near_duplicates(spark.createDataFrame([(3, None, 1)], "vec_id long, embedding array<float>, label int")).collect()] == [(3, 0, 3, True)]
