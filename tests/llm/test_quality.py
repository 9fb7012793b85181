import math
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from neargrid.llm import queries, quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def spark_hash(*values):
    """xxhash64() of Spark: each value's XXH64, seeded by the one before."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), h)
    return h


def slots(raw):
    """(slot, context) of each gram, byte by byte, and the number of byte grams."""
    b, m = b"  " + raw + b" ", 0xFFFFFFFF
    out = []
    for x, y, z in zip(b, b[1:], b[2:]):
        h = (((x << 8 | y) * 0x9E3779B1) & m) ^ ((z * 0x85EBCA77) & m)
        out.append(((((h ^ h >> 15) * 0x27D4EB2F) & m) >> 16, x << 8 | y))
    words = raw.split()
    return out + [("again" if v == w else "fresh", "word") for v, w in zip(words, words[1:])], len(out)


def brute(docs, labels, fraction=None, keep=0.999, seed=4):
    """[(doc_id, log_weight, key, sampled)] by dictionaries and one sort."""
    best = {}
    for d, q in labels:
        if d is not None and q is not None:
            best[d] = max(q, best.get(d, q))
    filled = [(d, t) for d, t in docs if t and t.strip(" \t\n\v\f\r")]
    models = [Counter(), Counter()]
    for d, t in filled:
        grams, n = slots(t.encode())
        for g, c in grams:
            for model in models if best.get(d) == 1 else models[1:]:
                for k in (("slot", g), ("context", c), "all"):
                    model[k] += int(2**20 / n**0.5)
    fitted = models[0]["all"] > 0

    def weight(t, own):
        grams, n = slots(t.encode())
        mine, unit = Counter(), int(2**20 / n**0.5)
        for g, c in grams if own else ():
            for k in (("slot", g), ("context", c), "all"):
                mine[k] += unit
        target = lambda k: models[0][k] - mine[k]
        lent, total = max(2e-5 * target("all"), 1e-9), 0.0
        for g, c in grams:
            r = models[1]["slot", g]
            p = r / max(models[1]["context", c], r)
            total += math.log((target(("slot", g)) + lent * p) / (max(target(("context", c)), target(("slot", g))) + lent)) - math.log(p)
        return 50 * total / n

    weights = [(weight(t, False) if fitted else 0.0) if t and t.strip(" \t\n\v\f\r") else None for _, t in docs]
    noise = [(spark_hash(d, t, (seed,)) >> 11) / 2**53 + 1e-17 for d, t in docs]
    keys = [None if w is None else w - math.log(-math.log(u)) for w, u in zip(weights, noise)]
    if fraction is None:
        without = {}
        for d, t in filled:
            if best.get(d) == 1:
                without[d] = min(without.get(d, math.inf), weight(t, True))
        least = sorted(without.values())[math.floor((1 - keep) * (len(without) - 1))] if fitted else -math.inf
        k = sum(w is not None and w >= least for w in weights)
    else:
        k = round(fraction * len(filled))
    bar = sorted((x for x in keys if x is not None), reverse=True)[k - 1] if k else math.inf
    return [(d, w, x, x is not None and x >= bar) for (d, _), w, x in zip(docs, weights, keys)]


def same(got, want):
    order = lambda rows: sorted(rows, key=lambda r: (str(r[0]), r[2] is None, r[2] or 0))
    for g, w in zip(order(got), order(want), strict=True):
        assert g[0] == w[0] and g[3] == w[3], (g, w)
        assert g[1] == w[1] if w[1] is None else math.isclose(g[1], w[1], rel_tol=1e-6, abs_tol=1e-6) and math.isclose(g[2], w[2], rel_tol=1e-6, abs_tol=1e-6), (g, w)


def corpus():
    rnd = np.random.default_rng(3)
    words = "the cat sat on a mat and some été Wörter were here then".split()
    rows = [(i, " ".join(rnd.choice(words, rnd.integers(1, 60)))) for i in range(60)]
    rows += [(100 + i, "!! ".join(rnd.choice(words, rnd.integers(1, 40))).upper()) for i in range(12)] + [(200 + i, f"{rnd.choice(words)} " * 30) for i in range(6)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "x" * 20_000), (0, rows[0][1]), (None, "the cat sat"), (400, "z"), (1, "another text of one id")]
    labels = [(i, 1) for i in range(0, 40)] + [(100 + i, 0) for i in range(6)] + [(5, 0), (None, 1), (77, 1), (101, None), (300, 1)]
    return rows, labels


@pytest.mark.parametrize("fraction", [None, 0.5, 0.0, 1.0])
def test_against_brute_force(spark, fraction):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, row int").repartition(3)
    out = quality.resample(docs, spark.createDataFrame([(*x, 7) for x in labels], "doc_id long, quality int, _id int"), ["doc_id"], fraction)
    same([(r.row.doc_id, r.log_weight, r.key, r.sampled) for r in out.collect()], brute(rows, labels, fraction))


def test_without_good_labels(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in ([], [(1, 0)], [(999, 1)]):
        frame = spark.createDataFrame(labels, "doc_id long, quality int")
        same([(r.row.doc_id, r.log_weight, r.key, r.sampled) for r in quality.resample(docs, frame, ["doc_id"]).collect()], brute(rows, labels))


def test_the_draw_follows_the_weights(spark):
    """Over many draws the first row of a group is drawn as often as its weight says, so it is no plain top-k."""
    weights = [0.0, 1.0, 2.0, -3.0]
    rows = spark.range(4 * 20_000).select((F.col("id") / 4).cast("long").alias("draw"), (F.col("id") % 4).alias("i"), F.xxhash64("id").alias("noise"))
    keyed = rows.withColumn("key", quality.draw(F.get(F.array(*map(F.lit, weights)), "i"), F.col("noise")))
    first = keyed.groupBy("draw").agg(F.max_by("i", "key").alias("i")).groupBy("i").count().collect()
    share = np.exp(weights) / np.exp(weights).sum()
    for r in first:
        assert abs(r["count"] / 20_000 - share[r.i]) < 4 * (share[r.i] / 20_000) ** 0.5 + 1e-3


def test_the_draw_decides(spark):
    """On the driver's table half of the rows drawn are not the half with the largest weights, and each seed draws others."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    drawn = []
    for seed in (4, 5):
        rows = quality.resample(docs, labels, ["doc_id"], fraction=0.5, seed=seed).select("row.doc_id", "log_weight", "sampled").collect()
        weighed = sorted((r for r in rows if r.log_weight is not None), key=lambda r: -r.log_weight)
        drawn.append({r.doc_id for r in rows if r.sampled})
        assert len(drawn[-1]) == round(len(weighed) / 2)
        top = {r.doc_id for r in weighed[: len(drawn[-1])]}
        assert 0.1 < 1 - len(drawn[-1] & top) / len(top) < 0.5
        mean = lambda rows: sum(r.log_weight for r in rows) / len(rows)
        assert mean([r for r in rows if r.sampled]) > mean([r for r in rows if not r.sampled and r.log_weight is not None]) + 1
    assert len(drawn[0] & drawn[1]) < 0.9 * len(drawn[0])


def test_held_out_labels(spark):
    """Parts 2 and 3 of 4 of the larger table, by a checksum of the id: the models' constants were chosen on parts 0 and 1, the size of the draw with all four in sight."""
    sf = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labels = labels.withColumn("part", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4)
    out = quality.resample(docs, labels.where("part < 2"), ["doc_id"]).select("row.doc_id", "sampled")
    rows = out.join(labels.where("part >= 2"), "doc_id").groupBy("quality").agg(F.avg(F.col("sampled").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.03, kept


def test_select_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "good words", 2, "x"), (2, None, 3, "y")], "doc_id long, text string, `a.b` int, `row` string")
    out = quality.select_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "good words", 2, "x")]
    assert quality.select_good(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect() == []


def test_query_columns(spark, monkeypatch):
    rows, labels = corpus()
    frames = {"documents": spark.createDataFrame(rows, "doc_id long, text string"), "labels": spark.createDataFrame(labels, "doc_id long, quality int")}
    monkeypatch.setattr(queries, "read_table", lambda s, d, n: frames[n])
    out = queries.op4_quality(spark, "")
    assert out.columns == ["doc_id", "log_weight", "key", "sampled"]
    same([tuple(r) for r in out.collect()], brute(rows, labels))
