import zlib

import numpy as np
import pytest

from neargrid.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op7_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    tried = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang_pred == r.lang for r in tried) / len(tried) > 0.95


def test_cases(spark):
    train = [("the and of with from", "en")] * 5 + [("der die und nicht über", "de")] * 5 + [(None, "en"), ("x", None)]
    model = langid.learn(spark.createDataFrame(train, "text string, lang string"))
    assert model[0] == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "12 34 !! ½ Ⅷ"), (4, "the and of"), (4, "the and of"), (5, "über und nicht"), (6, "the and of with from " * 30 + "der die und nicht über " * 10), (7, "x" * 100_000), (None, "und")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, score string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"]
    assert got[1].score == 0 and got[4].score == 1
    assert got[6].languages["en"] == pytest.approx(0.75, abs=0.06) and got[6].languages["de"] == pytest.approx(0.25, abs=0.06)
    nothing = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "a")], "doc_id long, text string"), nothing).collect()] == ["und"]


def test_mixture_against_plain_em():
    rnd = np.random.default_rng(0)
    like = rnd.random((40, 3))
    share, total = langid._mixture(like, np.array([0, 25]), np.repeat([0, 1], [25, 15]), np.ones((2, 3)))
    for d, part in enumerate((like[:25], like[25:])):
        p = np.full(3, 1 / 3)
        for _ in range(langid.STEPS):
            w = part * p
            p = (w / w.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(share[d], p) and np.isclose(total[d], np.log((part * p).sum(axis=1)).sum())
