import importlib

from tests.llm.test_secrets import base as base_secrets
from tests.llm.test_simhash import brute as brute_simhash
from tests.llm.test_winnowing import brute as brute_windows

from neargrid.llm import simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    names = [n for n, _ in pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = {}
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, SF)
        out[name] = docs = spark.createDataFrame(got.collect(), got.schema)
        assert name == names[-1] or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = {n: {r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for n, f in out.items() if n != names[-1]}
    all_docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good, kept, clean, safe = (rows[n] for n in names[:-1])
    assert sum(d not in good for d, q in labels.items() if q == 1) <= 0.03 * len(labels)
    assert all(good[d] == all_docs[d] for d in good) and len(good) < len(all_docs)
    assert set(kept) == {d for d, _, c in brute_simhash(list(good.items())) if c == d}
    assert set(clean) == {d for d, *_, hit in brute_windows(list(kept.items()), bench) if not hit}
    assert set(safe) == set(clean) and all((safe[d] != clean[d]) >= bool(base_secrets(clean[d])) and not base_secrets(safe[d]) for d in safe)
    pieces = out[names[-1]].collect()
    assert {r.doc_id for r in pieces} == set(safe)


def test_one_of_equal_rows_stays(spark):
    docs = spark.createDataFrame([(2, "a b c d", "x"), (2, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (None, "z", "q"), (None, "w", "q"), (3, "", "e"), (4, None, "e")], "doc_id long, text string, root string")
    got = sorted(map(tuple, simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, "a b c d", "y"), (None, "w", "q"), (None, "z", "q"), (3, "", "e")], key=str)
