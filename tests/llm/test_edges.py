"""Cases that several operators share: empty tables, one class, names that clash, and the whole pipeline."""

import importlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from neargrid.llm import langid, queries, simhash, winnowing
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_secrets import base as base_secrets
from tests.llm.test_simhash import brute as brute_simhash
from tests.llm.test_winnowing import brute as brute_windows
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_langid_of_an_empty_table(spark):
    model = langid.learn(spark.createDataFrame([("the and of", "en")], "text string, lang string"))
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_simhash_of_one_fingerprint(spark):
    docs = spark.createDataFrame([(i, "same words here again") for i in (7, 3, 9)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(3, 3), (7, 3), (9, 3)]
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [3]


def test_columns_of_any_name_stay(spark, monkeypatch):
    names = "doc_id long, text string, `a.b` int, k1 int, fp int, root int, `_simhash_k` string, `c``d` string"
    docs = spark.createDataFrame([(1, "one two three four", 1, 2, 3, 4, "x", "y"), (2, "one two three four", 1, 2, 3, 4, "x", "y"), (3, "other text", 5, 6, 7, 8, "z", "w")], names)
    bench = spark.createDataFrame([(1, "other text")], "item_id long, text string")
    for limit in (500_000, 0):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", limit)
        out = simhash.keep_one(docs)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "one two three four", 1, 2, 3, 4, "x", "y"), (3, "other text", 5, 6, 7, 8, "z", "w")]
    out = winnowing.decontaminate(docs, bench)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_pipeline_against_brute_force(spark):
    """run() on the driver's smallest table: each stage by its brute-force version, then the pieces by the tokenizer."""
    pipeline = importlib.import_module("corpus_pipeline")
    table = lambda name, *c: list(zip(*(pq.read_table(f"{SF}/{name}.parquet")[x].to_pylist() for x in c)))
    docs, labels, bench = table("documents", "doc_id", "text"), table("labels", "doc_id", "quality"), table("benchmark", "item_id", "text")
    drawn = {d for d, *_, sampled in brute_quality(docs, labels) if sampled}
    docs = [(d, t) for d, t in docs if d in drawn]
    first = {d for d, _, c in brute_simhash(docs) if d == c}
    docs = [(d, t) for d, t in docs if d in first]
    clean = {d for d, *_, hit in brute_windows(docs, bench) if not hit}
    safe = {}
    for d, t in docs:
        if d in clean:
            out, at = "", 0
            for s, _, e in base_secrets(t):
                out += t[at:s] + "<secret>" if s >= at else ""
                at = max(at, e)
            safe[d] = out + t[at:]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in safe.items()}
    rows = pipeline.run(spark, SF).collect()
    crc = lambda r: zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert {r.doc_id for r in rows} == set(ids) and all(r.ids_crc32 == crc(r) and r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    covered, sequences = Counter(), defaultdict(list)
    for r in rows:
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == {d: len(x) for d, x in ids.items()}
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_pipeline_of_empty_and_clashing_tables(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    extra = ", ".join(f"{c} string" for c in ("row", "key", "k1", "k2", "n", "f", "h", "spans", "pairs", "found", "base", "rest", "task"))
    for name, schema, rows in (
        ("documents", f"doc_id long, text string, lang string, source string, n_chars long, {extra}", []), ("labels", "doc_id long, quality int", []), ("benchmark", "item_id long, text string", []),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path / "empty")).collect() == []
    full = tmp_path / "full"
    rows = [(1, "plain words here", "en", "s", 16, *"abcdefghijklm"), (2, None, "en", "s", 0, *"abcdefghijklm"), (3, "password = abcdefgh1 here", "en", "s", 25, *"abcdefghijklm"), (3, "password = abcdefgh1 here", "en", "s", 25, *"abcdefghijklm")]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(str(full / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(full / "labels.parquet"))
    spark.createDataFrame([(9, "not in any text")], "item_id long, text string").write.parquet(str(full / "benchmark.parquet"))
    assert sorted(r.doc_id for r in pipeline.run(spark, str(full)).collect()) == [1, 3]


def test_queries_and_sql_have_the_same_names():
    assert set(queries.ORACLE_SQL) == {"op5_pq", "op8_licenses", "op9_chat", "op10_winnowing"} <= set(queries.QUERIES)


def test_langid_against_plain_arithmetic(spark):
    """Learning, segments, mixtures, the penalty and the prediction, by dictionaries and loops."""
    import math

    table = {d: (t, lang) for d, t, lang in zip(*(pq.read_table(f"{SF}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text", "lang")))}
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    fold = lambda raw: bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in raw)

    def slots(raw):
        b, m = fold(raw + b"  "), 0xFFFFFFFF
        return [((((x * 0x9E3779B1) & m ^ (y * 0x85EBCA77) & m ^ (z * 0xC2B2AE3D) & m) * 0x27D4EB2F) & m) >> 16 for x, y, z in zip(b, b[1:], b[2:])]

    counts = defaultdict(Counter)
    for d, (t, lang) in table.items():
        if t and lang is not None and not held(d):
            counts[lang].update(slots(t.encode()))
    names = sorted(counts)
    total = {x: sum(counts[x].values()) for x in names}
    like = lambda x, s: float(np.float32(max(-14.0, math.log((counts[x][s] + 0.5) / (total[x] + 0.5 * 65536)))))

    def plain(text):
        raw = text.encode()
        ends = [i for i, b in enumerate(raw) if b in (32, 10, 9, 13)]
        starts = sorted({0} | {next(e for e in ends if e >= k) for k in range(48, len(raw), 48) if ends and ends[-1] >= k})
        g = slots(raw)
        parts = [[sum(like(x, s) for s in g[a:b]) for x in names] for a, b in zip(starts, [*starts[1:], len(g)])]
        parts = [[math.exp(max(v - max(p), -600)) for v in p] for p in parts]

        def fit(allowed):
            share = [a / sum(allowed) for a in allowed]
            for _ in range(25):
                post = [[v * s for v, s in zip(p, share)] for p in parts]
                share = [sum(p[k] / sum(p) for p in post) / len(parts) for k in range(len(names))]
            return share, sum(math.log(sum(v * s for v, s in zip(p, share))) for p in parts)

        full = fit([1] * len(names))
        order = sorted(range(len(names)), key=lambda k: -full[0][k])
        tried = [(full[1] - 0.5 * (len(names) - 1) * math.log(len(parts) + 1), full[0])]
        for k in range(1, len(names)):
            share, value = fit([int(i in order[:k]) for i in range(len(names))])
            tried.append((value - 0.5 * (k - 1) * math.log(len(parts) + 1), share))
        best = max(v for v, _ in tried)
        return next(s for v, s in reversed(tried) if v >= best - 1e-9)

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs.where(~langid.held_out("doc_id")))).collect()}
    mixed = 0
    for d, (t, _) in sorted(table.items())[:120]:
        if not t or len(t) > 3000:
            continue
        share = plain(t)
        want = names[max(range(len(names)), key=lambda k: share[k])]
        assert out[d].lang_pred == want and math.isclose(out[d].score, max(share), abs_tol=1e-3), (d, out[d], share)
        mixed += max(share) < 0.999
    assert len(out) == len(table)
