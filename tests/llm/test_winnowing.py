import hashlib
import random
import re

import duckdb
from neargrid.llm import queries, winnowing

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench):
    windows = {}
    for i, t in bench:
        w = words(t)
        for p in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[p : p + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for x, ids in windows.items():
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit |= set(range(p, p + len(x)))
                    items |= ids
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def oracle(frames):
    c = duckdb.connect()
    for name, frame in frames.items():
        c.register(name, frame.toArrow())
    return c.execute(winnowing.ORACLE).fetchall()


def run(spark, docs, bench, monkeypatch):
    frames = {"documents": spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, n int, key string"), "benchmark": spark.createDataFrame([(*b, 3) for b in bench], "item_id long, text string, f int")}
    monkeypatch.setattr(queries, "read_table", lambda s, d, n: frames[n])
    got = queries.op10_winnowing(spark, "")
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(map(tuple, got.collect()), key=str), frames


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    vocab = ["a", "B", "the", "ÉTÉ", "été", "x9", "of"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) + (str(rnd.randrange(4)) if rnd.random() < 0.4 else "") for _ in range(n))
    bench = [(i, text(rnd.choice([12, 25, 40]))) for i in range(12)] + [(50, "one Two"), (51, "été"), (52, None), (53, "!!"), (54, "a a a a a a a a a a a a"), (55, text(10)), (55, "one Two"), (60, text(9))]
    docs = [(i, text(rnd.choice([3, 9, 10, 60, 300]))) for i in range(30)]
    docs += [(100 + i, f"{text(20)} {b[1].upper() if i % 2 else b[1]}. {text(15)}") for i, b in enumerate(bench) if b[1]]
    docs += [(200, None), (201, ""), (202, "one two"), (202, "one two"), (203, "a " * 40), (204, "a " * 9), (205, " ".join(bench[1][1].split()[:10])), (None, "one  two")]
    got, frames = run(spark, docs, bench, monkeypatch)
    assert got == brute(docs, bench)
    clean = winnowing.decontaminate(frames["documents"], frames["benchmark"])
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in got if not r[5])
    assert clean.columns == ["doc_id", "text", "n", "key"]
    assert sorted(oracle(frames), key=str) == got
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(winnowing, "CHUNK", 1)
    assert run(spark, docs, bench, monkeypatch)[0] == got


def test_long_texts_and_a_hot_item(spark, monkeypatch):
    long = " ".join(str(i * i) for i in range(60_000))
    bench = [(1, " ".join(long.split()[40_000:40_030])), (2, "the")]
    docs = [(i, f"the {i} the") for i in range(40)] + [(100, long), (101, long[:1000])]
    got, _ = run(spark, docs, bench, monkeypatch)
    assert {r[0]: r[1:4] for r in got} == {i: (3, 2, 1) for i in range(40)} | {100: (60_000, 30, 1), 101: (len(long[:1000].split()), 0, 0)}
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(winnowing, "FILTER_LONGS", 1)
    assert run(spark, docs, bench, monkeypatch)[0] == got


def test_empty_tables(spark, monkeypatch):
    assert run(spark, [], [(1, "a b")], monkeypatch)[0] == []
    assert [r[1:4] for r in run(spark, [(1, "a b")], [], monkeypatch)[0]] == [(2, 0, 0)]


def test_no_python_on_the_path(spark, tmp_path):
    docs, bench = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    plan = winnowing.hits(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
