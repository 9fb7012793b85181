import random
from collections import Counter

import neargrid.llm.simhash as m
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from neargrid.llm.simhash import near_duplicates, simhash, trie_classes


def brute(texts):
    def fp(t):
        import re

        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [fp(t) for _, t in texts]
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {c: min(texts[i][0] for i in range(len(fps)) if comp[i] == c) for c in set(comp)}
    return sorted((d, f, least[c]) for (d, _), f, c in zip(texts, fps, comp))


def test_documents_against_brute_force(spark):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice("alpha beta GAMMA délta epsilon zeta eta".split()) + str(rnd.randrange(50)) for _ in range(rnd.choice([1, 2, 3, 60, 200]))) for _ in range(40)]
    texts = [None, "", " \t\n", "One", "one", "a b", "A  B", *base, *base[:5], *(" ".join(w if rnd.random() > 0.01 else "x" for w in b.split()) for b in base for _ in range(3))]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    got = near_duplicates(spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, fp string, root int"))
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got.collect()) == brute(rows)


def test_empty_and_repeats(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = near_duplicates(spark.createDataFrame([(2, "p q r s"), (2, "p q r s"), (1, "p q r s"), (None, "z")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("2", "1"), ("2", "1"), ("None", "None")]


def test_long_text_in_parts():
    t = " ".join(str(i) for i in range(70_000))
    h = [xxhash.xxh64_intdigest(f"{i} {i + 1} {i + 2}", 42) for i in range(69_998)]
    assert simhash(t.encode()) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_every_shingle_of_long_texts_counts():
    half = False
    for k, n in ((5, 65_540), (44, 65_539), (18, 70_001), (15, 131_080), (1, 65_540), (23, 131_080)):
        words = [str(k * 7919 + i) for i in range(n)]
        h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(n - 2)], np.uint64)
        ones = [int((h >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
        half |= any(2 * c == len(h) for c in ones)
        assert simhash(" ".join(words).encode()) == sum(1 << b for b in range(64) if 2 * ones[b] > len(h)), (k, n)
    assert half  # a bit of exactly half stays 0


def test_trie_pairs():
    rnd = np.random.default_rng(0)
    centre = rnd.integers(0, 2**63, 8, dtype=np.uint64)
    x = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (200, 5), dtype=np.uint64), axis=1) for c in centre]))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    want = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([want[near[i]].min() for i in range(len(x))])
        if (new == want).all():
            break
        want = new
    assert (trie_classes(x, [(0, len(x), 0, len(x), 0, 0)], 3) == want).all()
    half = len(x) // 2
    y = np.concatenate([np.sort(x[:half]), np.sort(x[half:])])
    got = trie_classes(y, [(0, half, half, len(x), 0, 0), (0, half, 0, half, 0, 0), (half, len(x), half, len(x), 0, 0)], 3)
    assert (got == want).all()


def links(x):
    x = np.array(x, np.uint64)
    return {(int(a), int(b)) for i, a in enumerate(x) for b in x[i + 1 :][np.bitwise_count(x[i + 1 :] ^ a) <= 3]}


def classes(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("cell, step", [(4, 6), (64, 2), (1 << 14, 6)])
def test_dealt_tries_against_brute_force(spark, monkeypatch, cell, step):
    monkeypatch.setattr(m, "CELL", cell)
    monkeypatch.setattr(m, "STEP", step)
    monkeypatch.setattr(m, "GATHER", 50)
    rnd = random.Random(5)
    hot = [0xF23456789ABCDEF0 ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(0, 64, 7)]
    far = [rnd.getrandbits(64) for _ in range(150)]
    fps = sorted({0, 2**64 - 1, *hot, *far, *(f ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randrange(1, 5))}) for f in far)})
    frame = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    pairs = [(r.u % 2**64, r.v % 2**64) for r in m.near_edges(frame).collect()]
    want = links(fps)
    assert {(min(p), max(p)) for p in pairs} and classes(fps, pairs) == classes(fps, want)
    # each near pair of nodes is dealt to just one task
    met = {}
    for depth, rows in m.deal(frame):
        for r in rows.collect():
            f, own = r.fp % 2**64, (r.fp % 2**64) >> (64 - depth) if depth else 0
            met.setdefault((depth, min(own, r.other % 2**64), max(own, r.other % 2**64)), []).append(f)
    times = {}
    for (depth, a, b), fs in met.items():
        assert len(fs) == len(set(fs))
        for p in links(sorted(fs)):
            if a == b or p[0] >> (64 - depth) != p[1] >> (64 - depth):
                times[p] = times.get(p, 0) + 1
    assert {p for p, n in times.items() if n == 1} == want == set(times)


def test_tries_do_the_work():
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    x = np.unique(np.array([simhash((t or "").encode()) for t in docs], np.uint64))
    count = Counter()
    root = trie_classes(x, [(0, len(x), 0, len(x), 0, 0)], 3, count)
    want = links(x.tolist())
    got = classes(x.tolist(), zip(x.tolist(), x[root].tolist(), strict=True))
    assert got == classes(x.tolist(), want)
    assert 12 * count["compared"] < len(x) * (len(x) - 1) / 2 and count["expanded"] > 10 * len(x) and count["pruned"] > 10 * len(x), count  # the rest is pruned
