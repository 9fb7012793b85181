"""Cases of the feature space, requests, searches, evaluation, sources and sinks, against plain arithmetic."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from neargrid.functions import features, morton
from neargrid.operators import evaluate, kdtree, ranks, requests, search
from neargrid.plans import cascade, jobs
from neargrid.sources import indexes, shared, tables
from neargrid.sources.schemas import VECTOR

EPOCH = datetime.datetime(1970, 1, 1)


def iso(seconds):
    return (EPOCH + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def made(seed):
    """A request of our own making."""
    rnd = random.Random(seed)
    at = rnd.randrange(1_700_000_000, 1_900_000_000)
    shops = [f"shop-{rnd.randrange(60)}" for _ in range(rnd.randrange(4))]
    last = {"timestamp": iso(at - rnd.randrange(-3000, 200_000)), "km_from_current": rnd.choice([0, 40.5, rnd.random() * 1500])}
    return {
        "id": f"r{seed}-x",
        "transaction": {"amount": rnd.choice([0, 12.75, rnd.random() * 15_000]), "installments": rnd.randrange(15), "requested_at": iso(at)},
        "customer": {"avg_amount": rnd.choice([0, 55.5, rnd.random() * 3000]), "tx_count_24h": rnd.randrange(30), "known_merchants": shops},
        "merchant": {"id": rnd.choice([*shops, "shop-1", "other"]), "mcc": rnd.choice(["5411", "7995", "4511", "1234", "none", "+5812"]), "avg_amount": rnd.random() * 12_000},
        "terminal": {"is_online": rnd.random() < 0.5, "card_present": rnd.random() < 0.5, "km_from_home": rnd.random() * 1200},
        "last_transaction": rnd.choice([None, last, last]),
    }


def plain_vector(r):
    """The 14 numbers of a request, each by the rule in words: a ratio, cut to 0..1, in ten-thousandths of single precision."""
    seconds = lambda t: int((datetime.datetime.strptime(t, "%Y-%m-%dT%H:%M:%SZ") - EPOCH).total_seconds())
    cut = lambda x: float(np.float32(min(max(x, 0.0), 1.0)))
    t, c, m, p, last = (r[k] for k in ("transaction", "customer", "merchant", "terminal", "last_transaction"))
    now = seconds(t["requested_at"])
    moment = EPOCH + datetime.timedelta(seconds=now)
    risk = {4511: 0.35, 5311: 0.25, 5411: 0.15, 5812: 0.3, 5912: 0.2, 5944: 0.45, 5999: 0.5, 7801: 0.8, 7802: 0.75, 7995: 0.85}
    code = m["mcc"].removeprefix("+")
    ratio = cut(t["amount"] / c["avg_amount"] / 10) if c["avg_amount"] else float(t["amount"] > 0)
    raw = [
        cut(t["amount"] / 10_000), cut(t["installments"] / 12), ratio, moment.hour / 23, moment.weekday() / 6,
        -1.0 if last is None else cut(max(0, (now - seconds(last["timestamp"])) // 60) / 1440), -1.0 if last is None else cut(last["km_from_current"] / 1000),
        cut(p["km_from_home"] / 1000), cut(c["tx_count_24h"] / 20), float(p["is_online"]), float(p["card_present"]), float(m["id"] not in json.dumps(c["known_merchants"])),
        risk.get(int(code), 0.5) if code.isdigit() else 0.5, cut(m["avg_amount"] / 10_000),
    ]
    scaled = [float(np.float32(x) * np.float32(10_000)) for x in raw]
    return [int(abs(x) + 0.5) * (1 if x >= 0 else -1) for x in scaled]


def body(**change):
    b = {
        "id": "order 7",
        "transaction": {"amount": 120.5, "installments": 2, "requested_at": "2031-05-20T07:45:00Z"},
        "customer": {"avg_amount": 300.0, "tx_count_24h": 1, "known_merchants": ["shop-12", "shop-40"]},
        "merchant": {"id": "shop-12", "mcc": "5411", "avg_amount": 80.25},
        "terminal": {"is_online": True, "card_present": False, "km_from_home": 4.5},
        "last_transaction": {"timestamp": "2031-05-20T01:15:30Z", "km_from_current": 250.0},
    }
    for path, value in change.items():
        *parents, leaf = path.split("__")
        at = b
        for p in parents:
            at = at[p]
        at[leaf] = value
    return json.dumps(b)


def parse(spark, *bodies):
    return requests.parse_requests(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string"))


def vector(spark, *bodies):
    valid, _ = parse(spark, *bodies)
    return [list(r)[1:] for r in features.vectorised(valid, "n").orderBy("n").collect()]


def test_vectors_of_many_requests(spark):
    made_up = [made(i) for i in range(400)]
    assert vector(spark, *map(json.dumps, made_up)) == [plain_vector(r) for r in made_up]


def test_single_features(spark):
    got = vector(
        spark, body(last_transaction=None), body(last_transaction__timestamp="2031-05-20T08:00:00Z"), body(last_transaction__km_from_current=1e6), body(merchant__id="shop-1"), body(merchant__id="X"),
        body(merchant__mcc="word"), body(merchant__mcc="+7801"), body(customer__avg_amount=0), body(customer__avg_amount=0, transaction__amount=0), body(transaction__amount=-3), body(transaction__amount=1e12),
    )
    assert got[0][5:7] == [-10000, -10000] and got[1][5] == 0 and got[2][6] == 10000
    assert got[3][11] == 0 and got[4][11] == 10000  # a substring of the list's text counts as known
    assert got[5][12] == 5000 and got[6][12] == 8000
    assert got[7][2] == 10000 and got[8][2] == 0 and got[9][0] == 0 and got[10][0] == 10000


def test_quantised(spark):
    rnd = random.Random(4)
    x = [float("nan"), 4.0, -4.0, 0.00005, -0.00005, 0.0] + [rnd.uniform(-3.2, 3.2) for _ in range(500)]
    got = [r.q for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(features.quantised(F.col("x")).alias("q")).collect()]
    assert got[:6] == [0, 32767, -32768, 1, -1, 0]
    scaled = [float(np.float32(v) * np.float32(10_000)) for v in x[6:]]
    assert got[6:] == [int(abs(v) + 0.5) * (1 if v >= 0 else -1) for v in scaled]


def test_rejects(spark):
    cut = body()[:40]
    valid, rejected = parse(spark, body(), cut, body() + " x", body() + "{}", None, body(transaction__amount="a"), body(customer__avg_amount=None), body().replace(', "last_transaction"', ', "other"'), body(transaction__requested_at="2031-13-11T20:23:35Z"), body(id="x" * 3000), body(merchant__id='a{"}'), "")
    assert sorted(r.n for r in valid.collect()) == [0, 10]
    assert {r.n: r.reason for r in rejected.collect()} == {1: "json", 2: "json", 3: "json", 4: "size", 5: "json", 6: "fields", 7: "fields", 8: "date", 9: "size", 11: "json"}


def test_timestamp(spark):
    times = [0, 951_868_799, 951_868_800, 1_709_251_199, 4_102_444_800]
    got = spark.createDataFrame([(iso(t),) for t in times], "s string").select(requests.timestamp(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == times


def test_morton_bytes(spark):
    values = list(range(-10_000, 10_001, 137)) + [10_000]
    d = spark.createDataFrame([(v,) for v in values], "v int").selectExpr("v", f"{morton.byte('v', False)} AS a", f"{morton.byte('v', True)} AS b").collect()
    assert all(r.a == int(max(r.v, 0) * 255 / 10_000 + 0.5) and r.b == int((r.v + 10_000) * 255 / 20_000 + 0.5) for r in d)


def key_of(v):
    b = [((max(min(x + 10000, 20000), 0) * 255 + 10000) // 20000) if d in (5, 6) else ((max(min(x, 10000), 0) * 255 + 5000) // 10000) for d, x in enumerate(v)] + [0, 0]
    key = 0
    for bit in range(7, -1, -1):
        for d in range(16):
            key = key << 1 | b[d] >> bit & 1
    return key


def vectors(n, seed, ties=True):
    rnd = random.Random(seed)
    values = [-10000, 0, 100, 200, 5000, 10000] if ties else range(-10000, 10001)
    return [[rnd.choice(values) if d in (5, 6) else max(0, rnd.choice(values)) for d in range(14)] for _ in range(n)]


def frames(spark, refs, qs):
    index = search.build_index(spark.createDataFrame([(i, *v, i % 3 == 0 and 1 or 0) for i, v in enumerate(refs)], "ref_id long, " + ", ".join(f"{v} smallint" for v in VECTOR) + ", label tinyint"))
    return index, search.as_queries(spark.createDataFrame([(1000 + i, *v) for i, v in enumerate(qs)], "request_id long, " + ", ".join(f"{v} smallint" for v in VECTOR)), "request_id")


@pytest.mark.parametrize("n", [0, 1, 4, 5, 10, 11, 300])
def test_searches_against_brute_force(spark, n):
    refs, qs = vectors(n, 1), vectors(12, 2)
    qs += refs[:3] + [[10000] * 14, [0] * 5 + [-10000, -10000] + [0] * 7]
    index, q = frames(spark, refs, qs)
    order = sorted(range(n), key=lambda i: (key_of(refs[i]), i))
    assert index.n == n and [(r.ref_id, int(r.key, 16)) for r in index.rows.orderBy("pos").collect()] == [(i, key_of(refs[i])) for i in order]
    lb = {1000 + i: sum(key_of(r) < key_of(v) for r in refs) for i, v in enumerate(qs)}
    assert {r.id: r.lb for r in ranks.lower_bounds(q.select("id", "key"), index.keys).collect()} == lb
    top = {}
    for r in search.window_top(q, index, width=7).orderBy("id", "rank").collect():
        top.setdefault(r.id, []).append((r.d, r.pos))
    for i, v in enumerate(qs):
        at = lb[1000 + i]
        want = sorted((sum(abs(a - b) for a, b in zip(v, refs[order[p]], strict=True)), p) for p in range(max(0, at - 7), min(n, at + 8)))[:11]
        assert top.get(1000 + i, []) == want
    want = {1000 + i: sorted((sum((a - b) ** 2 for a, b in zip(v, r, strict=True)), j) for j, r in enumerate(refs))[:5] for i, v in enumerate(qs)}
    found = [search.knn_exact(q, index)] + ([kdtree.knn(q, *kdtree.build(index.rows, 8))] if n in (5, 300) else [])
    for knn in found:
        got = {}
        for r in knn.orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append((r.d, r.ref_id))
        assert all(got.get(i, []) == w for i, w in want.items())
    scores = {r.id: r.frauds for r in search.exact_votes(q, found[0]).collect()}
    assert scores == {i: sum(j % 3 == 0 for _, j in w) for i, w in want.items()}


def test_kd_search_asks_equal_queries_once_and_meets_few_leaves(spark, monkeypatch):
    """Equal rows on many leaves, overlapping boxes, a tree of several steps, and a k that no leaf holds."""
    monkeypatch.setattr(kdtree, "STEP", 2)
    refs, qs = vectors(60, 11) * 5, vectors(6, 12) * 3
    index, q = frames(spark, refs, qs)
    rows, leaves = kdtree.build(index.rows, 8)
    met = []
    real = kdtree.materialise
    monkeypatch.setattr(kdtree, "materialise", lambda df: met.append(real(df)) or met[-1])
    for k in (5, 20):
        want = {1000 + i: sorted((sum((a - b) ** 2 for a, b in zip(v, r, strict=True)), j) for j, r in enumerate(refs))[:k] for i, v in enumerate(qs)}
        got = {}
        for r in kdtree.knn(q, rows, leaves, k).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append((r.d, r.ref_id))
        assert got == want
    asked = [df.count() for df in met if df.columns == [*search.QUERY, "id"]]
    assert asked == [len(set(map(tuple, qs)))] * 2


def test_box_levels_deeper_than_two(spark, monkeypatch):
    monkeypatch.setattr(search, "FAN", 3)
    refs, qs = vectors(100, 5, ties=False), vectors(6, 6, ties=False)
    index, q = frames(spark, refs, qs)
    got = {}
    index.boxes = search.box_levels(index.rows, index.n, 3)
    assert len(index.boxes) == 4
    for r in search.knn_exact(q, index, fan=3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.ref_id)
    assert got == {1000 + i: [j for _, j in sorted((sum((a - b) ** 2 for a, b in zip(v, r, strict=True)), j) for j, r in enumerate(refs))[:5]] for i, v in enumerate(qs)}


def test_deep_key_tree(spark, monkeypatch):
    monkeypatch.setattr(ranks, "NODE", 3)
    refs, qs = vectors(100, 5), vectors(20, 6)
    index, q = frames(spark, refs, qs + refs[:5])
    assert len(index.keys) == 5
    assert {r.id: r.lb for r in ranks.lower_bounds(q, index.keys).collect()} == {1000 + i: sum(key_of(r) < key_of(v) for r in refs) for i, v in enumerate(qs + refs[:5])}


@pytest.mark.parametrize("subtree", [1, 40, 1 << 16])
def test_kd_tree_in_one_pass_or_level_by_level(spark, monkeypatch, subtree):
    monkeypatch.setattr(kdtree, "SUBTREE", subtree)
    refs = vectors(150, 9)
    rows, leaves = kdtree.build(spark.createDataFrame([(i, *v, 0) for i, v in enumerate(refs)], "ref_id long, " + ", ".join(f"{v} smallint" for v in VECTOR) + ", label tinyint"), 8)

    def plain(node, ids):
        if len(ids) <= 8:
            return {i: node for i in ids}
        spans = [max(refs[i][d] for i in ids) - min(refs[i][d] for i in ids) for d in range(14)]
        ids = sorted(ids, key=lambda i: (refs[i][spans.index(max(spans))], i))
        half = len(ids) // 2
        return plain(2 * node + 1, ids[:half]) | plain(2 * node + 2, ids[half:])

    want = plain(0, list(range(150)))
    assert {r.ref_id: r.node for r in rows.collect()} == want
    assert {r.node: r.n for r in leaves.collect()} == {n: sum(x == n for x in want.values()) for n in set(want.values())}


def test_fast_path_gate(spark):
    top = lambda ds, labels: spark.createDataFrame([(1, d, x) for d, x in zip(ds, labels, strict=True)], "id long, d int, label int")
    vote = lambda *a: search.window_vote(top(*a)).first().fast_score
    assert vote([5000] * 11, [0] * 11) == 0.0 and vote([0] * 11, [1] * 11) == 1.0
    assert vote([5001] * 11, [0] * 11) is None and vote([0] * 11, [1] + [0] * 10) is None and vote([0] * 10, [0] * 10) is None


def test_scorecard(spark):
    rows = [(True, True, True, 0.5)] * 997 + [(True, False, True, 0.5), (False, True, True, 0.5), (True, True, False, 0.5)]
    r = evaluate.scorecard(spark.createDataFrame(rows, "approved boolean, expected_approved boolean, http_ok boolean, latency_ms double")).first()
    assert (r.n, r.weighted, r.failures) == (1000, 9, 3) and r.latency_score == 3000.0 and r.detection_score == pytest.approx(2045.757491 - 300.0, abs=1e-5)
    bad = evaluate.scorecard(spark.createDataFrame([(True, False, True, 3000.0)] * 5, "approved boolean, expected_approved boolean, http_ok boolean, latency_ms double")).first()
    assert bad.final_score == -6000.0
    none = evaluate.scorecard(spark.createDataFrame([], "approved boolean, expected_approved boolean, http_ok boolean, latency_ms double")).first()
    assert none.n == 0 and none.epsilon == 0 and none.latency_score == 0


def test_exact_percentile(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BINS", 7)
    rnd = random.Random(2)
    for x in ([3.0], [1.0, 2.0], [5.0] * 50, [rnd.choice([1.0, 2.5, rnd.random() * 1e6]) for _ in range(997)]):
        frame = spark.createDataFrame([(v,) for v in [*x, None]], "ms double")
        for share in (0.0, 0.5, 0.99, 1.0):
            assert evaluate.percentile(frame, "ms", share) == pytest.approx(np.percentile(x, 100 * share), rel=1e-12)
    assert evaluate.percentile(frame.limit(0), "ms", 0.99) is None


def test_report(spark):
    rows = [("Morton", True, True), ("Morton", True, False), ("KdTree", False, False), ("KdTree", False, True), ("KdTree", True, False)]
    r = evaluate.report(spark.createDataFrame(rows, "source string, approved boolean, expected_approved boolean")).first().asDict()
    assert r.pop("elapsed_ms") >= 0 and r == {"entries": 5, "morton_cases": 2, "kdtree_cases": 3, "morton_mismatches": 1, "kdtree_mismatches": 2}


def test_http_requests_of_bytes(spark):
    post = lambda length, rest: b"POST /fraud-score HTTP/1.1\r\nContent-Length:" + length + b"\r\n\r\n" + rest
    cases = {
        post(b" 3", "é!".encode()) + b"GET /ready HTTP/1.1\r\n\r\n": [("score", 3, "é!"), ("ready", None, None)],
        post(b" 2", b"ab") * 5: [("score", 2, "ab")] * 5,
        b"POST /fraud-score HTTP/1.1\r\n\r\nab": [("bad", None, None)],
        post(b" 2 ", b"ab"): [("bad", None, None)],
        post(b" 2", b"a"): [("incomplete", 2, None)],
        b"GET /ready " + b"x" * 5000 + b"\r\n\r\n": [("ready", None, None)],
        b"GET /ready " + b"x" * 1012: [("incomplete", None, None)],
        b"GET /ready " + b"x" * 1013: [("bad", None, None)],
        b"": [("incomplete", None, None)],
    }
    out = requests.parse_http(spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, raw binary")).orderBy("i", "seq").collect()
    assert [[(r.route, r.content_length, r.body) for r in out if r.i == i] for i in range(len(cases))] == list(cases.values())


def test_references_are_numbered_by_file_and_place(spark, tmp_path):
    for name, lines in (("a", False), ("b", True)):
        (tmp_path / name).mkdir()
        for f in range(4):
            rows = [{"vector": [round((100 * f + k) / 1000, 3)] * 14, "label": "legit"} for k in range(f + 2)]
            (tmp_path / name / f"part{3 - f}.json").write_text("\n".join(map(json.dumps, rows)) if lines else json.dumps(rows))
        got = tables.read_references(spark, str(tmp_path / name), lines).orderBy("ref_id").collect()
        assert [(r.ref_id, r.v0) for r in got] == list(enumerate(10 * (100 * f + k) for f in (3, 2, 1, 0) for k in range(f + 2)))


def test_storage(spark, tmp_path):
    kept = shared.materialise(spark.range(3))
    with shared.scratch(spark):
        inside = shared.shared_path(spark)
        spark.range(5).write.parquet(inside)
        assert spark.read.parquet(inside).count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(inside)
    assert kept.count() == 3


def test_index_files(spark, tmp_path):
    refs = spark.createDataFrame([(i, *v, i % 2) for i, v in enumerate(vectors(200, 3))], "ref_id long, " + ", ".join(f"{v} smallint" for v in VECTOR) + ", label tinyint")
    entries, leaves = jobs.build_indexes(refs, str(tmp_path))
    index, (rows, boxes) = indexes.read_index(spark, f"{tmp_path}/morton"), indexes.read_kd(spark, f"{tmp_path}/kd")
    assert entries == index.n == tables.warm(index.rows).count() == rows.count() == 200 and leaves == boxes.count() == 4
    q = search.as_queries(spark.createDataFrame([(7, *vectors(1, 8)[0])], "request_id long, " + ", ".join(f"{v} smallint" for v in VECTOR)), "request_id")
    near = lambda top: [tuple(r) for r in top.select("rank", "ref_id", "d").orderBy("rank").collect()]
    assert near(search.knn_exact(q, index)) == near(kdtree.knn(q, rows, boxes))
    for bad, reader in ((f"{tmp_path}/none", indexes.read_index), (f"{tmp_path}/kd", indexes.read_index), (f"{tmp_path}/morton", indexes.read_kd)):
        with pytest.raises(indexes.InvalidIndex):
            reader(spark, bad)
    spark.range(1).selectExpr("'morton' AS kind", "1 AS version", "199 AS records", "1 AS keys", "1 AS boxes").write.mode("overwrite").json(f"{tmp_path}/morton/about")
    with pytest.raises(indexes.InvalidIndex, match="200 rows, not 199"):
        indexes.read_index(spark, f"{tmp_path}/morton")


def test_sources_and_sinks(spark, tmp_path):
    refs = [{"vector": [round(0.1 * k + 0.01 * i, 3) for i in range(14)], "label": "fraud" if k % 2 else "legit"} for k in range(5)]
    (tmp_path / "refs.json").write_text(json.dumps(refs))
    got = tables.read_references(spark, str(tmp_path / "refs.json")).orderBy("ref_id").collect()
    assert [(r.v0, r.label) for r in got] == [(0, 0), (1000, 1), (2000, 0), (3000, 1), (4000, 0)]
    (tmp_path / "bad.json").write_text(json.dumps([{"vector": [1.0], "label": "legit"}]))
    with pytest.raises(Exception, match="14 numbers"):
        tables.read_references(spark, str(tmp_path / "bad.json")).collect()
    index = search.build_index(tables.read_references(spark, str(tmp_path / "refs.json")))
    assert index.rows.count() == index.n == 5 and len(index.boxes) == len(index.keys) == 1
    (tmp_path / "eval.json").write_text(json.dumps({"entries": [{"request": json.loads(body()), "expected_approved": True}]}))
    entries = tables.read_evaluation(spark, str(tmp_path / "eval.json"))
    assert requests.parse_requests(entries)[0].first().merchant_id == "shop-12"
    (tmp_path / "eval.jsonl").write_text(json.dumps({"request": json.loads(body()), "expected_approved": False}))
    assert [r.expected_approved for r in tables.read_evaluation(spark, str(tmp_path / "eval.jsonl"), lines=True).collect()] == [False]
    valid, _ = parse(spark, body(), body(id="again"))
    flat = valid.withColumn("request_id", F.col("n").cast("bigint"))
    out = cascade.decide(features.vectorised(flat, "request_id"), index)
    assert [(r.source, r.frauds, r.approved) for r in out.collect()] == [("KdTree", 2, True)] * 2
    tables.write_responses(out, str(tmp_path / "out"))
    assert {r.value for r in spark.read.text(str(tmp_path / "out")).collect()} == {'{"fraud_score":0.4,"approved":true}'}
    tables.write_report(evaluate.class_balance(index.rows), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().total == 5 and tables.ready(spark).first().ready
