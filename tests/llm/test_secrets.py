import base64
import hashlib
import math
import random
import re
import string
import uuid
from collections import Counter

import numpy as np
from neargrid.llm import queries, secrets


def base(text):
    t, out = text or "", []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def corpus():
    rnd = random.Random(2)
    words = "the antidisestablishment of und Geschwindigkeitsbegrenzung internationalisation ordinary été text flows here".split()
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    key = lambda n: base64.b64encode(rnd.randbytes(n)).decode().rstrip("=")
    rows = [(i, prose(60)) for i in range(60)]
    rows += [(100 + i, f"{prose(20)} {key(30)} {prose(9)}") for i in range(20)]
    rows += [(200 + i, f"été {prose(3)} ToKen = \"{rnd.randbytes(20).hex()}\" x{rnd.randbytes(16).hex()}. AKIA{'Q7' * 8} AKIA123") for i in range(10)]
    rows += [(300, None), (301, ""), (302, "paſſword: abcdefgh1234 toKen=abcdefgh"), (303, "secret: short api_key='abcdefghi' apikey : 12345678"), (304, "a" * 50_000 + " " + "ab" * 20_000), (304, "passwd=" * 3000)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, base int, row string")
    monkeypatch.setattr(queries, "read_table", lambda s, d, n: frame)
    out = queries.op1_secrets(spark, "")
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256): r.spans for r in out.collect()}
    want = {}
    for d, t in rows:
        b = base(t)
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in b)
        want[d, *(sum(x[1] == k for x in b) for k in range(3)), hashlib.sha256(text.encode()).hexdigest()] = text
    assert got.keys() == want.keys()
    for key, spans in got.items():
        assert {x for x in spans.split(",") if x and not x.startswith("random")} == {x for x in want[key].split(",") if x}
        if key[0] < 100:
            assert not spans  # long ordinary words stay
    found = sum(spans.startswith("random:") for key, spans in got.items() if 100 <= key[0] < 120)
    assert found >= 16, found


def test_redact(spark):
    frame = spark.createDataFrame([(1, "x token = \"0123456789abcdef0123456789abcdef\" é", "en", 3), (2, None, None, 0), (3, "plain", "q", 5)], "doc_id long, text string, lang string, n_chars long")
    out = secrets.redact(frame)
    assert out.columns == frame.columns
    assert sorted(map(tuple, out.collect())) == [(1, 'x <secret>" é', "en", 13), (2, None, None, None), (3, "plain", "q", 5)]
    assert secrets.redact(frame.limit(0)).collect() == []


ALPHABETS = {
    "hex": "0123456789abcdef", "hex_mixed": "0123456789abcdefABCDEF", "base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits,
    "base36_upper": string.ascii_uppercase + string.digits, "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_",
}


def ordinary_tokens(rnd, words, n):
    """Paths, identifiers, numbers: made of the words of the text around, as in real text."""
    some = lambda k: [rnd.choice(words) for _ in range(k)]
    kinds = [
        lambda: "/".join(some(6)), lambda: "-".join(some(6)) + "-2024-11-26", lambda: "_".join(some(6)), lambda: "_".join(some(5)).upper() + "_V2", lambda: "".join(w.title() for w in some(6)),
        lambda: "/wiki/" + "_".join(w.title() for w in some(5)) + "-2024-11-26-release", lambda: "".join(some(6)), lambda: str(uuid.UUID(int=rnd.getrandbits(128))), lambda: str(rnd.getrandbits(100)), lambda: "abcdefghijklmnopqrstuvwxyz0123456789", lambda: "A" * 30,
    ]
    out = (rnd.choice(kinds)() for _ in range(10 * n))
    return [t for t in out if len(t) >= 20 and not base(t)][:n]


def test_false_discoveries_and_recall(spark):
    """Held-out ordinary tokens and planted keys in one corpus: recall by alphabet, and the share of false discoveries."""
    rnd = random.Random(11)
    words = "the antidote of und mountain river table quickly ordinary text flows here station letter between garden winter paper silver market people water answer number company system program question government during history".split()
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    ordinary = ordinary_tokens(rnd, words, 1500)
    keys = [(name, prefix + "".join(rnd.choice(a) for _ in range(n))) for name, a in ALPHABETS.items() for n in (20, 31, 40, 64) for prefix in ("", "ghp_") for _ in range(8) if not (name == "hex" and n > 31)]
    rows = [(i, f"{prose(40)} {t} {prose(20)}") for i, t in enumerate(ordinary)] + [(10_000 + i, f"{prose(40)} {t} {prose(20)}") for i, (_, t) in enumerate(keys)]
    out = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ["doc_id"]).select("row.doc_id", "secrets").collect()
    found = {r.doc_id for r in out if r.secrets}
    false = sum(d < 10_000 for d in found)
    assert false <= 0.01 * len(found), (false, len(found))
    for name in ALPHABETS:
        at = [10_000 + i for i, (k, _) in enumerate(keys) if k == name]
        assert sum(d in found for d in at) >= 0.95 * len(at), name


def test_a_path_is_no_secret_in_a_small_table(spark):
    path = "https://example.org/path/Some_Long_Path_Element-2024-11-26-release"
    rows = [(i, f"the quick brown fox reads {path} and some other path element of a long release") for i in range(10)]
    assert not any(r.secrets for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect())


def test_battery_tells_random_from_prose():
    rnd = random.Random(1)
    random_fits = [secrets.candidates(t, [t])[0]["fits"] for t in (base64.b64encode(rnd.randbytes(33)).decode() for _ in range(300))]
    assert sum(random_fits) >= 290
    t = "internationalisationofordinarytextflowshere"
    assert max(secrets.battery(t, "base64")) > 10
    for name, a in list(ALPHABETS.items())[:-1]:
        # each test rejects about one random token of ten thousand
        tests = np.array([secrets.battery(t, secrets.infer(t)) for t in ("".join(rnd.choice(a) for _ in range(40)) for _ in range(2000))])
        assert (tests > secrets.REJECTED).mean(axis=0).max() <= 0.005, name
        assert {secrets.infer(t) for t in ("".join(rnd.choice(a) for _ in range(200)) for _ in range(20))} == {name}


def test_every_pair_of_a_text_counts():
    text = "Ab9 été" + "xy" * 5000
    want = Counter()
    fold = lambda b: "abcdefghijklmnopqrstuvwxyz0123456789".find(chr(b).lower()) % 37 if b < 128 else 36
    codes = [36, *map(fold, text.encode()), 36]
    for a, b in zip(codes, codes[1:]):
        want[37 * a + b] += 1
    got = secrets.pairs(text.encode())
    assert {i: int(n) for i, n in enumerate(got) if n} == want
    model = np.exp(secrets.text_model(got)).reshape(37, 37)
    assert np.allclose(model[:, :36].sum(axis=1), 1) and (model[:, 36] < 1).all()


def test_discoveries_against_plain_benjamini_hochberg(spark):
    """Added spans of a corpus, from p-values to the rule, by plain arithmetic."""
    rows = [r for r in corpus() if r[0] < 300] + [(400 + i, f"some words and {t} here") for i, t in enumerate(ordinary_tokens(random.Random(8), ["alpha", "beta", "gamma", "release"], 40))]
    got = {(r.doc_id, s.start, s.end) for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ["doc_id"]).select("row.doc_id", "secrets").collect() for s in r.secrets if s.kind == 3}
    model = secrets.text_model(sum(secrets.pairs(t.encode()) for _, t in rows))
    tried = []
    for d, t in rows:
        for c in secrets.candidates(t, t.split()):
            k = c["codes"]
            ratio = sum(model[37 * a + b] for a, b in zip(k, k[1:])) - c["chance"]
            tried.append((c["stratum"], math.floor(10 * min(300, max(0, -ratio / math.log(10)))) if c["fits"] else 0, d, c["start"], c["end"]))
    want = set()
    for s in range(4):
        bins = sorted((t[1] for t in tried if t[0] == s), reverse=True)
        bound = min((b for k, b in enumerate(bins, 1) if b and 10 ** (-b / 10) <= 0.01 * sum(x >= b for x in bins) / len(bins)), default=10**9)
        want |= {t[2:] for t in tried if t[0] == s and t[1] >= bound}
    covered = {(d, c, e) for d, t in rows for _, c, e in [(0, x[0], x[2]) for x in base(t)]}
    want = {w for w in want if not any(w[0] == d and s <= w[1] and e >= w[2] for d, s, e in covered)}
    assert got == want and len(want) >= 16


def test_names_with_dots(spark):
    frame = spark.createDataFrame([(1, "password=abcdefghij", 2, "x")], "doc_id long, text string, `a.b` int, `c``d` string")
    assert [tuple(r) for r in secrets.redact(frame).collect()] == [(1, "<secret>", 2, "x")] and secrets.redact(frame).columns == frame.columns
