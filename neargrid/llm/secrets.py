"""Secret scan: fixed formats, and tokens that a randomness test battery tells from ordinary text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neargrid.llm.common import fields, quoted, row_schema, stored

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
CANDIDATE = re.compile("[A-Za-z0-9+/_-]{20,}={0,2}")
PIECE = re.compile("[A-Za-z0-9]{20,}")
PREFIX = re.compile("[A-Za-z0-9]{1,8}[_-]")
_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets by which a token is read, the narrowest first; each symbol's value is its place.
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "hex_upper": _DIGITS + "ABCDEF",
    "hex_mixed": _DIGITS + "abcdefABCDEF",
    "base32": _UP + "234567",
    "base36": _DIGITS + _LOW,
    "base36_upper": _DIGITS + _UP,
    "base62": _UP + _LOW + _DIGITS,
    "base64": _UP + _LOW + _DIGITS + "+/",
}
VALUES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
VALUES["base64"] |= {"-": 62, "_": 63}
#: Least lengths of the strata within which discoveries are controlled.
STRATA = (20, 32, 48, 96)
#: No test of the battery may reject randomness at 1e-4: the square of a normal deviate.
REJECTED = 15.1
#: Text is modelled by pairs of these: letters of either case, digits, and one for everything else.
LETTERS = 37
OTHER = LETTERS - 1
_CODES = {c: i for i, c in enumerate(_LOW + _DIGITS)}
CODE = bytes(_CODES.get(chr(b).lower(), OTHER) if b < 128 else OTHER for b in range(256))


def _chance(alphabet: str) -> list[float]:
    """log-probability of each of LETTERS in a random token; the 37th is that of both marks."""
    n = [sum(_CODES.get(c.lower(), OTHER) == i for c in alphabet) for i in range(LETTERS)]
    return [math.log(k / len(alphabet)) if k else -99.0 for k in n]


CHANCE = {name: _chance(a) for name, a in ALPHABETS.items()}
CANDIDATE_TYPE = "array<struct<start:int,end:int,stratum:int,codes:array<int>,chance:double,fits:boolean>>"


def infer(token: str) -> str:
    for name, values in VALUES.items():
        if values.keys() >= set(token):
            return name
    return "base64"


def _kind(c: str) -> int:
    return 0 if c in _UP else 1 if c in _LOW else 2 if c in _DIGITS else 3


_SAME_KIND = {name: sum((sum(_kind(c) == k for c in a) / len(a)) ** 2 for k in range(4)) for name, a in ALPHABETS.items()}


def battery(token: str, alphabet: str) -> tuple[float, ...]:
    """Squared normal deviates of a token from uniform, independent symbols.

    Chi-squared: the alphabet's symbols in as many equal bins as leave five expected in each, two at least; Wilson and
    Hilferty's cube root makes it a deviate, of which only an excess counts. Runs: of symbols in the upper and lower
    half of the alphabet, and of kinds (capitals, small letters, digits, marks). Serial correlation at lag one. Marks:
    an excess of those that part words elsewhere.
    """
    value, size, n = VALUES[alphabet], len(ALPHABETS[alphabet]), len(token)
    v = [value[c] for c in token]
    bins = max(2, min(size, 1 << max(0, (n // 5).bit_length() - 1)))
    count, width = [0] * bins, [0] * bins
    for x in v:
        count[x * bins // size] += 1
    for x in range(size):
        width[x * bins // size] += 1
    chi = sum(c * c * size / (w * n) for c, w in zip(count, width, strict=True)) - n
    df = bins - 1
    z = ((max(chi, 0.0) / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))
    half = [2 * x >= size for x in v]
    high = sum(half)
    low = n - high
    if high and low:
        runs = 1 + sum(a != b for a, b in zip(half, half[1:], strict=False))
        mean = 2 * high * low / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        r = (runs - mean) / math.sqrt(var)
    else:
        r = math.sqrt(n)
    m = sum(v) / n
    d = [x - m for x in v]
    s = sum(x * x for x in d)
    c = sum(a * b for a, b in zip(d, d[1:], strict=False)) / s * math.sqrt(n) if s else math.sqrt(n)
    kinds = [_kind(x) for x in token]
    p = 1 - _SAME_KIND[alphabet]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    k = (changes - (n - 1) * p) / math.sqrt((n - 1) * p * (1 - p))
    marks = max(0.0, kinds.count(3) - n / 32) / math.sqrt(n / 32 * 31 / 32)
    return max(z, 0.0) ** 2, r * r, c * c, k * k, marks * marks


def base_spans(text: str, words: list[str] | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed formats, by kind and start."""
    found = []
    if "=" in text or ":" in text:
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    at = 0
    for w in text.split() if words is None else words:
        if len(w) >= 32:
            at = text.index(w, at)  # words between are shorter, so they don't hold this one
            found += [(2, at + m.start(), at + m.end()) for m in HEX.finditer(w)]
            at += len(w)
    return found


def candidate(token: str, start: int) -> dict:
    alphabet = infer(token)
    codes = token.encode().translate(CODE)
    both = bool({"+", "/"} & set(token)) and bool({"-", "_"} & set(token))  # of two variants of base64, so of none
    fits = not both and max(battery(token, alphabet)) < REJECTED
    return {"start": start, "end": start + len(token), "stratum": sum(len(token) >= s for s in STRATA) - 1, "codes": [OTHER, *codes], "chance": sum(CHANCE[alphabet][c] for c in codes), "fits": fits}


def candidates(text: str, words: list[str]) -> list[dict]:
    """Tokens of 20 symbols and more, with `fits`: no test of the battery rejects.

    A token may have a prefix or be a path. Its readings are the whole, the rest after a short prefix, and its
    unbroken pieces. Those that fit an alphabet of one case come first, then the whole, then the others that fit.
    """
    found, at = [], 0
    for w in words:
        if len(w) < STRATA[0]:
            continue
        at = text.index(w, at)
        for m in CANDIDATE.finditer(w):
            token, start = m[0].rstrip("="), at + m.start()
            whole = candidate(token, start)
            prefix = PREFIX.match(token)
            rest = [candidate(token[prefix.end() :], start + prefix.end())] if prefix and len(token) - prefix.end() >= STRATA[0] else []
            pieces = [candidate(p[0], start + p.start()) for p in PIECE.finditer(token) if p[0] != token]
            narrow = [c for c in pieces if c["fits"] and infer(token[c["start"] - start : c["end"] - start]) not in ("base62", "base64")]
            found += narrow or (not whole["fits"] and ([c for c in rest if c["fits"]] or pieces)) or [whole | {"end": at + m.end()}]
        at += len(w)
    return found


def pairs(text: bytes) -> np.ndarray:
    """How often each of LETTERS follows each, as LETTERS * first + second; the text is closed by `OTHER`."""
    v = np.frombuffer((b" " + text + b" ").translate(CODE), np.uint8).astype(np.int32)
    return np.bincount(v[:-1] * LETTERS + v[1:], minlength=LETTERS * LETTERS)


def text_model(counts: np.ndarray) -> np.ndarray:
    """Pair counts -> log-probability of the second after the first; of a letter or digit, given that the word goes on.

    Half a count is added to each, so a small table says little.
    """
    table = counts.reshape(LETTERS, LETTERS) + 0.5
    ends = table[:, OTHER] / table.sum(axis=1)
    table = table / table[:, :OTHER].sum(axis=1, keepdims=True)
    table[:, OTHER] = ends
    return np.log(table).ravel()


def _scan(docs: DataFrame, carry: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = np.zeros(LETTERS * LETTERS, np.int64), None

        def out(columns: list, seen: list[int] | None) -> pa.RecordBatch:
            sums = [seen, *[None] * (len(columns[0]) - 1)]  # one row of a task has the sums of all
            return pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.list_(pa.int64()))], names=["row", "base", "found", "pairs"])

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                base, found = [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    words = text.split()
                    base.append([{"kind": k, "start": s, "end": e} for k, s, e in base_spans(text, words)])
                    found.append(candidates(text, words))
                    total += pairs(text.encode())
                if last:
                    yield out(last, None)
                last = [part.column(0), pa.array(base, span), pa.array(found, token)]
        if last:
            yield out(last, total.tolist())

    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    token = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("codes", pa.list_(pa.int32())), ("chance", pa.float64()), ("fits", pa.bool_())]))
    source = docs.select(fields(carry).alias("row"), quoted("text").cast("string").alias("text"))
    return source.mapInArrow(run, row_schema(source.schema["row"].dataType, f"base array<struct<kind:int,start:int,end:int>>, found {CANDIDATE_TYPE}, pairs array<bigint>"))


def find_secrets(docs: DataFrame, carry: list[str], q: float = 0.01) -> DataFrame:
    """(text, ...) -> `row` (struct of the columns `carry`), `base`, `secrets`: arrays {start, kind, end, name}, sorted.

    `base` are the fixed formats; `secrets` are these and tokens of kind random. Offsets are code points, ends are
    exclusive. A token of 20 symbols and more is read by the narrowest alphabet that has all its symbols, and tested
    for uniform, independent symbols by `battery`; where a test rejects, so that there may be a prefix or a path, its
    unbroken pieces are tested instead. What no test rejects is a secret if ordinary text would hardly be so: its
    p-value is the likelihood ratio of the table's own text, a chain of letters (either case), digits and gaps fitted
    on every pair in every text, to the random alphabet. By Markov's inequality a token of such text has a ratio of p or
    less with a probability of p at most, whatever its length. Within each stratum of lengths, Benjamini and Hochberg's
    rule over all candidates of the table keeps the share of false discoveries under `q`; it works on a histogram of
    tenths of -log10 p, rounded to the safe side. Tokens inside a base span add nothing. The same rules hold at every size: a
    small table has a vaguer model of text, whose p-values are larger.

    Null and empty texts have no spans; texts of any length are read whole. Repeated rows and ties each keep their row
    and spans; an empty table gives no rows; other columns, whatever their names, are carried only if asked for. The
    text is read once.
    """
    rows = stored(_scan(docs, carry))
    parts = range(len(STRATA))
    seen = rows.where("pairs IS NOT NULL").select(F.posexplode("pairs").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()  # LETTERS squared rows
    counts = np.zeros(LETTERS * LETTERS)
    for r in seen:
        counts[r["i"]] = r["n"]
    model = F.lit([float(x) for x in text_model(counts)])

    def evidence(c: Column) -> Column:
        """-log10 of the p-value."""
        n = F.size(c["codes"])
        steps = F.zip_with(F.slice(c["codes"], F.lit(1), n - 1), F.slice(c["codes"], F.lit(2), n - 1), lambda a, b: F.get(model, a * LETTERS + b))
        ratio = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) - c["chance"]
        return F.when(c["fits"], F.least(F.greatest(-ratio / math.log(10), F.lit(0.0)), F.lit(300.0))).otherwise(0.0)

    tokens = rows.where(F.size("found") > 0).select(F.explode("found").alias("c")).select("c.stratum", F.floor(10 * evidence(F.col("c"))).cast("int").alias("bin"))
    histogram: list[dict[int, int]] = [{} for _ in parts]
    for r in tokens.groupBy("stratum", "bin").count().collect():  # 4 x 3001 rows at most
        histogram[r["stratum"]][r["bin"]] = r["count"]
    least = []
    for h in histogram:
        k, bound, total = 0, 1e9, sum(h.values())
        for b in sorted(h, reverse=True):
            k += h[b]
            if b and -b / 10 <= math.log10(q * k / total):
                bound = b / 10
        least.append(bound)

    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    span = lambda s, k, e: F.struct(s.alias("start"), k.alias("kind"), e.alias("end"), name(k).alias("name"))
    base = F.transform("base", lambda s: span(s["start"], s["kind"], s["end"]))
    passes = lambda c: evidence(c) >= F.get(F.array(*(F.lit(float(x)) for x in least)), c["stratum"])
    fresh = F.filter("found", lambda c: passes(c) & ~F.exists("base", lambda s: (s["start"] <= c["start"]) & (s["end"] >= c["end"])))
    added = F.transform(fresh, lambda c: span(c["start"], F.lit(3), c["end"]))
    return rows.select("row", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, added)).alias("secrets"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with every secret in `text` replaced by `mark` (overlapping spans by one) and n_chars, if any, set anew.

    All columns are kept, whatever their names, and all rows: repeated ones, and those of null (null again) and empty
    texts. Cases as in `find_secrets`; an empty table gives no rows.
    """
    columns = docs.columns
    found = find_secrets(docs, columns)

    def clean(text: str | None, spans: list[dict]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for s in spans:
            if s["start"] >= at:
                out += [text[at : s["start"]], mark]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                text = [clean(t, s) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], names=["row", "text"])

    others = [c for c in columns if c != "text"]
    rest = F.struct(*(quoted("row", c).alias(c) for c in others)) if others else F.struct(F.lit(0).alias("_"))
    rows = found.select(rest.alias("row"), quoted("row", "text").alias("text"), "secrets")
    rows = rows.mapInArrow(run, row_schema(rows.schema["row"].dataType, "text string"))
    out = rows.select(*(F.col("text") if c == "text" else quoted("row", c).alias(c) for c in columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
