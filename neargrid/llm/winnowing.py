"""Benchmark decontamination by winnowed fingerprints. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neargrid.llm.common import UPPER, ascii_lower, cut, quoted, row_key

#: Everything in ASCII but digits and lower-case letters parts words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark windows are broadcast up to this many rows and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
#: Windows with the same fingerprint that one row holds at most; more take several rows.
CHUNK = 256
#: Beyond the broadcast: longs of the Bloom filter of benchmark fingerprints at most, and parts that a fingerprint's rows are dealt into.
FILTER_LONGS = 1 << 20
SALTS = 8


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN_WORDS), "")


def _upto(n: Column) -> Column:
    """0 .. n-1; empty if n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(h: str, n: Column, k: int) -> Column:
    return F.transform(_upto(n - k + 1), lambda i: F.xxhash64(*(F.get(h, i + d) for d in range(k))))


def _window_table(bench: DataFrame, window: int, k: int) -> DataFrame:
    """Distinct benchmark windows: f (fingerprint), at (its place in the window), h (the words' hashes), items."""
    span = window - k + 1
    b = bench.select("item_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    b = b.withColumn("len", F.least(F.size("h"), F.lit(window))).where("len > 0")
    b = b.select("item_id", "len", F.explode(F.transform(_upto(F.size("h") - F.col("len") + 1), lambda i: F.slice("h", i + 1, F.col("len")))).alias("h"))
    b = b.groupBy("h", "len").agg(F.collect_set("item_id").alias("items"))
    b = b.withColumn("g", F.when(F.col("len") == window, _grams("h", F.lit(window), k)))
    b = b.withColumn("f", F.coalesce(F.array_min("g"), F.xxhash64("len", "h")))
    b = b.withColumn("at", F.coalesce((F.array_position("g", F.col("f")) - 1).cast("int"), F.lit(0)))
    assert span >= 1
    return cut(b.select("f", "at", "h", "len", "items"))


def _filter_place(f: Column, longs: int) -> tuple[Column, Column]:
    """The long of the Bloom filter that a fingerprint has, and its two bits there."""
    h = F.xxhash64(F.lit(3), f)
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, by).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    return F.pmod(h, F.lit(longs)).cast("int"), bit(40).bitwiseOR(bit(50))


def _filtered(rows: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """rows less most of those whose f is not in `known`; rows of pos -1 stay. Sixteen bits a fingerprint, up to FILTER_LONGS."""
    longs = min(FILTER_LONGS, max(64, 1 << (16 * n // 64).bit_length()))
    place, mask = _filter_place(F.col("f"), longs)
    bits = known.select(place.alias("_place"), mask.alias("_mask")).groupBy("_place").agg(F.bit_or("_mask").alias("_bits"))
    d = rows.select("*", place.alias("_place"), mask.alias("_mask")).join(F.broadcast(bits), "_place", "left")
    return d.where((F.col("pos") < 0) | (F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))).select(*rows.columns)


def hits(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """docs (doc_id, text, ...) x bench (item_id, text, ...) -> one row per document row.

    doc_id, k1, k2 (128 bits of doc_id and text), n_words, spans (array of {p, n}: every occurrence of a benchmark window, in words, sorted), items (the
    item_ids of these windows). A window is `window` consecutive words of an item; an item of fewer words, but not
    none, is one window.

    Winnowing: of each `window - k + 1` consecutive k-gram hashes the least is kept, on both sides. A shared window
    holds just that many k-grams, so its least one is kept in the document too: every shared window is found by the
    join of fingerprints. A hit is extended to its window by comparing all its words' 64-bit hashes. Short items
    have no such guarantee; the document's grams of their very lengths are joined instead.

    Null and empty texts have no words and no hits; texts of any length are read whole. Repeated rows each keep a
    row. An empty benchmark hits nothing, an empty table gives none. Other columns are ignored, whatever their names.
    Texts are read once and not shuffled; what is shuffled is one row per document and its hits, combined before the
    shuffle. A benchmark of over BROADCAST_ROWS windows is joined by a shuffle: a Bloom filter of its fingerprints
    drops the documents' others first, and a fingerprint that very many texts share is dealt into SALTS parts.
    """
    span = window - k + 1
    table = _window_table(bench, window, k)
    short = sorted(r["len"] for r in table.where(F.col("len") < window).select("len").distinct().collect())  # under `window` values
    sizes = table.groupBy("f").agg(F.count(F.lit(1)).alias("n")).select("f", F.ceil(F.col("n") / CHUNK).alias("s"))
    known = table.join(sizes, "f").withColumn("c", F.pmod(F.xxhash64("h"), "s"))
    known = cut(known.groupBy("f", "c").agg(F.collect_list(F.struct("at", "h", "len", "items")).alias("windows")).select("f", "windows"))
    n = table.count()
    small = n <= BROADCAST_ROWS and table.agg(F.sum(F.size("items"))).first()[0] in range(4 * BROADCAST_ROWS + 1)

    d = docs.select("doc_id", *row_key("doc_id", "text"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    d = d.withColumn("n", F.size("h"))
    d = d.withColumn("g", F.when(F.col("n") >= window, _grams("h", F.col("n"), k)).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("m", F.transform(_upto(F.size("g") - span + 1), lambda i: F.least(*(F.get("g", i + j) for j in range(span)))))
    kept = F.filter(_upto(F.size("g")), lambda i: F.array_contains(F.slice("m", F.greatest(i - span + 2, F.lit(1)), F.least(i + 1, F.lit(span))), F.get("g", i)))

    def mark(f: Column, pos: Column, lo: Column, h: Column) -> Column:
        return F.struct(f.alias("f"), pos.alias("pos"), lo.alias("lo"), h.alias("h"))

    found = F.transform(kept, lambda i: mark(F.get("g", i), i, F.greatest(i - span + 1, F.lit(0)), F.slice("h", F.greatest(i - span + 2, F.lit(1)), window + span - 1)))
    base = F.array(mark(F.col("k1"), F.lit(-1), F.lit(0), F.array().cast("array<bigint>")))  # a row for each document, hit or not
    gram = lambda n: lambda i: mark(F.xxhash64(F.lit(n), F.slice("h", i + 1, n)), i, i, F.slice("h", i + 1, n))
    by_length = [F.transform(_upto(F.col("n") - n + 1), gram(n)) for n in short]
    rows = d.select("doc_id", "k1", "k2", "n", F.explode(F.concat(base, found, *by_length)).alias("x")).select("doc_id", "k1", "k2", "n", "x.*")
    if small:
        known, on = F.broadcast(known), ["f"]
    else:
        rows = _filtered(rows, known, n).withColumn("salt", F.pmod(F.xxhash64("k2", "pos"), F.lit(SALTS)))
        known, on = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["f", "salt"]

    same = F.filter("windows", lambda w: (F.col("pos") >= w["at"]) & (F.slice("h", F.greatest(F.col("pos") - w["at"] - F.col("lo") + 1, F.lit(1)), w["len"]) == w["h"]))
    rows = rows.join(known, on, "left").withColumn("same", F.when(F.col("pos") >= 0, same))
    rows = rows.where((F.col("pos") < 0) | (F.size("same") > 0))
    rows = rows.select(
        "doc_id", "k1", "k2", "n", (F.col("pos") < 0).cast("int").alias("base"),
        F.when(F.col("pos") >= 0, F.transform("same", lambda w: F.struct((F.col("pos") - w["at"]).alias("p"), w["len"].alias("n")))).alias("spans"),
        F.when(F.col("pos") >= 0, F.array_distinct(F.flatten(F.transform("same", lambda w: w["items"])))).alias("items"),
    )
    out = rows.groupBy("doc_id", "k1", "k2", "n").agg(F.sum("base").cast("int").alias("copies"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc_id", "k1", "k2", F.col("n").cast("bigint").alias("n_words"), "spans", "items")


def covered(spans: str) -> Column:
    """Words inside any of the sorted spans {p, n}."""
    start = F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("upto"))

    def step(a: Column, x: Column) -> Column:
        end = (x["p"] + x["n"]).cast("bigint")
        return F.struct((a["words"] + F.greatest(end - F.greatest(a["upto"], x["p"].cast("bigint")), F.lit(0).cast("bigint"))).alias("words"), F.greatest(a["upto"], end).alias("upto"))

    return F.aggregate(spans, start, step)["words"]


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows of docs that share no window with the benchmark, all columns kept, whatever their names.

    Cases as in `hits`: null and empty texts and all of a table without a benchmark stay, repeated rows stay or go
    together. Texts are not shuffled while at most BROADCAST_ROWS rows are hit, and once beyond.
    """
    hit = cut(hits(docs, bench, window, k).where(F.size("spans") > 0).select("k1", "k2").distinct())
    if hit.count() <= BROADCAST_ROWS:
        hit = F.broadcast(hit)
    k1, k2 = "_winnowing_k1", "_winnowing_k2"
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(row_key("doc_id", "text"), (k1, k2), strict=True)))
    return keyed.join(hit, (keyed[k1] == hit["k1"]) & (keyed[k2] == hit["k2"]), "left_anti").select(*(quoted(c) for c in docs.columns))


#: Exact windows, word by word: no hashes, no fingerprints.
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
    WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark
    ), bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0
    ), d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
    ), dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw))
    ), h AS (SELECT DISTINCT r, p, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
    ), x AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS at FROM h) GROUP BY r
    ), i AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN x USING (r) LEFT JOIN i USING (r)"""
