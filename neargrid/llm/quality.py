"""Quality by importance resampling: how much likelier a text is under a model of good text than under all text."""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neargrid.llm.common import fields, quoted, row_schema, stored

#: Hashed byte trigrams, and two more slots: a word that equals the word before it, and one that does not.
HASHED = 1 << 16
AGAIN, FRESH = HASHED, HASHED + 1
SLOTS = HASHED + 2
#: What a gram follows: two bytes, or (the last one) a word.
AFTER_WORD = 1 << 16
CONTEXTS = AFTER_WORD + 1
#: Counts of a gram in a text are over the square root of its length, in these units, so that sums are exact.
UNIT = 1 << 20
#: The target model's grams follow the raw model as this share of the target's mass would.
PRIOR = 2e-5
#: Labelled rows that the target model is fitted on at most, least hashes first.
LABELLED = 20_000
#: Grams that a text counts as, whatever its length: neighbouring grams depend on each other, so a long text says little more than a short one.
EFFECTIVE = 50.0
#: Bins of one step of the search for the k-th key.
BINS = 4096
#: Rows whose texts are Python objects at once.
SLICE = 512


def grams(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots, contexts, and the number of byte grams: each byte after the two before it, then each word after the one before."""
    b = np.frombuffer(b"  " + raw + b" ", np.uint8).astype(np.uint32)
    context = b[:-2] << np.uint32(8) | b[1:-1]
    h = context * np.uint32(0x9E3779B1) ^ b[2:] * np.uint32(0x85EBCA77)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    words = raw.split()
    again, pairs = sum(map(operator.eq, words, words[1:])), max(0, len(words) - 1)
    word = np.full(pairs, FRESH, np.uint32)
    word[:again] = AGAIN
    return np.concatenate([h, word]), np.concatenate([context, np.full(pairs, AFTER_WORD, np.uint32)]), len(h)


def counts(slot: np.ndarray, context: np.ndarray, n: int) -> np.ndarray:
    """What a text adds to a model: its slots' counts, then its contexts'."""
    return np.concatenate([np.bincount(slot, minlength=SLOTS), np.bincount(context, minlength=CONTEXTS)]) * int(UNIT / n**0.5)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            yield part, part.column(column).cast(pa.binary()).to_pylist()


def models(docs: DataFrame) -> np.ndarray:
    """docs (text, quality) -> counts [target or raw, slot, then context]: raw is every row with a text, target those of quality 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SLOTS + CONTEXTS), np.int64)
        for part, texts in _texts(batches, 0):
            for text, quality in zip(texts, part.column(1).to_pylist(), strict=True):
                c = counts(*grams(text))
                sums[1] += c
                if quality == 1:
                    sums[0] += c
        for which, slots in enumerate(sums):
            at = np.flatnonzero(slots)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), which), pa.int32()), pa.array(at, pa.int32()), pa.array(slots[at])], names=["which", "slot", "n"])

    total = docs.where(~blank(F.col("text"))).mapInArrow(run, "which int, slot int, n bigint").groupBy("which", "slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((2, SLOTS + CONTEXTS))
    table[total.column("which").to_numpy(), total.column("slot").to_numpy()] = total.column("n").to_numpy()
    return table


def log_ratio(table: np.ndarray, slot: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Each gram's log-probability after its context under the target model, less that under the raw one.

    The raw model lends the target model its grams, so that a context which good text has not shown says nothing.
    """
    target, raw = table
    t, t_all, r, r_all = target[slot], target[SLOTS + context], raw[slot], raw[SLOTS + context]
    p = r / np.maximum(np.maximum(r_all, r), 1.0)  # slots may be shared, so a gram may be counted more often than its context
    lent = max(PRIOR * target[:SLOTS].sum(), 1e-9)
    return np.log((t + lent * p) / (np.maximum(t_all, t) + lent)) - np.log(np.maximum(p, 1e-300))


def blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"\S"), F.lit(True))


def draw(log_weight: Column, noise: Column, temperature: float = 1.0) -> Column:
    """A Gumbel key: rows with the k largest are a draw without replacement in proportion to weights. noise: a hash, 64 bits."""
    even = F.shiftrightunsigned(noise, 11).cast("double") / float(1 << 53) + 1e-17
    return log_weight / temperature - F.log(-F.log(even))


def _kth(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest key, by histograms of BINS counts each: no sort, and no keys on the driver."""
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    while True:
        width = (hi - lo) / BINS
        if width <= 0 or lo + width == lo:
            return lo
        part = rows.where((F.col(key) >= lo) & (F.col(key) <= hi)).groupBy(F.least(F.floor((F.col(key) - lo) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for r in sorted(part, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        if above + r["n"] == k or r["lo"] == r["hi"]:
            return r["lo"]
        lo, hi = r["lo"], r["hi"]


def resample(docs: DataFrame, labels: DataFrame, carry: list[str], fraction: float | None = None, temperature: float = 1.0, keep: float = 0.999, seed: int = 4) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, quality, ...) -> row (struct of `carry`), log_weight, key, sampled.

    Both models generate a text byte by byte, each byte after the two before it (in hashed slots), and say of each
    word whether it repeats the one before. The target's is fitted on documents labelled of quality 1 (of LABELLED labelled rows at most, the
    documented bound), the raw one on all documents. A text's log importance weight is EFFECTIVE times the mean
    log-ratio of its grams. Keys are weights over `temperature` plus Gumbel noise from a hash of the row, and the
    rows with the k largest keys are sampled: a draw without replacement in proportion to the weights. k is
    `fraction` of the rows that have a weight. None stands for the number of rows that weigh as much as good text
    does: as the share `keep` of the good labelled rows, each weighed as if it had not been fitted on. No score and
    no label of a bad row sets k.

    Null, empty and blank texts weigh nothing (null) and are never sampled. Without a good label there is no target
    model: every other text weighs 0 and, unless `fraction` says how many, is sampled. Rows that tie for the last
    place are sampled together; repeated rows (doc_id and text equal) have equal keys. An empty table gives no rows.
    Labels without a document count for nothing; with several labels of one document the best holds; a row is
    counted for each text of a labelled id. Other columns, whatever their names, are carried only if asked for.
    Texts of any length are read twice, whole, and not shuffled; the k-th key is found by counting.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("_quality"))
    known = F.broadcast(known.withColumnRenamed("doc_id", "_id").orderBy(F.xxhash64("_id"), "_id").limit(LABELLED))
    source = docs.select(fields(carry).alias("row"), quoted("doc_id").alias("_id"), quoted("text").cast("string").alias("text"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("noise"))
    source = source.join(known, "_id", "left").select("row", "text", F.col("_quality").alias("quality"), "noise", F.when(F.col("_quality").isNotNull(), F.xxhash64("_id")).alias("id"))
    table = models(source.select("text", "quality"))
    fitted = bool(table[0].any())
    spread = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spread.value

        def weight(text: bytes | None, own: bool) -> float | None:
            if text is None or not text.strip() or not fitted:
                return None if text is None or not text.strip() else 0.0
            slot, context, n = grams(text)
            model = table - np.stack([counts(slot, context, n), np.zeros(SLOTS + CONTEXTS)]) if own else table
            return float(log_ratio(model, slot, context).sum()) / n * EFFECTIVE

        for part, texts in _texts(batches, 1):
            quality = part.column(2).to_pylist()
            without = [weight(t, True) if q == 1 else None for t, q in zip(texts, quality, strict=True)]  # LABELLED ids at most
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array([weight(t, False) for t in texts], pa.float64()), pa.array(without, pa.float64()), part.column(4)], names=["row", "noise", "log_weight", "without", "id"])

    rows = stored(source.mapInArrow(run, row_schema(source.schema["row"].dataType, "noise bigint, log_weight double, without double, id bigint")))
    rows = rows.withColumn("key", draw(F.col("log_weight"), F.col("noise"), temperature))
    weighed = rows.where("key IS NOT NULL").select("key", "log_weight")
    if fraction is None:
        good = rows.where("without IS NOT NULL").groupBy("id").agg(F.min("without").alias("w")).select("w").toArrow().column("w").to_numpy()  # a number an id
        least = float(np.quantile(good, 1 - keep, method="lower")) if fitted else -np.inf
        k = weighed.where(F.col("log_weight") >= least).count()
    else:
        k = round(fraction * weighed.count())
    least = _kth(weighed, "key", k) if k else float("inf")
    return rows.select("row", "log_weight", "key", F.coalesce(F.col("key") >= least, F.lit(False)).alias("sampled"))


def select_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that `resample` samples, all columns kept, whatever their names; cases as there.

    So null, empty and blank texts go, repeated rows stay or go together, and an empty table gives no rows.
    """
    return resample(docs, labels, docs.columns).where("sampled").select(*(quoted("row", c).alias(c) for c in docs.columns))
