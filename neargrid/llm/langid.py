"""Language identification: each document as a mixture of languages, by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed byte trigrams: slots of each language's model.
SLOTS = 1 << 16
#: Bytes that one segment, the unit of the mixture, has about; segments end at blanks.
SEGMENT = 48
STEPS = 25
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def grams(raw: bytes) -> np.ndarray:
    """The slot of the byte trigram that begins at each byte; the text is closed by blanks."""
    b = _FOLD[np.frombuffer(raw + b"  ", np.uint8)]
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """docs (text, lang) -> languages in order, log-likelihoods [slot, language], from all rows with text and lang.

    Each task counts the trigrams of its rows; counts are summed by language and slot, so SLOTS numbers a language
    reach the driver at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(SLOTS, np.int64)
                counts[lang] += np.bincount(grams(text.as_py()), minlength=SLOTS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at])], names=["lang", "slot", "n"])

    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND text <> ''").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = known.mapInArrow(run, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(sums.column("lang").to_pylist()))
    table = np.zeros((SLOTS, len(names)))
    place = {name: i for i, name in enumerate(names)}
    lang = np.array([place[x] for x in sums.column("lang").to_pylist()], np.int64)
    table[sums.column("slot").to_numpy(), lang] = sums.column("n").to_numpy()
    table = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * SLOTS))
    return names, np.maximum(table, -14.0).astype(np.float32)


def _mixture(like: np.ndarray, first: np.ndarray, doc: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For segments' likelihoods (scaled so that the best is 1) and documents' first segments: proportions, log-likelihood."""
    n = np.diff(np.append(first, len(like)))[:, None]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(STEPS):
        part = like * share[doc]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(part, first, axis=0) / n
    total = np.add.reduceat(np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-300)), first)
    return share, total


def proportions(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """[document, language]: proportions of the languages that the penalised likelihood keeps, 0 for the others.

    A segment's likelihood under a language is that of its trigrams. Sets of languages are the k of largest share in
    the mixture of all; each is fitted by expectation-maximisation, and the set with the best log-likelihood less
    half the log of the number of segments for each language after the first is kept.
    """
    languages = table.shape[1]
    out = np.zeros((len(texts), languages))
    full = [i for i, t in enumerate(texts) if t]
    if not full or not languages:
        return out
    scores, first, at = [], [], 0
    for i in full:
        raw = texts[i]
        g = table[grams(raw)]
        ends = np.flatnonzero(np.isin(np.frombuffer(raw, np.uint8), (32, 10, 9, 13)))
        at_least = np.searchsorted(ends, np.arange(SEGMENT, len(raw), SEGMENT))
        cut = ends[at_least[at_least < len(ends)]]
        starts = np.unique(np.concatenate([[0], cut]))
        scores.append(np.add.reduceat(g, starts, axis=0, dtype=np.float64))
        first.append(at)
        at += len(starts)
    score, start = np.concatenate(scores), np.array(first)
    like = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -600.0))
    n = np.diff(np.append(start, len(score)))
    top = score.argmax(axis=1)
    # one language is best in every segment: the mixture's maximum is that language alone
    alone = np.maximum.reduceat(top, start) == np.minimum.reduceat(top, start)
    got = np.zeros((len(full), languages))
    got[np.flatnonzero(alone), top[start[alone]]] = 1.0
    mixed = np.flatnonzero(~alone)
    if len(mixed):
        rows = np.flatnonzero(~alone[np.repeat(np.arange(len(full)), n)])
        like, sizes = like[rows], n[mixed]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        doc = np.repeat(np.arange(len(mixed)), sizes)
        share, value = _mixture(like, begin, doc, np.ones((len(mixed), languages)))
        order = np.argsort(-share, axis=1, kind="stable")
        chosen, bound = share, value - 0.5 * (languages - 1) * np.log(sizes + 1)
        for k in range(1, languages):
            allowed = np.zeros_like(share)
            np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
            part, value = _mixture(like, begin, doc, allowed)
            value = value - 0.5 * (k - 1) * np.log(sizes + 1)
            better = value >= bound
            chosen = np.where(better[:, None], part, chosen)
            bound = np.maximum(bound, value)
        got[mixed] = chosen
    out[full] = got
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, lang_pred, score, languages (map of kept languages' proportions), one per row.

    lang_pred has the largest proportion, score is that proportion; ties go to the first name. Null texts and texts
    without a letter are `und` with score 0 and no languages, as is everything if the model has no language.
    Repeated rows each keep a row; an empty table gives none; no other column is read.
    """
    names, table = model
    spread = docs.sparkSession.sparkContext.broadcast(table)  # SLOTS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t.encode() if t and _LETTER.search(t) else b"" for t in part.column(1).to_pylist()]
                share = proportions(texts, spread.value)
                top = share.argmax(axis=1) if names else np.zeros(len(texts), int)
                known = [bool(t) and bool(names) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([names[i] if k else "und" for i, k in zip(top, known, strict=True)], pa.string()),
                        pa.array([min(1.0, float(s[i])) if k else 0.0 for s, i, k in zip(share, top, known, strict=True)], pa.float64()),
                        pa.array([[(names[i], float(s[i])) for i in np.flatnonzero(s > 0)] if k else [] for s, k in zip(share, known, strict=True)], pa.map_(pa.string(), pa.float64())),
                    ],
                    names=["doc_id", "lang_pred", "score", "languages"],
                )

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, languages map<string,double>")
