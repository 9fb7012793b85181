"""Packing of tokenised documents into sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import base64
import heapq
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neargrid.llm.common import cut, stored

#: Words whose ids a worker keeps at hand, about 200 bytes each.
WORDS_KEPT = 600_000
#: Rank offsets and slots are broadcast up to this many rows and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Texts with these go to the tokenizer itself: its special token, and blanks that libraries may class differently.
_ODD_ASCII = ("<|endoftext|>", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_ODD_OTHER = ("\x85", "\xa0", "\u1680", "\u180e", "\u3000", "\ufeff", *map(chr, range(0x2000, 0x2010)), "\u2028", "\u2029", "\u202f", *map(chr, range(0x205F, 0x2065)))
#: Repeated blanks join into tokens, so these texts are not taken apart.
_RUNS = ("  ", " \n", " \r", " \t", "\n\n", "\n\r", "\n\t", "\t\n", "\r\n")


class ByteBpe(dict):
    """Ids of texts as little-endian unsigned 32-bit integers, equal to those of the tokenizer in byte_bpe_50k.json.

    No token crosses the start of a blank before a non-blank, nor that of a single line end, so words are looked up
    one by one: key `word` holds the ids of " word", key "\\nword" those of itself. Once WORDS_KEPT words are held,
    others are computed each time. Odd texts go to the tokenizer whole.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.words._core_bpe.encode_single_piece
        self.mark = {c: self.plain(c) for c in ".,;:!?"}

    def plain(self, text: str) -> bytes:
        return array("I", self.words.encode_ordinary(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            got = array("I", self.piece(f" {word}".encode())).tobytes()
        elif word[-1:] in self.mark and word[:-1].isalpha():
            got = self[word[:-1]] + self.mark[word[-1]]
        else:
            got = self.plain(word if word[:1] == "\n" else f" {word}")
        if len(self) < WORDS_KEPT and len(word) <= 64:
            self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(c in text for c in _ODD_ASCII) or not text.isascii() and any(c in text for c in _ODD_OTHER):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if text[-1] in " \n\r\t" or any(c in text for c in _RUNS):
            return self.plain(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))


def tokenised(docs: DataFrame, size: int, end_id: int, tokenizer: tuple[str, str]) -> DataFrame:
    """One row per document row: its full pieces' checksums, its rest with ids, and places among the task's rows.

    task, full_at (full pieces of earlier rows in the task), rest_at (rows of earlier rests of this length there).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, full, seen = ByteBpe(*tokenizer), TaskContext.get().partitionId(), 0, defaultdict(int)
        end, step = end_id.to_bytes(4, "little"), 4 * size
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for doc_id, text in zip(*(b.column(i).slice(at, 256).to_pylist() for i in (0, 1)), strict=True):
                    ids = bpe.ids(text or "") + end
                    n = len(ids) // step
                    rest = ids[n * step :]
                    rows.append((doc_id, len(ids) // 4, [zlib.crc32(ids[i * step : (i + 1) * step]) for i in range(n)], len(rest) // 4, rest, task, full, seen[len(rest)]))
                    full += n
                    seen[len(rest)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [b.schema.field(0).type, pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "doc_tokens", "full_crc", "rest", "rest_ids", "task", "full_at", "rest_at"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, doc_tokens bigint, full_crc array<bigint>, rest int, rest_ids binary, task int, full_at bigint, rest_at bigint")


def patterns(histogram: dict[int, int], size: int, least_gap: int = 16) -> tuple[list[tuple], list[tuple], int]:
    """Shortest-pack-first over the histogram {length: count}, all lengths under `size`: slots, fills, sequences.

    Longest lengths are placed first, each into the open pattern with the least tokens if it fits there, else into a
    new one; a pattern that is met by fewer documents than it has sequences is split by count. A slot (length, first
    rank, past rank, sequence, offset) says that the document of rank first + k is in sequence + k.

    Gaps of `least_gap` tokens and more are then filled: laid end to end they make one line, and so do the documents
    of the emptiest sequences, as many as fit. A fill (length, first, past, document line, gap, gap line, past gap
    line, sequence, offset) has where the first document and the first gap of two classes begin on the line; where a
    document overlaps gaps, it is cut. Gaps of that size thus keep fewer than `size` tokens of padding in all. The
    work depends on the number of different lengths, not on that of documents.
    """
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)  # by tokens: (count, [(length, rank)])
    used: list[int] = []  # a heap of the keys
    shift = lambda slots, n: [(length, rank + n) for length, rank in slots]

    def put(tokens: int, count: int, slots: list[tuple[int, int]]) -> None:
        if not open_[tokens]:
            heapq.heappush(used, tokens)
        open_[tokens].append((count, slots))

    for length in sorted(histogram, reverse=True):
        left, rank, fresh = histogram[length], 0, []
        while left:
            tokens = used[0] if used else size
            if tokens + length > size:
                per = size // length
                whole, more = divmod(left, per)
                if whole:
                    fresh.append((per * length, whole, [(length, rank + i * whole) for i in range(per)]))
                if more:
                    fresh.append((more * length, 1, [(length, rank + per * whole + i) for i in range(more)]))
                break
            count, slots = open_[tokens].pop()
            if not open_[tokens]:
                heapq.heappop(used)
            n = min(count, left)
            if count > n:
                put(tokens, count - n, shift(slots, n))
            fresh.append((tokens + length, n, [*slots, (length, rank)]))
            left, rank = left - n, rank + n
        for pattern in fresh:
            put(*pattern)

    packs = sorted(((tokens, count, slots) for tokens, found in open_.items() for count, slots in found), key=lambda p: -p[0])
    whole, short = [p for p in packs if size - p[0] < least_gap], [p for p in packs if size - p[0] >= least_gap]
    room, emptied = sum(count * (size - tokens) for tokens, count, _ in short), []
    while short and room >= size:  # a sequence that is emptied takes its gap from the line and adds its tokens to it
        tokens, count, docs = short.pop()
        n = min(count, room // size)
        emptied.append((n, docs))
        if n < count:
            short.append((tokens, count - n, shift(docs, n)))
        room -= n * size

    slots, fills, base, line, gaps = [], [], 0, 0, []
    for tokens, count, docs in whole + short[::-1]:  # the widest gaps first
        offset = 0
        for length, rank in docs:
            slots.append((length, rank, rank + count, base, offset))
            offset += length
        if size - tokens >= least_gap:
            gaps.append((size - tokens, line, line + count * (size - tokens), base, tokens))
            line = gaps[-1][2]
        base += count
    at, line = 0, 0
    for n, docs in emptied:
        for length, rank in docs:
            end = line + n * length
            while at < len(gaps) and gaps[at][1] < end:
                gap, begins, ends, sequence, offset = gaps[at]
                first = max(0, (begins - line) // length)
                fills.append((length, rank + first, rank + min(n, -(-(ends - line) // length)), line + first * length, gap, begins, ends, sequence, offset))
                if ends > end:
                    break
                at += 1
            line = end
    return slots, fills, base


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, text, ...) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokenizer ids and `end_id`. Whole runs of `size` ids are sequences of their own; the rests are
    packed by `patterns` over the histogram of their lengths (under `size` numbers on the driver) and joined back by
    rank among the documents of a length. The rank is a row's place among its task's rows plus an offset for the
    task, so that no task sorts or holds the documents of a common length. Ids are written once, with the rests'
    ids alone, and never shuffled. Null and empty texts are the one id `end_id`; repeated rows are packed one by
    one; an empty table gives no rows; other columns are ignored.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    spark = docs.sparkSession
    rows = stored(tokenised(docs, size, end_id, tokenizer))

    counts = rows.where("rest > 0").groupBy("rest", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.unionByName(rows.groupBy(F.lit(0).alias("rest"), "task").agg(F.sum(F.size("full_crc")).alias("n"))))
    total = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    n_full = total.pop(0, 0) or 0
    slots, fills, _ = patterns(total, size)
    slots = spark.createDataFrame(slots, "rest int, first bigint, past bigint, sequence bigint, at int")
    fills = spark.createDataFrame(fills, "rest int, first bigint, past bigint, line bigint, gap int, begins bigint, ends bigint, sequence bigint, at int")

    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = cut(offsets.select("rest", "task", F.coalesce("before", F.lit(0)).cast("bigint").alias("before")))
    small = F.broadcast if offsets.count() <= BROADCAST_ROWS else lambda x: x
    full_before = offsets.where("rest = 0").select("task", F.col("before").alias("full_before"))

    whole = rows.join(small(full_before), "task").select("doc_id", "doc_tokens", (F.col("full_at") + F.col("full_before")).alias("first"), F.posexplode("full_crc").alias("i", "ids_crc32"))
    whole = whole.select("doc_id", (F.col("i").cast("bigint") * size).alias("start"), F.lit(size).cast("bigint").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = rows.where("rest > 0").join(small(offsets.where("rest > 0")), ["rest", "task"]).withColumn("rank", F.col("rest_at") + F.col("before"))
    placed = rest.join(F.broadcast(slots), "rest").where("rank >= first AND rank < past")  # as many slots as different lengths, about
    placed = placed.select("doc_id", "doc_tokens", "rest", "rest_ids", F.lit(0).alias("p"), F.col("rest").alias("n"), (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence"), "at")
    cut_up = rest.join(F.broadcast(fills), "rest").where("rank >= first AND rank < past")
    cut_up = cut_up.withColumn("a", F.expr("line + (rank - first) * rest")).withColumn("k", F.explode(F.expr("sequence((greatest(a, begins) - begins) div gap, (least(a + rest, ends) - 1 - begins) div gap)")))
    cut_up = cut_up.withColumns({"lo": F.expr("greatest(a, begins + k * gap)"), "hi": F.expr("least(a + rest, begins + (k + 1) * gap, ends)")})
    cut_up = cut_up.select("doc_id", "doc_tokens", "rest", "rest_ids", F.expr("cast(lo - a as int) AS p"), F.expr("cast(hi - lo as int) AS n"), F.expr("sequence + k AS sequence"), F.expr("cast(at + lo - begins - k * gap as int) AS at"))
    pieces = placed.unionByName(cut_up).select(
        "doc_id", (F.col("doc_tokens") - F.col("rest") + F.col("p")).alias("start"), F.col("n").cast("bigint").alias("length"),
        F.crc32(F.substring("rest_ids", 4 * F.col("p") + 1, 4 * F.col("n"))).alias("ids_crc32"), "doc_tokens", (F.col("sequence") + n_full).alias("sequence_id"), F.col("at").cast("bigint").alias("offset"),
    )
    return whole.unionByName(pieces)
