"""SimHash near-duplicates by a self-join of binary tries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neargrid.llm.common import cut, quoted, row_key
from neargrid.llm.components import connected_components

#: Fingerprints of a pair of trie nodes that one task takes; a larger pair goes further down the trie.
CELL = 1 << 16
#: Levels that one step of the dealing goes down at most.
STEP = 6
#: Node pairs of this many fingerprint pairs or fewer are leaves: their fingerprints are compared.
LEAF = 4
#: Node pairs that are expanded at once; more wait on a stack.
FRONTIER = 1 << 17
#: Keys of dropped rows, and large node pairs, are broadcast up to this many and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000
#: Rows whose texts are Python objects at once.
SLICE = 512
#: Fingerprints that a task gathers before it joins the cells it has whole.
GATHER = 1 << 17


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """Of UTF-8 text: majority bits over the XXH64 (seed 42) of all word shingles; 0 without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    if len(words) <= shingle:
        found: Iterator[bytes] = iter([b" ".join(words)])
    else:
        found = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    ones = np.zeros(64, np.int64)
    for _ in range(0, n, 1 << 16):
        part = np.fromiter((digest(s, 42) for s in islice(found, 1 << 16)), np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, k1, k2, fp) row by row. k1, k2: 128 bits of doc_id and text. Null or blank text: fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                fp = np.array([simhash(t, shingle) for t in part.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(fp, pa.int64())], names=["doc_id", "k1", "k2", "fp"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), *row_key("doc_id", "text"))
    return source.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 bigint, k2 bigint, fp bigint")


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Put the classes of i and j together; `parent` points at roots before and after."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while len(i) and not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def trie_classes(x: np.ndarray, nodes: list[tuple[int, int, int, int, int, int]], budget: int, count: Counter | None = None) -> np.ndarray:
    """For sorted runs of x (uint64), the root of each element by the links that the tries of node pairs show.

    A node is a slice of x whose elements share the bits above the level. (la, ha, lb, hb, depth, diff) is a pair of
    nodes, `depth` bits down, whose paths differ in `diff` bits; the same slice twice joins a trie with itself. All
    live pairs go down a level at once; a pair whose paths differ in more than `budget` bits is dropped with
    everything below it. `count`, if given, counts expanded and pruned pairs of nodes, compared and linked pairs of fingerprints.
    """
    count = Counter() if count is None else count
    parent, ones = np.arange(len(x)), {}

    def below(level: int, at: np.ndarray) -> np.ndarray:
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((x >> np.uint64(level)) & np.uint64(1), dtype=np.int64)])
        return ones[level][at]

    def compare(la, na, lb, nb) -> None:
        total = np.cumsum(na * nb)
        at = 0
        while at < len(la):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 21))))
            sizes, width = (na * nb)[at:to], nb[at:to]
            k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            i, j = np.repeat(la[at:to], sizes) + k // np.repeat(width, sizes), np.repeat(lb[at:to], sizes) + k % np.repeat(width, sizes)
            near = (i != j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
            count["compared"] += len(i)
            count["linked"] += int(near.sum())
            _join(parent, i[near], j[near])
            at = to

    stack = []
    for depth in {n[4] for n in nodes}:
        la, ha, lb, hb, _, diff = (np.array(c, np.int64) for c in zip(*(n for n in nodes if n[4] == depth), strict=True))
        stack.append((63 - depth, la, ha, lb, hb, diff))
    while stack:
        level, la, ha, lb, hb, diff = stack.pop()
        if len(la) > FRONTIER:
            half = len(la) // 2
            stack += [(level, *(c[part] for c in (la, ha, lb, hb, diff))) for part in (slice(half), slice(half, None))]
            continue
        na, nb = ha - la, hb - lb
        leaf = (na * nb <= LEAF) | (level < 0)
        compare(la[leaf], na[leaf], lb[leaf], nb[leaf])
        la, ha, lb, hb, diff = (c[~leaf] for c in (la, ha, lb, hb, diff))
        if not len(la):
            continue
        count["expanded"] += len(la)
        ma, mb = ha - (below(level, ha) - below(level, la)), hb - (below(level, hb) - below(level, lb))
        same = la == lb
        pairs = [(la, ma, lb, mb, diff), (ma, ha, mb, hb, diff), (la, ma, mb, hb, diff + 1), tuple(c[~same] for c in (ma, ha, lb, mb, diff + 1))]
        la, ha, lb, hb, diff = (np.concatenate(c) for c in zip(*pairs, strict=True))
        live = (ha > la) & (hb > lb)
        count["pruned"] += int((live & (diff > budget)).sum())
        live &= (diff <= budget) & ~((la == lb) & (ha - la == 1))
        if live.any():
            stack.append((level - 1, *(c[live] for c in (la, ha, lb, hb, diff))))
    return parent


def _path(fp: str, depth: int) -> Column:
    """The first `depth` bits."""
    return F.shiftrightunsigned(fp, 64 - depth) if depth else F.lit(0).cast("bigint")


def deal(prints: DataFrame, budget: int = 3) -> list[tuple[int, DataFrame]]:
    """Distinct fingerprints (fp) -> [(depth, rows (fp, other))]: the pairs of trie nodes `depth` bits down that are left.

    A row says that fp's node at that depth meets the node whose path is `other`. The trie is joined with itself from
    the root: a step goes STEP levels down at most, and a fingerprint goes on with those nodes below the other one
    whose paths differ from its own in what is left of the budget; all other pairs of nodes are pruned. A pair of at
    most CELL fingerprints is left to one task, larger ones take the next step, so that a hot prefix is dealt out
    as far as it needs. A step of d levels gives a fingerprint C(d, 0) + ... + C(d, budget) rows, whatever the data.
    """
    depth, live, most, out = 0, prints.select("fp", F.lit(0).cast("bigint").alias("other")), prints.count(), []
    while most > CELL and depth < 64:
        step = min(STEP, 64 - depth, max(1, math.ceil(math.log2(4 * most / CELL))))
        masks = sorted((m for m in range(1 << step) if m.bit_count() <= budget), key=int.bit_count)
        upto = [sum(m.bit_count() <= t for m in masks) for t in range(budget + 1)]
        left = budget - F.bit_count(_path("fp", depth).bitwiseXOR(F.col("other")))
        allowed = F.slice(F.array(*(F.lit(m).cast("bigint") for m in masks)), F.lit(1), F.get(F.array(*map(F.lit, upto)), left))
        bits = _path("fp", depth + step).bitwiseAND(F.lit((1 << step) - 1).cast("bigint"))
        depth += step
        rows = live.select("fp", "other", F.explode(allowed).alias("m")).select("fp", F.shiftleft("other", step).bitwiseOR(bits.bitwiseXOR(F.col("m"))).alias("other"))
        rows = rows.select("fp", "other", F.least(_path("fp", depth), "other").alias("a"), F.greatest(_path("fp", depth), "other").alias("b"))
        sizes = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("other") == F.col("b")).alias("n_a"))
        large = cut(sizes.where(((F.col("a") == F.col("b")) | F.col("n_a").between(1, F.col("n") - 1)) & (F.col("n") > CELL)))
        found = large.agg(F.count(F.lit(1)), F.max("n")).first()
        if not found[0]:
            return [*out, (depth, rows.select("fp", "other"))]
        side = large.select("a", "b")
        side = F.broadcast(side) if found[0] <= BROADCAST_ROWS else side
        out.append((depth, rows.join(side, ["a", "b"], "left_anti").select("fp", "other")))
        live, most = cut(rows.join(side, ["a", "b"], "left_semi").select("fp", "other")), found[1]
    return [*out, (depth, live)]


def near_edges(prints: DataFrame, budget: int = 3) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) with the same components as all pairs of `budget` bits or fewer.

    Each pair of trie nodes that `deal` leaves is joined in one task, from its depth down, by `trie_classes`. Every
    near pair is in exactly one of them, at most CELL fingerprints are in any, and none is left out. A task returns
    a spanning forest of its links, at most a row for each fingerprint it read.
    """
    parts = [rows.select("fp", "other", F.lit(depth).alias("depth"), F.least(_path("fp", depth), "other").alias("a"), F.greatest(_path("fp", depth), "other").alias("b")) for depth, rows in deal(prints, budget)]
    cells = reduce(DataFrame.unionByName, parts)
    key = ["depth", "a", "b"]

    def join(depth: np.ndarray, a: np.ndarray, b: np.ndarray, other: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        side = (other == a) & (a != b)  # fingerprints under b meet a
        order = np.lexsort((fp, side, b, a, depth))
        depth, a, b, side, fp = depth[order], a[order], b[order], side[order], fp[order]
        fresh = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        nodes = []
        for lo, hi in zip(fresh.tolist(), [*fresh[1:].tolist(), len(fp)], strict=True):
            if a[lo] == b[lo]:
                nodes.append((lo, hi, lo, hi, int(depth[lo]), 0))
            else:
                mid = lo + int(np.searchsorted(side[lo:hi], True))
                if lo < mid < hi:
                    nodes.append((lo, mid, mid, hi, int(depth[lo]), ((int(a[lo]) ^ int(b[lo])) & (1 << 64) - 1).bit_count()))
        root = trie_classes(fp, nodes, budget)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fp[c].view(np.int64), pa.int64()) for c in (moved, root[moved])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def columns() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (*key, "other", "fp")])
            size += batch.num_rows
            if size >= GATHER:
                rows = columns()
                last = np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1]))[0]  # the last cell may go on
                if last:
                    yield join(*(c[:last] for c in rows[:4]), rows[4][:last].view(np.uint64))
                held, size = [[c[last:] for c in rows]], len(rows[0]) - last
        if held:
            rows = columns()
            yield join(*rows[:4], rows[4].view(np.uint64))

    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, text, ...) -> one row (doc_id, k1, k2, fp, root, component_id) per row.

    root is the fingerprint that names the component, component_id is the least doc_id that links of `budget` bits or
    fewer lead to; fp is the 64-bit fingerprint; k1, k2 are 128 bits of doc_id and text. Only distinct fingerprints
    are joined, so a group of copies of any size is one row there. Null, empty and blank texts have fingerprint 0 and
    link like any other; texts of any length are read whole; repeated rows each keep a row; a table of one
    fingerprint is one component; an empty table gives no rows; other columns are ignored. A null doc_id is never a
    component's id unless it has no other.
    """
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(near_edges(classes.select("fp"), budget)).withColumnRenamed("node", "fp")
    classes = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "k1", "k2", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """The rows of docs, all columns kept, whatever their names, less all but one of each component: the one of least doc_id (nulls last).

    Of equal rows one stays; cases otherwise as in `near_duplicates`: all null, empty and blank texts are one
    component, and an empty table gives no rows. Texts are not shuffled while at most BROADCAST_ROWS rows are
    dropped, and once beyond.
    """
    found = cut(near_duplicates(docs, shingle, budget).select("doc_id", "k1", "k2", "root"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("m")
    kept = found.groupBy("root").agg(best).select("m.k1", "m.k2")
    rows = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    gone = cut(rows.join(kept, ["k1", "k2"], "left_anti").select("k1", "k2"))
    again = cut(rows.where("n > 1").join(kept, ["k1", "k2"], "left_semi").select("k1", "k2"))
    k1, k2 = "_simhash_k1", "_simhash_k2"
    keyed = docs.select("*", *(k.alias(n) for k, n in zip(row_key("doc_id", "text"), (k1, k2), strict=True)))
    on = lambda keys: (keyed[k1] == keys["k1"]) & (keyed[k2] == keys["k2"])
    back = [quoted(c) for c in docs.columns]
    if gone.count() + again.count() > BROADCAST_ROWS:
        keep = cut(kept)
        return keyed.join(keep, on(keep), "left_semi").dropDuplicates([k1, k2]).select(*back)  # one shuffle by the key serves both
    out = keyed.join(F.broadcast(gone), on(gone), "left_anti")
    if again.isEmpty():
        return out.select(*back)
    once, more = out.join(F.broadcast(again), on(again), "left_anti"), out.join(F.broadcast(again), on(again), "left_semi")
    return once.unionByName(more.dropDuplicates([k1, k2])).select(*back)
