"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table lookups, exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neargrid.llm.common import cut, row_key
from neargrid.llm.components import connected_components

#: Classes that the quantiser is fitted on at most, least hashes first. Every class is indexed.
SAMPLE = 8192
#: Centroids of a level at most. Beyond, a second level cuts each list by what the first leaves over.
CENTRES = 1024
#: Dimensions of a subspace, and codes in each.
WIDTH, CODES = 4, 16
#: Members that a list has about, and members and queries of one task's cell; longer lists are dealt into cells that meet pair by pair.
CELL = 1024
#: Standard deviations, across a plane between two lists, of a link whose direction is not known; `reach` says what for.
SPREAD = 4.0
#: Sizes of lists are broadcast up to this many and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000
#: Queries whose table lookups are done at once.
BLOCK = 128
_SLACK = 1e-5


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def _within(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector, centre): the nearest centres, and those whose plane with the nearest is `reach` away at most."""
    d = _near(x, c)
    own = d.argmin(axis=1)
    planes = np.sqrt(_near(c[own], c))
    return np.nonzero(d - d[np.arange(len(x)), own][:, None] <= 2 * reach * planes + _SLACK)


def _means(x: np.ndarray, k: int, steps: int, rnd: np.random.Generator) -> np.ndarray:
    c = x[rnd.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = np.concatenate([(p @ c.T * -2 + (c * c).sum(axis=1)).argmin(axis=1) for p in np.array_split(x, len(x) // 4096 + 1)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class Quantiser:
    """Centroids of lists, those of the lists' parts, and codebooks [subspace, code, WIDTH] of what is left after both."""

    centres: np.ndarray
    parts: np.ndarray
    books: np.ndarray
    dim: int

    @classmethod
    def fit(cls, units: np.ndarray, lists: int, seed: int = 0) -> Quantiser:
        """`lists` in all: up to CENTRES on one level, up to its square on two."""
        rnd = np.random.default_rng(seed)
        dim = -(-units.shape[1] // WIDTH) * WIDTH
        x = np.pad(units, ((0, 0), (0, dim - units.shape[1])))
        centres = _means(x, min(lists, CENTRES, max(1, len(x) // 8)), 8, rnd)
        left = x - centres[_near(x, centres).argmin(axis=1)]
        wanted = min(-(-lists // len(centres)), CENTRES, max(1, len(x) // 8))
        parts = _means(left, wanted, 8, rnd) if wanted > 1 else np.zeros((1, dim))
        left = left - parts[_near(left, parts).argmin(axis=1)]
        books = [_means(left[:, i : i + WIDTH], min(CODES, len(x)), 6, rnd) for i in range(0, dim, WIDTH)]
        return cls(centres, parts, np.stack(books), dim)

    def units(self, v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return np.pad(v / np.sqrt((v * v).sum(axis=1, keepdims=True)), ((0, 0), (0, self.dim - v.shape[1])))

    def centre(self, place: int) -> np.ndarray:
        return self.centres[place // len(self.parts)] + self.parts[place % len(self.parts)]

    def lists(self, x: np.ndarray) -> np.ndarray:
        """Each vector's own list."""
        own = _near(x, self.centres).argmin(axis=1)
        return own * len(self.parts) + _near(x - self.centres[own], self.parts).argmin(axis=1)

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) for every list that begins within `reach` beyond the plane between it and the nearest, level by level."""
        i, first = _within(x, self.centres, reach)
        if len(self.parts) == 1:
            return i, first
        k, second = _within(x[i] - self.centres[first], self.parts, reach)
        return i[k], first[k] * len(self.parts) + second

    def encode(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they leave over."""
        codes, error = [], np.zeros(len(left))
        for m, book in enumerate(self.books):
            part = left[:, m * WIDTH : (m + 1) * WIDTH]
            d = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
            codes.append(d.argmin(axis=1))
            error += d.min(axis=1)
        return np.stack(codes, axis=1).astype(np.uint8), np.sqrt(error)

    def distances(self, left: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """[query, member]: asymmetric distances, summed from each query's table of distances to the codes."""
        out = np.zeros((len(left), len(codes)))
        for m, book in enumerate(self.books):
            table = ((left[:, m * WIDTH : (m + 1) * WIDTH][:, None, :] - book[None]) ** 2).sum(axis=2)
            out += table[:, codes[:, m]]
        return np.sqrt(out)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _usable(v: str) -> Column:
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def reach(radius: float, dim: int) -> float:
    """How far beyond a plane a list is still probed.

    On unit vectors a link is a step of length `radius` at most. Its part across a plane is `radius` only if it goes
    straight that way; of a step whose direction is not known it is radius / sqrt(dim) in the root mean square, so
    SPREAD times that is sufficient for all but a few in 10 000, and never more than `radius` is needed.
    """
    return radius * min(1.0, SPREAD / dim**0.5)


def links(classes: DataFrame, model: Quantiser, threshold: float) -> DataFrame:
    """classes (node, label, dim, v, size) -> (node, root, n): the number of vectors linked to each class's vectors in
    other classes, and a spanning forest of the links; a class has a row for each cell where it has links.

    A vector is a member of the list it is nearest to and a query in each other list that `reach` allows; a pair is met
    where the query's list comes first. Table lookups give the distance from the query to a member's code; the member
    is off its code by a known length, so a pair is left out only where the difference exceeds the radius. The rest get
    their exact cosine. Lists grow in number with the classes, so a vector meets about CELL members in each. What is
    shuffled is one copy of a vector for each list it is in.
    """
    radius = float(np.sqrt(2 - 2 * threshold)) + _SLACK
    spread = classes.sparkSession.sparkContext.broadcast(model)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 256):
                    p = part.slice(at, 256)
                    yield p, spread.value.units(_matrix(p.column("v")))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, x in parts(batches):
            yield pa.RecordBatch.from_arrays([p.column("label"), p.column("dim"), pa.array(spread.value.lists(x), pa.int64())], names=["label", "dim", "list"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, x in parts(batches):
            at = spread.value.lists(x)
            i, to = spread.value.probes(x, reach(radius, int(p.column("dim")[0].as_py())))
            later = to > at[i]
            i, to = np.concatenate([np.arange(len(x)), i[later]]), np.concatenate([at, to[later]])
            yield pa.RecordBatch.from_arrays([*p.take(pa.array(i)).columns, pa.array(to, pa.int64()), pa.array(to == at[i])], names=names)

    names = [*classes.columns, "list", "member"]
    label = classes.schema["label"].dataType.simpleString()
    g = F.xxhash64("label", "dim", "list").alias("g")
    sizes = cut(classes.select("label", "dim", "v").mapInArrow(own, f"label {label}, dim int, list bigint").groupBy(g).agg(F.count(F.lit(1)).alias("n")))
    cells = sizes.select("g", F.ceil(F.col("n") / CELL).alias("s"))
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    rows = classes.mapInArrow(place, f"{kinds}, list bigint, member boolean").select("node", "size", "v", "list", "member", g).join(cells, "g")
    # members are dealt into s parts; a member meets the others of its part and each other part once, a query all parts
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("s")))
    meets = F.expr("""
        CASE WHEN member THEN transform(sequence(0L, s - 1), o -> struct(least(own, o) AS i, greatest(own, o) AS j, own <= o AS first))
             ELSE transform(sequence(0L, s - 1), o -> struct(o AS i, o AS j, false AS first)) END""")
    rows = rows.withColumn("m", F.explode(meets)).select(F.xxhash64("g", "m.i", "m.j").alias("cell"), "m.first", (F.col("member") & (F.col("m.i") == F.col("m.j"))).alias("within"), "node", "size", "v", "list")

    def meet(table: pa.Table) -> pa.Table:
        model = spread.value
        t = table.combine_chunks()
        col = lambda n: t.column(n).combine_chunks() if isinstance(t.column(n), pa.ChunkedArray) else t.column(n)
        first, within = (col(n).to_numpy(zero_copy_only=False).astype(bool) for n in ("first", "within"))
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        node, size = (col(n).to_numpy(zero_copy_only=False) for n in ("node", "size"))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(a) and t.num_rows > 1:
            x = model.units(_matrix(col("v")))
            left = x - model.centre(col("list")[0].as_py())
            codes, error = model.encode(left[a])
            for queries, inner in ((a[within[a]], True), (b, False)):
                for at in range(0, len(queries), BLOCK):
                    q = queries[at : at + BLOCK]
                    i, j = np.nonzero(model.distances(left[q], codes) <= radius + error[None])
                    i, j = q[i], a[j]
                    if inner:
                        i, j = i[i < j], j[i < j]
                    near = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
                    found.append((i[near], j[near]))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))
        n = np.bincount(i, weights=size[j], minlength=t.num_rows) + np.bincount(j, weights=size[i], minlength=t.num_rows)
        root = np.arange(t.num_rows)
        while len(i):
            ri, rj = root[i], root[j]
            ok = ri != rj
            i, j, ri, rj = i[ok], j[ok], ri[ok], rj[ok]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while not np.array_equal(up := root[root], root):
                root = up
        has = np.flatnonzero(n)
        return pa.table({"node": pa.array(node[has], pa.int64()), "root": pa.array(node[root[has]], pa.int64()), "n": pa.array(n[has].astype(np.int64))})

    return rows.groupBy("cell").applyInArrow(meet, "node bigint, root bigint, n bigint")


def near_duplicates(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, embedding, label, ...) -> one row per row: vec_id, n_links, component_id, kept.

    Vectors link if their labels and lengths are equal, no label is null, and their cosine is `threshold` or more.
    n_links counts the other vectors linked directly, component_id is the least vec_id reachable, kept says that it
    is one's own. No pair below the threshold is linked; of the others `links` may miss some in long vectors, where
    it does not probe every list that a link could lead to (see `reach`). Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, as do rows without a label. Equal vectors of a label are one class
    and link with each other; only classes are compared, so a table of one vector has no comparison at all. Repeated
    rows each keep a row; an empty table gives none; other columns are ignored.
    """
    r = rows.select("vec_id", F.col("label").alias("label"), F.col("embedding").alias("v"))
    ok = F.col("label").isNotNull() & _usable("v")
    alone = r.where(~ok).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    good = r.where(ok)
    # a class is named by a number that the checkpoint fixes; rows find it by 128 bits
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"))
    classes = cut(classes.select(*row_key("label", "v"), "label", F.size("v").alias("dim"), "v", "size", "least", F.monotonically_increasing_id().alias("node")))
    count, dim = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    if count:
        most = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        share = min(1 << 30, -(-(2 * SAMPLE << 30) // count))  # by a hash first, so that no partition sends more than its part
        sample = classes.where(F.pmod(F.xxhash64("k2"), F.lit(1 << 30)) < share).orderBy(F.xxhash64("k1"), "k2").limit(SAMPLE).select("v", "dim").toArrow().combine_chunks()
        x = np.zeros((sample.num_rows, dim))
        x[np.arange(dim) < sample.column("dim").to_numpy()[:, None]] = sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        del sample
        x /= np.abs(x).max(axis=1, keepdims=True)
        model = Quantiser.fit(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), -(-most // CELL))
        found = cut(links(classes.select("node", "label", "dim", "v", "size"), model, threshold))
    else:
        found = classes.select("node", F.col("node").alias("root"), F.col("size").alias("n"))
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    c = classes.select("node", "k1", "k2", "least", "size").join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(roots, "node", "left")
    c = c.select("k1", "k2", "least", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = c.join(c.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("k1", "k2", "n_links", "component_id")
    out = good.select("vec_id", *row_key("label", "v")).join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: All pairs of a label by their cosine, and components by reachability.
ORACLE = """
    WITH RECURSIVE e AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS r FROM embeddings
    ), ok AS MATERIALIZED (
      SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
    ), links AS MATERIALIZED (
      SELECT a.r AS u, b.r AS w FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= 0.98
    ), reach AS (
      SELECT r AS u, r AS w FROM e UNION SELECT reach.u, links.w FROM reach JOIN links ON reach.w = links.u
    ), c AS (SELECT u, min(vec_id) AS component_id FROM reach JOIN e ON e.r = reach.w GROUP BY u
    ), n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.u = e.r LEFT JOIN n ON n.u = e.r"""
