"""Chat formatting: logged snapshots that begin a longer conversation are collapsed into it. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neargrid.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>\n"
#: Values of `turn` that one part of a rendered conversation covers.
PART = 1024
#: Partitions' totals are broadcast; conversations' places are, up to this many, and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000
_ORDER = ["conv_id", "turn", "role", "m"]


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def _sofar(rows: DataFrame, what: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows (_part, _row, ...) with running values over all rows in order: name: (sum or bit_xor, column).

    A running value is that of the row's partition up to the row, and the totals of the partitions before. Only the
    totals, a row a partition, are gathered; no conversation has a task of its own.
    """
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    agg = lambda kind, c: F.sum(c) if kind == "sum" else F.bit_xor(c)
    rows = rows.select("*", *(c.alias(f"_x_{n}") for n, (_, c) in what.items()))
    totals = rows.groupBy("_part").agg(*(agg(k, F.col(f"_x_{n}")).alias(f"_t_{n}") for n, (k, _) in what.items()))
    totals = totals.select("_part", *(F.coalesce(agg(k, F.col(f"_t_{n}")).over(before), F.lit(0).cast("bigint")).alias(f"_b_{n}") for n, (k, _) in what.items()))
    join = lambda k, a, b: a + b if k == "sum" else a.bitwiseXOR(b)
    found = rows.select("*", *(agg(k, F.col(f"_x_{n}")).over(inside).alias(f"_s_{n}") for n, (k, _) in what.items())).join(F.broadcast(totals), "_part")
    drop = [f"_{a}_{n}" for a in "xsb" for n in what]
    return found.select("*", *(join(k, F.col(f"_s_{n}"), F.col(f"_b_{n}")).alias(n) for n, (k, _) in what.items())).drop(*drop)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), conv_id never null -> conv_id, i, h1, h2, n: after each turn, 128 bits of the first i turns; n turns in all.

    Equal rows are one turn. Rows without their texts, which an MD5 stands for, are sorted over all partitions by
    conversation and turn; a turn's place is its place among all less that of the conversation's first, and a prefix's
    hash is the exclusive or of all rows' hashes so far less that before the conversation's first. So a conversation
    with a third of all turns is sorted and hashed by as many tasks as its rows take.
    """
    t = turns.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("m")).distinct()
    placed = cut(t.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("_row", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    place = _sofar(placed, {"at": ("sum", F.lit(1).cast("bigint"))})
    ends = place.groupBy("conv_id").agg((F.min("at") - 1).alias("first"), F.count(F.lit(1)).alias("n"))
    rows = place.join(ends, "conv_id").withColumn("i", F.col("at") - F.col("first"))
    rolled = _sofar(rows, {f"h{s}": ("xor", F.xxhash64(F.lit(s), "i", "role", "m")) for s in (1, 2)})
    rolled = cut(rolled.select("conv_id", "i", "n", "h1", "h2", *(F.xxhash64(F.lit(s), "i", "role", "m").alias(f"x{s}") for s in (1, 2))))
    start = rolled.where("i = 1").select("conv_id", *(F.col(f"h{s}").bitwiseXOR(F.col(f"x{s}")).alias(f"b{s}") for s in (1, 2)))
    return rolled.join(start, "conv_id").select("conv_id", "i", "n", *(F.col(f"h{s}").bitwiseXOR(F.col(f"b{s}")).alias(f"h{s}") for s in (1, 2)))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> conv_id, n_turns, copies, part, rendered: the maximal conversations, rendered.

    Turns are in order of turn, then role, then the text's MD5; equal rows are one turn. A conversation's k-th rolling
    hash is 128 bits over its first k turns with their places. A conversation whose whole hash is a shorter prefix's of
    another is a snapshot of it and is dropped by an anti-join; of conversations with equal turns the one with the
    least conv_id stays, and `copies` counts them. Hashes of prefixes are made distinct before the join, map-side too,
    so that a first turn which very many conversations share is one row. Texts are shuffled once, those of
    conversations that go not at all.

    What stays is rendered turn by turn, one row for each PART values of `turn` (0: the first values, nulls, and what
    is below), so a conversation of usual length is one row, and one of any length is never one cell.

    A null role or text counts as empty, a null turn as the first. A row without a conv_id is a conversation of its
    own, of one turn: it goes if another conversation begins with it, and otherwise gives one row a different turn with
    a null conv_id, after all others in the choice of who stays. Repeated rows are one turn. An empty table gives no
    rows; very long texts and extra columns, whatever their names, change nothing.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    known = t.where("conv_id IS NOT NULL")
    rolled = cut(prefixes(known))
    # rows without a conversation: their only turn's hash, as prefixes() has it
    single = F.unhex(F.md5("text"))
    lone = t.where("conv_id IS NULL").groupBy(*(F.xxhash64(F.lit(s), F.lit(1).cast("bigint"), "role", single).alias(f"h{s}") for s in (1, 2))).agg(F.count(F.lit(1)).alias("copies"), F.min("text").alias("text"), F.min("role").alias("role"))
    lone = cut(lone)
    named = rolled.where("i = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    whole = named.unionByName(lone.select(F.lit(1).cast("bigint").alias("n"), "h1", "h2", F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), "copies"))
    whole = whole.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("copies"))
    begun = rolled.where("i < n").select(F.col("i").alias("n"), "h1", "h2").distinct()
    kept = cut(whole.join(begun, ["n", "h1", "h2"], "left_anti"))

    part = F.greatest(F.coalesce(F.floor(F.col("turn") / PART), F.lit(0)), F.lit(0))
    ids = kept.where("conv_id IS NOT NULL").select("conv_id", F.col("n").alias("n_turns"), "copies")
    if ids.count() <= BROADCAST_ROWS:
        said = known.withColumn("part", part).join(F.broadcast(ids), "conv_id")
    else:  # dealt by part, so that a long conversation is no hot key; the aggregation below needs no further shuffle
        parts = known.select("conv_id", part.alias("part")).distinct()
        said = known.withColumn("part", part).join(ids.join(parts, "conv_id"), ["conv_id", "part"])
    said = said.groupBy("conv_id", "part", "n_turns", "copies").agg(F.array_sort(F.collect_set(F.struct("turn", "role", F.md5("text").alias("m"), "text"))).alias("turns"))
    out = said.select("conv_id", "n_turns", "copies", "part", F.array_join(F.transform("turns", lambda x: _turn(x["role"], x["text"])), "").alias("rendered"))
    alone = kept.where("conv_id IS NULL").join(lone.select("h1", "h2", "role", "text"), ["h1", "h2"])
    return out.unionByName(alone.select("conv_id", F.col("n").alias("n_turns"), "copies", F.lit(0).cast("bigint").alias("part"), _turn(F.col("role"), F.col("text")).alias("rendered")))


ORACLE = f"""
    WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, greatest(coalesce(turn // {PART}, 0), 0) AS part FROM conversations WHERE conv_id IS NOT NULL
    ), c AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, md5(text)) AS l, 1 AS times FROM t GROUP BY conv_id
      UNION ALL SELECT NULL, [{{'r': coalesce(role, ''), 't': coalesce(text, '')}}], 1 FROM conversations WHERE conv_id IS NULL
    ), u AS (SELECT min(conv_id) AS conv_id, sum(times) AS copies, l FROM c GROUP BY l
    ), p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM u)
    ), kept AS (SELECT * FROM u WHERE l NOT IN (SELECT l FROM p)
    ), said AS (SELECT conv_id, part, string_agg('{START}' || role || chr(10) || text || '{END.strip()}' || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text)) AS rendered FROM t GROUP BY conv_id, part)
    SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS copies, CAST(part AS BIGINT) AS part, rendered FROM kept JOIN said USING (conv_id)
    UNION ALL SELECT NULL, 1, CAST(copies AS BIGINT), 0, '{START}' || l[1].r || chr(10) || l[1].t || '{END.strip()}' || chr(10) FROM kept WHERE conv_id IS NULL"""
