"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation again and again, each time some turns longer. Each turn gets
the rolling hash of the prefix that ends with it; a conversation whose whole hash is the hash of a
proper prefix of another is dropped by an anti-join, and of equal conversations the smallest
conv_id stays. The maximal conversations are rendered.

A prefix hash is the sum, over its turns, of hashes of (position, role, text), in four parts of 31
bits. Sums can be built in pieces, so one conversation may be longer than a task can hold: rows are
range-partitioned by conversation and turn, positions and sums are taken within a partition, and
each (conversation, partition) is then offset by the totals before it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import core_conf, written

#: Turns rendered into one row; a longer conversation has several parts.
PART_TURNS = 256
_H = [f"h{i}" for i in range(4)]


def _hashes(*columns: str) -> list[Column]:
    """Four 31-bit hashes of the columns."""
    out = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *columns)
        out += [h.bitwiseAND((1 << 31) - 1), F.shiftrightunsigned(h, 33)]
    return out


def _running(rows: DataFrame, sums: dict[str, Column], name: str) -> DataFrame:
    """Adds running totals along (conv, task, order); rows lie in task's order and are written."""
    before = Window.partitionBy("conv", "task").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("conv", "task").agg(*[F.sum(e).alias(f"t_{c}") for c, e in sums.items()])
    earlier = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(totals.select("conv", "task", *[F.coalesce(F.sum(f"t_{c}").over(earlier), F.lit(0)).alias(f"t_{c}") for c in sums]), name)
    own = rows.withColumns({f"o_{c}": F.sum(e).over(before) for c, e in sums.items()})
    return (own.join(offsets, ["conv", "task"]).withColumns({c: F.col(f"o_{c}") + F.col(f"t_{c}") for c in sums})
            .drop(*[f"{x}_{c}" for c in sums for x in "ot"]))


_ORDER = ["turn", "role", "text"]


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv (the id as text, '' for null), conv_id, turn, role, text, position (from 1), h0..h3.

    Repeated rows count once. Turns are ordered by turn, role, text, nulls first, so ties have a
    fixed order; null role or text is kept apart from the empty string in the hash.
    """
    rows = (conversations.select("conv_id", "turn", "role", "text").distinct()
            .withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))))
    keys = ["conv", *_ORDER]
    spread = rows.repartitionByRange(core_conf(conversations.sparkSession), *keys).sortWithinPartitions(*keys)
    spread = written(spread.withColumn("task", F.spark_partition_id()), "turns")
    placed = written(_running(spread, {"position": F.lit(1).cast("long")}, "positions"), "placed")
    own = _hashes("position", "role", "text", F.col("role").isNull(), F.col("text").isNull())
    hashed = placed.withColumns({f"e{i}": h for i, h in enumerate(own)})
    return _running(hashed, {c: F.col(f"e{i}") for i, c in enumerate(_H)}, "hashes").drop("e0", "e1", "e2", "e3")


def maximal(turns: DataFrame) -> DataFrame:
    """conv, n_turns, n_copies of the conversations that no other extends; turns: see prefixes."""
    whole = (turns.groupBy("conv").agg(F.max(F.struct("position", *_H)).alias("w"))
             .select("conv", F.col("w.position").alias("n_turns"), *[F.col(f"w.{h}").alias(h) for h in _H]))
    # equal conversations are one row from here on: a conversation copied any number of times is no hot key
    equal = written(whole.groupBy("n_turns", *_H).agg(F.min(F.struct(F.col("conv") == "", F.length("conv"), "conv")).alias("c"), F.count("*").alias("n_copies")), "equal")
    proper = (turns.select("conv", "position", *_H).join(whole.select("conv", "n_turns"), "conv").filter("position < n_turns")
              .groupBy(F.col("position").alias("n_turns"), *_H).agg(F.lit(1).alias("one")).drop("one"))
    return equal.join(written(proper, "proper"), ["n_turns", *_H], "left_anti").select(F.col("c.conv").alias("conv"), "n_turns", "n_copies")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def op8_chat_collapse(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies, rendered: the maximal conversations, PART_TURNS turns a row.

    Of equal conversations the smallest conv_id stays (a null id only if all are null);
    rows with a null conv_id are one conversation. An empty table gives no rows. Other columns are
    not looked at, whatever their names.
    """
    turns = written(prefixes(conversations), "prefixes")
    best = written(maximal(turns), "maximal")
    part = F.floor((F.col("position") - 1) / PART_TURNS).cast("int")
    lines = turns.join(best, "conv").select("conv", "conv_id", "n_turns", "n_copies", part.alias("part"),
                                            F.struct("position", render(F.col("role"), F.col("text")).alias("line")).alias("t"))
    grouped = lines.groupBy("conv", "conv_id", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("t.line"), "").alias("rendered"))


#: DuckDB SQL of op8 (conversation ids are integers or null).
ORACLE = r"""
WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position,
             string_agg(coalesce('+' || role, '-') || chr(1) || coalesce('+' || text, '-'), chr(2)) OVER
               (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS prefix FROM r),
w AS (SELECT conv_id, max(position) AS n_turns, max_by(prefix, position) AS whole FROM p GROUP BY conv_id),
e AS (SELECT whole, n_turns, count(*) AS n_copies, min(conv_id) AS conv_id FROM w GROUP BY whole, n_turns),
m AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id
                                        WHERE p.position < w.n_turns AND p.position = e.n_turns AND p.prefix = e.whole))
SELECT m.conv_id, CAST((position - 1) // 256 AS INTEGER) AS part, CAST(m.n_turns AS BIGINT) AS n_turns, CAST(m.n_copies AS BIGINT) AS n_copies,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY position) AS rendered
FROM m JOIN p ON p.conv_id IS NOT DISTINCT FROM m.conv_id
GROUP BY m.conv_id, (position - 1) // 256, m.n_turns, m.n_copies
"""
