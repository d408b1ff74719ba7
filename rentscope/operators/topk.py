"""Ordering, limits and arg-extremes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ord(c) -> Column:
    return F.col(c).asc_nulls_first() if isinstance(c, str) else c


def top_k(df: DataFrame, order: Sequence, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """``ORDER BY order, tiebreak LIMIT k``.

    Planned as TakeOrderedAndProject: each task keeps its own top k, so only
    k rows per task cross the network. ``tiebreak`` keys make ties deterministic.
    """
    cols = [_ord(c) for c in order] + [F.col(t).asc_nulls_first() for t in tiebreak]
    return df.orderBy(*cols).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int,
                    rank_alias: str = "rank") -> DataFrame:
    """Top k rows per group with their rank.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the
    shuffle, so a large group only sends k rows per task.
    """
    w = Window.partitionBy(*group).orderBy(*[_ord(c) for c in order])
    return df.withColumn(rank_alias, F.row_number().over(w)).where(F.col(rank_alias) <= k)


def random_sample(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """n pseudo-random rows (O4): top n by the md5 of seed and key, no full sort. The rows depend
    on the data alone, not on its partitions, so a rerun picks the same ones."""
    return df.withColumn("__r", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("__r", key).limit(n).drop("__r")


def extremes(df: DataFrame, label: str, value: str, order_key: str | None = None,
             names: tuple[str, str, str, str] = ("peak", "peak_value", "low", "low_value")) -> DataFrame:
    """Arg-max and arg-min of a numeric ``value`` in one aggregate.

    Ties go to the smallest ``order_key`` (default: the label) in both
    directions: ``min_by`` over a (value, key) struct - no sort, no limit.
    """
    ok = F.col(order_key or label)
    v = F.col(value)
    df = df.where(v.isNotNull())          # a NULL value is neither the peak nor the low
    out = df.agg(F.min_by(F.struct(F.col(label).alias("l"), v.alias("v")), F.struct(-v, ok)).alias("__hi"),
                 F.min_by(F.struct(F.col(label).alias("l"), v.alias("v")), F.struct(v, ok)).alias("__lo"))
    return out.select(F.col("__hi.l").alias(names[0]), F.col("__hi.v").alias(names[1]),
                      F.col("__lo.l").alias(names[2]), F.col("__lo.v").alias(names[3]))


def count_in_top_k(df: DataFrame, order: Sequence, k: int, condition: Column,
                   alias: str = "n_in_top", tiebreak: Sequence[str] = ()) -> DataFrame:
    """How many of the top k rows meet ``condition`` (G18); one row."""
    return top_k(df, order, k, tiebreak).agg(F.count_if(condition).alias(alias))
