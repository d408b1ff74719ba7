"""Shares of a total."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pct, round_half_up
from .partitioning import materialize


def share_of_total(df: DataFrame, n_col: str, alias: str = "pct", *,
                   within: Sequence[str] = (), digits: int | None = 1,
                   denominator=None) -> DataFrame:
    """``100 * n / sum(n)`` over all rows of ``df`` (or within ``within`` groups).

    The grand total is a scalar subquery over the rows of ``df``, which are written once
    (read twice), not ``sum() over ()``, which would pull every row into one task.
    Per-group totals are a small aggregate joined back on the group key.
    ``denominator`` overrides the total with any scalar column (e.g. all rows of
    the source table when the grouped rows drop NULL keys, as pandas does).
    """
    within = list(within)
    if denominator is not None:
        val = pct(F.col(n_col), denominator)
        out = df.withColumn(alias, val)
    elif not within:
        df = materialize(df)
        total = df.agg(F.sum(n_col).alias("__t")).scalar()
        out = df.withColumn(alias, pct(F.col(n_col), total))
    else:
        from .medians import _ns_join
        tot = df.groupBy(*within).agg(F.sum(n_col).alias("__t"))
        # NULL-safe: a NULL partition key is one partition, as in PARTITION BY
        out = _ns_join(df, tot, within).withColumn(alias, pct(F.col(n_col), F.col("__t"))).drop("__t")
    if digits is not None:
        out = out.withColumn(alias, round_half_up(alias, digits))
    return out


def mix(df: DataFrame, key: str, n_alias: str = "n", pct_alias: str = "pct", *,
        drop_null_key: bool = False, digits: int | None = 1) -> DataFrame:
    """Group size with share of all rows.

    ``drop_null_key=True`` follows pandas ``groupby``: the NULL group is not
    shown but its rows stay in the denominator.
    """
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias(n_alias))
    if drop_null_key:
        # the total comes from the grouped rows (NULL group included), not a second scan
        g = materialize(g)
        total = g.agg(F.sum(n_alias)).scalar()
        return share_of_total(g.where(F.col(key).isNotNull()), n_alias, pct_alias,
                              digits=digits, denominator=total)
    return share_of_total(g, n_alias, pct_alias, digits=digits)


def top_n_share(df: DataFrame, key: str, n: int, alias: str = "top_share_pct", *,
                digits: int | None = 1, drop_null_key: bool = True) -> DataFrame:
    """Share of all rows held by the ``n`` largest groups (W8); one row.

    Ties at the cut are broken by the key so the result is deterministic. The
    ``row_number <= n`` filter is planned as a partial window group limit.
    """
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    g = materialize(g)
    total = g.agg(F.sum("__n")).scalar()          # from the aggregate, not a second scan
    if drop_null_key:
        g = g.where(F.col(key).isNotNull())
    top = g.orderBy(F.col("__n").desc(), F.col(key).asc()).limit(n)
    out = top.agg(F.sum("__n").alias("top_rows"))
    val = pct(F.col("top_rows"), total)
    out = out.withColumn(alias, round_half_up(val, digits) if digits is not None else val)
    return out.withColumn("top_rows", F.coalesce(F.col("top_rows"), F.lit(0)).cast("long"))


def ratio_of_counts(num: DataFrame, den: DataFrame, alias: str = "ratio_pct",
                    digits: int | None = 1) -> DataFrame:
    """One-row ratio of two counts (D33): ``100 * count(num) / count(den)``."""
    a = num.agg(F.count(F.lit(1)).alias("numerator"))
    b = den.agg(F.count(F.lit(1)).alias("denominator"))
    out = a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")
    val = pct(F.col("numerator"), F.col("denominator"))
    return out.withColumn(alias, round_half_up(val, digits) if digits is not None else val)


__all__ = ["share_of_total", "mix", "top_n_share", "ratio_of_counts"]
