"""Joins of detail rows with group statistics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .medians import grouped_median


def with_group_stat(df: DataFrame, stat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detail rows joined to a per-group statistic.

    ``stat`` has one row per group. No broadcast hint: AQE broadcasts it at run
    time when its measured size is under the threshold and sort-merges (with
    skew splitting) otherwise, so an unbounded number of groups stays safe.
    NULL keys drop out, as with an SQL inner join.
    """
    return df.join(stat, list(keys), "inner")


def below_group_median(df: DataFrame, keys: Sequence[str], value: str,
                       median_alias: str = "group_median", strict: bool = True,
                       median_rows: Column | None = None) -> DataFrame:
    """Rows whose value is below their group's exact median.

    ``median_rows`` restricts the rows the median is taken over (e.g. priced
    rows of one kind); the detail rows are not restricted by it.
    """
    base = df.where(median_rows) if median_rows is not None else df
    med = grouped_median(base, keys, value, median_alias)
    out = with_group_stat(df, med, keys)
    cond = F.col(value) < F.col(median_alias) if strict else F.col(value) <= F.col(median_alias)
    return out.where(cond)


def portfolio_sizes(df: DataFrame, owner: str, value: str | None = None) -> DataFrame:
    """Per owner: rows and (optionally) sum of ``value`` (J3 without a self-join).

    The row-vs-portfolio self-join of the source is folded into a two-level
    aggregate: everything a band report needs (owners, rows, mean value) can be
    summed from this table, so no detail row is ever joined back.
    """
    aggs = [F.count(F.lit(1)).alias("portfolio_size")]
    if value is not None:
        aggs += [F.sum(value).alias("value_sum"), F.count(value).alias("value_n")]
    return df.groupBy(owner).agg(*aggs)


def count_children(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str,
                   alias: str = "n_children", count_col: str | None = None) -> DataFrame:
    """Parents with their number of children, absent = 0.

    Children are counted first (partial aggregate; a hot parent is combined
    map-side) and the count is left-joined, instead of joining every child row.
    """
    cnt = F.count(count_col) if count_col else F.count(F.lit(1))
    per = child.groupBy(F.col(child_key).alias("__ck")).agg(cnt.alias(alias))
    out = parent.join(per, parent[parent_key] == per["__ck"], "left").drop("__ck")
    return out.withColumn(alias, F.coalesce(F.col(alias), F.lit(0)).cast("long"))
