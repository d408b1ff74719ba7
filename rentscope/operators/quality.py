"""Data-quality gates (Q0-Q7, QS, F5, F6, N9)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pct, round_half_up


def count_conditions(df: DataFrame, conditions: Mapping[str, Column],
                     total_alias: str | None = None) -> DataFrame:
    """One row: how many rows meet each condition.

    ``count_if`` gives 0 for NULL conditions and over zero rows, one pass.
    """
    aggs = [F.count(F.lit(1)).alias(total_alias)] if total_alias else []
    aggs += [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]
    return df.agg(*aggs)


def null_profile(df: DataFrame, columns: Mapping[str, Column | str],
                 pct_of: str | None = None, total_alias: str = "total_rows") -> DataFrame:
    """NULL counts per condition plus % missing of one of them (Q1)."""
    conds = {name: (F.col(c).isNull() if isinstance(c, str) else c) for name, c in columns.items()}
    out = count_conditions(df, conds, total_alias)
    if pct_of:
        out = out.withColumn(f"pct_{pct_of}", round_half_up(pct(F.col(pct_of), F.col(total_alias)), 1))
    return out


def range_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Out-of-range counts, each rule an OR of bounds."""
    return count_conditions(df, rules)


def duplicate_keys(df: DataFrame, keys: Sequence[str], alias: str = "occurrences") -> DataFrame:
    """Keys that occur more than once (Q4); an empty result passes the gate."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias)).where(F.col(alias) > 1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when ``keys`` is not unique (N9). Runs one small job."""
    dup = duplicate_keys(df, keys).limit(1).collect()
    if dup:
        raise ValueError(f"key {list(keys)} is not unique, e.g. {dup[0].asDict()}")


def load_checks(checks: Mapping[str, Column], df_for: Mapping[str, DataFrame]) -> DataFrame:
    """UNION ALL of one-line checks with mixed-type values (QS / U1).

    ``checks`` maps name -> aggregate column, ``df_for`` maps name -> source frame.
    Checks on the same frame are computed in one aggregate (one scan per
    source), then unpivoted; values are strings so integers and dates share a column.
    """
    by_frame: dict[int, tuple[DataFrame, list[str]]] = {}
    for name in checks:
        df = df_for[name]
        by_frame.setdefault(id(df), (df, []))[1].append(name)
    out = None
    for df, names in by_frame.values():
        one = df.agg(*[checks[n].cast("string").alias(f"c{i}") for i, n in enumerate(names)])
        long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("value"))
                                              for i, n in enumerate(names)])).alias("r")).select("r.*")
        out = long if out is None else out.unionByName(long)
    return out
