"""Pivot / unpivot / caller-ordered comparison."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pivot_wide(df: DataFrame, index: Sequence[str], column: str, value: str,
               values: Mapping[object, str], agg: str = "max",
               default: float | None = None) -> DataFrame:
    """Long -> wide with an explicit value list.

    The value list is given so no extra job discovers it; ``values`` maps each
    pivot value to its output column name. ``default`` fills absent cells
    (e.g. 0.0 for a band with no rows).
    """
    fn = getattr(F, agg)
    aggs = [fn(F.when(F.col(column) == k, F.col(value))).alias(name) for k, name in values.items()]
    out = (df.groupBy(*index) if index else df).agg(*aggs)
    if default is not None:
        out = out.fillna(default, subset=list(values.values()))
    return out


def side_by_side(df: DataFrame, index: Sequence[str], column: str | Column, value: Column, alias: str, count_alias: str) -> DataFrame:
    """One line per index with every ``column=value`` found in the data, in order of the column (U4, T4).

    Unlike a pivot it needs no list of values, so a new period or group appears by itself. For
    aggregated input: one row per index and column, a line holds as many parts as there are columns.
    Rows with a NULL column or value are passed over.
    """
    key = F.col(column) if isinstance(column, str) else column
    rows = df.select(*index, F.struct(key.alias("k"), F.concat(key, F.lit("="), value).alias("part")).alias("e"), (key.isNotNull() & value.isNotNull()).alias("has")).where("has")
    lines = rows.groupBy(*index).agg(F.count(F.lit(1)).alias(count_alias), F.sort_array(F.collect_list("e")).alias("e"))
    return lines.select(*index, count_alias, F.array_join("e.part", " ").alias(alias))


def unpivot_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str],
                 variable: str = "metric", value: str = "value",
                 labels: Mapping[str, str] | None = None) -> DataFrame:
    """Wide -> long (U5) with optional relabelling of the variable."""
    out = df.unpivot(list(ids), [F.col(c).cast("double").alias(c) for c in columns], variable, value) \
        if ids else df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], variable, value)
    if labels:
        expr = None
        for k, lab in labels.items():
            expr = F.when(F.col(variable) == k, F.lit(lab)) if expr is None else expr.when(F.col(variable) == k, F.lit(lab))
        out = out.withColumn(variable, expr.otherwise(F.col(variable)))
    return out


def picks_frame(spark: SparkSession, key: str, picks: Sequence[str]) -> DataFrame:
    """The caller's key list with its position."""
    return spark.createDataFrame([(p, i) for i, p in enumerate(picks)], f"{key} string, position int")


def compare_groups(picks: DataFrame, stats: DataFrame, key: str, *more: DataFrame) -> DataFrame:
    """Stats of caller-picked groups in the caller's order; picks without rows are
    kept with NULL stats (J10): left joins from the picks frame."""
    out = picks.join(stats, key, "left")
    for m in more:
        out = out.join(m, key, "left")
    return out
