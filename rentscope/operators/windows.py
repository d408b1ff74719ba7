"""Steps, deltas and rolling runs over ordered aggregates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import pct, round_half_up


def adjacent_step(agg: DataFrame, order: str, value: str, alias: str = "step",
                  digits: int | None = 2, within: Sequence[str] = ()) -> DataFrame:
    """``value - lag(value)`` over ``order`` (W4), on already aggregated rows.

    Only meant for bounded aggregates (a handful of bands or periods): without
    ``within`` the window has one partition.
    """
    w = Window.partitionBy(*within).orderBy(F.col(order)) if within else Window.orderBy(F.col(order))
    d = F.col(value) - F.lag(value).over(w)
    return agg.withColumn(alias, round_half_up(d, digits) if digits is not None else d)


def metric_deltas(long: DataFrame, metric: str = "metric", period: str = "period",
                  value: str = "value", digits: int | None = 2) -> DataFrame:
    """Change vs. previous period for each metric.

    Input is a long table (metric, period, value); adds prev_value, delta and
    pct_change (NULL when there is no previous period or it is 0).
    """
    w = Window.partitionBy(metric).orderBy(period)
    prev = F.lag(value).over(w)
    out = (long.withColumn("prev_value", prev)
               .withColumn("delta", F.col(value) - F.col("prev_value"))
               .withColumn("pct_change", pct(F.col("delta"), F.col("prev_value"))))
    if digits is not None:
        for c in ("delta", "pct_change"):
            out = out.withColumn(c, round_half_up(c, digits))
    return out


def rolling_sum(agg: DataFrame, order_index: str, value: str, width: int,
                alias: str = "rolling") -> DataFrame:
    """Sum over the ``width`` consecutive index values ending at each row.

    A RANGE frame, so gaps in the index (a missing month) are not bridged.
    """
    w = Window.orderBy(F.col(order_index)).rangeBetween(-(width - 1), 0)
    return agg.withColumn(alias, F.sum(value).over(w))
