"""Multi-snapshot marts: KPI rows (B2/D1/D2), snapshot comparisons (D14-D17),
trends (D18, D28), change vs previous month (W6: M14/D27) and the long
metrics table (S14)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pct, round_half_up as R
from ..operators import group_movers, metric_deltas, share_of_total, snapshot_diff, unpivot_long
from . import market as M
from .document import document
from .listings import ENTIRE, PRIVATE

KPI_NAMES = {"period": "month", "rows": "listings", "a_median": "entire_med", "b_median": "private_med",
             "no_price_pct": "no_quote_pct", "flag_share": "superhost_share", "never_pct": "never_reviewed_pct",
             "premium": "premium"}
KPI_METRICS = ["listings", "entire_med", "private_med", "no_quote_pct", "superhost_share", "never_reviewed_pct"]


def listings_slim(frames: dict[str, DataFrame]) -> DataFrame:
    """B1: stack typed monthly snapshots, checked for and pruned to the slim columns."""
    from ..operators import stack_snapshots
    from ..sources import LISTING_SLIM_COLUMNS
    return stack_snapshots(frames, LISTING_SLIM_COLUMNS, label="month")


def kpis(stacked: DataFrame) -> DataFrame:
    """One KPI row per month of the stacked table (B2 / D2, premium from rounded medians)."""
    never = (F.col("number_of_reviews") == 0) | F.col("number_of_reviews").isNull()
    return M.kpi_rows(stacked, F.col("month"), "price", "room_type", ENTIRE, PRIVATE,
                      flag=F.col("host_is_superhost") == 1, never=never, names=KPI_NAMES)


def kpi_deltas(stacked: DataFrame) -> DataFrame:
    """Change vs previous month per KPI."""
    long = unpivot_long(kpis(stacked), ["month"], KPI_METRICS, "metric", "value")
    return metric_deltas(long, "metric", "month", "value")


def added_removed(stacked: DataFrame, old: str, new: str) -> DataFrame:
    """Listings added / removed / kept between two months."""
    return snapshot_diff(stacked, "id", old, new)


def overall_median(stacked: DataFrame) -> DataFrame:
    """Priced median per month (exact), then % change vs the previous month."""
    from ..operators import grouped_median
    m = grouped_median(stacked.where(F.col("price") > 0), ["month"], "price", "value")
    long = m.select("month", F.lit("median_price").alias("metric"), R("value", 2).alias("value"))
    return metric_deltas(long, "metric", "month", "value")


def room_mix_by_month(stacked: DataFrame) -> DataFrame:
    """Room-type counts and share within each month."""
    g = stacked.groupBy("month", "room_type").agg(F.count(F.lit(1)).alias("n"))
    return share_of_total(g, "n", "pct", within=["month"])


def median_movers(stacked: DataFrame, old: str, new: str, min_rows: int = 50) -> DataFrame:
    """Top-3 area median movers with >= min_rows priced rows in both months."""
    return group_movers(stacked.where(F.col("price") > 0), "neighbourhood_cleansed", "price", old, new,
                        min_rows=min_rows)


def professionalisation(stacked: DataFrame) -> DataFrame:
    """D18 per month."""
    n = F.col("calculated_host_listings_count")
    df = stacked.where(n.isNotNull())
    share = lambda cond: R(pct(F.count_if(cond), F.count(F.lit(1))), 1)
    return df.groupBy("month").agg(share(n >= 2).alias("pct_multi"), share(n >= 5).alias("pct_5plus"),
                                   share(n == 1).alias("pct_single"), share(F.col("room_type") == ENTIRE).alias("pct_entire"))


def area_trajectories(stacked: DataFrame, months: list[str], k: int = 8) -> DataFrame:
    """Median price per month of the k biggest areas of the latest month, pivoted."""
    from ..operators import grouped_median, materialize, pivot_wide, top_k
    priced = stacked.where((F.col("price") > 0) & F.col("neighbourhood_cleansed").isNotNull())
    # the sizes that make the top list come with the medians
    m = materialize(grouped_median(priced, ["month", "neighbourhood_cleansed"], "price", "med", stats={"n": "n"}))
    latest = m.agg(F.max("month")).scalar()
    top = top_k(m.where(F.col("month") == latest), [F.col("n").desc()], k,
                ["neighbourhood_cleansed"]).select("neighbourhood_cleansed")
    m = m.join(top, "neighbourhood_cleansed", "left_semi").drop("n").withColumn("med", R("med", 2))
    return pivot_wide(m, ["neighbourhood_cleansed"], "month", "med", {mo: mo for mo in months})


def metrics_tables(stacked: DataFrame, period: str = "month") -> DataFrame:
    """The document (M1-M13) of every month of a stacked table, see ``plans.document``."""
    return document(stacked, period)


def metrics_table(listings: DataFrame, month: str) -> DataFrame:
    """S14 of one month's listings: (month, metric, key, rank, value, text), ready for
    ``write.partitionBy('month')``."""
    return document(listings.withColumn("month", F.lit(month)), "month")
