"""Calendar marts C1-C6 and the precomputed B3-B6 variants.

The calendar is the large fact (listing x forward day). Every mart aggregates
it per listing first (partial aggregation, one shuffle by listing id) and only
then joins the small per-listing result to the listings table (J4).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import band
from ..functions.numeric import pct, round_half_up as R
from ..operators import pivot_wide, share_of_total, top_k
from . import market as M

# Band labels of the source reports.
LEAD_BANDS = dict(uppers=[7, 30, 90], labels=["0–7 days", "8–30 days", "31–90 days"], else_label="90+ days",
                  null_label="No bookings in 365d")
MIN_NIGHT_BANDS = dict(uppers=[1, 3, 7, 30], labels=["1 night", "2–3 nights", "4–7 nights", "8–30 nights"],
                       else_label="31+ nights")
MIN_NIGHT_BANDS_WIDE = dict(uppers=[1, 7, 30], labels=["1 night", "2–7 nights", "8–30 nights"], else_label="31+ nights")


def per_listing(calendar: DataFrame) -> DataFrame:
    """One row per listing: days, unavailable days, first day, first unavailable day, min nights."""
    c = F.col
    return calendar.groupBy("listing_id").agg(
        F.count(F.lit(1)).alias("total_days"), F.sum(F.lit(1) - c("available")).alias("booked_days"),
        F.min("date").alias("start_date"), F.min(F.when(c("available") == 0, c("date"))).alias("first_booked"),
        F.min("minimum_nights").alias("minimum_nights"))


def c1_city_unavailability(calendar: DataFrame) -> DataFrame:
    """Mean over listings of the unavailable share (C1) - not B5's ratio of sums."""
    return M.entity_ratio_mean(calendar, "listing_id", F.col("available") == 0,
                               alias="avg_true_occupancy_pct", count_alias="listings")


def b5_city_unavailability(calendar: DataFrame) -> DataFrame:
    """Unavailable days over all days."""
    return M.ratio_of_sums(calendar, F.col("available") == 0, alias="city_true_occ_pct")


def c2_true_vs_estimate(calendar: DataFrame, listings: DataFrame, k: int = 10) -> DataFrame:
    """Per-listing % rounded to 1 place before averaging; top k areas by size."""
    pl = per_listing(calendar).select("listing_id", R(pct(F.col("booked_days"), F.col("total_days")), 1).alias("t"))
    l = listings.where(F.col("estimated_occupancy_l365d").isNotNull()).select(
        "id", "neighbourhood_cleansed", "estimated_occupancy_l365d")
    j = l.join(pl, l.id == pl.listing_id, "inner")
    est = F.col("estimated_occupancy_l365d") * 100.0 / 365
    g = j.groupBy(F.col("neighbourhood_cleansed").alias("neighbourhood")).agg(
        F.count(F.lit(1)).alias("listings"), F.avg("t").alias("__t"), F.avg(est).alias("__e"))
    g = g.select("neighbourhood", "listings", R("__t", 1).alias("true_occ_pct"), R("__e", 1).alias("est_occ_pct"),
                 R(F.col("__t") - F.col("__e"), 1).alias("bias_pts_true_minus_est"))
    return top_k(g, [F.col("listings").desc()], k, ["neighbourhood"])


def b4_occupancy_by_area(calendar: DataFrame, listings: DataFrame, min_rows: int = 20, k: int = 10) -> DataFrame:
    """No inner rounding, >= min_rows, top k by unavailable %, estimate may be NULL."""
    pl = per_listing(calendar).select("listing_id", pct(F.col("booked_days"), F.col("total_days")).alias("t"))
    l = listings.select("id", "neighbourhood_cleansed", "estimated_occupancy_l365d")
    j = l.join(pl, l.id == pl.listing_id, "inner")
    g = j.groupBy(F.col("neighbourhood_cleansed").alias("nb")).agg(
        F.count(F.lit(1)).alias("listings"), R(F.avg("t"), 1).alias("true_occ_pct"),
        R(F.avg("estimated_occupancy_l365d") * 100.0 / 365, 1).alias("est_occ_pct")).where(F.col("listings") >= min_rows)
    return top_k(g, [F.col("true_occ_pct").desc()], k, ["nb"])


def c3_availability_curve(calendar: DataFrame, null_counts: bool = False) -> DataFrame:
    """C3 (AVG skips NULL flags) / B3 (``null_counts=True``: NULL in the denominator)."""
    a = F.coalesce(F.col("available"), F.lit(0)) if null_counts else F.col("available")
    return M.period_share(calendar, F.date_format("date", "yyyy-MM"), a, period_alias="cal_month",
                          count_alias=None if null_counts else "listing_days", pct_alias="pct_available")


def c4_lead_time(calendar: DataFrame) -> DataFrame:
    lt = M.lead_time(calendar, "listing_id", "date", F.col("available") == 0)
    return M.band_counts(lt, band("lead_days", **LEAD_BANDS), "lead_time_band", "listings", "pct")


def c5_min_nights(calendar: DataFrame) -> DataFrame:
    """Per-listing minimum of minimum_nights, banded; NULL falls into '31+ nights'."""
    pl = calendar.groupBy("listing_id").agg(F.min("minimum_nights").alias("mn"))
    return M.band_counts(pl, band("mn", **MIN_NIGHT_BANDS), "min_nights_band", "listings", "pct")


def b6_min_nights_wide(listings: DataFrame) -> DataFrame:
    """Bands 1 / 2-7 / 8-30 / 31+ on listings, spread to columns, 0.0 default."""
    g = listings.groupBy(band("minimum_nights", **MIN_NIGHT_BANDS_WIDE).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    g = share_of_total(g, "n", "pct")       # bands are exhaustive (NULL falls to ELSE): sum = all rows
    return pivot_wide(g, [], "band", "pct", {"1 night": "min_nights_1", "2–7 nights": "min_nights_2_7",
                                             "8–30 nights": "min_nights_8_30", "31+ nights": "min_nights_31plus"},
                      default=0.0)


def c6_by_room_type(calendar: DataFrame, listings: DataFrame) -> DataFrame:
    pl = per_listing(calendar)
    j = listings.select("id", "room_type").join(pl, F.col("id") == F.col("listing_id"), "inner")
    return j.groupBy("room_type").agg(
        F.count(F.lit(1)).alias("listings"), R(F.avg("minimum_nights"), 1).alias("avg_min_nights"),
        R(F.avg(pct(F.col("booked_days"), F.col("total_days"))), 1).alias("avg_true_occ_pct"))


def h9_low_high_month(calendar: DataFrame) -> DataFrame:
    """Availability curve's highest and lowest month (ties to the earliest month)."""
    from ..operators import extremes
    return extremes(c3_availability_curve(calendar), "cal_month", "pct_available",
                    names=("high_month", "high_pct_available", "low_month", "low_pct_available"))
