"""Listing-snapshot marts: quality gates Q0-Q8 and market questions A1-A11,
with the dashboard (D) and monthly-document (M) variants as arguments.

Input: the typed ``listings`` table of one snapshot (``sources.clean_listings``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import band, label_flag
from ..functions.numeric import pct, round_half_up as R
from ..operators import (count_conditions, duplicate_keys, grouped_median, mix, random_sample, top_k)
from . import market as M

ENTIRE, PRIVATE = "Entire home/apt", "Private room"   # fixed values: room-type labels of the source data

# Band labels of the source reports.
RATING_BANDS = dict(uppers=[4.5, 4.8], labels=["Below 4.50", "4.50 – 4.79"], else_label="4.80 – 5.00",
                    null_label="No rating yet", strict=True)
AVAIL_BANDS = dict(uppers=[30, 90, 180, 300], labels=["0–30 days", "31–90 days", "91–180 days", "181–300 days"],
                   else_label="301–365 days")
HOST_BANDS = dict(bounds=(1, 5), labels=("1 listing", "2–5 listings"), else_label="6+ listings")


# ---------------------------------------------------------------- quality gates
def q0_size(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count(F.lit(1)).alias("listings"), F.min("last_scraped").alias("earliest_scrape"),
                        F.max("last_scraped").alias("latest_scrape"))


def q1_nulls(listings: DataFrame) -> DataFrame:
    c = F.col
    out = count_conditions(listings, {
        "missing_price": c("price").isNull(), "missing_room_type": c("room_type").isNull(),
        "missing_neighbourhood": c("neighbourhood_cleansed").isNull(),
        "missing_coordinates": c("latitude").isNull() | c("longitude").isNull(),
        "missing_review_count": c("number_of_reviews").isNull(),
        "missing_rating": c("review_scores_rating").isNull(),
        "listings_never_reviewed": c("first_review").isNull()}, "total_listings")
    return out.withColumn("pct_missing_price", R(pct(c("missing_price"), c("total_listings")), 1))


def q2_room_mix(listings: DataFrame) -> DataFrame:
    return mix(listings, "room_type", "n", "pct")


def q2_property_top(listings: DataFrame, k: int = 15) -> DataFrame:
    g = listings.groupBy("property_type").agg(F.count(F.lit(1)).alias("n"))
    return top_k(g, [F.col("n").desc()], k, ["property_type"])


def q3_price_by_room(listings: DataFrame) -> DataFrame:
    return M.price_profile(listings, "room_type", "price")


def q4_duplicate_ids(listings: DataFrame) -> DataFrame:
    return duplicate_keys(listings, ["id"])


def q5_ranges(listings: DataFrame) -> DataFrame:
    c = F.col
    return count_conditions(listings, {
        "odd_accommodates": (c("accommodates") <= 0) | (c("accommodates") > 16),
        "odd_bedrooms": (c("bedrooms") < 0) | (c("bedrooms") > 10),
        "bad_availability_365": (c("availability_365") < 0) | (c("availability_365") > 365),
        "bad_availability_30": (c("availability_30") < 0) | (c("availability_30") > 30),
        "bad_rating": (c("review_scores_rating") < 1) | (c("review_scores_rating") > 5),
        "negative_min_nights": c("minimum_nights") < 0, "negative_price": c("price") < 0})


def q6_dates(listings: DataFrame) -> DataFrame:
    c = F.col
    return count_conditions(listings, {
        "last_before_first": c("last_review") < c("first_review"),
        "review_after_scrape": c("last_review") > c("last_scraped"),
        "has_first_review_but_zero_reviews": c("first_review").isNotNull() & (c("number_of_reviews") == 0)})


def q7_blank_column(raw: DataFrame, column: str = "instant_bookable") -> DataFrame:
    return raw.agg(F.count_if(F.col(column).isNull() | (F.col(column) == ""))
                   .alias(f"rows_where_{column}_is_blank"))


def q8_spot_check(listings: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    return random_sample(listings.select("id", "name", "neighbourhood_cleansed", "room_type", "price",
                                         "accommodates", "bathrooms", "bedrooms", "number_of_reviews",
                                         "last_scraped"), n, seed)


# ---------------------------------------------------------------- market questions
def a1_top_areas(listings: DataFrame, k: int | None = 15, share_digits: int = 1,
                 keep_null_area: bool = False) -> DataFrame:
    """A1 (k=15, share to 1 place); D3 (k=None); M7 (share_digits=2, keep_null_area=True:
    the NULL area is a row and counts in the share's total)."""
    return M.supply_by_group(listings, "neighbourhood_cleansed", "price", limit=k, out_key="neighbourhood",
                             share_digits=share_digits, keep_null=keep_null_area)


def a2_entire_premium(listings: DataFrame, ratio_of_rounded: bool = False) -> DataFrame:
    """A2 (ratio of unrounded medians) / M3 (``ratio_of_rounded=True``)."""
    from ..operators import median_ratio
    return median_ratio(listings.where(F.col("price") > 0), "room_type", "price", ENTIRE, PRIVATE,
                        names=("entire_home_median", "private_room_median", "entire_home_premium_ratio"),
                        ratio_of_rounded=ratio_of_rounded)


def a3_host_type(listings: DataFrame, include_unknown: bool = True, rounded: bool = True) -> DataFrame:
    """A3/M4; H3 is ``include_unknown=False, rounded=False``; D4 drops one column."""
    df = listings.where(F.col("price") > 0)
    if not include_unknown:
        df = df.where(F.col("host_is_superhost").isNotNull())
    d = (lambda n: n) if rounded else (lambda n: None)
    return M.grouped_stats(df, label_flag("host_is_superhost", "Superhost", "Regular host", "Unknown"),
                           "host_type", "listings",
                           {"avg_price": ("price", d(2)), "avg_rating": ("review_scores_rating", d(2)),
                            "avg_reviews_per_month": ("reviews_per_month", d(2)),
                            "avg_total_reviews": ("number_of_reviews", d(1))})


def a4_rating_bands(listings: DataFrame) -> DataFrame:
    g = M.grouped_stats(listings.where(F.col("price") > 0), band("review_scores_rating", **RATING_BANDS),
                        "rating_band", "listings", {"avg_price": ("price", 2), "avg_reviews": ("number_of_reviews", 1)})
    return g.orderBy(F.col("avg_price").desc())


def a5_availability_bands(listings: DataFrame, priced_only: bool = False) -> DataFrame:
    """A5 (all rows with availability) / M6 (``priced_only=True``)."""
    df = listings.where(F.col("availability_365").isNotNull())
    if priced_only:
        df = df.where(F.col("price") > 0)
    g = df.groupBy(band("availability_365", **AVAIL_BANDS).alias("availability_band")).agg(
        F.count(F.lit(1)).alias("listings"), R(F.avg("estimated_occupancy_l365d"), 1).alias("avg_est_occupancy_days"),
        R(F.avg(F.col("estimated_occupancy_l365d") * 100.0 / 365), 1).alias("implied_occupancy_pct"),
        F.min("availability_365").alias("__o"))
    return g.orderBy("__o").drop("__o")


def a6_most_reviewed(listings: DataFrame, k: int = 20) -> DataFrame:
    out = listings.select("number_of_reviews", "name", F.col("neighbourhood_cleansed").alias("neighbourhood"),
                          "room_type", R("price", 2).alias("price"), F.col("review_scores_rating").alias("rating"), "id")
    return top_k(out, [F.col("number_of_reviews").desc_nulls_last()], k, ["id"]).drop("id")


def a7_latest_review_months(listings: DataFrame, k: int = 24) -> DataFrame:
    g = listings.where(F.col("last_review").isNotNull()).groupBy(
        F.date_format("last_review", "yyyy-MM").alias("review_month")).agg(
        F.count(F.lit(1)).alias("listings_with_latest_review"))
    return top_k(g, [F.col("review_month").desc()], k)


def a8_host_concentration(listings: DataFrame, keep_null_host: bool = False) -> DataFrame:
    """A8/D5; M8 keeps the NULL host as one group (``keep_null_host=True``)."""
    g = M.portfolio_bands(listings, "host_id", "price", keep_null_owner=keep_null_host, **HOST_BANDS)
    order = F.when(F.col("host_size_band") == "1 listing", 0).when(F.col("host_size_band") == "2–5 listings", 1).otherwise(2)
    return g.orderBy(order)


def a9_bedroom_curve(listings: DataFrame, mode: str = "keep") -> DataFrame:
    """A9 (raw bedrooms, 0-5), D7 (``mode='prefilter'``, 1-5 before the step),
    H6 (``mode='postfilter'``), M9 (``mode='cast'``: groups by the truncated value)."""
    df = listings.where(F.col("room_type") == ENTIRE)
    names = ("listings", "avg_price", "marginal_cost_of_extra_bedroom")
    if mode == "cast":
        return M.step_curve(df, "bedrooms", "price", 0, 5, names=names, group_by_cast="int").orderBy("bedrooms")
    return M.step_curve(df, "bedrooms", "price", 0, 5, mode=mode, cut=1, names=names).orderBy("bedrooms")


def a10_revenue_leaders(listings: DataFrame, min_rows: int | None = 20, priced_only: bool = False) -> DataFrame:
    """A10 (>= 20 rows) / M10 (``min_rows=None, priced_only=True``)."""
    df = listings.where(F.col("price") > 0) if priced_only else listings
    return M.having_top(df, "neighbourhood_cleansed", "estimated_revenue_l365d", min_rows=min_rows, k=10,
                        names=("listings", "avg_est_annual_revenue"), out_key="neighbourhood",
                        extra_means={"avg_est_occupancy_days": ("estimated_occupancy_l365d", 1)})


def a11_value_picks(listings: DataFrame, min_rating: float = 4.8, min_reviews: int = 20, k: int = 20,
                    area: str | None = None, max_price: float | None = None) -> DataFrame:
    """A11 (k=20) / M13 (k=8) / D29 (``min_reviews=10, k=25`` with the area and the price ceiling
    picked by the user; the ceiling bounds the picks, not the rows of the median)."""
    c = F.col
    base = (c("room_type") == ENTIRE) & (c("price") > 0)
    if area is not None:
        listings = listings.where(c("neighbourhood_cleansed") == area)      # an area's median needs its own rows only
    ceiling = F.lit(True) if max_price is None else c("price") <= max_price
    return M.value_picks(
        listings, "neighbourhood_cleansed", "price", median_filter=base,
        pick_filter=base & ceiling & (c("review_scores_rating") >= min_rating) & (c("number_of_reviews") >= min_reviews),
        order=[c("review_scores_rating").desc(), c("number_of_reviews").desc()], tiebreak=["id"], k=k,
        select=["name", c("neighbourhood_cleansed").alias("neighbourhood"), R("price", 2).alias("price"),
                "nb_median_price", c("review_scores_rating").alias("rating"), c("number_of_reviews").alias("reviews")])


# ---------------------------------------------------------------- dashboard-only marts
def d19_revenue_by_room(listings: DataFrame) -> DataFrame:
    """Median upper-bound 30-day revenue price x (30 - availability_30) by room type."""
    df = listings.where((F.col("price") > 0) & F.col("availability_30").isNotNull()) \
        .withColumn("rev", F.col("price") * (F.lit(30) - F.col("availability_30")))
    m = grouped_median(df, ["room_type"], "rev", "__m", stats={"n": "listings"})      # the NULL room type is a group
    return m.select("room_type", R("__m", 2).alias("median_est_revenue"), "listings")


def d22_forward_availability(listings: DataFrame, keys=(), min_rows: int | None = None,
                             k: int | None = None) -> DataFrame:
    """D22 (city) / D23 (``keys=['neighbourhood_cleansed'], min_rows=30, k=15``): median free days
    of the next 30/60/90 as a percentage of the window; rows with a NULL key are left out."""
    from ..operators import multi_median
    for key in keys:
        listings = listings.where(F.col(key).isNotNull())
    days = (30, 60, 90)
    out = multi_median(listings, list(keys), {f"__{d}": f"availability_{d}" for d in days}, count_alias="listings")
    out = out.select(*keys, "listings", *[R(F.col(f"__{d}") * 100.0 / d, 1).alias(f"med_avail_{d}") for d in days])
    if min_rows is not None:
        out = out.where(F.col("listings") >= min_rows)
    if k is not None:
        out = top_k(out, [F.col("listings").desc()], k, list(keys))
    return out


def d18_professionalisation(listings: DataFrame) -> DataFrame:
    c, n = F.col, F.col("calculated_host_listings_count")
    df = listings.where(n.isNotNull())
    share = lambda cond: R(pct(F.count_if(cond), F.count(F.lit(1))), 1)
    return df.agg(share(n >= 2).alias("pct_multi"), share(n >= 5).alias("pct_5plus"),
                  share(n == 1).alias("pct_single"), share(c("room_type") == ENTIRE).alias("pct_entire"))


def d13_area_list(listings: DataFrame, k: int = 60) -> DataFrame:
    """Selector list: the k biggest areas, NULL excluded."""
    g = listings.where(F.col("neighbourhood_cleansed").isNotNull()).groupBy("neighbourhood_cleansed") \
        .agg(F.count(F.lit(1)).alias("listings"))
    return top_k(g, [F.col("listings").desc()], k, ["neighbourhood_cleansed"])


def _revenue_rows(listings: DataFrame) -> DataFrame:
    return listings.where((F.col("price") > 0) & F.col("availability_30").isNotNull()) \
        .withColumn("rev", F.col("price") * (F.lit(30) - F.col("availability_30")))


def d20_revenue_by_area(listings: DataFrame, k: int = 15) -> DataFrame:
    """Median upper-bound 30-day revenue by area, the k biggest areas."""
    df = _revenue_rows(listings).where(F.col("neighbourhood_cleansed").isNotNull())
    m = grouped_median(df, ["neighbourhood_cleansed"], "rev", "__m", stats={"n": "listings"})
    m = m.select(F.col("neighbourhood_cleansed").alias("nb"), R("__m", 2).alias("median_est_revenue"), "listings")
    return top_k(m, [F.col("listings").desc()], k, ["nb"])


def d21_revenue_exclusions(listings: DataFrame) -> DataFrame:
    """How many rows D19/D20 leave out, and why."""
    c = F.col
    return count_conditions(listings, {"no_price": c("price").isNull() | (c("price") <= 0),
                                       "no_availability_30": (c("price") > 0) & c("availability_30").isNull(),
                                       "no_area": c("neighbourhood_cleansed").isNull()}, "listings")


def d24_comparator(listings: DataFrame, picks: list[str]) -> DataFrame:
    """Stats and entire/private medians of caller-picked areas, in the caller's order;
    a pick without rows stays as an empty row (D24 + D25)."""
    from ..functions.numeric import pct as _pct
    from ..operators import compare_groups, picks_frame, pivot_wide
    c = F.col
    df = listings.where(c("neighbourhood_cleansed").isin(picks)).withColumnRenamed("neighbourhood_cleansed", "nb")
    priced = c("price") > 0
    stats = df.groupBy("nb").agg(
        F.count(F.lit(1)).alias("listings"),
        R(_pct(F.count_if(priced & (c("host_is_superhost") == 1)), F.nullif(F.count_if(priced), F.lit(0))), 1)
        .alias("superhost_pct"),
        R(F.avg(F.lit(100.0) * (F.lit(1) - c("availability_365") / 365.0)), 1).alias("occ_upper_pct"),
        R(F.avg("reviews_per_month"), 2).alias("reviews_pm"))
    med = grouped_median(df.where(priced & c("room_type").isin(ENTIRE, PRIVATE)), ["nb", "room_type"], "price", "m") \
        .withColumn("m", R("m", 2))
    piv = pivot_wide(med, ["nb"], "room_type", "m", {ENTIRE: "entire_median", PRIVATE: "private_median"})
    spark = listings.sparkSession
    return compare_groups(picks_frame(spark, "nb", picks), stats, "nb", piv).orderBy("position")


def d26_mean_median_skew(listings: DataFrame, min_rows: int = 50, k: int = 10) -> DataFrame:
    """Areas whose mean price sits furthest above the median."""
    s = M.supply_by_group(listings, "neighbourhood_cleansed", "price", limit=None, out_key="nb", min_rows=min_rows)
    s = s.withColumn("skew", R(F.col("avg_price") - F.col("median_price"), 2))
    return top_k(s, [F.col("skew").desc()], k, ["nb"])
