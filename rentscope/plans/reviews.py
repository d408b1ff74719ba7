"""Review marts R1-R6, B7, B8 and the word tables.

Reviews are the second large fact: aggregate per listing before any join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up as R
from ..operators import mean_words, top_k, word_top
from . import market as M

REVIEW_BANDS = dict(bounds=[5, 20, 50], labels=["1–5", "6–20", "21–50"], else_label="51+")


def _month(c: str = "date"):
    return F.date_format(c, "yyyy-MM")


def r1_volume(reviews: DataFrame, distinct: bool = True) -> DataFrame:
    """R1 (with distinct listings) / B7 (``distinct=False``)."""
    return M.period_volume(reviews, _month(), period_alias="review_month", count_alias="reviews",
                           distinct="listing_id" if distinct else None, distinct_alias="active_listings")


def r2_words(reviews: DataFrame) -> DataFrame:
    return mean_words(reviews.withColumn("review_month", _month()), "comments", ["review_month"])


def r3_velocity(reviews: DataFrame, listings: DataFrame, asof: str, days: int = 90, min_total: int = 20,
                k: int = 20) -> DataFrame:
    per = M.trailing_vs_lifetime(reviews, "listing_id", "date", asof, days, min_total=min_total)
    j = listings.join(per, listings.id == per.listing_id, "inner")
    out = j.select("id", "name", F.col("neighbourhood_cleansed").alias("neighbourhood"), "room_type",
                   F.col("recent").alias("reviews_90d"), F.col("total").alias("total_reviews"),
                   R(F.col("recent") / F.col("total") * 100.0, 1).alias("pct_of_total_in_90d"))
    return top_k(out, [F.col("reviews_90d").desc()], k, ["id"]).drop("id")


def r4_count_bands(reviews: DataFrame, listings: DataFrame) -> DataFrame:
    return M.children_bands(listings, reviews, "id", "listing_id", REVIEW_BANDS["bounds"], REVIEW_BANDS["labels"],
                            REVIEW_BANDS["else_label"], names=("review_count_band", "listings", "pct_of_listings"))


def r5_recent_top(reviews: DataFrame, listings: DataFrame, asof: str, days: int = 365, k: int = 15) -> DataFrame:
    per = M.trailing_count(reviews, "listing_id", "date", asof, days, "reviews_12mo")
    j = listings.join(per, listings.id == per.listing_id, "inner")
    out = j.select("id", "name", F.col("neighbourhood_cleansed").alias("neighbourhood"), "room_type",
                   R("price", 2).alias("price"), F.col("review_scores_rating").alias("rating"), "reviews_12mo")
    return top_k(out, [F.col("reviews_12mo").desc()], k, ["id"]).drop("id")


def r6_seasonality(reviews: DataFrame, start: str = "2024-01-01", end: str = "2026-08-01") -> DataFrame:
    return M.month_of_year_mean(reviews, "date", start, end, alias="avg_reviews_per_month")


def b8_velocity_top(listings: DataFrame, min_reviews: int = 20, k: int = 15) -> DataFrame:
    df = listings.where((F.col("number_of_reviews") >= min_reviews) & F.col("reviews_per_month").isNotNull())
    out = df.select("id", "name", F.col("neighbourhood_cleansed").alias("nb"), "room_type",
                    R("price", 2).alias("price"), R("reviews_per_month", 2).alias("reviews_pm"),
                    F.col("number_of_reviews").alias("reviews"), F.col("reviews_per_month").alias("__o"))
    return top_k(out, [F.col("__o").desc()], k, ["id"]).drop("id", "__o")


def t1_top_words(reviews: DataFrame, k: int = 100, **kw) -> DataFrame:
    """Word frequency per year, markup stripped, stop words removed, top k with rank."""
    df = reviews.withColumn("year", F.year("date"))
    return word_top(df, "comments", ["year"], k=k, **kw).select("year", "rank", "word", "count")


def t4_side_by_side(words: DataFrame, k: int = 20) -> DataFrame:
    """Top-k words per year spread side by side by rank."""
    top = words.where(F.col("rank") <= k)
    return top.groupBy("rank").pivot("year").agg(F.first("word")).orderBy("rank")


def h8_peak_month(reviews: DataFrame) -> DataFrame:
    """Review volume's peak and low month (ties to the earliest month)."""
    from ..operators import extremes
    return extremes(r1_volume(reviews, distinct=False), "review_month", "reviews",
                    names=("peak_month", "peak_reviews", "low_month", "low_reviews"))
