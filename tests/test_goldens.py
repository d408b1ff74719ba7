"""Derived goldens: the source's captured review outputs that follow from each other.

The captured monthly review counts (R1) fix the review table's month totals; the
captured seasonality output (R6) must follow from them through our R6 mart, and
our R1 / B7 must give the counts back. The review rows are rebuilt by Spark from
the counts (one row per review, dated inside its month).
"""
from pyspark.sql import functions as F

from rentscope.plans.reviews import h8_peak_month, r1_volume, r6_seasonality

# The source's captured R1 review counts per month, 2023-01 .. 2026-08.
R1_REVIEWS = {
    "2023-01": 3633, "2023-02": 3356, "2023-03": 4851, "2023-04": 6109, "2023-05": 7683, "2023-06": 9176,
    "2023-07": 9760, "2023-08": 10252, "2023-09": 9866, "2023-10": 8781, "2023-11": 6118, "2023-12": 5151,
    "2024-01": 4536, "2024-02": 4392, "2024-03": 6393, "2024-04": 7709, "2024-05": 9336, "2024-06": 11991,
    "2024-07": 12323, "2024-08": 14130, "2024-09": 13005, "2024-10": 10116, "2024-11": 11427, "2024-12": 6924,
    "2025-01": 5256, "2025-02": 4756, "2025-03": 7385, "2025-04": 8654, "2025-05": 11498, "2025-06": 13723,
    "2025-07": 16744, "2025-08": 18678, "2025-09": 17174, "2025-10": 13700, "2025-11": 10231, "2025-12": 7747,
    "2026-01": 6641, "2026-02": 6047, "2026-03": 10304, "2026-04": 12967, "2026-05": 19335, "2026-06": 23782,
    "2026-07": 24685, "2026-08": 10804,
}

# The source's captured R6 output (mean monthly reviews by month of year, 2024-01 .. 2026-07).
R6_AVG = {"01": 5478.0, "02": 5065.0, "03": 8027.0, "04": 9777.0, "05": 13390.0, "06": 16499.0,
          "07": 17917.0, "08": 16404.0, "09": 15090.0, "10": 11908.0, "11": 10829.0, "12": 7336.0}

# Fixed value: review rows kept from 2023-01-01 on, as the source states.
KEPT_REVIEWS = 447_129


def _reviews(spark):
    months = spark.createDataFrame(list(R1_REVIEWS.items()), "m string, n int")
    start = F.to_date(F.concat(F.col("m"), F.lit("-01")))
    rows = months.select(start.alias("__s"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    # day inside the month from the row number, listing id from the row number: all Spark-side
    return rows.select((F.col("i") % 1000).cast("long").alias("listing_id"),
                       F.date_add("__s", (F.col("i") % 28).cast("int")).alias("date"))


def test_r1_counts_sum_to_kept_reviews():
    assert sum(R1_REVIEWS.values()) == KEPT_REVIEWS


def test_r6_follows_from_r1(spark):
    reviews = _reviews(spark)
    got = {r["month_num"]: r["avg_reviews_per_month"] for r in r6_seasonality(reviews).collect()}
    assert got == R6_AVG                                    # incl. 15,089.5 -> 15,090 (half up)


def test_r1_and_b7_give_the_counts_back(spark):
    reviews = _reviews(spark)
    b7 = {r["review_month"]: r["reviews"] for r in r1_volume(reviews, distinct=False).collect()}
    assert b7 == R1_REVIEWS
    r1 = r1_volume(reviews).collect()
    assert {r["review_month"]: r["reviews"] for r in r1} == R1_REVIEWS
    assert all(r["active_listings"] == min(1000, R1_REVIEWS[r["review_month"]]) for r in r1)
    peak = h8_peak_month(reviews).first()
    assert tuple(peak)[:2] == ("2026-07", 24685)            # H8: peak month of the captured volume


# The source's captured band outputs over its 22,257 listings: (label, listings, pct).
C4_LEAD = [("0–7 days", 20170, 90.6), ("8–30 days", 265, 1.2), ("31–90 days", 207, 0.9), ("90+ days", 597, 2.7),
           ("No bookings in 365d", 1018, 4.6)]
C5_MIN_NIGHTS = [("1 night", 5168, 23.2), ("2–3 nights", 3200, 14.4), ("4–7 nights", 342, 1.5),
                 ("8–30 nights", 12478, 56.1), ("31+ nights", 1069, 4.8)]
R4_REVIEW_BANDS = [("0", 6877, 30.9), ("1–5", 5208, 23.4), ("6–20", 4630, 20.8), ("21–50", 2590, 11.6),
                   ("51+", 2952, 13.3)]
LISTINGS = 22_257


def _listings_per_value(spark, values_and_counts):
    """Listing ids 0..n-1, each with the value of its band (Spark explodes the ranges)."""
    rows, start = [], 0
    for value, n in values_and_counts:
        rows.append((value, start, start + n - 1))
        start += n
    df = spark.createDataFrame(rows, "v int, a long, b long")
    return df.select("v", F.explode(F.sequence("a", "b")).alias("listing_id"))


def _as_table(df, label):
    return [(r[label], r[1], r[2]) for r in df.collect()]


def test_c4_c5_r4_band_counts_and_shares(spark):
    from rentscope.plans.calendar import c4_lead_time, c5_min_nights
    from rentscope.plans.reviews import r4_count_bands
    assert all(sum(n for _, n, _ in t) == LISTINGS for t in (C4_LEAD, C5_MIN_NIGHTS, R4_REVIEW_BANDS))

    # Each listing's minimum nights, one value inside each captured band
    per = _listings_per_value(spark, zip([1, 2, 5, 10, 40], [n for _, n, _ in C5_MIN_NIGHTS]))
    cal = per.select("listing_id", F.lit("2026-08-15").cast("date").alias("date"), F.lit(1).alias("available"),
                     F.col("v").alias("minimum_nights"))
    assert sorted(_as_table(c5_min_nights(cal), "min_nights_band")) == sorted(C5_MIN_NIGHTS)

    # C4: first unavailable day at lead 0 / 10 / 40 / 100 days, or none (-1)
    per = _listings_per_value(spark, zip([0, 10, 40, 100, -1], [n for _, n, _ in C4_LEAD]))
    day0 = F.lit("2026-08-15").cast("date")
    first = per.select("listing_id", day0.alias("date"), F.when(F.col("v") == 0, 0).otherwise(1).alias("available"))
    booked = per.where(F.col("v") > 0).select("listing_id", F.date_add(day0, F.col("v")).alias("date"),
                                              F.lit(0).alias("available"))
    cal = first.unionByName(booked).withColumn("minimum_nights", F.lit(1))
    assert sorted(_as_table(c4_lead_time(cal), "lead_time_band")) == sorted(C4_LEAD)

    # 0 / 1 / 6 / 21 / 51 reviews per listing; listings without reviews kept as 0
    per = _listings_per_value(spark, zip([0, 1, 6, 21, 51], [n for _, n, _ in R4_REVIEW_BANDS]))
    listings = per.select(F.col("listing_id").alias("id"))
    reviews = per.where(F.col("v") > 0).select("listing_id", F.explode(F.sequence(F.lit(1), "v")).alias("k"))
    assert sorted(_as_table(r4_count_bands(reviews, listings), "review_count_band")) == sorted(R4_REVIEW_BANDS)
