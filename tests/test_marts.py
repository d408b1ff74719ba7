"""One test per semantic trap on hand-written fixtures."""
import pytest
from pyspark.sql import functions as F

from rentscope.plans import calendar as C, listings as L, reviews as RV
from tests.fixtures import LISTING_SCHEMA, calendar_rows, listings_rows, reviews_rows


@pytest.fixture(scope="module")
def listings(spark):
    return spark.createDataFrame(listings_rows(), LISTING_SCHEMA)


@pytest.fixture(scope="module")
def calendar(spark):
    return spark.createDataFrame(calendar_rows(), "listing_id long, date date, available int, minimum_nights int")


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(reviews_rows(), "id long, listing_id long, date date, comments string")


def test_a1_share_before_limit_and_null_key(listings):
    rows = {r["neighbourhood"]: r for r in L.a1_top_areas(listings, k=2).collect()}
    assert set(rows) == {"A", "D"}                       # top 2 by count
    assert rows["A"]["median_price"] == 250.0 and rows["A"]["listings"] == 4
    allr = L.a1_top_areas(listings, k=None).collect()
    assert None not in {r["neighbourhood"] for r in allr}  # inner join drops NULL area (trap 10)
    # shares are of all areas, not of the 2 shown (trap 7)
    assert rows["A"]["pct_of_city_supply"] == round(100 * 4 / 14, 1)


def test_a3_unknown_group(listings):
    got = {r["host_type"]: r["listings"] for r in L.a3_host_type(listings).collect()}
    assert got["Unknown"] > 0 and got["Superhost"] == 2
    got_h3 = {r["host_type"] for r in L.a3_host_type(listings, include_unknown=False).collect()}
    assert "Unknown" not in got_h3


def test_a4_null_band(listings):
    bands = {r["rating_band"]: r["listings"] for r in L.a4_rating_bands(listings).collect()}
    assert bands["No rating yet"] == 1 and bands["Below 4.50"] == 1
    assert bands["4.50 – 4.79"] == 11         # 4.5, 4.79 and nine rows at the 4.7 default
    assert bands["4.80 – 5.00"] == 3          # 4.8 is the lower edge of the top band


def test_bedroom_curves_three_variants(listings):
    a9 = L.a9_bedroom_curve(listings).collect()
    assert [r["bedrooms"] for r in a9] == [0, 1, 2, 3, 5]            # raw grouping (A9)
    d7 = {r["bedrooms"]: r for r in L.a9_bedroom_curve(listings, "prefilter").collect()}
    h6 = {r["bedrooms"]: r for r in L.a9_bedroom_curve(listings, "postfilter").collect()}
    assert 0 not in d7 and 0 not in h6
    first = min(d7)
    assert d7[first]["marginal_cost_of_extra_bedroom"] is None          # D7: step against nothing
    assert h6[first]["marginal_cost_of_extra_bedroom"] is not None      # H6: step kept against 0


def test_group_by_raw_value_gives_two_rows_with_one_label(spark, listings):
    extra = spark.createDataFrame([listings_rows()[4][:9] + (1.0,) + listings_rows()[4][10:]], LISTING_SCHEMA)
    lst = listings.unionByName(extra.withColumn("room_type", F.lit("Entire home/apt")).withColumn("bedrooms", F.lit(1.5)))
    labels = [r["bedrooms"] for r in L.a9_bedroom_curve(lst).collect()]
    assert labels.count(1) == 2                                # 1 and 1.5 both labelled 1 (trap 4)
    assert [r["bedrooms"] for r in L.a9_bedroom_curve(lst, "cast").collect()].count(1) == 1   # M9 merges


def test_a5_vs_m6(listings):
    a5 = {r["availability_band"]: r["listings"] for r in L.a5_availability_bands(listings).collect()}
    m6 = {r["availability_band"]: r["listings"] for r in L.a5_availability_bands(listings, priced_only=True).collect()}
    assert a5["0–30 days"] == 1 and a5["31–90 days"] == 2
    assert sum(a5.values()) > sum(m6.values())


def test_a8_portfolio_bands(listings):
    got = {r["host_size_band"]: r for r in L.a8_host_concentration(listings).collect()}
    assert got["6+ listings"]["hosts"] == 1 and got["6+ listings"]["listings"] == 6
    assert got["2–5 listings"]["hosts"] == 2
    assert sum(r["pct_of_supply"] for r in got.values()) == pytest.approx(100, abs=0.2)


def test_a11_value_picks(listings):
    rows = L.a11_value_picks(listings, min_reviews=20).collect()
    assert [r["price"] for r in rows] == [100.0, 200.0] and rows[0]["nb_median_price"] == 250.0


def test_c1_vs_b5(calendar):
    c1 = C.c1_city_unavailability(calendar).first()["avg_true_occupancy_pct"]
    b5 = C.b5_city_unavailability(calendar).first()["city_true_occ_pct"]
    assert c1 != b5


def test_c3_vs_b3_null_in_denominator(calendar):
    c3 = {r["cal_month"]: r["pct_available"] for r in C.c3_availability_curve(calendar).collect()}
    b3 = {r["cal_month"]: r["pct_available"] for r in C.c3_availability_curve(calendar, null_counts=True).collect()}
    assert c3["2026-08"] > b3["2026-08"]


def test_c4_c5_bands(calendar):
    c4 = {r["lead_time_band"]: r["listings"] for r in C.c4_lead_time(calendar).collect()}
    assert c4 == {"No bookings in 365d": 1, "0–7 days": 3, "8–30 days": 1}
    c5 = {r["min_nights_band"]: r["listings"] for r in C.c5_min_nights(calendar).collect()}
    assert c5["31+ nights"] == 2          # NULL minimum nights falls into ELSE (trap 3) + listing 999
    assert sum(c5.values()) == 5


def test_c2_joins_aggregate_first(calendar, listings):
    rows = C.c2_true_vs_estimate(calendar, listings).collect()
    assert {r["neighbourhood"] for r in rows} == {"A", "B"}


def test_r2_space_counting_and_trim(reviews):
    rows = {r["review_month"]: r["avg_words"] for r in RV.r2_words(reviews).collect()}
    assert rows["2026-08"] == 3.0               # "great  stay" counts 3 (trap 12)
    assert "2025-08" in rows                    # newline-only comment stays (trap 17)


def test_r4_zero_kept(reviews, listings):
    got = {r["review_count_band"]: r["listings"] for r in RV.r4_count_bands(reviews, listings).collect()}
    assert got["0"] == listings.count() - 3 and got["21–50"] == 1
    assert sum(got.values()) == listings.count()


def test_r3_r5_trailing(reviews, listings):
    r3 = RV.r3_velocity(reviews, listings, "2026-08-15", min_total=20).collect()
    assert len(r3) == 1 and r3[0]["total_reviews"] == 21 and r3[0]["reviews_90d"] == 4
    r5 = {r["name"]: r["reviews_12mo"] for r in RV.r5_recent_top(reviews, listings, "2026-08-15").collect()}
    assert r5["L2"] == 7                        # on the cut day counts, one day before does not


def test_b6_default_zero(listings):
    row = C.b6_min_nights_wide(listings).first().asDict()
    assert row["min_nights_1"] == 0.0 and row["min_nights_2_7"] == 100.0


def test_division_by_zero_is_null(spark):
    from rentscope.functions import pct
    assert spark.range(1).select(pct(F.lit(1), F.lit(0)).alias("p")).first()["p"] is None


def test_words_markup_and_stopwords(reviews):
    words = {r["word"] for r in RV.t1_top_words(reviews).collect()}
    assert "great" in words and "stay" in words and "clean" in words and "place" in words
    assert not any("<" in w or w == "with" for w in words)


def test_dashboard_extras(listings, reviews, calendar):
    assert [r["neighbourhood_cleansed"] for r in L.d13_area_list(listings, 2).collect()] == ["A", "D"]  # tie at 6, by name
    assert L.d20_revenue_by_area(listings).count() == 4
    ex = L.d21_revenue_exclusions(listings).first()
    assert (ex["no_price"], ex["no_area"]) == (3, 2)
    cmp_rows = L.d24_comparator(listings, ["B", "A", "ZZ"]).collect()
    assert [r["nb"] for r in cmp_rows] == ["B", "A", "ZZ"] and cmp_rows[2]["listings"] is None
    assert cmp_rows[1]["entire_median"] == 250.0 and cmp_rows[0]["private_median"] == 55.0
    assert L.d26_mean_median_skew(listings, min_rows=1).count() == 4
    pk = RV.h8_peak_month(reviews).first()
    assert pk["peak_reviews"] >= pk["low_reviews"]
    hl = C.h9_low_high_month(calendar).first()
    assert hl["high_month"] == hl["low_month"] == "2026-08"


def test_a10_keeps_null_group_and_m10_differs(listings):
    """Trap 10: GROUP BY keeps the NULL area (A1's inner join drops it); trap 13: M10 is
    A10 with the priced filter and without the minimum group size."""
    a10 = {r["neighbourhood"]: r["listings"] for r in L.a10_revenue_leaders(listings, min_rows=None).collect()}
    assert a10 == {"A": 6, "B": 4, "C": 1, None: 2, "D": 6}
    m10 = {r["neighbourhood"]: r["listings"]
           for r in L.a10_revenue_leaders(listings, min_rows=None, priced_only=True).collect()}
    assert m10 == {"A": 4, "B": 3, "C": 1, None: 2, "D": 6}
    assert L.a10_revenue_leaders(listings).count() == 0        # A10 keeps groups of >= 20 rows only


def test_null_groups_follow_the_definitions(spark):
    """D19 keeps the NULL room type, M7 the NULL area; D21 counts missing availability of priced rows only;
    D22/D23 are percentages of the window without the NULL area; M8's mean leaves the NULL owner out."""
    rows = [(1, "A", None, 10.0, 10, 1), (2, "A", "x", 10.0, 0, 1), (3, None, "x", 20.0, 15, None), (4, "B", "x", None, None, 2), (5, "B", "x", 30.0, None, None)]
    df = spark.createDataFrame(rows, "id long, neighbourhood_cleansed string, room_type string, price double, availability_30 int, host_id long")
    df = df.withColumn("availability_60", F.col("availability_30") * 2).withColumn("availability_90", F.col("availability_30") * 3)
    assert {(r["room_type"], r["listings"]) for r in L.d19_revenue_by_room(df).collect()} == {(None, 1), ("x", 2)}
    assert {(r["neighbourhood"], r["pct_of_city_supply"]) for r in L.a1_top_areas(df, share_digits=2, keep_null_area=True).collect()} == {
        ("A", 50.0), (None, 25.0), ("B", 25.0)}
    assert L.d21_revenue_exclusions(df).first()["no_availability_30"] == 1
    city = L.d22_forward_availability(df).first()
    assert (city["listings"], city["med_avail_30"], city["med_avail_90"]) == (3, 33.3, 33.3)
    assert [(r["neighbourhood_cleansed"], r["med_avail_30"]) for r in L.d22_forward_availability(df, ["neighbourhood_cleansed"]).collect()] == [("A", 16.7)]
    bands = {r["host_size_band"]: r for r in L.a8_host_concentration(df, keep_null_host=True).collect()}
    assert bands["2–5 listings"]["hosts"] == 2 and bands["2–5 listings"]["avg_listing_price"] == 10.0
    flags = spark.createDataFrame([(1, 0), (1, 1), (2, None)], "listing_id int, available int")
    assert C.M.entity_ratio_mean(flags, "listing_id", F.col("available") == 0, alias="p", count_alias="n").first() == (50.0, 2)
