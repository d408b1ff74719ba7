"""Multi-snapshot marts, registry marts and jobs on hand-written fixtures."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from rentscope.operators import (assert_unique, latest_snapshot, pending_snapshots, previous_period,
                                 stack_snapshots)
from rentscope.plans import kpis as K, registry as RG
from tests.fixtures import LISTING_SCHEMA, listings_rows


@pytest.fixture(scope="module")
def stacked(spark):
    june = spark.createDataFrame(listings_rows(), LISTING_SCHEMA)
    # July: listing 1 removed, 500 and 501 added, every price up 10 %
    july = june.where(F.col("id") != 1).withColumn("price", F.col("price") * 1.1)
    extra = spark.createDataFrame([r[:0] + (500 + i,) + r[1:] for i, r in enumerate(listings_rows()[:2])], LISTING_SCHEMA)
    return stack_snapshots({"2026-06": june, "2026-07": july.unionByName(extra)})


def test_kpis_per_month(stacked):
    rows = {r["month"]: r for r in K.kpis(stacked).collect()}
    assert set(rows) == {"2026-06", "2026-07"}
    import statistics
    src = listings_rows()
    priced = lambda rt: [r[10] for r in src if r[6] == rt and r[10] is not None and r[10] > 0]
    j = rows["2026-06"]
    assert j["listings"] == len(src)
    assert j["private_med"] == statistics.median(priced("Private room"))
    assert j["entire_med"] == statistics.median(priced("Entire home/apt"))
    unpriced = sum(1 for r in src if r[10] is None or r[10] <= 0)   # NULL, 0 and -5
    assert j["no_quote_pct"] == round(100 * unpriced / len(src), 2)
    assert j["premium"] == round(j["entire_med"] / j["private_med"], 2)


def test_kpi_deltas_and_diff(stacked):
    d = {(r["metric"], r["month"]): r for r in K.kpi_deltas(stacked).collect()}
    assert d[("listings", "2026-06")]["prev_value"] is None
    assert d[("listings", "2026-07")]["delta"] == 1.0
    diff = K.added_removed(stacked, "2026-06", "2026-07").first()
    assert (diff["added"], diff["removed"]) == (2, 1)


def test_movers_and_trends(stacked):
    mv = K.median_movers(stacked, "2026-06", "2026-07", min_rows=3).collect()
    # area A also gained two unscaled listings: median 250 -> 220 is the largest move
    assert (mv[0]["neighbourhood_cleansed"], mv[0]["change_pct"]) == ("A", -12.0)
    assert all(r["change_pct"] == 10.0 for r in mv[1:])
    tr = K.area_trajectories(stacked, ["2026-06", "2026-07"], k=2).collect()
    assert len(tr) == 2 and all(r["2026-07"] is not None for r in tr)
    mix = K.room_mix_by_month(stacked).where(F.col("month") == "2026-06").collect()
    assert abs(sum(r["pct"] for r in mix) - 100) < 0.3
    assert K.professionalisation(stacked).count() == 2
    om = {r["month"]: r for r in K.overall_median(stacked).collect()}
    assert om["2026-07"]["pct_change"] is not None


def test_metrics_table(stacked):
    m = K.metrics_table(stacked.where(F.col("month") == "2026-06").drop("month"), "2026-06")
    rows = {(r["metric"], r["key"]): r["value"] for r in m.collect()}
    assert rows[("quality.total_listings", "")] == float(len(listings_rows()))
    assert ("top_areas.median_price", "A") in rows and ("host_size.hosts", "6+ listings") in rows
    assert rows[("value_picks.picks", "")] == 2.0


def test_snapshot_bookkeeping(spark):
    found = spark.createDataFrame([("2026-06", 1), ("2026-07", 2), ("2026-07", 1), ("2026-08", 1)],
                                  "month string, day_rank int")
    done = spark.createDataFrame([("2026-06",)], "month string")
    assert {r["month"] for r in pending_snapshots(found, done).collect()} == {"2026-07", "2026-08"}
    best = latest_snapshot(found, "2026-07").first()
    assert (best["month"], best["day_rank"]) == ("2026-07", 1)
    assert previous_period(found, "2026-08").first()["month"] == "2026-07"
    assert previous_period(found, "2027-01").first()["month"] == "2026-08"   # not bound to one year


def test_assert_unique(spark):
    assert_unique(spark.createDataFrame([(1,), (2,)], "id long"), ["id"])
    with pytest.raises(ValueError):
        assert_unique(spark.createDataFrame([(1,), (1,)], "id long"), ["id"])


@pytest.fixture(scope="module")
def registry(spark):
    rows = [("STR-2401-0001", "Ward 1", "Apartment", "1 Main St", "101", "M5V 1A1"),
            ("STR-2401-0002", "Ward 1", "Apartment", "1 Main St", "102", "M5V 1A2"),
            ("STR-2402-0003", "Ward 2", "House", "2 Side St", None, "M4K 2B2"),
            ("STR-2404-0004", None, "Condominium", "3 Bay St", "7", "M5V 3C3"),
            ("STR-2408-0005", "Ward 2", "House", "4 Oak Ave", None, "M6H 4D4")]
    return spark.createDataFrame(rows, "registration_number string, ward_name string, property_type string, "
                                       "address string, unit string, postal_code string")


def test_registry_marts(registry, spark):
    wards = {r["ward_name"]: r["pct"] for r in RG.d30_by_ward(registry).collect()}
    assert wards == {"Ward 1": 40.0, "Ward 2": 40.0}               # NULL ward hidden, still in denominator
    e1 = RG.e1_profile(registry).first()
    assert (e1["registrations"], e1["distinct_addresses"], e1["with_unit"]) == (5, 4, 3)
    e2 = RG.e2_postal_share(registry).first()
    assert (e2["postal_area"], e2["pct"]) == ("M5V", 60.0)
    e3 = {r["cohort_month"]: r["run_4m"] for r in RG.e3_cohorts(registry).collect()}
    assert e3["2024-04"] == 4 and e3["2024-08"] == 1               # gap months are not bridged
    assert RG.d32_top_addresses(registry, 1).first()["address"] == "1 Main St"
    listings = spark.range(10)
    assert RG.d33_coverage(registry, listings).first()["registered_per_listed_pct"] == 50.0


def test_registry_extras_and_slim(registry, spark):
    assert RG.d31_multi_unit_share(registry).first()["multi_unit_pct"] == 60.0
    cov = RG.d33_coverage(registry, spark.range(10), outside_count=20).first()
    assert cov["registered_per_outside_pct"] == 25.0
    june = spark.createDataFrame(listings_rows(), LISTING_SCHEMA)
    with pytest.raises(ValueError):
        K.listings_slim({"2026-06": june})           # fixture lacks some slim columns
