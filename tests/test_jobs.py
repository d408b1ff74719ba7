import datetime as dt
import os

import pytest

from rentscope.plans.jobs import build_marts, build_snapshot
from rentscope.sources import LISTING_RAW_COLUMNS
from tests.test_cleaning import _raw_row, _write_csv


def _snapshot_csv(path, ids, price="$100.00"):
    rows = [_raw_row(id=str(i), name=f"L{i}", price=price, room_type="Entire home/apt" if i % 2 else "Private room",
                     neighbourhood_cleansed="A", host_id=str(i % 2), number_of_reviews=str(i * 10),
                     reviews_per_month="1.5", minimum_nights=str(i), last_scraped="2026-06-16") for i in ids]
    _write_csv(path, LISTING_RAW_COLUMNS, rows)


def test_build_snapshot_and_marts(spark, tmpdir_path):
    table = f"{tmpdir_path}/listings"
    _snapshot_csv(f"{tmpdir_path}/jun.csv", [1, 2, 3])
    _snapshot_csv(f"{tmpdir_path}/jul.csv", [2, 3, 4, 5], price="$110.00")
    assert build_snapshot(spark, f"{tmpdir_path}/jun.csv", "2026-06", table) == 3
    assert build_snapshot(spark, f"{tmpdir_path}/jul.csv", "2026-07", table) == 4
    assert build_snapshot(spark, f"{tmpdir_path}/jun.csv", "2026-06", table) == 3    # rerun replaces the month
    assert spark.read.parquet(table).count() == 7
    written = build_marts(spark, table, f"{tmpdir_path}/marts", month="2026-07")
    assert all(os.path.isdir(p) for p in written)
    kpis = {r["month"]: r["listings"] for r in spark.read.parquet(f"{tmpdir_path}/marts/monthly_kpis").collect()}
    assert kpis == {"2026-06": 3, "2026-07": 4}


def test_build_snapshot_rejects_duplicate_ids(spark, tmpdir_path):
    _snapshot_csv(f"{tmpdir_path}/dup.csv", [1, 1])
    with pytest.raises(ValueError):
        build_snapshot(spark, f"{tmpdir_path}/dup.csv", "2026-08", f"{tmpdir_path}/t")
