"""Batch jobs: build one snapshot (S13), build the marts (S7, Entry D)."""
from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..operators import assert_unique
from ..operators.partitioning import spread
from ..session import scratch_path
from ..sources import clean_listings, read_listings_raw, write_mart, write_snapshot


def build_snapshot(spark: SparkSession, csv_path: str, month: str, table_path: str,
                   partitions: int | None = None) -> int:
    """Header check -> typed listings -> unique id gate -> write the month's partition.

    The multi-line CSV is not splittable per file and is the costly part, so it is
    parsed once: the typed rows are staged as Parquet in the shared checkpoint
    folder (which also cuts the lineage back to the CSV), the id gate reads only
    the staged id column, and the month's partition is written from the stage.
    Nothing reaches the table when the gate fails. ``partitions`` deals the parsed rows out before
    they are cleaned (a snapshot is one file, so one task).
    """
    raw = spread(read_listings_raw(spark, csv_path), partitions)
    stage = scratch_path(spark, "staging", f"{month}-{uuid.uuid4().hex}")
    clean_listings(raw).write.parquet(stage)
    staged = spark.read.parquet(stage)
    assert_unique(staged, ["id"])
    write_snapshot(staged, table_path, month)
    return spark.read.parquet(table_path).where(f"month = '{month}'").count()


def build_marts(spark: SparkSession, stacked_path: str, out_root: str, calendar=None, reviews=None,
                month: str | None = None) -> list[str]:
    """Materialise the dashboard marts from the stacked listings table (Entry D)."""
    from pyspark.sql import functions as F
    from . import calendar as C, kpis as K, reviews as RV
    stacked = spark.read.parquet(stacked_path)
    written = [write_mart(K.kpis(stacked), out_root, "monthly_kpis")]
    if month is not None:
        listings = stacked.where(F.col("month") == month).drop("month")
        written.append(write_mart(RV.b8_velocity_top(listings), out_root, "velocity_top"))
        written.append(write_mart(C.b6_min_nights_wide(listings), out_root, "calendar_summary_min_nights"))
        if calendar is not None:
            written.append(write_mart(C.c3_availability_curve(calendar, null_counts=True), out_root, "calendar_monthly"))
            written.append(write_mart(C.b4_occupancy_by_area(calendar, listings), out_root,
                                      "calendar_occupancy_neighbourhood"))
            written.append(write_mart(C.b5_city_unavailability(calendar), out_root, "calendar_city"))
        if reviews is not None:
            written.append(write_mart(RV.r1_volume(reviews, distinct=False), out_root, "review_volume"))
    return written
