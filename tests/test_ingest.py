import csv
import os

import pytest
from pyspark.sql import functions as F

from rentscope.streaming import ingest_snapshots

COLS = ["id", "name", "price"]


def _drop(root, month, rows, header=COLS):
    d = f"{root}/incoming/listings-{month}"
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/part-0.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def _clean(df):
    return df.select(F.col("id").cast("long").alias("id"), "name", F.col("price").cast("double").alias("price"), "month")


def test_incremental_rerun_is_idempotent(spark, tmpdir_path):
    root = tmpdir_path
    _drop(root, "2026-06", [["1", "a, b", "10"], ["2", "c", "20"]])
    run = lambda: ingest_snapshots(spark, f"{root}/incoming/*", f"{root}/table", f"{root}/ckpt", COLS, _clean)
    run()
    assert spark.read.parquet(f"{root}/table").count() == 2
    _drop(root, "2026-07", [["1", "a", "11"]])
    run()
    run()                                           # nothing new: no change
    t = spark.read.parquet(f"{root}/table")
    assert {r["month"]: r["n"] for r in t.groupBy("month").agg(F.count("*").alias("n")).collect()} == \
        {"2026-06": 2, "2026-07": 1}


def test_ingest_header_mismatch_fails(spark, tmpdir_path):
    root = tmpdir_path
    _drop(root, "2026-08", [["1", "x", "5"]], header=["id", "title", "price"])
    with pytest.raises(Exception):
        ingest_snapshots(spark, f"{root}/incoming/*", f"{root}/table", f"{root}/ckpt", COLS, _clean)


def _run(spark, root):
    ingest_snapshots(spark, f"{root}/incoming/*", f"{root}/table", f"{root}/ckpt", COLS, _clean)


def test_late_file_of_a_month_adds_rows(spark, tmpdir_path):
    root = tmpdir_path
    _drop(root, "2026-06", [["1", "a", "10"], ["2", "b", "20"], ["3", "c", "30"]])
    _run(spark, root)
    with open(f"{root}/incoming/listings-2026-06/part-1.csv", "w", newline="") as f:
        csv.writer(f).writerows([COLS, ["4", "late", "40"]])
    _run(spark, root)
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/table").collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("row", [["1", "short"], ["1", "long", "5", "extra"]])
def test_rows_of_another_width_fail(spark, tmpdir_path, row):
    _drop(tmpdir_path, "2026-06", [row])
    with pytest.raises(Exception):
        _run(spark, tmpdir_path)


def test_file_without_a_month_fails(spark, tmpdir_path):
    _drop(tmpdir_path, "latest", [["1", "a", "10"]])
    with pytest.raises(Exception):
        _run(spark, tmpdir_path)
