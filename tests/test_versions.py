"""Versioned ingest (I1): re-sent months, identical files, replays, pruned reads."""
import csv
import os

import pytest
from pyspark.sql import functions as F

from rentscope.sources.versions import (drop_superseded, file_digests, live_versions, merged, newest_file, read_live,
                                        read_manifest, superseded, write_version)
from rentscope.streaming import ingest_snapshots

COLS = ["id", "name", "price"]


def _drop(root, month, name, rows):
    d = f"{root}/incoming/listings-{month}"
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/{name}.csv", "w", newline="") as f:
        csv.writer(f).writerows([COLS, *rows])


def _clean(df):
    return df.select(F.col("id").cast("long").alias("id"), "name", F.col("price").cast("double").alias("price"), "month", "__file", "__time")


def _run(spark, root, **kw):
    ingest_snapshots(spark, f"{root}/incoming/*", f"{root}/table", f"{root}/ckpt", COLS, _clean, key=["id"], **kw)


def _live(spark, root, months=None):
    return sorted((r["month"], r["id"], r["name"], r["price"]) for r in read_live(spark, f"{root}/table", months).collect())


def test_corrected_file_under_a_new_name_does_not_add(spark, tmpdir_path):
    root = tmpdir_path
    _drop(root, "2026-06", "a", [["1", "x", "10"], ["2", "y", "20"]])
    _drop(root, "2026-07", "a", [["1", "x", "11"]])
    _run(spark, root)
    _drop(root, "2026-06", "corrected", [["2", "y", "25"], ["3", "late", "30"]])
    _run(spark, root)
    _run(spark, root)                                           # nothing new
    assert _live(spark, root) == [("2026-06", 1, "x", 10.0), ("2026-06", 2, "y", 25.0), ("2026-06", 3, "late", 30.0), ("2026-07", 1, "x", 11.0)]
    assert _live(spark, root, ["2026-07"]) == [("2026-07", 1, "x", 11.0)]
    m = read_manifest(spark, f"{root}/table")
    assert {(r["month"], r["version"]) for r in live_versions(m).collect()} == {("2026-06", 2), ("2026-07", 1)}
    assert sorted((r["month"], r["rows"], r["version"]) for r in m.collect()) == [("2026-06", 2, 1), ("2026-06", 2, 2), ("2026-07", 1, 1)]
    assert [tuple(r) for r in superseded(spark, f"{root}/table").collect()] == [("2026-06", 1)]
    before = _live(spark, root)
    assert drop_superseded(spark, f"{root}/table") == 1 and _live(spark, root) == before


def test_replace_drops_rows_that_do_not_come_again(spark, tmpdir_path):
    root = tmpdir_path
    _drop(root, "2026-06", "a", [["1", "x", "10"], ["2", "y", "20"]])
    _drop(root, "2026-07", "a", [["7", "z", "1"]])
    _run(spark, root, resend="replace")
    _drop(root, "2026-06", "b", [["2", "y", "21"]])
    _run(spark, root, resend="replace")
    assert _live(spark, root) == [("2026-06", 2, "y", 21.0), ("2026-07", 7, "z", 1.0)]


def test_identical_file_is_listed_only(spark, tmpdir_path):
    root = tmpdir_path
    rows = [["1", "x", "10"], ["2", "y", ""]]
    _drop(root, "2026-06", "a", rows)
    _run(spark, root)
    _drop(root, "2026-06", "again", rows[::-1])
    _run(spark, root)
    assert sorted(r["wrote"] for r in read_manifest(spark, f"{root}/table").collect()) == [False, True]
    assert _live(spark, root) == [("2026-06", 1, "x", 10.0), ("2026-06", 2, "y", None)]


def test_an_older_copy_that_comes_last_wins(spark, tmpdir_path):
    """Newest means last to come, not the larger value or an earlier digest."""
    root = tmpdir_path
    for name, price in (("a", "10"), ("b", "11"), ("c", "10")):
        _drop(root, "2026-06", name, [["1", "x", price]])
        _run(spark, root)
    assert _live(spark, root) == [("2026-06", 1, "x", 10.0)]
    assert read_manifest(spark, f"{root}/table").where("wrote").count() == 3


STAGED = "id long, price double, month string, __file string, __time timestamp"


def _staged(spark, rows):
    return spark.createDataFrame([(*r[:4], __import__("datetime").datetime(2026, 1, r[4])) for r in rows], STAGED)


def test_newest_file_wins_within_a_batch(spark):
    rows = [(1, 1.0, "m", "a", 1), (1, 2.0, "m", "b", 2), (2, 3.0, "m", "a", 1), (2, 3.5, "m", "a", 1), (None, 4.0, "m", "a", 1), (None, 5.0, "m", "c", 2), (1, 9.0, "n", "a", 1)]
    got = newest_file(_staged(spark, rows), ["id"])
    assert sorted((r["month"], r["id"] or 0, r["price"]) for r in got.collect()) == [("m", 0, 5.0), ("m", 1, 2.0), ("m", 2, 3.0), ("m", 2, 3.5), ("n", 1, 9.0)]


def test_merge_knows_null_keys(spark):
    old = spark.createDataFrame([("m", 1, 1.0), ("m", None, 2.0), ("n", None, 3.0)], "month string, id long, price double")
    new = spark.createDataFrame([("m", None, 7.0), ("m", 4, 8.0)], "month string, id long, price double")
    assert sorted((r["month"], r["id"] or 0, r["price"]) for r in merged(old, new, ["id"]).collect()) == [("m", 0, 7.0), ("m", 1, 1.0), ("m", 4, 8.0), ("n", 0, 3.0)]


def test_replayed_batch_changes_nothing(spark, tmpdir_path):
    table = f"{tmpdir_path}/t"
    one, two = _staged(spark, [(1, 1.0, "m", "a", 1), (2, 2.0, "m", "a", 1)]), _staged(spark, [(2, 5.0, "m", "b", 2)])
    assert write_version(one, table, ["id"], source="s", batch=0) == 1
    assert write_version(two, table, ["id"], source="s", batch=1) == 2
    assert write_version(one, table, ["id"], source="s", batch=0) == 1                  # a replay of an old batch
    assert sorted((r["id"], r["price"]) for r in read_live(spark, table).collect()) == [(1, 1.0), (2, 5.0)]
    # a version that was written, but not listed, before a loss: the same number is written again
    os.makedirs(f"{table}/versions/month=m/version=3")
    three = _staged(spark, [(3, 6.0, "m", "c", 3)])
    assert write_version(three, table, ["id"], source="s", batch=2) == 3
    assert read_live(spark, table).count() == 3
    assert write_version(three.where("false"), table, ["id"], source="s", batch=3) is None
    # another stream (a lost checkpoint) starts again at batch 0
    assert write_version(one, table, ["id"], source="other", batch=0) == 4
    assert sorted((r["id"], r["price"]) for r in read_live(spark, table).collect()) == [(1, 1.0), (2, 2.0), (3, 6.0)]
    with pytest.raises(ValueError):
        write_version(one, table, ["id"], source="x", batch=0, resend="add")


def test_digest_knows_rows_not_their_order(spark):
    rows = [(1, 1.0, "m", "a", 1), (1, 1.0, "m", "a", 1), (2, 2.0, "m", "a", 1), (2, 2.0, "m", "b", 1), (1, 1.0, "m", "b", 1), (1, 1.0, "m", "b", 1), (1, 1.0, "m", "c", 1), (2, 2.0, "m", "c", 1)]
    d = {r["file"]: r["digest"] for r in file_digests(_staged(spark, rows), ["id", "price"]).collect()}
    assert d["a"] == d["b"] != d["c"]


def test_live_read_prunes_partitions(spark, tmpdir_path):
    table = f"{tmpdir_path}/t"
    for k in range(3):
        write_version(_staged(spark, [(i, float(k), f"m{k}", f"f{k}", 1) for i in range(5)]), table, ["id"], source="s", batch=k)
    months = spark.createDataFrame([("m1",)], "month string").where(F.col("month") > "m0")
    df = read_live(spark, table, months)
    assert sorted({r["month"] for r in df.collect()}) == ["m1"]
    assert "dynamicpruning" in df._jdf.queryExecution().toString().lower()


def test_transform_must_carry_the_file(spark, tmpdir_path):
    _drop(tmpdir_path, "2026-06", "a", [["1", "x", "10"]])
    with pytest.raises(Exception, match="drops"):
        ingest_snapshots(spark, f"{tmpdir_path}/incoming/*", f"{tmpdir_path}/t", f"{tmpdir_path}/c", COLS, lambda df: df.select("id", "month"), key=["id"])
