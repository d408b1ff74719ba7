"""Scale probe (not a registered query): synthetic inputs generated with spark.range.

1. C1-C6 over a calendar of 8,123,819 rows (22,257 listings x 365 days + 14),
   the size the source reports for one snapshot.
2. Exact median of one hot group holding a third of all rows: the hybrid (hot group
   by selection, the rest built-in), selection for all groups, and the built-in
   ``median`` aggregate for all groups, checked equal.
3. Snapshot changes and median movers over 12 snapshots of the same data (hot key kept).
4. Word and bigram top-k over 1 M documents where one word is a third of all tokens.

usage: python scripts/scale_probe.py [rows_for_median]
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def timed(label, df, out):
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    out[label] = round(time.perf_counter() - t0, 2)


def main():
    n_med = int(sys.argv[1]) if len(sys.argv) > 1 else 30_000_000
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from rentscope.operators import grouped_median
    from rentscope.plans import calendar as C
    from rentscope.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    res = {}

    rows = 22_257 * 365 + 14
    cal = spark.range(rows).select(
        (F.col("id") / 365).cast("long").alias("listing_id"),
        F.date_add(F.lit("2026-08-15").cast("date"), (F.col("id") % 365).cast("int")).alias("date"),
        F.when(F.abs(F.xxhash64("id")) % 100 < 35, 0).otherwise(1).alias("available"),
        (F.lit(1) + (F.col("id") / 365).cast("long") % 40).cast("int").alias("minimum_nights"))
    listings = spark.range(22_258).select(
        F.col("id"), F.concat(F.lit("N"), (F.col("id") % 140).cast("string")).alias("neighbourhood_cleansed"),
        F.when(F.col("id") % 5 == 0, "Private room").otherwise("Entire home/apt").alias("room_type"),
        (F.col("id") % 365).cast("int").alias("estimated_occupancy_l365d"))
    for name, df in [("C1", C.c1_city_unavailability(cal)), ("C2", C.c2_true_vs_estimate(cal, listings)),
                     ("C3", C.c3_availability_curve(cal)), ("C4", C.c4_lead_time(cal)),
                     ("C5", C.c5_min_nights(cal)), ("C6", C.c6_by_room_type(cal, listings))]:
        timed(name, df, res)

    # one key holds a third of all rows; values are high-cardinality doubles
    data = spark.range(n_med).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 10_000).cast("string")))
        .alias("k"), (F.abs(F.xxhash64("id")) % 10_000_000 / 100.0 + F.rand(1)).alias("v"))
    t0 = time.perf_counter()
    own = {r["k"]: r["m"] for r in grouped_median(data, ["k"], "v", "m").where(F.col("k").isin("hot", "k1", "k2")).collect()}
    res["median"] = round(time.perf_counter() - t0, 2)
    t0 = time.perf_counter()
    built = data.groupBy("k").agg(F.median("v").alias("m")).where(F.col("k").isin("hot", "k1", "k2"))
    built = {r["k"]: r["m"] for r in built.collect()}
    res["median_builtin"] = round(time.perf_counter() - t0, 2)
    res["median_equal"] = own == built
    # snapshot comparisons with the same hot key: 12 monthly snapshots of 30 M rows
    from rentscope.operators import movers_by_period, snapshot_changes
    snaps = data.withColumn("month", F.format_string("2026-%02d", (F.col("v") * 7).cast("long") % 12 + 1))
    t0 = time.perf_counter()
    ch = snapshot_changes(snaps, "k").collect()
    res["snapshot_changes"] = round(time.perf_counter() - t0, 2)
    res["snapshot_changes_ok"] = len(ch) == 11 and all(r["kept"] + r["added"] > 0 for r in ch)
    t0 = time.perf_counter()
    mv = movers_by_period(snaps, "k", "v", min_rows=50, k=3).collect()
    res["movers_by_period"] = round(time.perf_counter() - t0, 2)
    res["movers_rows"] = len(mv)
    # text: 1 M documents of 60 words; one word is a third of all tokens (a hot group for the word counts)
    from rentscope.operators import bigram_top, word_top
    n_docs = 1_000_000
    words_expr = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.when(
        i % 3 == 0, F.lit("hotword")).otherwise(F.concat(F.lit("w"), (F.abs(F.xxhash64(F.col("id"), i)) % 50_000)
                                                         .cast("string"))))
    docs = spark.range(n_docs).select((F.col("id") % 4).cast("string").alias("lang"),
                                      F.concat_ws(" ", words_expr).alias("text"))
    t0 = time.perf_counter()
    wt = word_top(docs, "text", ["lang"], k=20, min_len=1, stop_words=()).collect()
    res["word_top_1M_docs"] = round(time.perf_counter() - t0, 2)
    res["word_top_hot_count_ok"] = all(r["count"] == n_docs // 4 * 20 for r in wt if r["word"] == "hotword")
    t0 = time.perf_counter()
    bigram_top(docs, "text", ["lang"], k=10).collect()
    res["bigram_top_1M_docs"] = round(time.perf_counter() - t0, 2)
    res["calendar_rows"] = rows
    res["median_rows"] = n_med
    print(json.dumps(res))


if __name__ == "__main__":
    main()
