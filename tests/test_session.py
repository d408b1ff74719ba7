"""Shared-folder helpers: intermediates go to spark.checkpoint.dir, never elsewhere."""
import os

from pyspark.sql import functions as F

from rentscope.operators import materialize
from rentscope.session import ensure_checkpoint_dir, scratch_path


def test_checkpoint_dir_is_read_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert ensure_checkpoint_dir(spark) == configured               # an existing setting is kept
    assert scratch_path(spark, "x", "y").startswith(os.path.join(configured, "rentscope"))


def test_materialize_writes_to_the_shared_folder_and_cuts_lineage(spark):
    base = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    m = materialize(base)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Range" not in plan            # reads the written rows only
    assert sorted(tuple(r) for r in m.collect()) == sorted(tuple(r) for r in base.collect())
    root = spark.sparkContext.getCheckpointDir()
    assert root and root.replace("file:", "").startswith(spark.conf.get("spark.checkpoint.dir").replace("file:", ""))
