"""Partitioning guards."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal the rows out to ``partitions`` before CPU-heavy work per row. For a caller that knows its
    input as one unsplittable piece (a gzip or multi-line CSV file, one row group); None leaves the
    input's own splits and adds no shuffle."""
    return df if partitions is None else df.repartition(partitions)


def materialize(df: DataFrame) -> DataFrame:
    """Write a small intermediate that is used more than once (a per-group or
    per-period aggregate, a top-k list) to the shared checkpoint folder.

    Every later use reads the written rows instead of recomputing the scans,
    joins and shuffles behind them, and the lineage is cut, so a lost executor
    does not send the job back to the source tables. Reliable checkpoint only
    (``spark.checkpoint.dir``), never a local one.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write rows that are read more than once as Parquet in the shared folder and read them
    back: what is behind them runs once, and Catalyst knows their size."""
    from ..session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, name, uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
