"""Table IO: parquet tables, partitioned snapshot tables, mart writes."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def write_snapshot(df: DataFrame, path: str, month: str, label: str = "month") -> None:
    """Write one month into a table partitioned by ``label``; a rerun replaces only
    that partition (dynamic partition overwrite), so it is idempotent."""
    (df.withColumn(label, F.lit(month)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(label).parquet(path))


def read_snapshot(spark: SparkSession, path: str, month: str | None = None, label: str = "month") -> DataFrame:
    """A partitioned snapshot table; with ``month`` only that partition is scanned."""
    df = spark.read.parquet(path)
    return df.where(F.col(label) == month) if month is not None else df


def write_stacked(stacked: DataFrame, path: str, label: str = "month") -> None:
    """Write stacked snapshots as one table partitioned by ``label`` (S4); the months of ``stacked``
    replace theirs, others stay."""
    (stacked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(label).parquet(path))


def read_months(spark: SparkSession, path: str, months: DataFrame, label: str = "month") -> DataFrame:
    """The rows of the months in a list of their own (S6): the list is known at run time only and
    reaches the scan as a dynamic partition filter, so other months are not read."""
    table = spark.read.parquet(path)
    return table.withColumn(label, F.col(label).cast("string")).join(months.select(label).distinct(), label, "left_semi")


def write_mart(df: DataFrame, root: str, name: str) -> str:
    """Materialise an aggregate table (S7); marts are small, written once per build."""
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path
