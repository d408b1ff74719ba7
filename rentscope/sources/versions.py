"""Versioned monthly table (I1, S11, S13): re-sent months replace, they do not add.

A table is a folder with two parts:

* ``versions/month=.../version=N/``  the whole month as of version N, never rewritten in place
* ``manifest/version=N/``            a row a file and month that came in with version N: digest,
                                     rows, file time, and ``wrote`` (the version holds a new copy
                                     of the month; an identical re-send does not)

The live version of a month is the newest that wrote it. A version is written first and its
manifest rows after it, so a reader sees a month as it was before or as it is after, and what a lost
driver left behind unlisted is written again under the same number. ``read_live`` joins the small list of
live (month, version) pairs to the partitioned table: the pairs reach the scan as a dynamic
partition filter, and neither old versions nor other months are read.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST_SCHEMA = ("month string, file string, digest string, rows long, file_time timestamp, "
                   "source string, batch long, wrote boolean, version long")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_manifest(spark: SparkSession, table_path: str) -> DataFrame:
    """Every file that came in, by month and version; empty before the first one."""
    path = f"{table_path}/manifest"
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def live_versions(manifest: DataFrame, before: int | None = None) -> DataFrame:
    """(month, version): the newest version that wrote each month, ``before`` a version if given."""
    rows = manifest.where("wrote")
    if before is not None:
        rows = rows.where(F.col("version") < before)
    return rows.groupBy("month").agg(F.max("version").alias("version"))


def read_versions(spark: SparkSession, table_path: str) -> DataFrame:
    """All versions of all months (live or not), partitioned by month and version."""
    return spark.read.option("basePath", f"{table_path}/versions").parquet(f"{table_path}/versions") \
        .withColumn("month", F.col("month").cast("string")).withColumn("version", F.col("version").cast("long"))


def read_live(spark: SparkSession, table_path: str, months: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """The live rows of every month, or of the given ones (a list, or a DataFrame with a ``month``
    column, which prunes the scan at run time)."""
    live = live_versions(read_manifest(spark, table_path))
    if isinstance(months, DataFrame):
        live = live.join(months.select("month").distinct(), "month", "left_semi")
    elif months is not None:
        live = live.where(F.col("month").isin(list(months)))
    return read_versions(spark, table_path).join(live, ["month", "version"], "left_semi").drop("version")


def file_digests(rows: DataFrame, columns: Sequence[str], file: str = "__file", time: str = "__time") -> DataFrame:
    """(month, file, digest, rows, file_time). The digest is the sum and the exclusive or of the rows'
    hashes and their number, so it does not depend on the order in which rows are read."""
    h = F.xxhash64(*columns)
    return rows.groupBy("month", F.col(file).alias("file")).agg(
        F.concat_ws("-", F.hex(F.bit_xor(h)), F.sum(h.cast("decimal(20,0)")).cast("string"), F.count(F.lit(1)).cast("string")).alias("digest"),
        F.count(F.lit(1)).alias("rows"), F.max(time).alias("file_time"))


def newest_file(rows: DataFrame, key: Sequence[str], file: str = "__file", time: str = "__time") -> DataFrame:
    """Per month and key the rows of the newest file that has the key (file time, then name). A key
    that repeats within that file stays repeated: the unique-key gate is another check."""
    w = Window.partitionBy("month", *key)
    newest = F.max(F.struct(time, file)).over(w)
    return rows.withColumn("__newest", newest).where(F.col("__newest") == F.struct(time, file)).drop("__newest")


def merged(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The old rows whose (month, key) does not come again, and the new rows; a NULL key is a key."""
    came = new.select("month", *key).distinct()
    cond: Column = old["month"].eqNullSafe(came["month"])
    for k in key:
        cond = cond & old[k].eqNullSafe(came[k])
    return old.join(came, cond, "left_anti").unionByName(new)


def write_version(staged: DataFrame, table_path: str, key: Sequence[str], *, source: str, batch: int,
                  resend: str = "merge") -> int | None:
    """Take a staged micro-batch (columns, month, __file, __time) into the table; its version, or None
    if it is empty.

    ``resend="merge"``: newest file wins by key, keys that do not come again stay (a late file adds, a
    corrected one corrects). ``resend="replace"``: the files of a month replace the month, so rows that a
    corrected file no longer has go too. A month whose files all equal the newest
    ones taken in for it is listed but not written again. A batch that comes again after a loss takes
    its old number, so the result is the same.
    """
    if resend not in ("merge", "replace"):
        raise ValueError(f"resend is merge or replace, not {resend!r}")
    spark = staged.sparkSession
    columns = [c for c in staged.columns if c not in ("month", "__file", "__time")]
    manifest = read_manifest(spark, table_path)
    known = manifest.where((F.col("source") == source) & (F.col("batch") == batch)).agg(F.max("version")).first()[0]
    if known is not None:
        return int(known)       # the batch is in: its manifest rows are written last
    version = int(manifest.agg(F.max("version")).first()[0] or 0) + 1
    files = file_digests(staged, columns)
    # per month, the digest of the newest file so far: the same file again changes nothing
    latest = manifest.groupBy("month").agg(F.max_by("digest", F.struct("version", "file_time", "file")).alias("__last"))
    files = files.join(latest, "month", "left").withColumn("__same", F.coalesce(F.col("digest") == F.col("__last"), F.lit(False)))
    files = files.withColumn("wrote", ~F.min("__same").over(Window.partitionBy("month")))
    entries = [r.asDict() for r in files.select("month", "file", "digest", "rows", "file_time", "wrote").collect()]     # a row a file
    if not entries:
        return None
    changed = sorted({e["month"] for e in entries if e["wrote"]})
    if changed:
        new = newest_file(staged.where(F.col("month").isin(changed)), key).drop("__file", "__time")
        live = live_versions(manifest).where(F.col("month").isin(changed))
        if resend == "merge" and not live.isEmpty():
            old = read_versions(spark, table_path).join(live, ["month", "version"], "left_semi").select(*new.columns)
            new = merged(old, new, key)
        (new.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("month", "version").parquet(f"{table_path}/versions"))
    rows = [(e["month"], e["file"], e["digest"], e["rows"], e["file_time"], source, batch, e["wrote"], version) for e in entries]
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).drop("version").write.mode("overwrite").parquet(f"{table_path}/manifest/version={version}")
    return version


def superseded(spark: SparkSession, table_path: str) -> DataFrame:
    """(month, version) pairs that hold an older copy of a month; ``drop_superseded`` removes them."""
    manifest = read_manifest(spark, table_path)
    return manifest.where("wrote").select("month", "version").distinct().join(live_versions(manifest), ["month", "version"], "left_anti")


def drop_superseded(spark: SparkSession, table_path: str) -> int:
    """Delete the folders of older copies (when no reader uses them any more); how many went."""
    jvm, gone = spark.sparkContext._jvm, 0
    for r in superseded(spark, table_path).collect():       # a row a month and old version
        p = jvm.org.apache.hadoop.fs.Path(f"{table_path}/versions/month={r['month']}/version={r['version']}")
        gone += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    return gone
