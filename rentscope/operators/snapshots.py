"""Snapshot handling."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .medians import grouped_median
from .partitioning import materialize


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    """Fail before stacking when a snapshot lacks a required column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing columns: {missing}")
    return df


def stack_snapshots(frames: Mapping[str, DataFrame], columns: Sequence[str] | None = None,
                    label: str = "month") -> DataFrame:
    """Stack per-snapshot frames into one table with a discriminator column.

    With ``columns`` each frame is checked and pruned to them first.
    """
    out = None
    for lab, df in frames.items():
        if columns is not None:
            df = require_columns(df, columns, f"snapshot {lab}").select(*columns)
        df = df.select(F.lit(lab).alias(label), *df.columns)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no snapshots given")
    return out


def snapshot(stacked: DataFrame, label_value: str, label: str = "month") -> DataFrame:
    """One logical snapshot of the stacked table (S6): a partition filter."""
    return stacked.where(F.col(label) == label_value).drop(label)


def snapshot_diff(stacked: DataFrame, key: str, old: str, new: str,
                  label: str = "month") -> DataFrame:
    """Keys added / removed / kept between two snapshots (J8); one row.

    One aggregation by key with two presence flags replaces the two anti-joins:
    a single shuffle, and each key is looked at once.
    """
    per_key = (stacked.where(F.col(label).isin(old, new))
                      .groupBy(key)
                      .agg(F.max((F.col(label) == old).cast("int")).alias("__o"),
                           F.max((F.col(label) == new).cast("int")).alias("__n")))
    return per_key.agg(F.count_if((F.col("__n") == 1) & (F.col("__o") == 0)).alias("added"),
                       F.count_if((F.col("__o") == 1) & (F.col("__n") == 0)).alias("removed"),
                       F.count_if((F.col("__o") == 1) & (F.col("__n") == 1)).alias("kept"))


def group_movers(stacked: DataFrame, key: str, value: str, old: str, new: str, *,
                 label: str = "month", min_rows: int = 50, k: int = 3,
                 digits: int = 2) -> DataFrame:
    """Groups whose exact median moved most between two snapshots (J9 + O7).

    Both snapshots' medians come from one grouped median over (label, key); an
    inner join keeps groups present in both with at least ``min_rows`` rows.
    """
    from ..functions.numeric import round_half_up, safe_ratio
    two = stacked.where(F.col(label).isin(old, new) & F.col(key).isNotNull())
    s = materialize(grouped_median(two, [label, key], value, "__med", stats={"n": "__n"}))     # read twice below
    o = s.where(F.col(label) == old).select(key, F.col("__med").alias("median_old"), F.col("__n").alias("n_old"))
    n = s.where(F.col(label) == new).select(key, F.col("__med").alias("median_new"), F.col("__n").alias("n_new"))
    m = n.join(o, key, "inner").where((F.col("n_new") >= min_rows) & (F.col("n_old") >= min_rows))
    m = m.withColumn("change_pct", (safe_ratio("median_new", "median_old") - F.lit(1.0)) * F.lit(100.0))
    m = m.orderBy(F.abs("change_pct").desc(), F.col(key).asc()).limit(k)
    return m.select(key, round_half_up("median_old", digits).alias("median_old"),
                    round_half_up("median_new", digits).alias("median_new"),
                    "n_old", "n_new", round_half_up("change_pct", digits).alias("change_pct"))


def _with_previous(periods: DataFrame, label: str, prev: str) -> DataFrame:
    """Each period of a small per-period table with the period before it.

    The unpartitioned window is fine here: it runs on one row per snapshot.
    Labels must sort in time order (``yyyy``, ``yyyy-MM``, dates)."""
    return periods.withColumn(prev, F.lag(label).over(Window.orderBy(F.col(label))))


def snapshot_changes(stacked: DataFrame, key: str, label: str = "month",
                     prev_label: str = "prev_month") -> DataFrame:
    """Keys added / removed / kept between every snapshot and the one before it (J8
    over all snapshots); one row per snapshot that has a predecessor.

    One shuffle by key: each key's sorted snapshot list is built with a partial
    ``collect_set`` (<= one entry per snapshot per task, so a hot key is combined
    map-side and bounded by the snapshot count). From it every (snapshot, previous
    snapshot of this key) pair is counted into a table of <= snapshots^2 rows;
    kept(s) = keys whose previous appearance is the snapshot just before s.
    """
    per_key = (stacked.where(F.col(label).isNotNull()).groupBy(key)
                      .agg(F.array_sort(F.collect_set(label)).alias("__ls")))
    pairs = per_key.select(F.posexplode("__ls").alias("__i", label), "__ls").select(
        label, F.when(F.col("__i") > 0, F.element_at("__ls", F.col("__i").cast("int"))).alias("__pk"))
    cnt = pairs.groupBy(label, "__pk").agg(F.count(F.lit(1)).alias("__c"))
    tot = cnt.groupBy(label).agg(F.sum("__c").alias("__n"))
    seq = _with_previous(tot, label, prev_label).withColumn("__np", F.lag("__n").over(Window.orderBy(label)))
    kept = cnt.where(F.col("__pk").isNotNull()).select(F.col(label).alias("__l"), F.col("__pk").alias("__p"), "__c")
    j = seq.join(kept, (seq[label] == kept["__l"]) & (seq[prev_label] == kept["__p"]), "left")
    k = F.coalesce(F.col("__c"), F.lit(0)).cast("long")
    return (j.where(F.col(prev_label).isNotNull())
             .select(label, prev_label, (F.col("__n") - k).alias("added"),
                     (F.col("__np") - k).alias("removed"), k.alias("kept")))


def movers_by_period(stacked: DataFrame, key: str, value: str, *, label: str = "month",
                     prev_label: str = "prev_month", min_rows: int = 50, k: int = 3,
                     digits: int = 2, stage: bool = False) -> DataFrame:
    """For every snapshot, the ``k`` groups whose exact median moved most against the
    snapshot before it (J9 + O7 over all snapshots).

    All (snapshot, group) medians and counts come from one grouped median; each
    snapshot's row is joined with its predecessor's on the group key (inner: the
    group must be in both with ``min_rows`` rows), and the top k per snapshot is a
    ``row_number`` window planned with a partial group limit.
    """
    from ..functions.numeric import round_half_up, safe_ratio
    from .topk import top_k_per_group
    s = grouped_median(stacked.where(F.col(key).isNotNull()), [label, key], value, "__med", stats={"n": "__n"}, stage=stage)
    s = materialize(s)          # one row per (snapshot, group), read three times below
    seq = _with_previous(s.select(label).distinct(), label, prev_label)   # every snapshot with values
    s = s.where(F.col("__n") >= min_rows)
    new = s.join(seq, label).select(label, prev_label, key, F.col("__med").alias("median_new"),
                                    F.col("__n").alias("n_new"))
    old = s.select(F.col(label).alias(prev_label), key, F.col("__med").alias("median_old"),
                   F.col("__n").alias("n_old"))
    m = new.join(old, [prev_label, key], "inner")
    m = m.withColumn("__chg", (safe_ratio("median_new", "median_old") - F.lit(1.0)) * F.lit(100.0))
    m = top_k_per_group(m, [label], [F.abs("__chg").desc_nulls_last(), F.col(key).asc()], k, "__rk")
    return m.select(label, prev_label, key, round_half_up("median_old", digits).alias("median_old"),
                    round_half_up("median_new", digits).alias("median_new"), "n_old", "n_new",
                    round_half_up("__chg", digits).alias("change_pct"))


def pending_snapshots(found: DataFrame, done: DataFrame, key: str = "month") -> DataFrame:
    """Snapshots found but not processed yet (S11): a left anti-join."""
    return found.join(done.select(key).distinct(), key, "left_anti")


def latest_snapshot(found: DataFrame, upto: str, month: str = "month",
                    preference: str = "day_rank") -> DataFrame:
    """Newest candidate at or before ``upto`` (S12): most recent month first,
    then the caller's day preference (lower rank first); one row."""
    cand = found.where(F.col(month) <= upto)
    return cand.orderBy(F.col(month).desc(), F.col(preference).asc()).limit(1)


def previous_period(periods: DataFrame, current: str, period: str = "month") -> DataFrame:
    """The newest period strictly before ``current`` (S15); not bound to one year."""
    return periods.where(F.col(period) < current).agg(F.max(period).alias(period))
