"""Exact medians (G5-G8) that stay exact and bounded when one group is huge.

``F.median`` keeps every distinct value of a group in one aggregation buffer,
so a group holding a third of a 100 TB table would land in one task. The
operator here selects the middle rank(s) by narrowing histograms instead, by the
same steps for every group and at every size. Each pass reads the input again, so a caller whose
input has a join or a costly filter behind it passes ``stage=True``: the (key, value) rows are
written once to the shared folder first. A plain table scan is read again instead: writing its
values would cost more than the second scan.

1. One pass counts rows per (group, coarse bucket). The coarse bucket is a
   data-independent monotone function of the value, so this is a plain partial
   aggregation (map-side combine; a hot group is split over all map tasks).
   A window over the <= few-thousand buckets of a group gives the group size
   ``n``, the target ranks ``(n+1) div 2`` and ``(n+2) div 2`` (1-based, the
   "mean of the two middles" rule) and the bucket that holds each rank.
2. While a chosen interval still holds more than ``final_max_rows`` rows, a
   further pass cuts it at ``cuts`` quantiles of the rows inside it (still partial
   aggregations), narrowing it again.
   The per-group target table (<= 2 rows per group) is written after each pass, so the
   scan behind it is not repeated; Catalyst picks its join by the size of its files.
3. A target whose interval holds a single distinct value is answered without a
   sort. Only the remaining rows, at most ``final_max_rows`` an interval, get a ``row_number`` to pick the exact rank.

Because buckets are contiguous value ranges, a bucket is identified by the
[min, max] of the values it holds, and the rows "below" it are counted exactly.
NULL and NaN values are ignored, as SQL's median ignores NULL.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .partitioning import written

_ALL = "__all"
_V = "__v"


def _value(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


_INF = float("inf")


def _coarse_bucket(v: Column, per_unit: float) -> Column:
    # sign(v) * log1p(|v|) is monotone and symmetric; finite doubles map to
    # |bucket| < 46,000 * per_unit / 64, infinities get their own end buckets.
    finite = F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(per_unit)).cast("long")
    return F.when(v == F.lit(_INF), F.lit(1 << 62)).when(v == F.lit(-_INF), F.lit(-(1 << 62))).otherwise(finite)


def _with_quantile_bucket(df: DataFrame, v: Column, cuts: int) -> DataFrame:
    """``__b``: bucket of v among the cuts ``__q``, monotone in v; equal to a cut is a bucket of its own.

    The cuts below v are counted by binary search, a column a step: log2(cuts) comparisons a row inside
    generated code, where a lambda over the array would be called for every cut.
    """
    df, step = df.withColumn("__b", F.lit(0)), 1 << (cuts.bit_length() - 1)
    while step:
        # get() beyond the last cut is NULL, which is not below v
        below = F.get("__q", F.col("__b") + (step - 1)) < v
        df = df.withColumn("__b", F.col("__b") + F.when(below, F.lit(step)).otherwise(F.lit(0)))
        step >>= 1
    return df.withColumn("__b", F.col("__b") * 2 + F.when(F.get("__q", F.col("__b")) == v, F.lit(1)).otherwise(F.lit(0)))


def _ns_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join on ``keys`` where NULL keys match each other (SQL GROUP BY semantics)."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys]
    out = left.join(r, cond, "inner")
    return out.drop(*[f"__r_{k}" for k in keys])


def _pick_targets(h: DataFrame, gkeys: list[str], part: list[str], carry: Sequence[str] = ()) -> DataFrame:
    """From per-bucket counts (cnt, lo_b, hi_b) with a running total, keep one row per
    target rank: the bucket that holds it, with the rows below it and its size."""
    w = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("__cum", F.sum("__c").over(w) + F.col("__below"))
    first = F.col("__cum") - F.col("__c")
    hit = F.filter("__ks", lambda k: (k > first) & (k <= F.col("__cum")))
    return (h.where(F.size(hit) > 0)
             .select(*gkeys, *carry, F.explode(hit).alias("__k"), first.alias("__below"),
                     F.col("__bl").alias("__lo"), F.col("__bh").alias("__hi"), F.col("__c").alias("__cnt")))


_STATS = ["__n", "__gsum", "__gmin", "__gmax"]

# Largest interval handed to the final exact sort; a larger one is refined again.
FINAL_MAX_ROWS = 2_000_000


def _targets(t: DataFrame) -> tuple[DataFrame, int]:
    """The small target table, written (no later use repeats the scan behind it), and the
    rows of its largest open interval, observed by the job that writes it."""
    seen = Observation()
    t = written(t.observe(seen, F.max(F.when(F.col("__lo") < F.col("__hi"), F.col("__cnt"))).alias("open")), "median-targets")
    return t, int(seen.get["open"] or 0)


def _histogram(x: DataFrame, gkeys: Sequence[str], per_unit: float, counts: Sequence[str] = ()) -> DataFrame:
    """Rows per (group, coarse bucket) with the bucket's smallest and largest value and its sum;
    ``counts`` are integer columns that are summed along. Rows without a value are bucket NULL."""
    v = F.col(_V)
    return (x.groupBy(*gkeys, _coarse_bucket(v, per_unit).alias("__b"))
             .agg(F.count(v).alias("__c"), F.min(v).alias("__bl"), F.max(v).alias("__bh"), F.sum(v).alias("__s"),
                  *[F.sum(c).alias(c) for c in counts]))


def median_values(df: DataFrame, keys: Sequence[str], value, *, cuts: int = 255,
                  coarse_per_unit: float = 64.0, final_max_rows: int = FINAL_MAX_ROWS,
                  stage: bool = False, histogram: DataFrame | None = None) -> DataFrame:
    """One row per (group, middle rank) with the exact value at that rank.

    Columns: ``keys`` (or ``__all`` when no keys), the group statistics
    ``__n, __gsum, __gmin, __gmax`` (taken from the first histogram for free),
    ``__k`` rank, ``__v`` value.
    Runs one histogram pass, then refinement passes while some open interval holds more
    than ``final_max_rows`` rows. A pass cuts every open interval at ``cuts`` quantiles of its own
    rows, whatever their magnitudes, and a value that is a cut has a bucket of its own; so each
    pass divides the rows by about ``cuts`` or closes the interval, and the last sort is bounded.
    ``stage`` writes the rows first; ``histogram`` is the first pass if the caller has made it.
    """
    keys = list(keys)
    gkeys = keys or [_ALL]
    x = df.select(*[F.col(k) for k in keys], _value(value).alias(_V))
    if not keys:
        x = x.withColumn(_ALL, F.lit(0))
    x = x.where(F.col(_V).isNotNull() & ~F.isnan(F.col(_V)))
    if stage:
        x = written(x, "median-values")
    v = F.col(_V)

    # Pass 1: coarse histogram over all rows; group size and target ranks.
    h = _histogram(x, gkeys, coarse_per_unit) if histogram is None else histogram
    wg = Window.partitionBy(*gkeys)
    n = F.sum("__c").over(wg)
    h = (h.withColumn("__n", n).withColumn("__gsum", F.sum("__s").over(wg))
          .withColumn("__gmin", F.min("__bl").over(wg)).withColumn("__gmax", F.max("__bh").over(wg))
          .withColumn("__ks", F.array_distinct(F.array(
              F.floor((F.col("__n") + 1) / 2).cast("long"),
              F.floor((F.col("__n") + 2) / 2).cast("long"))))
          .withColumn("__below", F.lit(0).cast("long")))
    t, max_open = _targets(_pick_targets(h, gkeys, gkeys, _STATS))

    # Further passes: quantile sub-buckets inside each open interval.
    while max_open > final_max_rows:
        open_iv = (t.where(F.col("__lo") < F.col("__hi"))
                    .groupBy(*gkeys, *_STATS, "__lo", "__hi", "__below")
                    .agg(F.array_sort(F.collect_set("__k")).alias("__ks")))
        cand = _ns_join(x, open_iv, gkeys).where(v.between(F.col("__lo"), F.col("__hi")))
        at = F.percentile_approx(v, [i / (cuts + 1) for i in range(1, cuts + 1)], 8 * (cuts + 1))
        bounds = cand.groupBy(*gkeys, "__lo", "__hi").agg(at.alias("__q"))
        cand = _ns_join(cand, bounds, gkeys + ["__lo", "__hi"])
        cand = _with_quantile_bucket(cand, v, cuts)
        h = (cand.groupBy(*gkeys, *_STATS, "__lo", "__hi", "__below", "__ks", "__b")
                 .agg(F.count(F.lit(1)).alias("__c"), F.min(v).alias("__bl"), F.max(v).alias("__bh")))
        refined = _pick_targets(h, gkeys, gkeys + ["__lo", "__hi"], _STATS)
        t, max_open = _targets(t.where(F.col("__lo") == F.col("__hi")).unionByName(refined))

    # Intervals of one distinct value answer their ranks directly.
    closed = t.where(F.col("__lo") == F.col("__hi")).select(*gkeys, *_STATS, "__k", F.col("__lo").alias(_V))
    if max_open == 0:           # no interval holds two distinct values: no second scan of the data
        return closed
    # The rest: exact rank inside the (now small) interval.
    open_iv = (t.where(F.col("__lo") < F.col("__hi"))
                .groupBy(*gkeys, *_STATS, "__lo", "__hi", "__below")
                .agg(F.collect_set("__k").alias("__ks")))
    cand = _ns_join(x, open_iv, gkeys).where(v.between(F.col("__lo"), F.col("__hi")))
    rn = F.row_number().over(Window.partitionBy(*gkeys, "__lo", "__hi").orderBy(v))
    cand = cand.withColumn("__k", F.col("__below") + rn)
    picked = cand.where(F.array_contains("__ks", F.col("__k"))).select(*gkeys, *_STATS, "__k", _V)
    return closed.unionByName(picked)


def grouped_median(df: DataFrame, keys: Sequence[str], value, alias: str = "median",
                   *, stats: dict[str, str] | None = None, **kw) -> DataFrame:
    """Exact median of ``value`` per group (G6); mean of the two middle rows for even n.

    Groups whose values are all NULL / NaN are absent from the result; NULL keys are one group.
    ``stats`` maps any of n / sum / avg / min / max to an output column; they
    describe the same non-NULL values and come from the first pass.
    """
    keys = list(keys)
    stats = stats or {}
    mv = median_values(df, keys, value, **kw)
    st = {"n": F.max("__n"), "sum": F.max("__gsum"), "avg": F.max("__gsum") / F.max("__n"),
          "min": F.max("__gmin"), "max": F.max("__gmax")}
    # equal middles are the median itself (avg would overflow for two values near the double maximum)
    mid = F.when(F.min(_V) == F.max(_V), F.min(_V)).otherwise(F.avg(_V))
    aggs = [mid.alias(alias), *[st[k].alias(c) for k, c in stats.items()]]
    return mv.groupBy(*keys).agg(*aggs) if keys else mv.agg(*aggs)


def median_and_counts(df: DataFrame, keys: Sequence[str], value, counts: dict[str, Column], alias: str = "median",
                      *, coarse_per_unit: float = 64.0, **kw) -> tuple[DataFrame, DataFrame]:
    """(medians, counts): the exact median of ``value`` per group as ``grouped_median`` gives it, and per
    group how many rows meet each condition of ``counts``, also of rows whose value is NULL.

    The conditions are counted along in the median's first histogram, so the two take one scan
    together (the median's last step reads the values a second time).
    """
    keys = list(keys)
    gkeys = keys or [_ALL]
    names = [f"__n{i}" for i in range(len(counts))]
    x = df.select(*[F.col(k) for k in keys], _value(value).alias(_V),
                  *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in zip(names, counts.values())])
    if not keys:
        x = x.withColumn(_ALL, F.lit(0))
    x = x.withColumn(_V, F.when(~F.isnan(_V), F.col(_V)))
    h = written(_histogram(x, gkeys, coarse_per_unit, names), "median-histogram")
    sums = [F.sum(n).alias(c) for n, c in zip(names, counts)]
    per = h.groupBy(*keys).agg(*sums) if keys else h.agg(*sums)
    return grouped_median(df, keys, value, alias, histogram=h.where(F.col("__b").isNotNull()).drop(*names),
                          coarse_per_unit=coarse_per_unit, **kw), per


def global_median(df: DataFrame, value, alias: str = "median", **kw) -> DataFrame:
    """Exact median over the whole table (G7), one row; never a single-partition sort."""
    return grouped_median(df, [], value, alias, **kw)


def multi_median(df: DataFrame, keys: Sequence[str], columns: dict[str, str],
                 count_alias: str | None = "n", **kw) -> DataFrame:
    """Several medians at once (G8) after the joint not-NULL filter.

    ``columns`` maps output name -> input column. The columns are unpivoted to
    (metric, value) rows, so one exact-median pipeline over (keys, metric) serves
    all of them: one scan, one histogram shuffle and one refinement per call
    instead of one per column; the small result is pivoted back per group.
    """
    keys = list(keys)
    cond = None
    for c in columns.values():
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    entries = F.array(*[F.struct(F.lit(i).alias("__m"), _value(c).alias("__x"))
                        for i, c in enumerate(columns.values())])
    long = df.where(cond).select(*keys, F.explode(entries).alias("__e")).select(*keys, "__e.__m", "__e.__x")
    m = grouped_median(long, keys + ["__m"], "__x", "__med", stats={"n": "__cnt"}, **kw)
    aggs = [F.max(F.when(F.col("__m") == i, F.col("__med"))).alias(name) for i, name in enumerate(columns)]
    if count_alias:
        aggs.insert(0, F.max(F.when(F.col("__m") == 0, F.col("__cnt"))).alias(count_alias))
    return m.groupBy(*keys).agg(*aggs) if keys else m.agg(*aggs)


def median_ratio(df: DataFrame, key: str, value, a: str, b: str, *,
                 names: tuple[str, str, str] = ("a_median", "b_median", "a_to_b_ratio"),
                 digits: int = 2, ratio_of_rounded: bool = False, **kw) -> DataFrame:
    """Medians of two key values side by side and their ratio.

    ``ratio_of_rounded=False`` divides the unrounded medians (the SQL script);
    ``True`` divides the medians rounded for display (the monthly document).
    """
    from ..functions.numeric import round_half_up, safe_ratio
    m = grouped_median(df.where(F.col(key).isin(a, b)), [key], value, "__m", **kw)
    piv = m.agg(F.max(F.when(F.col(key) == a, F.col("__m"))).alias("__a"),
                F.max(F.when(F.col(key) == b, F.col("__m"))).alias("__b"))
    ra, rb = round_half_up("__a", digits), round_half_up("__b", digits)
    ratio = safe_ratio(ra, rb) if ratio_of_rounded else safe_ratio("__a", "__b")
    return piv.select(ra.alias(names[0]), rb.alias(names[1]),
                      round_half_up(ratio, digits).alias(names[2]))
