"""Named query shapes of the source project as parameterised DataFrame functions.

Each function takes column names as arguments, so the rental marts
(``plans.listings`` / ``calendar`` / ``reviews``) and the driver-table
bindings (``plans.bindings``) run the very same code. Definition variants that
differ in meaning (trap list: C1 vs B5, A2 vs M3, A9 vs D7 vs H6, ...) are
arguments, not copies.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import band
from ..functions.numeric import pct, round_half_up, safe_ratio
from ..operators.joins import count_children, portfolio_sizes
from ..operators.medians import grouped_median, median_and_counts
from ..operators.partitioning import materialize
from ..operators.shares import share_of_total
from ..operators.topk import top_k
from ..operators.windows import adjacent_step, rolling_sum

R = round_half_up


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def supply_by_group(df: DataFrame, key: str, value: str, *, limit: int | None = 15,
                    out_key: str | None = None, count_alias: str = "listings",
                    share_alias: str = "pct_of_city_supply", avg_alias: str = "avg_price",
                    median_alias: str = "median_price", share_digits: int = 1,
                    min_rows: int | None = None,
                    keep_null: bool = False, stage: bool = False) -> DataFrame:
    """Groups by size with share, mean and exact median of priced rows (A1/D3/M7/H1).

    Share is taken over all groups before the limit. The NULL group is left out
    of rows and share (A1/D3), unless ``keep_null`` (M7). ``stage``: the input has a join behind it
    (see ``operators.medians``).
    """
    out_key = out_key or key
    priced = df.where(F.col(value) > 0)
    # count and mean come from the median's first pass; the source's inner join
    # of the two aggregates drops the NULL group, so drop it explicitly.
    j = grouped_median(priced, [key], value, "__med", stats={"n": "__n", "avg": "__avg"}, stage=stage)
    if not keep_null:
        j = j.where(F.col(key).isNotNull())
    if min_rows is not None:
        j = j.where(F.col("__n") >= min_rows)
    j = share_of_total(j, "__n", "__share", digits=share_digits)
    out = j.select(F.col(key).alias(out_key), F.col("__n").alias(count_alias),
                   F.col("__share").alias(share_alias), R("__avg", 2).alias(avg_alias),
                   R("__med", 2).alias(median_alias))
    return top_k(out, [F.col(count_alias).desc()], limit, [out_key]) if limit else out


def price_profile(df: DataFrame, key: str, value: str, *, count_alias: str = "n",
                  names: Sequence[str] = ("min_price", "avg_price", "median_price", "max_price")) -> DataFrame:
    """n / min / mean / exact median / max of priced rows per group."""
    priced = df.where(F.col(value) > 0)
    j = grouped_median(priced, [key], value, "__med",
                       stats={"n": count_alias, "min": "__mn", "avg": "__avg", "max": "__mx"})
    return j.select(key, count_alias, R("__mn", 2).alias(names[0]), R("__avg", 2).alias(names[1]),
                    R("__med", 2).alias(names[2]), R("__mx", 2).alias(names[3]))


def grouped_stats(df: DataFrame, label: Column, label_alias: str, count_alias: str,
                  means: Mapping[str, tuple[Column | str, int | None]]) -> DataFrame:
    """Rows and rounded means per computed label.

    ``means`` maps output -> (expression, digits); digits None keeps it unrounded.
    """
    aggs = [F.count(F.lit(1)).alias(count_alias)]
    for name, (expr, digits) in means.items():
        m = F.avg(_col(expr))
        aggs.append((R(m, digits) if digits is not None else m).alias(name))
    return df.groupBy(label.alias(label_alias)).agg(*aggs)


def band_counts(df: DataFrame, label: Column, label_alias: str, count_alias: str,
                pct_alias: str = "pct", digits: int = 1) -> DataFrame:
    """Rows per band and their share of all rows."""
    g = df.groupBy(label.alias(label_alias)).agg(F.count(F.lit(1)).alias(count_alias))
    return share_of_total(g, count_alias, pct_alias, digits=digits)


def portfolio_bands(df: DataFrame, owner: str, value: str, *, bounds=(1, 5),
                    labels=("1 listing", "2–5 listings"), else_label: str = "6+ listings",
                    names: Sequence[str] = ("host_size_band", "hosts", "listings",
                                            "pct_of_supply", "avg_listing_price"),
                    priced: bool = True, keep_null_owner: bool = False) -> DataFrame:
    """Supply by owner-portfolio band (A8/D5/M8) as a two-level aggregate.

    The source joins every row to its owner's portfolio; here the per-owner
    count and value sum are enough, so no detail row is joined back.
    ``keep_null_owner`` makes the NULL owner one group of the counts (the monthly
    document); its rows have no owner to join to and stay out of the mean value.
    """
    base = df.where(F.col(value) > 0) if priced else df
    if not keep_null_owner:
        base = base.where(F.col(owner).isNotNull())
    per = portfolio_sizes(base, owner, value)
    b = band(F.col("portfolio_size"), bounds, labels, else_label)
    g = per.groupBy(b.alias(names[0])).agg(
        F.count(F.lit(1)).alias(names[1]), F.sum("portfolio_size").alias(names[2]),
        *[F.sum(F.when(F.col(owner).isNotNull(), F.col(c))).alias(a) for c, a in (("value_sum", "__vs"), ("value_n", "__vn"))])
    g = share_of_total(g, names[2], names[3], digits=1)
    return g.select(names[0], names[1], names[2], names[3],
                    R(safe_ratio("__vs", "__vn"), 2).alias(names[4]))


def step_curve(df: DataFrame, key: str, value: str, lo, hi, *, mode: str = "keep",
               cut=None, names: Sequence[str] = ("listings", "avg_price", "step"),
               key_alias: str | None = None, group_by_cast: str | None = None) -> DataFrame:
    """Mean value per key level and the step from the previous level.

    mode="keep": levels in [lo, hi], step against the previous level (A9);
    mode="prefilter": levels < cut removed before the step (D7);
    mode="postfilter": step computed over [lo, hi], then levels < cut hidden (H6).
    ``group_by_cast`` groups by the cast level (M9) instead of the raw value (A9).
    """
    k = F.col(key)
    base = df.where(F.col(value) > 0).where(k.between(lo, hi))
    if mode == "prefilter":
        base = base.where(k >= cut)
    key_alias = key_alias or key
    gk = k.cast(group_by_cast) if group_by_cast else k
    g = base.groupBy(gk.alias("__g")).agg(F.count(F.lit(1)).alias(names[0]), F.avg(value).alias("__avg"))
    g = adjacent_step(g, "__g", "__avg", names[2], digits=2)
    if mode == "postfilter":
        g = g.where(F.col("__g") >= cut)
    label = F.col("__g").cast("int") if not group_by_cast else F.col("__g")
    return g.select(label.alias(key_alias), names[0], R("__avg", 2).alias(names[1]), names[2])


def having_top(df: DataFrame, key: str, value: Column | str, *, min_rows: int | None, k: int,
               names: Sequence[str], extra_means: Mapping[str, tuple[Column | str, int]] = {},
               digits: int = 0, out_key: str | None = None) -> DataFrame:
    """Top k groups by rounded mean value with a minimum group size.

    Ordered by the rounded mean as the source does, then by key.
    """
    v = _col(value)
    base = df.where(v.isNotNull())
    aggs = [F.count(F.lit(1)).alias(names[0]), R(F.avg(v), digits).alias(names[1])]
    aggs += [R(F.avg(_col(e)), d).alias(n) for n, (e, d) in extra_means.items()]
    g = base.groupBy(key).agg(*aggs)
    if min_rows is not None:
        g = g.where(F.col(names[0]) >= min_rows)
    if out_key:
        g = g.withColumnRenamed(key, out_key)
    return top_k(g, [F.col(names[1]).desc()], k, [out_key or key])


def value_picks(df: DataFrame, key: str, value: str, *, median_filter: Column,
                pick_filter: Column, order: Sequence[Column], tiebreak: Sequence[str],
                k: int, select: Sequence[Column], median_alias: str = "nb_median_price",
                stage: bool = False) -> DataFrame:
    """Rows below their group's exact median that pass ``pick_filter``."""
    med = grouped_median(df.where(median_filter), [key], value, "__med", stage=stage)
    j = df.join(med, key, "inner").where(pick_filter & (F.col(value) < F.col("__med")))
    j = j.withColumn(median_alias, R("__med", 2))
    return top_k(j, order, k, tiebreak).select(*select)


def entity_ratio_mean(df: DataFrame, entity: str, flag: Column, *, alias: str,
                      count_alias: str, digits: int = 1) -> DataFrame:
    """Mean over entities of each entity's flagged share, in % (C1). An entity whose flags are
    all NULL has no share: it is counted, but not averaged."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("__t"), F.sum(flag.cast("int")).alias("__f"))
    return per.agg(R(F.avg(F.col("__f") / F.col("__t")) * F.lit(100.0), digits).alias(alias),
                   F.count(F.lit(1)).alias(count_alias))


def ratio_of_sums(df: DataFrame, flag: Column, *, alias: str, count_alias: str | None = None,
                  digits: int = 1) -> DataFrame:
    """Flagged rows over all rows, in % (B5); NULL flags count in the denominator."""
    aggs = [R(pct(F.count_if(flag), F.count(F.lit(1))), digits).alias(alias)]
    if count_alias:
        aggs.append(F.count(F.lit(1)).alias(count_alias))
    return df.agg(*aggs)


def period_share(df: DataFrame, period: Column, flag_value: Column, *, period_alias: str,
                 count_alias: str | None, pct_alias: str, digits: int = 1) -> DataFrame:
    """Rows and mean flag in % per period.

    ``flag_value`` is 1/0/NULL: C3 (AVG) skips NULL, B3 passes
    ``coalesce(flag, 0)`` so NULL counts in the denominator.
    """
    aggs = []
    if count_alias:
        aggs.append(F.count(F.lit(1)).alias(count_alias))
    aggs.append(R(F.lit(100.0) * F.avg(flag_value), digits).alias(pct_alias))
    return df.groupBy(period.alias(period_alias)).agg(*aggs)


def period_volume(df: DataFrame, period: Column, *, period_alias: str, count_alias: str,
                  distinct: str | None = None, distinct_alias: str | None = None) -> DataFrame:
    """Rows (and exact distinct entities) per period."""
    aggs = [F.count(F.lit(1)).alias(count_alias)]
    if distinct:
        aggs.append(F.count_distinct(distinct).alias(distinct_alias))
    return df.groupBy(period.alias(period_alias)).agg(*aggs)


def month_of_year_mean(df: DataFrame, date_col: str, start=None, end=None, *,
                       alias: str, digits: int = 0) -> DataFrame:
    """Mean monthly volume by calendar month over [start, end).

    ``start`` / ``end`` are ISO date strings or date columns. Without them: from the first month of
    the data up to, not including, the latest one, bounded on the month table itself, so the rows
    are read once."""
    d = F.col(date_col)
    if start is None and end is None:
        m = materialize(df.where(d.isNotNull()).groupBy(F.trunc(d.cast("date"), "month").alias("__m")).agg(F.count(F.lit(1)).alias("__c")))
        m = m.where(F.col("__m") < m.agg(F.max("__m")).scalar())
        return m.groupBy(F.date_format("__m", "MM").alias("month_num")).agg(R(F.avg("__c"), digits).alias(alias))
    lo = F.lit(start).cast("date") if isinstance(start, str) else start
    hi = F.lit(end).cast("date") if isinstance(end, str) else end
    m = (df.where((d >= lo) & (d < hi))
           .groupBy(F.trunc(d.cast("date"), "month").alias("__m")).agg(F.count(F.lit(1)).alias("__c")))
    return m.groupBy(F.date_format("__m", "MM").alias("month_num")).agg(R(F.avg("__c"), digits).alias(alias))


def trailing_vs_lifetime(events: DataFrame, entity: str, date_col: str, asof: str, days: int, *,
                         min_total: int) -> DataFrame:
    """Per entity: events in the ``days`` before ``asof`` and lifetime events.

    One aggregation pass gives both counts (the source scans twice and joins).
    Entities without recent events are dropped, as the inner join does.
    """
    cut = F.date_sub(F.lit(asof).cast("date"), days)
    per = events.groupBy(entity).agg(F.count_if(F.col(date_col) >= cut).alias("recent"),
                                     F.count(F.lit(1)).alias("total"))
    return per.where((F.col("recent") > 0) & (F.col("total") >= min_total))


def trailing_count(events: DataFrame, entity: str, date_col: str, asof: str, days: int,
                   alias: str) -> DataFrame:
    """Events per entity since ``asof - days`` (R5), pre-aggregated before any join."""
    cut = F.date_sub(F.lit(asof).cast("date"), days)
    return events.where(F.col(date_col) >= cut).groupBy(entity).agg(F.count(F.lit(1)).alias(alias))


def distinct_profile(df: DataFrame, keys: Mapping[str, str], count_alias: str, counts: Mapping[str, Column] = {}) -> DataFrame:
    """Rows, rows that meet each condition, and the distinct values of each key (E1); one row.

    Two distinct counts in one aggregate would expand every row once a key; here each key is
    aggregated by itself (a key is combined before the shuffle), the first one along with the counts.
    """
    (first, key), *rest = keys.items()
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias(count_alias), *[F.count_if(c).alias(n) for n, c in counts.items()])
    out = per.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in (count_alias, *counts)], F.count(key).alias(first))
    return out.select("*", *[df.groupBy(k).agg(F.count(F.lit(1))).agg(F.count(k)).scalar().alias(n) for n, k in rest])


def cohort_report(df: DataFrame, year: Column, month: Column, *, run: int = 4, count_alias: str = "registrations") -> DataFrame:
    """Issue cohorts (E3): rows and share of each year, of the ``run`` consecutive months that hold the most,
    and of the earliest month: (part, cohort, count, pct). One ROLLUP serves all three; rows without a
    valid year and month have no cohort, but count in the shares. Ties go to the earlier run.
    """
    ok = month.between(1, 12) & year.isNotNull()
    g = (df.select(F.when(ok, year).alias("__y"), F.when(ok, month).alias("__m")).rollup("__y", "__m")
           .agg(F.count(F.lit(1)).alias("__n"), F.grouping_id().alias("__g")))
    g = materialize(g)              # a row a month and year
    total = g.where("__g = 3").agg(F.max("__n")).scalar()
    years = g.where("__g = 1 AND __y IS NOT NULL").select(F.lit("year").alias("part"), F.col("__y").cast("string").alias("cohort"), "__n")
    months = g.where("__g = 0 AND __y IS NOT NULL").select((F.col("__y") * 12 + F.col("__m") - 1).alias("__i"), "__n")
    label = lambda i: F.format_string("%04d-%02d", F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"))
    i = F.col("__i")
    best = top_k(rolling_sum(months, "__i", "__n", run, "__r"), [F.col("__r").desc()], 1, ["__i"]).select(
        F.lit("best_run").alias("part"), F.concat(label(i - (run - 1)), F.lit(" to "), label(i)).alias("cohort"), F.col("__r").alias("__n"))
    first = top_k(months, [i], 1).select(F.lit("earliest").alias("part"), label(i).alias("cohort"), "__n")
    return years.unionByName(best).unionByName(first).select(
        "part", "cohort", F.col("__n").alias(count_alias), R(pct("__n", total), 1).alias("pct"))


def lead_time(events: DataFrame, entity: str, date_col: str, hit: Column) -> DataFrame:
    """Per entity: days from its first event to its first ``hit`` event."""
    d = F.col(date_col).cast("date")
    per = events.groupBy(entity).agg(F.min(d).alias("__start"), F.min(F.when(hit, d)).alias("__first"))
    return per.withColumn("lead_days", F.datediff("__first", "__start"))


def children_bands(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str,
                   bounds, labels, else_label: str, *, names: Sequence[str],
                   zero_label: str | None = "0") -> DataFrame:
    """Parents by number of children (0 kept), with share."""
    c = count_children(parent.select(parent_key), child.select(child_key), parent_key, child_key, "__n")
    n = F.col("__n")
    lab = band(n, bounds, labels, else_label)
    if zero_label is not None:
        lab = F.when(n == 0, F.lit(zero_label)).otherwise(lab)
    return band_counts(c, lab, names[0], names[1], names[2])


def kpi_rows(df: DataFrame, period: Column | None, price: str, kind: str, a: str, b: str, *,
             flag: Column, never: Column, names: Mapping[str, str]) -> DataFrame:
    """One KPI row per period (B2/D1/D2): rows, two kind medians, three shares.

    The scalar subqueries of the source (six scans) become one grouped median over (period,
    kind) whose first histogram counts the conditions along, pivoted on the small result.
    """
    p = F.col(price)
    priced = p > 0
    keys = ["__p"] if period is not None else []
    base = df.withColumn("__p", period) if period is not None else df
    med, per = median_and_counts(base, keys + [kind], F.when(priced & F.col(kind).isin(a, b), p), {
        "rows": F.lit(True), "__none": p.isNull() | (p <= 0), "__priced": priced, "__flag": priced & flag, "__never": never}, "__m")
    total = [F.sum(c).alias(c) for c in ("rows", "__none", "__priced", "__flag", "__never")]
    stats = (per.groupBy(*keys) if keys else per).agg(*total).select(
        *keys, F.coalesce("rows", F.lit(0)).alias("rows"), R(pct("__none", "rows"), 2).alias("no_price_pct"),
        R(pct("__flag", "__priced"), 2).alias("flag_share"), R(pct("__never", "rows"), 2).alias("never_pct"))
    piv = (med.groupBy(*keys) if keys else med).agg(
        F.max(F.when(F.col(kind) == a, F.col("__m"))).alias("__a"),
        F.max(F.when(F.col(kind) == b, F.col("__m"))).alias("__b"))
    if keys:
        r = piv.withColumnRenamed("__p", "__r")
        j = stats.join(r, stats["__p"].eqNullSafe(r["__r"]), "left")
    else:
        j = stats.withColumn("__one", F.lit(1)).join(piv.withColumn("__one", F.lit(1)), "__one", "left")
    cols = ([F.col("__p").alias(names["period"])] if keys else []) + [
        F.col("rows").alias(names["rows"]), R("__a", 2).alias(names["a_median"]),
        R("__b", 2).alias(names["b_median"]), F.col("no_price_pct").alias(names["no_price_pct"]),
        F.col("flag_share").alias(names["flag_share"]), F.col("never_pct").alias(names["never_pct"])]
    if "premium" in names:
        cols.append(R(safe_ratio(R("__a", 2), R("__b", 2)), 2).alias(names["premium"]))
    return j.select(*cols)
