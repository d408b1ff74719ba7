"""The monthly metrics document (S14, M1-M13) of every month of a stacked table.

The needed columns are read once and written slim. One aggregation over GROUPING SETS gives every
band, group and owner metric of every month, one grouped median gives all medians, and two ranked
lists (a group-limited window each) give the row lists. The result is long: a row a month, metric,
key or rank, and field, ready for ``write.partitionBy('month')``; numbers are in ``value``, names in
``text``.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import band, band_order, label_flag
from ..functions.numeric import pct, round_half_up as R, safe_ratio
from ..operators import grouped_median, top_k_per_group
from ..operators.partitioning import written
from .listings import ENTIRE, PRIVATE

# Labels of the document, in its order (the reports' labels have a dash in place of the hyphen).
RATING_LABELS = ["4.80 - 5.00", "No rating yet", "4.50 - 4.79", "Below 4.50"]
AVAIL_LABELS = ["0-30 days", "31-90 days", "91-180 days", "181-300 days", "301-365 days"]
HOST_LABELS = ["1 listing", "2-5 listings", "6+ listings"]
TOP_AREAS, TOP_REVENUE, TOP_REVIEWED, REVIEW_MONTHS, PICKS = 15, 10, 20, 24, 8

_DIMS = ["room", "host_type", "rating_band", "avail_band", "area", "bedroom", "review_month", "host"]


def _slim(stacked: DataFrame, period: str) -> DataFrame:
    """The document's columns; a grouping column is NULL where the row is not part of its report."""
    c = F.col
    priced = c("price") > 0
    level = c("bedrooms")
    return stacked.select(
        c(period).cast("string").alias("p"), "id", "name", "price", priced.alias("priced"), "number_of_reviews",
        "review_scores_rating", "reviews_per_month", "estimated_occupancy_l365d", "estimated_revenue_l365d", "last_scraped",
        c("first_review").isNull().alias("never"), (c("latitude").isNull() | c("longitude").isNull()).alias("unplaced"),
        c("room_type").alias("room"), c("neighbourhood_cleansed").alias("area"), c("host_id").alias("host"),
        label_flag("host_is_superhost", "Superhost", "Regular host", "Unknown").alias("host_type"),
        band("review_scores_rating", [4.5, 4.8], [RATING_LABELS[3], RATING_LABELS[2]], RATING_LABELS[0], RATING_LABELS[1], strict=True).alias("rating_band"),
        F.when(c("availability_365").isNotNull(), band("availability_365", [30, 90, 180, 300], AVAIL_LABELS[:4], AVAIL_LABELS[4])).alias("avail_band"),
        F.when(priced & (c("room_type") == ENTIRE) & level.between(0, 5), level.cast("int")).alias("bedroom"),
        F.date_format("last_review", "yyyy-MM").alias("review_month"))


def _grouped(slim: DataFrame) -> DataFrame:
    """Every measure per month and per month and value of each grouping column; ``dim`` names the
    grouping column ('' for the month alone)."""
    c = F.col
    priced = c("priced")
    of_priced = lambda x: F.avg(F.when(priced, c(x)))
    earns = priced & c("estimated_revenue_l365d").isNotNull()
    ids = {0 if d is None else k: d for k, d in enumerate([None, *_DIMS])}
    cols = ["p", *_DIMS]
    bits = {d: sum(1 << (len(cols) - 1 - i) for i, col in enumerate(cols) if col not in ("p", d)) for d in ids.values()}
    g = slim.groupingSets([[c("p")]] + [[c("p"), c(d)] for d in _DIMS], *[c(x) for x in cols]).agg(
        F.grouping_id().alias("__gid"), F.count(F.lit(1)).alias("n_all"), F.count_if(priced).alias("n"),
        F.count_if(c("price").isNull()).alias("missing_price"), F.count_if(c("never")).alias("never_reviewed"),
        F.count_if(c("unplaced")).alias("missing_coordinates"),
        F.count_if(c("number_of_reviews").isNull()).alias("missing_review_count"),
        F.count_if(c("review_scores_rating").isNull()).alias("missing_rating"),
        F.min("last_scraped").alias("earliest"), F.max("last_scraped").alias("latest"),
        F.sum(F.when(priced, c("price"))).alias("price_sum"), of_priced("price").alias("avg_price"),
        of_priced("review_scores_rating").alias("avg_rating"), of_priced("reviews_per_month").alias("avg_rpm"),
        of_priced("number_of_reviews").alias("avg_reviews"), of_priced("estimated_occupancy_l365d").alias("avg_occ"),
        F.count_if(earns).alias("n_rev"), F.avg(F.when(earns, c("estimated_revenue_l365d"))).alias("avg_rev"),
        F.avg(F.when(earns, c("estimated_occupancy_l365d"))).alias("avg_occ_rev"))
    dim = F.create_map(*[x for d, bit in bits.items() for x in (F.lit(bit).cast("long"), F.lit(d or ""))])
    return g.withColumn("dim", dim[c("__gid").cast("long")]).drop("__gid")


def _medians(slim: DataFrame) -> DataFrame:
    """(p, kind, key, med, n): exact medians of priced rows, overall, by the two room kinds, by area
    and by area among entire homes, from one grouped median."""
    c = F.col
    kinds = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("key")),
                    F.when(c("room").isin(ENTIRE, PRIVATE), F.struct(F.lit("room").alias("kind"), c("room").alias("key"))),
                    F.struct(F.lit("area").alias("kind"), c("area").alias("key")),
                    F.when(c("room") == ENTIRE, F.struct(F.lit("entire_area").alias("kind"), c("area").alias("key"))))
    rows = slim.where("priced").select("p", "price", F.explode(F.array_compact(kinds)).alias("k")).select("p", "k.kind", "k.key", "price")
    return grouped_median(rows, ["p", "kind", "key"], "price", "med")


def _part(df: DataFrame, metric: str, fields: Mapping[str, Column | str], *, key=None, rank=None, texts: Sequence[str] = ()) -> DataFrame:
    """(p, metric, key, rank, value, text): a row a field of each row of ``df``."""
    k = F.lit("") if key is None else F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
    r = F.lit(None).cast("long") if rank is None else F.col(rank).cast("long")
    col = lambda x: F.col(x) if isinstance(x, str) else x
    entries = [F.struct(F.lit(f"{metric}.{name}").alias("metric"),
                        (F.lit(None) if name in texts else col(x)).cast("double").alias("value"),
                        (col(x) if name in texts else F.lit(None)).cast("string").alias("text")) for name, x in fields.items()]
    return df.select("p", k.alias("key"), r.alias("rank"), F.explode(F.array(*entries)).alias("e")).select("p", "e.metric", "key", "rank", "e.value", "e.text")


def _ranked(df: DataFrame, order: Sequence[Column], k: int | None, alias: str = "rank") -> DataFrame:
    if k is not None:
        return top_k_per_group(df, ["p"], order, k, alias)
    return df.withColumn(alias, F.row_number().over(Window.partitionBy("p").orderBy(*order)))


def document(stacked: DataFrame, period: str = "month") -> DataFrame:
    """S14 of every period of ``stacked``: (period, metric, key, rank, value, text).

    Ties in a top list go to the smaller key or id; NULL keys are written as 'NULL'.
    """
    c = F.col
    slim = written(_slim(stacked, period), "document-rows")
    g = written(_grouped(slim), "document-groups")
    med = written(_medians(slim), "document-medians")
    of = lambda d: g.where(c("dim") == d)
    parts: list[DataFrame] = []
    # M1
    total = of("").withColumn("pct_missing_price", R(pct("missing_price", "n_all"), 1))
    parts.append(_part(total, "size", {"listings": "n_all", "earliest_scrape": "earliest", "latest_scrape": "latest"}, texts=["earliest_scrape", "latest_scrape"]))
    parts.append(_part(total, "quality", {"total_listings": "n_all", "listings_never_reviewed": "never_reviewed",
                                          **{x: x for x in ("missing_price", "pct_missing_price", "missing_coordinates", "missing_review_count", "missing_rating")}}))
    # M2
    share = lambda n, digits: R(pct(n, F.sum(n).over(Window.partitionBy("p"))), digits)
    room = of("room").withColumn("pct", share("n_all", 1))
    parts.append(_part(_ranked(room, [c("n_all").desc(), c("room")], None), "room_mix", {"n": "n_all", "pct": "pct"}, key="room", rank="rank"))
    # M3 and the overall median
    kind = lambda k, key: F.max(F.when((c("kind") == k) & (c("key") == key), R("med", 2)))
    wide = med.where(c("kind").isin("all", "room")).groupBy("p").agg(kind("all", "").alias("value"), kind("room", ENTIRE).alias("e"), kind("room", PRIVATE).alias("o"))
    parts.append(_part(wide, "premium", {"entire_home_median": "e", "private_room_median": "o", "entire_home_premium_ratio": R(safe_ratio("e", "o"), 2)}))
    parts.append(wide.select("p", F.lit("median_price").alias("metric"), F.lit("").alias("key"), F.lit(None).cast("long").alias("rank"), "value", F.lit(None).cast("string").alias("text")))
    # M4-M6: bands of priced rows
    parts.append(_part(of("host_type").where("n > 0"), "host_type", {"listings": "n", "avg_price": R("avg_price", 2), "avg_rating": R("avg_rating", 2),
                                                                   "avg_reviews_per_month": R("avg_rpm", 2), "avg_total_reviews": R("avg_reviews", 1)}, key="host_type"))
    rating = of("rating_band").where("n > 0").withColumn("rank", band_order("rating_band", RATING_LABELS) + 1)
    parts.append(_part(rating, "rating_band", {"listings": "n", "avg_price": R("avg_price", 2), "avg_reviews": R("avg_reviews", 1)}, key="rating_band", rank="rank"))
    avail = of("avail_band").where("n > 0 AND avail_band IS NOT NULL").withColumn("rank", band_order("avail_band", AVAIL_LABELS) + 1)
    parts.append(_part(avail, "availability_band", {"listings": "n", "avg_occ_days": R("avg_occ", 1), "implied_occupancy_pct": R(F.lit(100.0) * c("avg_occ") / 365, 1)},
                       key="avail_band", rank="rank"))
    # M7: the share is of all areas, then the largest
    area = of("area").where("n > 0").withColumn("pct", share("n", 2))
    area = _ranked(area, [c("n").desc(), c("area")], TOP_AREAS)
    am = med.where(c("kind") == "area").select(c("p").alias("mp"), c("key").alias("mk"), "med")
    area = area.join(am, c("p").eqNullSafe(c("mp")) & c("area").eqNullSafe(c("mk")), "left")
    parts.append(_part(area, "top_areas", {"listings": "n", "pct_of_city_supply": "pct", "avg_price": R("avg_price", 2), "median_price": R("med", 2)}, key="area", rank="rank"))
    # M8: owners by the number of their priced rows; the NULL owner counts, but has no mean price
    size = band("n", [1, 5], HOST_LABELS[:2], HOST_LABELS[2])
    own = F.col("host").isNotNull()
    hosts = of("host").where("n > 0").groupBy("p", size.alias("band")).agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("listings"), F.sum(F.when(own, c("price_sum"))).alias("s"), F.sum(F.when(own, c("n"))).alias("k"))
    hosts = hosts.withColumn("pct", share("listings", 1)).withColumn("rank", band_order("band", HOST_LABELS) + 1)
    parts.append(_part(hosts, "host_size", {"hosts": "hosts", "listings": "listings", "pct_of_supply": "pct", "avg_listing_price": R(safe_ratio("s", "k"), 2)}, key="band", rank="rank"))
    # M9
    step = c("avg_price") - F.lag("avg_price").over(Window.partitionBy("p").orderBy("bedroom"))
    beds = of("bedroom").where("bedroom IS NOT NULL").withColumn("step", step)
    parts.append(_part(beds, "bedrooms", {"listings": "n", "avg_price": R("avg_price", 2), "marginal_cost_of_extra_bedroom": R("step", 2)}, key="bedroom"))
    # M10
    rev = of("area").where("n_rev > 0").withColumn("avg_rev", R("avg_rev", 0))
    parts.append(_part(_ranked(rev, [c("avg_rev").desc(), c("area")], TOP_REVENUE), "revenue",
                       {"listings": "n_rev", "avg_est_annual_revenue": "avg_rev", "avg_est_occupancy_days": R("avg_occ_rev", 1)}, key="area", rank="rank"))
    # The rows and how many of them are private rooms
    top = written(_ranked(slim, [c("number_of_reviews").desc_nulls_last(), c("id")], TOP_REVIEWED)
                  .select("p", "rank", "number_of_reviews", "name", "area", "room", "price", "review_scores_rating"), "document-top")
    parts.append(_part(top, "top_reviewed", {"number_of_reviews": "number_of_reviews", "name": "name", "neighbourhood": "area", "room_type": "room",
                                             "price": R("price", 2), "rating": "review_scores_rating"}, rank="rank", texts=["name", "neighbourhood", "room_type"]))
    parts.append(_part(top.groupBy("p").agg(F.count_if(c("room") == PRIVATE).alias("n")), "top_reviewed", {"private_in_top20": "n"}))
    # M12
    months = of("review_month").where("review_month IS NOT NULL")
    parts.append(_part(_ranked(months, [c("review_month").desc()], REVIEW_MONTHS), "latest_review", {"listings_with_latest_review": "n_all"}, key="review_month", rank="rank"))
    # Entire homes below their area's median
    em = med.where(c("kind") == "entire_area").select(c("p").alias("mp"), c("key").alias("mk"), "med")
    good = slim.where(c("priced") & (c("room") == ENTIRE) & (c("review_scores_rating") >= 4.8) & (c("number_of_reviews") >= 20))
    picks = good.join(em, c("p").eqNullSafe(c("mp")) & (c("area") == c("mk"))).where("price < med")
    picks = written(_ranked(picks, [c("review_scores_rating").desc(), c("number_of_reviews").desc(), c("id")], PICKS)
                    .select("p", "rank", "name", "area", "price", "med", "review_scores_rating", "number_of_reviews"), "document-picks")
    parts.append(_part(picks, "value_picks", {"name": "name", "neighbourhood": "area", "price": R("price", 2), "nb_median_price": R("med", 2),
                                              "rating": "review_scores_rating", "reviews": "number_of_reviews"}, rank="rank", texts=["name", "neighbourhood"]))
    parts.append(_part(total.select("p").join(picks.groupBy("p").agg(F.count(F.lit(1)).alias("k")).withColumnRenamed("p", "mp"), c("p").eqNullSafe(c("mp")), "left")
                       .withColumn("k", F.coalesce("k", F.lit(0))), "value_picks", {"picks": "k"}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("p", period)
