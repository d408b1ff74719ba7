"""The monthly document (S14, M1-M13) against plain Python on the fixture rows."""
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rentscope.operators import stack_snapshots
from rentscope.plans import document as D
from tests.fixtures import E, LISTING_SCHEMA, P, listings_rows

NAMES = [c.split()[0] for c in LISTING_SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def rows():
    return [dict(zip(NAMES, r, strict=True)) for r in listings_rows()]


@pytest.fixture(scope="module")
def doc(spark):
    june = spark.createDataFrame(listings_rows(), LISTING_SCHEMA)
    july = june.where(F.col("id") > 3).withColumn("price", F.col("price") * 2)
    out = D.document(stack_snapshots({"2026-06": june, "2026-07": july}))
    assert out.columns == ["month", "metric", "key", "rank", "value", "text"]
    return out.collect()


def part(doc, metric, month="2026-06"):
    return {(r["key"], r["rank"]): r["value"] if r["value"] is not None else r["text"] for r in doc if r["metric"] == metric and r["month"] == month}


def priced(rows):
    return [r for r in rows if r["price"] is not None and r["price"] > 0]


def test_every_part_is_there(doc):
    want = {"size", "quality", "room_mix", "premium", "median_price", "host_type", "rating_band", "availability_band", "top_areas", "host_size",
            "bedrooms", "revenue", "top_reviewed", "latest_review", "value_picks"}
    for month in ("2026-06", "2026-07"):
        assert {r["metric"].split(".")[0] for r in doc if r["month"] == month} == want


def test_size_and_window(doc, rows):
    assert part(doc, "size.listings") == {("", None): float(len(rows))}
    assert part(doc, "size.earliest_scrape") == {("", None): "2026-06-16"} == part(doc, "size.latest_scrape")
    assert part(doc, "quality.missing_price") == {("", None): float(sum(r["price"] is None for r in rows))}
    assert part(doc, "quality.listings_never_reviewed") == {("", None): 0.0}
    assert part(doc, "size.listings", "2026-07") == {("", None): float(sum(r["id"] > 3 for r in rows))}


def test_bands_in_order_with_hyphens(doc, rows):
    def rating(r):
        x = r["review_scores_rating"]
        return "No rating yet" if x is None else "4.80 - 5.00" if x >= 4.8 else "4.50 - 4.79" if x >= 4.5 else "Below 4.50"
    n = Counter(map(rating, priced(rows)))
    assert part(doc, "rating_band.listings") == {(k, D.RATING_LABELS.index(k) + 1): float(v) for k, v in n.items()}

    def avail(x):
        return "0-30 days" if x <= 30 else "31-90 days" if x <= 90 else "91-180 days" if x <= 180 else "181-300 days" if x <= 300 else "301-365 days"
    n = Counter(avail(r["availability_365"]) for r in priced(rows) if r["availability_365"] is not None)
    assert part(doc, "availability_band.listings") == {(k, D.AVAIL_LABELS.index(k) + 1): float(v) for k, v in n.items()}
    assert set(part(doc, "availability_band.avg_occ_days").values()) == {100.0}
    assert set(part(doc, "availability_band.implied_occupancy_pct").values()) == {27.4}


def test_areas_and_medians(doc, rows):
    groups = defaultdict(list)
    for r in priced(rows):
        groups[r["neighbourhood_cleansed"]].append(r["price"])
    order = sorted(groups, key=lambda a: (-len(groups[a]), a is not None, a or ""))
    assert part(doc, "top_areas.listings") == {(a or "NULL", i + 1): float(len(groups[a])) for i, a in enumerate(order)}
    assert part(doc, "top_areas.median_price") == {(a or "NULL", i + 1): statistics.median(groups[a]) for i, a in enumerate(order)}
    double = {k: round(2 * v, 2) for k, v in part(doc, "top_areas.median_price").items() if k[0] == "D"}
    assert {k: v for k, v in part(doc, "top_areas.median_price", "2026-07").items() if k[0] == "D"} == double
    e, p = ([r["price"] for r in priced(rows) if r["room_type"] == k] for k in (E, P))
    assert part(doc, "premium.entire_home_median") == {("", None): statistics.median(e)}
    assert part(doc, "premium.entire_home_premium_ratio") == {("", None): round(statistics.median(e) / statistics.median(p), 2)}
    assert part(doc, "median_price") == {("", None): statistics.median([r["price"] for r in priced(rows)])}


def test_owners(doc, rows):
    n = Counter(r["host_id"] for r in priced(rows))
    label = lambda k: D.HOST_LABELS[0 if k == 1 else 1 if k <= 5 else 2]
    bands = Counter(label(k) for k in n.values())
    assert part(doc, "host_size.hosts") == {(b, D.HOST_LABELS.index(b) + 1): float(v) for b, v in bands.items()}
    prices = defaultdict(list)
    for r in priced(rows):
        prices[label(n[r["host_id"]])].append(r["price"])
    assert part(doc, "host_size.avg_listing_price") == {(b, D.HOST_LABELS.index(b) + 1): pytest.approx(round(statistics.mean(v), 2)) for b, v in prices.items()}


def test_row_lists(doc, rows):
    top = sorted(rows, key=lambda r: (-(r["number_of_reviews"] if r["number_of_reviews"] is not None else -1), r["id"]))[:20]
    assert [part(doc, "top_reviewed.name")["", k + 1] for k in range(len(top))] == [r["name"] for r in top]
    assert [part(doc, "top_reviewed.number_of_reviews")["", k + 1] for k in range(len(top))] == [r["number_of_reviews"] for r in top]
    assert part(doc, "top_reviewed.private_in_top20") == {("", None): float(sum(r["room_type"] == P for r in top))}
    entire = [r for r in priced(rows) if r["room_type"] == E]
    med = {a: statistics.median([r["price"] for r in entire if r["neighbourhood_cleansed"] == a]) for a in {r["neighbourhood_cleansed"] for r in entire}}
    picks = [r for r in entire if r["neighbourhood_cleansed"] is not None and (r["review_scores_rating"] or 0) >= 4.8 and r["number_of_reviews"] >= 20 and r["price"] < med[r["neighbourhood_cleansed"]]]
    picks.sort(key=lambda r: (-r["review_scores_rating"], -r["number_of_reviews"], r["id"]))
    assert [part(doc, "value_picks.name").get(("", k + 1)) for k in range(len(picks))] == [r["name"] for r in picks] and len(picks) == 2
    assert part(doc, "value_picks.picks") == {("", None): 2.0}


def test_a_month_without_prices_or_picks(spark):
    df = spark.createDataFrame(listings_rows()[:3], LISTING_SCHEMA).withColumn("price", F.lit(None).cast("double"))
    got = D.document(df.withColumn("month", F.lit("m"))).collect()
    assert part(got, "value_picks.picks", "m") == {("", None): 0.0} and part(got, "size.listings", "m") == {("", None): 3.0}
    assert not part(got, "top_areas.listings", "m") and part(got, "top_reviewed.name", "m")
    assert D.document(df.withColumn("month", F.lit("m")).where("false")).isEmpty()
