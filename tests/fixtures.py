"""Hand-written fixture rows (values are ours; see FIXTURES.md section 8)."""
from __future__ import annotations

import datetime as dt

LISTING_SCHEMA = (
    "id long, name string, host_id long, host_is_superhost int, neighbourhood_cleansed string, "
    "property_type string, room_type string, accommodates int, bathrooms double, bedrooms double, price double, "
    "minimum_nights int, availability_30 int, availability_60 int, availability_90 int, availability_365 int, "
    "number_of_reviews int, reviews_per_month double, review_scores_rating double, "
    "calculated_host_listings_count int, estimated_occupancy_l365d int, estimated_revenue_l365d double, "
    "last_review date, first_review date, last_scraped date, latitude double, longitude double")

E, P, H = "Entire home/apt", "Private room", "Hotel room"
D = dt.date


def listing(i, nb, rt, price, *, host=None, sh=None, bedrooms=1.0, rating=4.7, reviews=10, avail=100,
            occ=100, rev=10000.0, mn=2, chlc=1, rpm=1.0, last=D(2026, 5, 1), first=D(2024, 1, 1)):
    return (i, f"L{i}", host if host is not None else 1000 + i, sh, nb, "Rental unit", rt, 2, 1.0, bedrooms, price,
            mn, 10, 20, 30, avail, reviews, rpm, rating, chlc, occ, rev, last, first, D(2026, 6, 16), 43.6, -79.4)


def listings_rows():
    rows = []
    # area A: even count (4) priced entire homes; area B: odd (3); area C: single; NULL area (2)
    for i, p in enumerate([100.0, 200.0, 300.0, 400.0]):
        rows.append(listing(1 + i, "A", E, p, sh=1 if i % 2 else 0, bedrooms=float(i), rating=[4.9, 4.8, 4.49, None][i],
                            reviews=[25, 30, 5, 0][i], avail=[30, 31, 90, 91][i]))
    for i, p in enumerate([50.0, 60.0, 1000.0]):
        rows.append(listing(10 + i, "B", P if i < 2 else E, p, bedrooms=[1.0, 1.5, 5.0][i], avail=[180, 181, 300][i],
                            host=77, sh=None, rating=[4.5, 4.79, 5.0][i]))
    rows.append(listing(20, "C", E, 80.0, bedrooms=6.0, avail=301, host=77))
    rows.append(listing(21, None, E, 90.0, avail=None, host=78))
    rows.append(listing(22, None, H, 95.0, host=78))
    # not priced: NULL, 0, negative
    rows.append(listing(30, "A", E, None, host=79))
    rows.append(listing(31, "A", E, 0.0, host=79))
    rows.append(listing(32, "B", E, -5.0, host=79))
    # host 77 has 3 listings; host 78 has 2; host 90 has 6 priced listings
    for j in range(6):
        rows.append(listing(40 + j, "D", P, 70.0 + j, host=90, bedrooms=None))
    return rows


def calendar_rows():
    """listing 1 fully free (3 days); 2 blocked on day 0; 3 blocked on day 8 with more rows;
    10 has NULL available on one day and NULL minimum nights; 999 is not in listings."""
    rows = []
    start = D(2026, 8, 15)
    for i in range(3):
        rows.append((1, start + dt.timedelta(days=i), 1, 1))
        rows.append((2, start + dt.timedelta(days=i), 0 if i == 0 else 1, 3))
    for i in range(10):
        rows.append((3, start + dt.timedelta(days=i), 0 if i == 8 else 1, 8))
    rows.append((10, start, None, None))
    rows.append((10, start + dt.timedelta(days=1), 0, None))
    rows.append((999, start, 0, 31))
    return rows


def reviews_rows():
    asof = D(2026, 8, 15)
    rows = []
    rid = 1
    for n, lid in ((5, 1), (6, 2), (21, 3)):
        for k in range(n):
            rows.append((rid, lid, asof - dt.timedelta(days=k * 30), "great  stay"))
            rid += 1
    rows.append((rid, 1, asof - dt.timedelta(days=90), None)); rid += 1
    rows.append((rid, 1, asof - dt.timedelta(days=91), "  ")); rid += 1
    rows.append((rid, 2, asof - dt.timedelta(days=365), "\n")); rid += 1
    rows.append((rid, 2, asof - dt.timedelta(days=366), "<b>Très</b> bien, clean place")); rid += 1
    return rows
