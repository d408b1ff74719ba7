import pytest
from pyspark.sql import functions as F

from rentscope.functions import flag, iso_date, leading_number, money, to_double, to_int
from rentscope.sources import HeaderMismatch, LISTING_RAW_COLUMNS, assert_header, clean_listings, read_listings_raw


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,expected", [("3", 3), ("3.0", 3), ("3.7", 3), (" 12abc", 12), ("abc", 0),
                                           ("", None), (None, None), ("-4", -4)])
def test_lenient_int(spark, text, expected):
    assert _one(spark, to_int, text) == expected


@pytest.mark.parametrize("text,expected", [("2.5", 2.5), ("Shared", 0.0), ("1e2x", 100.0), ("", None), (".5", 0.5)])
def test_lenient_double(spark, text, expected):
    assert _one(spark, to_double, text) == expected


@pytest.mark.parametrize("text,expected", [("1 bath", 1.0), ("2.5 shared baths", 2.5), ("Half-bath", 0.0),
                                           ("Shared half-bath", 0.0), ("", None), (None, None)])
def test_leading_number(spark, text, expected):
    assert _one(spark, leading_number, text) == expected


@pytest.mark.parametrize("text,expected", [("$1,449.89", 1449.89), ("$85.00", 85.0), ("", None)])
def test_money(spark, text, expected):
    assert _one(spark, money, text) == expected


@pytest.mark.parametrize("text,expected", [("t", 1), ("f", 0), ("", None), ("x", None), (None, None)])
def test_flag(spark, text, expected):
    assert _one(spark, flag, text) == expected


def test_iso_date(spark):
    import datetime as dt
    assert _one(spark, iso_date, "2026-06-16") == dt.date(2026, 6, 16)
    assert _one(spark, iso_date, "") is None
    assert _one(spark, iso_date, "not a date") is None


def _write_csv(path, header, rows):
    import csv
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        for r in rows:
            w.writerow(r)


def _raw_row(**kv):
    row = {c: "" for c in LISTING_RAW_COLUMNS}
    row.update(kv)
    return [row[c] for c in LISTING_RAW_COLUMNS]


def test_staging_keeps_quotes_commas_newlines(spark, tmpdir_path):
    p = f"{tmpdir_path}/listings.csv"
    _write_csv(p, LISTING_RAW_COLUMNS, [
        _raw_row(id="1", name='Cosy, "quiet"\nflat', price="$1,449.89", bathrooms_text="2.5 baths",
                 host_is_superhost="t", last_scraped="2026-06-16", accommodates="3.0"),
        _raw_row(id="2", name="Plain", price="", bathrooms_text="Half-bath", host_is_superhost="")])
    raw = read_listings_raw(spark, p)
    assert raw.count() == 2
    clean = {r["id"]: r for r in clean_listings(raw).collect()}
    assert clean[1]["name"] == 'Cosy, "quiet"\nflat'
    assert clean[1]["price"] == 1449.89 and clean[1]["bathrooms"] == 2.5 and clean[1]["host_is_superhost"] == 1
    assert clean[1]["accommodates"] == 3
    assert clean[2]["price"] is None and clean[2]["bathrooms"] == 0.0 and clean[2]["host_is_superhost"] is None


@pytest.mark.parametrize("mutate", ["rename", "reorder", "drop"])
def test_header_contract(spark, tmpdir_path, mutate):
    cols = list(LISTING_RAW_COLUMNS)
    if mutate == "rename":
        cols[5] = "title"
    elif mutate == "reorder":
        cols[1], cols[2] = cols[2], cols[1]
    else:
        cols = cols[:-1]
    with pytest.raises(HeaderMismatch):
        assert_header(cols)
    p = f"{tmpdir_path}/bad.csv"
    _write_csv(p, cols, [["1"] * len(cols)])
    with pytest.raises(HeaderMismatch):
        read_listings_raw(spark, p)


def test_gzip_staging_read(spark, tmpdir_path):
    import gzip
    import shutil
    p = f"{tmpdir_path}/listings.csv"
    _write_csv(p, LISTING_RAW_COLUMNS, [_raw_row(id="7", name="a\nb", price="$5.00")])
    with open(p, "rb") as src, gzip.open(p + ".gz", "wb") as dst:
        shutil.copyfileobj(src, dst)
    row = clean_listings(read_listings_raw(spark, p + ".gz")).first()
    assert (row["id"], row["name"], row["price"]) == (7, "a\nb", 5.0)
