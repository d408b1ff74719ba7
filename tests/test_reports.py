"""Reports with arguments or several shares: picks, cohorts, key profile, monthly means."""
import datetime as dt

from pyspark.sql import functions as F

from rentscope.plans import listings as L, market as M, registry as RG
from tests.fixtures import LISTING_SCHEMA, listing, listings_rows

ENTIRE = "Entire home/apt"


def test_value_picks_by_area_and_ceiling(spark):
    extra = [listing(100 + i, "B", ENTIRE, p, rating=4.9, reviews=12) for i, p in enumerate([10.0, 20.0, 30.0])]
    df = spark.createDataFrame(listings_rows() + extra, LISTING_SCHEMA)
    names = lambda **kw: [r["name"] for r in L.a11_value_picks(df, min_reviews=10, k=25, **kw).collect()]
    assert names(area="B") == ["L100", "L101"]                   # the area's median is 25: 10 and 20 lie below
    assert names(area="B", max_price=15.0) == ["L100"]           # the ceiling does not move the median
    assert names(area="nowhere") == [] and set(names(area="B")) < set(names())


def test_cohort_report(spark):
    def rows(year, month, n):
        return [(f"STR-{year % 100:02d}{month:02d}-{k}",) for k in range(n)]
    data = rows(2024, 11, 3) + rows(2024, 12, 4) + rows(2025, 2, 5) + rows(2025, 3, 2) + rows(2026, 1, 6) + [("no number",), (None,), ("STR-2613-1",), ("STR-2600-1",)]
    reg = spark.createDataFrame(data, "registration_number string")
    got = {(r["part"], r["cohort"]): (r["registrations"], r["pct"]) for r in RG.e3_report(reg).collect()}
    n = len(data)
    pct = lambda k: round(100 * k / n, 1)
    assert got == {("year", "2024"): (7, pct(7)), ("year", "2025"): (7, pct(7)), ("year", "2026"): (6, pct(6)),
                   ("best_run", "2024-11 to 2025-02"): (12, pct(12)), ("earliest", "2024-11"): (3, pct(3))}
    assert RG.e3_report(reg.where("false")).isEmpty()


def test_distinct_profile_does_not_expand(spark):
    rows = [(1, "a"), (1, None), (2, "a"), (None, "b"), (None, None)]
    df = spark.createDataFrame(rows, "k long, s string")
    out = M.distinct_profile(df, {"ks": "k", "ss": "s"}, "rows", {"named": F.col("s").isNotNull()})
    assert out.first().asDict() == {"rows": 5, "named": 3, "ks": 2, "ss": 2}
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert M.distinct_profile(df.where("false"), {"ks": "k", "ss": "s"}, "rows").first().asDict() == {"rows": 0, "ks": 0, "ss": 0}


def test_month_means_of_complete_months(spark):
    days = [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6), dt.datetime(2025, 1, 7), dt.datetime(2025, 2, 1), dt.datetime(2025, 3, 1), dt.datetime(2025, 3, 9), None]
    df = spark.createDataFrame([(d,) for d in days], "d timestamp")
    got = {r["month_num"]: r["n"] for r in M.month_of_year_mean(df, "d", alias="n", digits=1).collect()}
    assert got == {"01": 1.5, "02": 1.0}                         # March is the latest month, so not complete
    same = {r["month_num"]: r["n"] for r in M.month_of_year_mean(df, "d", "2024-01-01", "2025-03-01", alias="n", digits=1).collect()}
    assert same == got
