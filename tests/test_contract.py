"""Driver contract: entry(), queries(), oracle_sql() on the smallest driver tables."""
import duckdb
import pytest

import __spark_entry__ as E
from rentscope.plans import bindings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["p_brand", "lines", "pct_of_supply", "avg_price", "median_price"]
    assert 0 < len(rows) <= 15


def test_keys_cover_oracles():
    assert set(E.oracle_sql()) <= set(E.queries())
    q, o = bindings.queries(), bindings.oracle_sql()
    assert set(o) <= set(q)
    assert set(q) == set(o)


@pytest.mark.parametrize("key", ["top_groups_supply", "median_by_group", "portfolio_concentration", "kpi_by_month",
                                 "word_top", "compare_groups", "metric_deltas", "rolling_cohort_max",
                                 "snapshot_diff", "group_movers", "stack_and_prune", "csv_roundtrip", "pending_months",
                                 "latest_snapshot_pick", "previous_month", "month_of_year_mean", "median_multi",
                                 "calendar_load", "calendar_min_nights", "reviews_load", "metrics_document"])
def test_oracle_match(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[key](spark, SF)
    cur = con.execute(E.oracle_sql()[key])
    ocols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    norm = lambda cols, rows: sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in rows), key=repr)
    assert norm(df.columns, [tuple(r) for r in df.collect()]) == norm(ocols, cur.fetchall())
