"""Tables with the odd cases: nulls, empty and very long texts, ties, repeated rows, clashing names."""
import duckdb
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for their own columns.
CLASH = ["n_words", "hit_spans", "row", "sid", "bands", "kind", "task", "x", "found", "text_sha256", "length", "piece", "c0", "_words", "live"]


def odd_docs(spark, extra=()):
    long_text = " ".join(f"w{i % 977} v{i % 31}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "One", "en", None, 3),
            (5, long_text, "de", "b", len(long_text)), (6, "same text here again " * 30, "en", "a", 1), (6, "same text here again " * 30, "en", "a", 1),
            (7, "same text here again " * 30, "en", "b", 1), (None, "no id but some words", "fr", "c", 5), (8, "é ü ß 漢字 \U0001f600 tail", None, "c", 1), *extra]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def empty(df):
    return df.filter("false")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same_as_sql(spark, df, sql, **tables):
    """Equal rows from DuckDB, with the given tables (DataFrames) in place of the files."""
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        if t in tables:
            con.register(t, tables[t].toArrow())
        else:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    assert rows(df, *names) == want
