"""Plans that read once or stay in generated code: medians, KPI rows, words, pruned months."""
import statistics

import pytest
from pyspark.sql import functions as F

from rentscope.functions.text import count_listed, count_words, tokens, word_line
from rentscope.operators import grouped_median, lexicon_rate
from rentscope.operators.medians import _with_quantile_bucket, median_and_counts


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cuts", [1, 2, 3, 7, 10, 255])
def test_quantile_bucket_is_monotone_and_keeps_cuts_apart(spark, cuts):
    q = sorted([float(i * i % 97) for i in range(cuts)])        # cuts may repeat
    values = sorted({*q, *[x + .5 for x in q], -1.0, 1e9})
    df = spark.createDataFrame([(v, q) for v in values], "v double, __q array<double>")
    got = {r["v"]: r["__b"] for r in _with_quantile_bucket(df, F.col("v"), cuts).collect()}
    for v in values:
        assert got[v] == 2 * sum(x < v for x in q) + (v in q)
    assert "lambda" not in _plan(_with_quantile_bucket(df, F.col("v"), cuts)).lower()


@pytest.mark.parametrize("stage", [False, True])
def test_staged_or_not_is_the_same(spark, stage):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 1009).cast("double")).alias("v"))
    got = {r["k"]: (r["m"], r["n"]) for r in grouped_median(df, ["k"], "v", "m", stats={"n": "n"}, stage=stage, cuts=5, final_max_rows=20).collect()}
    for k in range(7):
        vals = [float(i * 37 % 1009) for i in range(k, 5000, 7) if i % 11]
        assert got[k] == (statistics.median(vals), len(vals))


def test_counts_come_with_the_median(spark):
    rows = [("a", 1.0, True), ("a", 3.0, None), ("a", None, True), ("b", None, False), (None, 5.0, True), ("a", float("nan"), True)]
    df = spark.createDataFrame(rows, "k string, v double, f boolean")
    med, per = median_and_counts(df, ["k"], "v", {"rows": F.lit(True), "flagged": F.col("f"), "valued": F.col("v") > 0}, "m")
    assert {r["k"]: r["m"] for r in med.collect()} == {"a": 2.0, None: 5.0}
    got = {r["k"]: (r["rows"], r["flagged"]) for r in per.collect()}
    assert got == {"a": (4, 3), "b": (1, 0), None: (1, 1)}
    med, per = median_and_counts(df, [], "v", {"rows": F.lit(True)}, "m")
    assert med.first()["m"] == 3.0 and per.first()["rows"] == 6


TEXTS = ["Good  clean<br/>PLACE, goodness!", "a bb ccc dddd", "", "   ", "dirty-dirty 9good9 cl3an", "été good", "x" * 50 + " good"]


@pytest.mark.parametrize("min_len", [1, 3, 4])
def test_words_by_matches_are_the_words_by_splitting(spark, min_len):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    old = F.filter(F.split(F.lower(F.regexp_replace("t", r"<[^>]+>", " ")), r"[^a-z]+"), lambda w: F.length(w) >= min_len)
    got = df.select(tokens("t", min_len=min_len).alias("a"), old.alias("b"), count_words("t", min_len).alias("n"),
                    count_listed(word_line("t", min_len), ["good", "clean", "c.*", ""]).alias("l"))
    for r in got.collect():
        assert r["a"] == r["b"] and r["n"] == len(r["a"]) and r["l"] == sum(w in ("good", "clean") for w in r["a"])
    assert "lambda" not in _plan(df.select(tokens("t", min_len=min_len))).lower()


def test_lexicon_without_lambda_equals_the_array_form(spark):
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(TEXTS)] + [(0, None)], "g int, t string")
    args = dict(positive=["good", "clean"], negative=["dirty"])
    new, old = lexicon_rate(df, "t", ["g"], **args), lexicon_rate(df, "t", ["g"], separator="[^a-z]+ *", **args)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))
    assert "lambda" not in _plan(new).lower() and "lambda" in _plan(old).lower()
    none = lexicon_rate(df, "t", ["g"], positive=[], negative=[]).collect()
    assert all(r["positive"] == r["negative"] == 0 for r in none)


def test_stacked_months_prune(spark):
    from rentscope.plans import bindings
    df = bindings.queries()["stacked_months"](spark, "/root/testdata/sf0.001")
    assert df.count() == 2 and "dynamicpruning" in df._jdf.queryExecution().toString().lower()
