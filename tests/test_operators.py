from pyspark.sql import functions as F

from rentscope.functions import band, round_half_up, word_count_spaces
from rentscope.operators import (extremes, mix, pivot_wide, share_of_total, side_by_side, snapshot_diff, stack_snapshots, top_k,
                                 top_n_share, unpivot_long)


def test_band_null_falls_to_else(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    got = [r["b"] for r in df.select(band("v", [1, 3], ["one", "few"], "many").alias("b")).collect()]
    assert got == ["one", "many", "many"]


def test_round_half_up(spark):
    r = spark.range(1).select(round_half_up(F.lit(1.005), 2).alias("a"), round_half_up(F.lit(2.675), 2).alias("b"),
                              round_half_up(F.lit(-2.5), 0).alias("c"), round_half_up(F.lit(15089.5), 0).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (1.01, 2.68, -3.0, 15090.0)


def test_shares_sum_to_100_and_pandas_null_rule(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    s = {r["k"]: r["pct"] for r in mix(df, "k").collect()}
    assert sum(s.values()) == 100.0
    s2 = {r["k"]: r["pct"] for r in mix(df, "k", drop_null_key=True).collect()}
    assert s2 == {"a": 50.0, "b": 25.0}
    assert top_n_share(df, "k", 1).first()["top_share_pct"] == 50.0


def test_within_share(spark):
    df = spark.createDataFrame([("m1", 2), ("m1", 2), ("m2", 1)], "m string, n long")
    assert {r["pct"] for r in share_of_total(df, "n", "pct", within=["m"]).collect()} == {50.0, 100.0}


def test_snapshot_diff_net(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    b = spark.createDataFrame([(2,), (3,), (4,), (5,)], "id long")
    st = stack_snapshots({"2026-06": a, "2026-07": b})
    r = snapshot_diff(st, "id", "2026-06", "2026-07").first()
    assert (r["added"], r["removed"], r["kept"]) == (2, 1, 2)
    assert r["added"] - r["removed"] == b.count() - a.count()


def test_extremes_ties(spark):
    df = spark.createDataFrame([("2026-01", 5), ("2026-02", 9), ("2026-03", 9), ("2026-04", 5)], "m string, n long")
    r = extremes(df, "m", "n").first()
    assert (r["peak"], r["low"]) == ("2026-02", "2026-01")


def test_pivot_default_and_unpivot(spark):
    df = spark.createDataFrame([("x", 1.0)], "b string, v double")
    w = pivot_wide(df, [], "b", "v", {"x": "cx", "y": "cy"}, default=0.0).first()
    assert (w["cx"], w["cy"]) == (1.0, 0.0)
    long = unpivot_long(spark.createDataFrame([(1, 2.0)], "a int, b double"), [], ["a", "b"])
    assert {r["metric"]: r["value"] for r in long.collect()} == {"a": 1.0, "b": 2.0}


def test_top_k_tiebreak(spark):
    df = spark.createDataFrame([(3, 1), (1, 5), (2, 5)], "id int, n int")
    assert [r["id"] for r in top_k(df, [F.col("n").desc()], 2, ["id"]).collect()] == [1, 2]


def test_word_count_spaces(spark):
    df = spark.createDataFrame([("a  b",), ("one",)], "t string")
    assert [r["w"] for r in df.select(word_count_spaces("t").alias("w")).collect()] == [3, 1]


def test_within_share_keeps_null_partition(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("m", 2)], "m string, n long")
    got = sorted((r["m"] or "", r["pct"]) for r in share_of_total(df, "n", "pct", within=["m"]).collect())
    assert got == [("", 25.0), ("", 75.0), ("m", 100.0)]


def test_extremes_ignore_null(spark):
    df = spark.createDataFrame([("a", None), ("b", 3), ("c", 1)], "m string, n long")
    r = extremes(df, "m", "n").first()
    assert (r["peak"], r["low"]) == ("b", "c")


def test_null_ordering(spark):
    """Trap 9: NULLs last on DESC, first on ASC (as the source's engine), stated explicitly."""
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7), (4, None)], "id int, n int")
    assert [r["id"] for r in top_k(df, [F.col("n").desc()], 4, ["id"]).collect()] == [3, 2, 1, 4]
    assert [r["id"] for r in top_k(df, ["n"], 4, ["id"]).collect()] == [1, 4, 2, 3]


def test_line_bigrams_equal_token_bigrams(spark):
    from rentscope.functions.text import bigrams, line_bigrams, tokens, word_line
    texts = ["<p>Great stay, really GREAT!</p>", "a  b c", "", "   ", "Très bien: l'été à Paris", "x", "one two",
             "it's a de-luxe room\nnear the sea", "<b>", "ab cd efg hijk lmnop"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 4):
        toks = F.filter(tokens("t", min_len=n), lambda x: F.length(x) > 0)
        got = df.select(line_bigrams(word_line("t", n)).alias("a"), bigrams(toks).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got), [(r["a"], r["b"]) for r in got if r["a"] != r["b"]]


def test_side_by_side_takes_its_columns_from_the_data(spark):
    df = spark.createDataFrame([("a", "2002", "x"), ("a", "1991", "y"), ("b", "2031", "z"), ("b", "2030", None), ("c", None, "w")],
                               "k string, yr string, v string")
    got = side_by_side(df, ["k"], "yr", F.col("v"), "line", "n").orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 2, "1991=y 2002=x"), ("b", 1, "2031=z")]
    assert side_by_side(df.limit(0), ["k"], "yr", F.col("v"), "line", "n").isEmpty()
