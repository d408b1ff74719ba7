"""Classifier, language model, rules, language ID: brute force and held-out accuracy."""
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentscope.llm import langid, lattice, lm_score, quality_pu, rules

from .common import clashing, empty, odd_docs, rows

SF1 = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(lattice.vocabulary_path())


def brute_marginal(pieces, word, p):
    """All segmentations, by plain recursion over piece strings."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=lattice.vocabulary_path())
    names = {}
    for i in range(sp.get_piece_size()):
        s = sp.id_to_piece(i)
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or "▁" in s[1:]):
            names[s.replace("▁", " ").encode()] = i
    text = b" " + word
    at = [1.0] + [0.0] * len(text)
    for z in range(1, len(text) + 1):
        at[z] = at[z - 1] * p[pieces.byte[text[z - 1]]] + sum(at[a] * p[names[text[a:z]]] for a in range(z) if text[a:z] in names)
    return math.log(at[-1])


def test_lattice(pieces):
    words = [b"the", b"x", "größe".encode(), "漢字".encode(), b"a" * 41, b"internationalisation", b"|", b"\xff", b"the"]
    logp = np.log(np.maximum(pieces.start, 1e-300))
    got = lattice.log_marginals(pieces, words, np.stack([logp, logp], 1))
    want = [brute_marginal(pieces, w, pieces.start) for w in words]
    assert np.allclose(got[:, 0], want) and np.allclose(got[:, 1], want)
    # a small change of one piece's weight moves the log marginal by its expected count
    e = lattice.expected_counts(pieces, [b"there"], np.ones((1, 1)), logp[:, None])[:, 0]
    i = int(e.argmax())
    up = logp.copy()
    up[i] += 1e-6
    base, moved = (lattice.log_marginals(pieces, [b"there"], x[:, None])[0, 0] for x in (logp, up))
    assert abs((moved - base) / 1e-6 - e[i]) < 1e-3


@pytest.mark.parametrize("block", [1, lattice.BLOCK_WEIGHTS])
def test_long_words_block_by_block(pieces, monkeypatch, block):
    """Words walked alone against all arcs of the whole word at once, with blocks of the least size too."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 105, n, dtype=np.uint8)) for n in (40, 41, 64, 333)] + ["größe漢字".encode() * 9, b"international" * 20, b"a" * 90]
    logp = np.log(np.c_[pieces.start, rng.dirichlet(np.ones(pieces.size))] + 1e-12)
    weights = rng.random((len(words), 2))
    monkeypatch.setattr(lattice, "BLOCK_WEIGHTS", block)
    scores, counts = lattice.log_marginals(pieces, words, logp), lattice.expected_counts(pieces, words, weights, logp[:, :1])
    monkeypatch.setattr(lattice, "BATCH_LENGTH", 1 << 30)
    assert np.allclose(scores, lattice.log_marginals(pieces, words, logp), rtol=1e-12)
    assert np.allclose(counts, lattice.expected_counts(pieces, words, weights, logp[:, :1]), atol=1e-9)


def test_very_long_word(pieces):
    """A word of 100 KB: a few bytes of memory a byte of it, not one arc list a byte."""
    word = bytes(np.random.default_rng(6).integers(97, 123, 100_000, dtype=np.uint8))
    logp = np.log(np.maximum(pieces.start, 1e-300))[:, None]
    tracemalloc.start()
    counts = lattice.expected_counts(pieces, [word], np.ones((1, 1)), logp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 100_000 / pieces.reach < counts.sum() <= 100_001 and peak < 100e6


def test_op5(spark, pieces):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(odd_docs(spark))
    data = docs.select("doc_id", "text").collect()
    tokens = [(r["doc_id"], r["doc_id"] is None or crc(r["doc_id"]) % 7 == 2, (r["text"] or "").encode().lower().split() + [b""]) for r in data]
    count = Counter(t for _, out, ts in tokens if not out for t in ts)
    total, distinct = sum(count.values()), len(count)
    got = {}
    for r in lm_score.score(docs, chunk_bytes=100_000).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, out, ts in tokens:
        base = sum(math.log10((count[t] + 1) / (total + distinct + 1)) for t in ts)
        known = sum(1 for t in ts if count[t])
        assert any(r["held_out"] == out and r["n_tokens"] == len(ts) and r["n_known"] == known and r["train_tokens"] == total
                   and math.isclose(r["base_score"], base, rel_tol=1e-9) for r in got[i]), i
    assert sum(map(len, got.values())) == len(data)
    # the score is the marginal probability under the trained pieces
    lists = lm_score.word_lists(docs).filter("kind = 0").groupBy("word").agg(F.sum("n").alias("c"))
    logp = lm_score.train(lists, lattice.vocabulary_path())
    assert math.isclose(np.exp(logp).sum(), 1.0, abs_tol=1e-6)
    word = {w for _, _, ts in tokens for w in ts if w}
    by = dict(zip(word, lattice.log_marginals(pieces, list(word), logp[:-1, None])[:, 0], strict=True)) | {b"": logp[-1]}
    for i, _, ts in tokens:
        assert any(math.isclose(r["score"], sum(by[t] for t in ts) / math.log(10), rel_tol=1e-9) for r in got[i]), i
    assert lm_score.score(empty(docs)).isEmpty()
    assert lm_score.score(clashing(docs)).count() == len(data)


def test_op5_training_helps(spark):
    """Trained pieces give held-out texts more probability than the start weights."""
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    trained = lm_score.score(docs).filter("held_out").agg(F.sum("score")).first()[0]
    start = lm_score.score(docs.withColumn("doc_id", F.lit(None).cast("long"))).agg(F.sum("score")).first()[0]
    share = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).agg(F.sum(F.length("text"))).first()[0] / docs.agg(F.sum(F.length("text"))).first()[0]
    assert trained > start * share


def brute_statistics(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_op6_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(odd_docs(spark, [
        (50, "a\n\n b\na\nb \n a\n", "en", "s", 1), (51, "x y   z \x0b\x1c q", "en", "s", 1), (52, "a b c a b c a b", "en", "s", 1), (53, "a a a a", "en", "s", 1)]))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = rules.op6_quality_rules(docs, labels)
    want = []
    for r in docs.select("doc_id", "text").collect():
        s = brute_statistics(r["text"])
        want.append((r["doc_id"], *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert got.filter("base_failed AND kept").isEmpty()
    assert rules.op6_quality_rules(empty(docs), labels).isEmpty()
    assert rules.op6_quality_rules(docs, empty(labels)).filter("kept = base_failed").isEmpty()
    c = clashing(docs)
    kept = rules.keep_good(c, labels)
    assert kept.columns == c.columns and kept.count() == got.filter("kept").count()


def test_exact_bound():
    """At the bound the chance of k events or fewer is exactly 1 - confidence."""
    for k, n in ((0, 10), (0, 3000), (3, 50), (20, 5000), (49, 50)):
        p = rules.upper_bound(k, n, 0.99)
        cdf = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert abs(cdf - 0.01) < 1e-6 and p > k / n
    assert rules.upper_bound(0, 0, 0.99) == 1.0 and rules.upper_bound(5, 5, 0.99) == 1.0


def test_op6_bound_on_many_labels():
    """The exact tail, summed over every term, is 1 - confidence at the bound; a hundred million labels take no longer than the root of it."""
    n, k = 20_000, 380
    p = rules.upper_bound(k, n, 0.98)
    tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert abs(tail - 0.02) < 1e-6
    n, k = 10**8, 2 * 10**6
    p = rules.upper_bound(k, n, 0.98)
    assert abs((p - k / n) / math.sqrt(k / n * (1 - k / n) / n) - 2.0537) < 0.01        # the normal quantile
    assert rules.upper_bound(0, n, 0.98) == pytest.approx(-math.log(0.02) / n, rel=1e-6)


def test_op6_risk(spark):
    """Good documents below a cutoff stay; junk that no good document resembles goes; few labels certify nothing."""
    good = [(i, " ".join(f"w{(i * 7 + j) % 5003}" for j in range(100)), 1) for i in range(3000)]
    junk = [(10_000 + i, " ".join(f"z{(i * 11 + j) % 5003}***" for j in range(100)), 0) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in good + junk], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in good + junk] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = rules.op6_quality_rules(docs, labels)
    assert got.filter("kept").count() == 3000 and got.filter("kept AND doc_id >= 10000").isEmpty()
    few = rules.op6_quality_rules(docs, labels.filter("doc_id % 50 = 0"))
    assert few.filter("kept").count() == 3200
    counts = {(0, "symbols"): (3000, [0] * 10 + [100] * 8)}
    assert rules.choose(counts) == {(0, "symbols"): rules.GRID[9]}


def test_op6_certifies_on_the_large_table(spark):
    """All bands of sf0.1 certify a cutoff that catches bad documents and keeps its promise on the good ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    cutoffs = rules.calibrate(rules.with_statistics(docs, ["doc_id"]), labels)
    assert cutoffs == {0: 0.2, 1: 0.1, 2: 0.1}
    got = rules.op6_quality_rules(docs, labels).filter("NOT base_failed").join(labels, "doc_id").withColumn("s", rules.stratum())
    by = {(r["s"], r["quality"]): r for r in got.groupBy("s", "quality").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone")).collect()}
    for s in range(3):
        assert rules.upper_bound(by[s, 1]["gone"], by[s, 1]["n"], 1 - rules.DELTA / 3) <= rules.ALPHA
        assert by[s, 0]["gone"] == by[s, 0]["n"]
    # without a false rejection 203 good documents certify the strictest cutoff, 202 none
    assert rules.choose({0: (203, [0] * len(rules.GRID)), 1: (202, [0] * len(rules.GRID))}) == {0: rules.GRID[-1]}


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = int((y == 1).sum())
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_op4_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_pu.op4_quality_classifier(docs, labels)
    assert got.count() == docs.count()
    held = got.filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    assert auc(held.quality.values, held.score.values) > 0.99
    assert (held.predicted == held.quality).mean() > 0.93
    assert got.filter("score < 0 OR score > 1 OR predicted <> cast(score >= 0.5 AS int)").isEmpty()
    # labels of the held-out fold are never read
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_pu.op4_quality_classifier(docs, flipped)
    assert got.join(again.select("doc_id", F.col("score").alias("s")), "doc_id").filter("abs(score - s) > 1e-9").isEmpty()


def test_op4_odd(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (7, 1), (7, 0)], "doc_id long, quality int")
    for d, lab in ((docs, labels), (docs, empty(labels)), (clashing(docs), labels)):
        got = quality_pu.op4_quality_classifier(d, lab)
        assert got.count() == docs.count() and got.filter("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert quality_pu.op4_quality_classifier(empty(docs), labels).isEmpty()


def test_op7_held_out(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    got = langid.op7_language_id(docs)
    held = got.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.filter("lang = lang_pred").count() / held.count() > 0.97
    assert got.filter("score < 0 OR score > 1").isEmpty()


def test_op7_blocks_and_odd(spark):
    path = lattice.vocabulary_path()
    docs = odd_docs(spark, [(60, "der und die das nicht", "de", "s", 1), (61, "1234 -- 5", "en", "s", 1), (62, "the and of that", "en", "s", 1)])
    models = langid.fit(spark.read.parquet(f"{SF1}/documents.parquet"), path)
    assert sorted(models) == ["de", "en", "es", "fr"]
    one = rows(langid.predict(docs, models, path, ["doc_id"]).withColumn("score", F.round("score", 9)), "doc_id", "lang_pred", "score")
    assert one == rows(langid.predict(docs, models, path, ["doc_id"], block=1).withColumn("score", F.round("score", 9)), "doc_id", "lang_pred", "score")
    by = {r[0]: r for r in one}
    assert by[60][1] == "de" and by[62][1] == "en"
    assert all(by[i][1:] == ("und", 0.0) for i in (1, 2, 3, 61))
    assert langid.op7_language_id(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und' OR score <> 0").isEmpty()
    assert langid.op7_language_id(empty(docs)).isEmpty()
    assert langid.op7_language_id(clashing(docs)).count() == docs.count()


def test_op7_rare_language(spark):
    """A language with a handful of texts in a large table is learned and predicted."""
    common = spark.range(400_000).select(F.col("id").alias("doc_id"), F.lit("the and of that").alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(1_000_000 + i, " ".join(f"{'zuv nol mesh krip'.split()[(i + j) % 4]}{'ta ra ish'.split()[j % 3]}" for j in range(40)), "qx") for i in range(10)],
                                 common.schema)
    got = langid.op7_language_id(common.unionByName(rare))
    by = {tuple(r)[:3]: r["count"] for r in got.groupBy(F.col("doc_id") >= 1_000_000, "held_out", "lang_pred").count().collect()}
    out = sum(crc(1_000_000 + i) % 5 == 0 for i in range(10))
    assert 0 < out < 10 and {k: n for k, n in by.items() if k[0]} == {(True, False, "qx"): 10 - out, (True, True, "qx"): out}
    assert all(k[2] == "en" for k in by if not k[0]) and sum(by.values()) == 400_010
