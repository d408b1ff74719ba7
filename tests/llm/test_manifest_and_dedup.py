"""Whitening, suffix removal and the Merkle manifest against brute force and SQL."""
import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentscope.llm import entry, merkle, suffixes, whitening

from .common import SF, clashing, empty, odd_docs, rows, same_as_sql

VECS = "vec_id long, embedding array<float>, label int"


# ------------------------------------------------------------------ op11
def characteristic(a):
    """Faddeev-LeVerrier, lowest coefficient first."""
    d = len(a)
    m, c = np.zeros((d, d), object), [1]
    for k in range(1, d + 1):
        m = a.dot(m) + c[-1] * np.eye(d, dtype=int).astype(object)
        c.append(-int(np.trace(a.dot(m))) // k)
    return c[::-1]


@pytest.mark.parametrize("d", [1, 2, 7, 12])
def test_charpoly_exact(spark, d):
    rnd = random.Random(d)
    b = np.array([[rnd.randrange(-10**9, 10**9) for _ in range(d)] for _ in range(d + 2)], object)
    a = b.T.dot(b)
    assert whitening.charpoly(spark, a) == characteristic(a)


def test_charpoly_with_zero_pivots(spark):
    a = np.diag([5, 5, 0, 3, 3, 3]).astype(object)
    a[0, 5] = a[5, 0] = 1
    assert whitening.charpoly(spark, a) == characteristic(a)


def test_repeated_and_close_eigenvalues(spark):
    """Roots 36 (twice), 16, 0; and a pair that doubles can not tell apart."""
    q = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]], object)
    a = q.dot(np.diag([9, 9, 4, 0]).astype(object)).dot(q.T)
    values, vectors = whitening.eigen(spark, a, 4)
    assert [round(float(v), 12) for v in values] == [36, 36, 16, 0]
    assert np.allclose(vectors[:3] @ vectors[:3].T, np.eye(3), atol=1e-15) and not vectors[3].any()
    assert np.allclose(vectors @ a.astype(float), np.array([float(v) for v in values])[:, None] * vectors)
    big = 10**30
    close = np.array([[big, 1], [1, big]], object)
    values, vectors = whitening.eigen(spark, close, 2)
    assert float(values[0] - big) == pytest.approx(1, rel=1e-12) and float(values[1] - big) == pytest.approx(-1, rel=1e-12)
    assert np.allclose(np.abs(vectors), math.sqrt(.5), atol=1e-15)


def brute_whitening(vectors):
    """n, rows, S, eigenvalues and components by numpy on exactly centred integers."""
    ok = [v for v in vectors if v is not None and len(v) == len(max(vectors, key=lambda x: len(x or []))) and all(e is not None and math.isfinite(e) for e in v)]
    x = np.array([[math.floor(64.0 * e) + 1_000_000 for e in v] for v in ok], object)
    n, s = len(x), x.sum(axis=0)
    dev = n * x - s
    cov = (dev.T.dot(dev) / Fraction(n) ** 3).astype(float)
    values, u = np.linalg.eigh(cov)
    return n, dev, values[::-1], u[:, ::-1]


def test_op11_against_numpy(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = entry.op11_embedding_whitening(spark, SF).toPandas()
    table = e.orderBy("vec_id").toPandas()
    n, dev, values, u = brute_whitening([list(map(float, v)) for v in table.embedding])
    count = min(32, len(values))
    assert len(got) == n * count and set(got.n) == {n}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    want = dev.astype(float) / n @ u[:, :count] / np.sqrt(values[:count])
    assert np.abs(np.abs(wide) - np.abs(want)).max() < 1e-7
    first = got[got.component == 1].set_index("vec_id").loc[table.vec_id]
    assert first.deviation.tolist() == [int(v) for v in (dev ** 2).sum(axis=1)]
    explained = got[got.vec_id == table.vec_id[0]].sort_values("component").explained.to_numpy()
    assert np.allclose(explained, values[:count] / values.sum(), rtol=1e-9)
    assert set(got.identity_error) == {got.identity_error[0]} and got.identity_error[0] < 1e-9
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(count)).max() < 1e-9


def test_op11_odd(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0, 0.5], 1), (2, [0.0, -1.0, 0.25], 1), (2, [0.0, -1.0, 0.25], 1), (None, [3.0, 1.5, -2.0], 1), (3, None, 1), (4, [1.0, None, 2.0], 1),
            (5, [nan, 1.0, 1.0], 1), (6, [inf, 1.0, 1.0], 1), (7, [1.0, 2.0], 1), (8, [], 1), (9, [1e30, 0.0, 0.0], 1), (10, [1.0, 1.0, 1.0], None)]
    e = spark.createDataFrame(data, VECS).repartition(3)
    out = whitening.op11_embedding_whitening(e)
    got = out.collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((i, c) for i in (0, 1, 2, 2, 10) for c in (1, 2, 3))
    assert {r["n"] for r in got} == {5} and got[0]["identity_error"] < 1e-12
    clash = e.withColumns({c: F.lit("own") for c in ("n", "v", "key", "component", "whitened", "i", "l0")})
    assert whitening.op11_embedding_whitening(clash).columns == out.columns and whitening.op11_embedding_whitening(clash).count() == 15
    assert whitening.op11_embedding_whitening(empty(e)).columns == out.columns and whitening.op11_embedding_whitening(empty(e)).isEmpty()
    assert whitening.op11_embedding_whitening(e.filter("vec_id IN (3, 5, 6)")).isEmpty()
    # a dimension that does not vary: eigenvalue 0
    flat = spark.createDataFrame([(i, [float(i), float(i * i % 7), 4.0], 0) for i in range(9)], VECS)
    last = [r for r in whitening.op11_embedding_whitening(flat).collect() if r["component"] == 3]
    assert all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] < 1e-12 for r in last) and len(last) == 9
    one = whitening.op11_embedding_whitening(flat.limit(1)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(0, None, 0.0, None)] * 3


def test_gram_of_large_integers():
    rnd = random.Random(3)
    y = np.array([[rnd.randrange(-1 << 61, 1 << 61), rnd.randrange(-9, 9), rnd.randrange(1 << 40)] for _ in range(2000)], np.int64)
    gram = whitening.Gram(3)
    gram.add(y[:1500])
    gram.add(y[1500:] % 50)
    gram.add(y[1500:])
    a, b = y.astype(object), (y[1500:] % 50).astype(object)
    assert (gram.result() == a.T.dot(a) + b.T.dot(b)).all()
    assert all(whitening.from_limbs({f"l{k}": d for k, d in enumerate(whitening.limbs(v))}) == v for v in (0, -1, 1 << 150, -(1 << 149) + 5))


# ------------------------------------------------------------------ op12
def brute_removal(docs, length=100):
    """(n_bytes, n_removed, n_spans, sha256) by document number, from a dictionary of all strings."""
    first = {}
    texts = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in docs]
    for i, t in texts:
        for p in range(len(t) - length + 1):
            w = t[p:p + length]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] != (i, p):
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def removal(df):
    return sorted((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_op12_sql(spark):
    same_as_sql(spark, entry.op12_suffix_dedup(spark, SF), entry.oracle_sql()["op12_suffix_dedup"])


def families():
    """Shared passages with many borders, runs of one byte, periods, near copies."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage = text(18)[:95], text(60)
    docs = [(100 + i, text(5 + i % 9) + line + text(30)) for i in range(60)]
    docs += [(300 + i, text(7) + passage[i:] + text(4)) for i in range(25)] + [(400 + i, passage[:99 + i]) for i in range(4)]
    docs += [(500, "a" * 1000), (501, "a" * 150), (502, "xy" * 300), (503, "x" + "xy" * 60), (504, passage + " | " + passage)]
    base = text(150).split(" ")
    for i in range(20):
        near = base[:]
        near[rnd.randrange(150)] = word()
        docs.append((600 - i, " ".join(near)))
    docs += [(7, passage), (7, passage), (7, "x" + passage), (None, passage), (701, None), (702, ""), (703, "z" * 99), (704, line + "!" * 5 + line)]
    return docs


@pytest.mark.parametrize("limits", [suffixes.Limits(), suffixes.Limits(block_hot=3, block_runs=400), suffixes.Limits(hot=2, slice=700),
                                    suffixes.Limits(slice=256, block_runs=50, sort_suffixes=20, block_hot=2, hot=2)])
def test_op12_brute_force(spark, limits):
    """Equal results by every route: anchors spread or not, texts cut, blocks of any size."""
    docs = families()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert removal(suffixes.remove_repeats(df, limits=limits)) == brute_removal(docs)


def test_op12_odd(spark):
    docs = odd_docs(spark)
    got = suffixes.op12_suffix_dedup(docs)
    assert removal(got) == brute_removal([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert removal(suffixes.op12_suffix_dedup(clashing(docs).withColumns({c: F.lit(1) for c in ("at", "th", "kept", "n_bytes", "open", "repeats", "key")}))) == removal(got)
    assert suffixes.op12_suffix_dedup(empty(docs)).isEmpty() and suffixes.op12_suffix_dedup(docs.filter("doc_id < 4")).count() == 3
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffixes.remove_repeats(docs.filter("doc_id IN (4, 8)")).collect()}
    assert kept == {4: "One", 8: "é ü ß 漢字 \U0001f600 tail"}


def test_suffix_sort_orders_by_bytes():
    rnd = random.Random(2)
    data = bytes(rnd.choice(b"ab") for _ in range(3000)) + b"c" * 200
    with np.errstate(over="ignore"):
        h = suffixes.Hashes(np.frombuffer(data, np.uint8))
        at = np.array(rnd.sample(range(3000), 700))
        segment = np.sort(np.array([rnd.randrange(5) for _ in at]))
        order = suffixes.suffix_sort(h, at, segment)
        assert (segment[order] == segment).all()
        key = lambda k: (segment[k], data[at[k]:at[k] + 100])
        assert [key(k) for k in order] == sorted(key(k) for k in range(len(at)))
        i, j = np.array([0, 5, 3000]), np.array([0, 9, 3001])
        want = [next((k for k in range(100) if data[a + k] != data[b + k]), 100) for a, b in zip(i, j, strict=True)]
        assert h.common(i, j, 100).tolist() == want


def test_collisions_are_settled_by_bytes(monkeypatch):
    """With hashes that call everything equal the groups still are those of the bytes."""
    data = np.frombuffer(b"".join(bytes([65 + k % 3]) * 120 for k in range(9)), np.uint8)
    at, segment = np.arange(9) * 120, np.zeros(9, np.int64)
    monkeypatch.setattr(suffixes.Hashes, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    order, group = suffixes.groups(suffixes.Hashes(data), at, segment)
    assert sorted(zip((order % 3).tolist(), group.tolist(), strict=True)) == [(k, k) for k in range(3) for _ in range(3)]


# ------------------------------------------------------------------ op13
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(docs):
    """op13 by following every level of the tree for every document."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    record = lambda r, text: h(*[field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])

    def climb(level, p, f):
        proof = ""
        while len(level) > 1:
            run = [k for k in range(p - p % 3, min(p - p % 3 + 3, len(level)))]
            proof += "".join(level[k] for k in run if k != p)
            f = h(*[f if k == p else level[k] for k in run])
            level = [h(*level[k:k + 3]) for k in range(0, len(level), 3)]
            p //= 3
        return level[0], proof, f

    trees = {}
    for r in docs:
        trees.setdefault(r["source"], []).append(r)
    keys = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots = []
    for s in keys:
        trees[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, record(r, r["text"])))
        subroots.append(climb([record(r, r["text"]) for r in trees[s]], 0, "")[0])
    out = []
    for at, s in enumerate(keys):
        leaves = [record(r, r["text"]) for r in trees[s]]
        for p, r in enumerate(trees[s]):
            even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            f = record(r, r["text"].replace("\n", "")) if even and r["text"] is not None else leaves[p]
            subroot, proof, f = climb(leaves, p, f)
            root, more, f = climb(subroots, at, f)
            out.append((r["doc_id"], leaves[p], subroot, root, h(proof + more), f, f == root))
    return sorted(out, key=repr)


OP13 = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_op13_sql(spark):
    same_as_sql(spark, entry.op13_merkle_manifest(spark, SF), entry.oracle_sql()["op13_merkle_manifest"])


def test_op13_brute_force(spark):
    """Sources of one leaf, of a block, of one more, of several stages; odd rows; any partitioning."""
    sizes = {"one": 1, "two": 2, "nine": 9, "block": merkle.BLOCK, "more": merkle.BLOCK + 1, "hot": 3 * merkle.BLOCK + 80, "Z": 4, "é": 3}
    many = spark.createDataFrame([(i * 7 % 100_003, f"text\n{i}", "en", s, i) for s, n in sizes.items() for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = many.union(odd_docs(spark)).repartition(7)
    want = brute_manifest([r.asDict() for r in docs.collect()])
    assert rows(merkle.op13_merkle_manifest(docs), *OP13) == want
    clash = clashing(docs).withColumns({c: F.lit("own") for c in ("tree", "idx", "m", "block", "leaf", "path", "other", "id", "digest")})
    assert rows(merkle.op13_merkle_manifest(clash), *OP13) == want


def test_op13_edges(spark):
    docs = odd_docs(spark)
    assert merkle.op13_merkle_manifest(empty(docs)).isEmpty() and merkle.op13_merkle_manifest(empty(docs)).columns == OP13
    for one in (docs.filter("doc_id = 4"), docs.filter("doc_id = 6"), docs.filter("doc_id IS NULL")):
        assert rows(merkle.op13_merkle_manifest(one), *OP13) == brute_manifest([r.asDict() for r in one.collect()])


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100, 729])
def test_positions_address_the_log(leaves):
    levels = merkle.depth(leaves)
    level = [bytes([k % 251, k // 251]) + bytes(30) for k in range(leaves)]
    log = merkle.append_log(level, levels)
    seen = set()
    for k in range(levels + 1):
        for i, node in enumerate(level):
            at = merkle.position(k, i, leaves)
            assert log[at] == node
            seen.add(at)
        level = [merkle.parent(level[i:i + 3]) for i in range(0, len(level), 3)]
    assert seen == set(range(len(log)))


def test_logs_address_whole_trees(spark):
    """The first place of a block's log follows from the leaves before it."""
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 1) for i in range(2 * merkle.BLOCK + 5)], "doc_id long, text string, lang string, source string, n_chars long")
    _, logs, root = merkle.manifest(docs)
    first = {r["block"]: (r["first"], len(r["nodes"]) // 32) for r in logs[0].collect()}
    full = sum(merkle.BLOCK // 3 ** k for k in range(merkle.HEIGHT + 1))
    assert first[0] == (0, full) and first[1] == (full, full) and first[2][0] == 2 * full
    assert root == bytes(logs[-1].collect()[0]["nodes"][-32:]) and len(logs) == 2


# ------------------------------------------------------------------ op4
def test_op4_samples_any_number_of_rows():
    from rentscope.llm import quality_pu
    for n in (0, 1, 20_000, 10**9, 5 * 10**10, 10**15):
        share = quality_pu.threshold(20_000, n) / 2.0 ** quality_pu.SHARE_BITS
        assert share == pytest.approx(min(1.0, 20_000 / max(n, 1)), rel=1e-3)


def test_op3_archives_lie_in_partitions_of_their_own(spark):
    from rentscope.llm import warc
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.lit("x"), 120).alias("html"))
    recs = pages.select(F.pmod("page_id", F.lit(40)).cast("int").alias("archive"), "page_id", F.sha2("url", 256).alias("payload_digest"), "url", F.lit("response").alias("record_type"),
                        F.lit(None).cast("long").alias("refers_to"), F.lit(120).cast("long").alias("payload_bytes"), F.col("html").alias("payload"))
    parts = warc._travel(recs, 40, ["page_id", "payload_digest", "url"]).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("archive").alias("n"))
    assert sorted(r["n"] for r in parts.collect()) == [1] * 40
