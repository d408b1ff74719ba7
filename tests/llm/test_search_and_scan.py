"""Decontamination, secrets and WARC against SQL or brute force."""
import hashlib
import pickle
import random
import re

import pytest
from pyspark.sql import functions as F

from rentscope.llm import decontaminate as D
from rentscope.llm import entry, secrets, warc
from rentscope.llm.common import scratch

from .common import SF, clashing, empty, odd_docs, rows, same_as_sql

BENCH = "item_id long, text string"


def brute_hits(text, items, window=13):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    hit, found = set(), set()
    for i, t in items:
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        m = min(window, len(w))
        for p in range(len(w) - m + 1 if m else 0):
            for q in range(len(words) - m + 1):
                if words[q:q + m] == w[p:p + m]:
                    hit.update(range(q, q + m))
                    found.add("" if i is None else str(i))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_op1_sql(spark):
    same_as_sql(spark, entry.op1_decontaminate(spark, SF), entry.oracle_sql()["op1_decontaminate"])


@pytest.mark.parametrize(("block_bytes", "held_bytes"), [(1 << 20, 1 << 20), (40, 1 << 20), (40, 150)])
def test_op1_brute_force(spark, block_bytes, held_bytes):
    """Overlapping and repeating windows, items of every length, several benchmark blocks."""
    rng = random.Random(3)
    word = lambda: rng.choice("aa b Cc dé 漢 7 e-f".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 20, 30])] + [(20, None), (21, ""), (22, "--"), (3, "other b"), (None, "漢 7 b")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(40)]
    docs += [(100 + i, "x y " + t + " z") for i, t in items if t and i is not None] + [(200, None), (200, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, BENCH)
    got = D.verdicts(D.find_windows(d, b, block_bytes=block_bytes, held_bytes=held_bytes))
    want = sorted(((i, *brute_hits(t, items)) for i, t in docs), key=repr)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == want


def test_op1_tables(monkeypatch):
    """Colliding hashes give the same occurrences; the tables are a small multiple of the benchmark."""
    rng = random.Random(4)
    items = [(i, [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(5, 30))]) for i in range(60)]
    text = [rng.choice([b"a", b"b", b"c"]) for _ in range(3000)]
    for m in (1, 2, 5):
        want = []
        for at in range(len(text) - m + 1):
            ids = {i for i, w in items if any(w[p:p + m] == text[at:at + m] for p in range(len(w) - m + 1))}
            want += [(at, ids)] * bool(ids)
        assert list(D.WuManber(m, items).search(text)) == want
        with monkeypatch.context() as few:
            few.setattr(D.zlib, "crc32", lambda w, h=0: (len(w) + h) % 2)
            assert list(D.WuManber(m, items).search(text)) == want
    long = [(i, b" ".join(b"w%d" % rng.randrange(10 ** 6) for _ in range(400))) for i in range(1000)]
    size = sum(len(t) for _, t in long)
    assert sum(len(pickle.dumps(t)) for t in D.compile_windows(long)) < 10 * size


def test_op1_odd(spark):
    d = odd_docs(spark)
    b = spark.createDataFrame([(1, "same text here again same text here again same text here again same")], BENCH)
    got = {r["doc_id"]: r for r in D.op1_decontaminate(d, b).collect()}
    assert got[6]["contaminated"] and got[7]["contaminated"] and not got[5]["contaminated"]
    assert got[1]["n_words"] == 0 and got[8]["n_words"] == 6
    assert D.op1_decontaminate(d, empty(b)).filter("n_hit > 0").isEmpty()
    assert D.op1_decontaminate(empty(d), b).isEmpty()
    c = clashing(d)
    kept = D.decontaminate(c, b)
    assert kept.columns == c.columns and kept.count() == d.count() - 3
    assert kept.select("n_words").distinct().collect()[0][0] == "own n_words"


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_secrets(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(out))
    return (*(sum(1 for o in out if o[1] == k) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined)


def test_op2_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(odd_docs(spark)).union(spark.createDataFrame([
        (901, 'é PassWord : "Zz9-zz9-zz9-zz9" ſecret=abcdefghijklmnop AKIA' + "B7" * 9, "en", "s", 1),
        (902, "token=secret: abcdefghijklmnop api_key='0123456789abcdef0' AKIAAKIA1 " + "f" * 15 + "g" + "0" * 16, "en", "s", 1)], docs.schema))
    got = secrets.op2_secrets(docs)
    want = sorted(((r["doc_id"], *brute_secrets(r["text"])[:4]) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    for r in got.filter("spans <> ''").collect():
        kept = ",".join(s for s in r["spans"].split(",") if not s.startswith("live:"))
        assert hashlib.sha256(kept.encode()).hexdigest() == r["base_sha256"]


def test_op2_ownership(spark):
    live, copied = "Abc123Def456Ghi7", "Example1Example2"
    data = [(1, f"password={live}", "en", "a", 1), (2, f"we log {live} here", "en", "b", 1), (3, f"log {copied} here", "en", "z", 1)]
    data += [(10 + i, f"token={copied}", "en", f"s{i}", 1) for i in range(5)] + [(20, f"token={copied}", "en", "s1", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in secrets.op2_secrets(docs).collect()}
    assert got[1]["n_live"] == 1 and got[10]["n_example"] == 1 and got[10]["n_live"] == 0
    assert got[2]["spans"] == "live:7:23" and got[3]["spans"] == ""
    out = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert out[1]["text"] == "[SECRET]" and out[2]["text"] == "we log [SECRET] here" and out[3]["text"] == f"log {copied} here"
    assert out[2]["n_chars"] == len("we log [SECRET] here") and out[3]["n_chars"] == 1
    assert secrets.op2_secrets(empty(docs)).isEmpty() and secrets.redact(empty(docs)).isEmpty()
    c = clashing(odd_docs(spark))
    assert rows(secrets.redact(c), *c.columns) == rows(c, *c.columns)


def test_op2_texts_and_owners(spark):
    """An example in many texts of one source is no live value; a secret in one text is, whoever copies the text."""
    pasted, leaked, few = "Pasted12Pasted34", "Leaked12Leaked34", "Fewtxt12Fewtxt34"
    data = [(i, f"page {i} says password={pasted} to all", "en", "hot", 1) for i in range(secrets.MAX_REPOSITORIES + 1)]
    data += [(100 + i, f"page {i} says password={few} to us", "en", "hot", 1) for i in range(secrets.MAX_REPOSITORIES)]
    data += [(200 + i, f"our notes: password={leaked} for now", "en", f"s{i}", 1) for i in range(6)]
    data += [(300, f"log {pasted} here", "en", "z", 1), (301, f"log {few} here", "en", "z", 1), (302, f"log {leaked} here", "en", "z", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    owners = {r["hash"]: r[1:] for r in secrets.ownership(secrets.scan(docs, ["source"]), "source").select("hash", "n_owners", "n_repositories", "live").collect()}
    assert owners == {secrets._hash(v.encode()): want for v, want in (
        (pasted, (1, secrets.MAX_REPOSITORIES + 1, False)), (few, (1, secrets.MAX_REPOSITORIES, True)), (leaked, (1, 1, True)))}
    got = {r["doc_id"]: r for r in secrets.op2_secrets(docs).collect()}
    assert (got[0]["n_live"], got[0]["n_example"]) == (0, 1) and (got[200]["n_live"], got[205]["n_example"]) == (1, 0)
    assert [got[i]["spans"] for i in (300, 301, 302)] == ["", "live:4:20", "live:4:20"]
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert [out[i] for i in (300, 301, 302)] == [f"log {pasted} here", "log [SECRET] here", "log [SECRET] here"]


def test_op3_sql(spark):
    same_as_sql(spark, entry.op3_warc(spark, SF), entry.oracle_sql()["op3_warc"])


def test_op3_odd(spark):
    big = "é" * 120_000
    data = [(1, "http://a/ b\r\nc", "x" * 100), (2, None, "x" * 100), (2, None, "x" * 100), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""),
            (7, "u", big), (8, "u", big), (None, "u", big), (None, "v", "n" * 200), (9, "u", "a\r\n\r\nWARC/1.1\r\n\n")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("archive", F.lit(9)).withColumn("head", F.lit("own"))
    same_as_sql(spark, warc.op3_warc(pages), entry.oracle_sql()["op3_warc"], pages=pages.select("page_id", "url", "html"))
    folder = scratch(spark, "warc-test")
    index = warc.write_archives(pages, folder, archive_bytes=1 << 16)
    one = warc.read_records(spark, folder, index.filter("page_id IN (7, 9)"), payload=True).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in one} == {"7": big, "9": data[-1][2]}
    assert warc.op3_warc(empty(pages)).isEmpty()


def test_coalesced_ranges():
    got = list(warc.coalesce_ranges(iter([("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("b", 0, 5), ("b", 5, 100)]), gap=10, most=50))
    assert [g[:3] for g in got] == [("a", 0, 15), ("a", 40, 45), ("b", 0, 5), ("b", 5, 105)]
