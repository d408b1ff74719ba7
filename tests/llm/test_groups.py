"""Chat collapse, packing, near-dedup and the pipeline against SQL or brute force."""
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rentscope.llm import collapse, decontaminate, entry, minhash, packing, rules, secrets, shingles

from .common import SF, clashing, empty, odd_docs, rows, same_as_sql

CONV = "conv_id long, turn long, role string, text string"


def test_op8_sql(spark):
    same_as_sql(spark, entry.op8_chat_collapse(spark, SF), entry.oracle_sql()["op8_chat_collapse"])


def test_op8_odd(spark):
    chat = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", ""), (None, "x")]
    data = [(c, t, *chat[t]) for c, n in ((1, 5), (2, 3), (3, 5), (4, 1), (5, 4)) for t in range(n)]
    data += [(6, t, "user", "hi" if t == 0 else "other") for t in range(3)]                 # shares a first turn only
    data += [(7, 0, "user", "hi"), (7, 0, "user", "hi"), (7, 0, "user", "a tie"), (None, 1, "user", "no id"), (None, None, "user", "no turn")]
    data += [(8, t, "user", f"turn {t}") for t in range(700)] + [(9, t, "user", f"turn {t}") for t in range(699)]
    data += [(10, 0, "user", None), (11, 0, "user", ""), (12, 5, "user", "hi"), (12, 9, "assistant", "hello")]   # gaps in turn do not matter
    conversations = spark.createDataFrame(data, CONV).repartition(5)
    got = collapse.op8_chat_collapse(conversations)
    same_as_sql(spark, got, entry.oracle_sql()["op8_chat_collapse"], conversations=conversations)
    by = {(r["conv_id"], r["part"]): r for r in got.collect()}
    assert by[1, 0]["n_copies"] == 2 and (2, 0) not in by and (4, 0) not in by and (12, 0) not in by and (9, 0) not in by
    assert sorted(p for c, p in by if c == 8) == [0, 1, 2]
    assert collapse.op8_chat_collapse(empty(conversations)).isEmpty()
    assert collapse.op8_chat_collapse(conversations.withColumn("position", F.lit("own")).withColumn("h0", F.lit(1)).withColumn("task", F.lit(1))).count() == len(by)


def check_packing(rows_, capacity):
    places = defaultdict(list)
    for r in rows_:
        assert 1 <= r["length"] <= capacity
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_op9_round_trip(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(odd_docs(spark, [
        (70, "İSTANBUL ΣΑΣ é ́x <|endoftext|> don't'S a b\x85c 12½", "en", "s", 1), (71, "tail" * 5000, "en", "s", 1)]))
    got = packing.pack(docs, ["doc_id"], keep_ids=True).collect()
    want = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for p, start in enumerate(range(0, len(ids), 4096)):
            one = np.array(ids[start:start + 4096], "<u4").tobytes()
            want[r["doc_id"], p, start, len(one) // 4].append(zlib.crc32(one))
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"], r["piece"], r["start"], r["length"]].append(r["ids_crc32"])
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    n = check_packing(got, 4096)
    total = sum(r["length"] for r in got)
    assert n <= -(-total // 4096) + 1
    assert packing.op9_best_fit_packing(empty(docs)).isEmpty()
    assert packing.op9_best_fit_packing(clashing(docs)).count() == len(got)


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion(seed):
    rng = random.Random(seed)
    capacity = [10, 50, 100, 100, 4096, 4096][seed]
    counts = defaultdict(int)
    for _ in range([8, 60, 300, 300, 500, 5000][seed]):
        counts[rng.randrange(1, capacity + 1) if seed % 2 else min(capacity, 1 + int(rng.expovariate(3 / capacity)))] += 1
    plan = packing.bin_completion(counts, capacity)
    used = defaultdict(int)
    for filling, times in plan:
        assert sum(filling) <= capacity
        for x in filling:
            used[x] += times
    assert used == counts
    bins = sum(n for _, n in plan)
    assert bins <= sum(n for _, n in packing.best_fit_decreasing(counts, capacity))
    if seed == 0:       # exhaustive: the optimum of a few pieces
        items = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)

        def optimum(i, rooms, best):
            if len(rooms) >= best:
                return best
            if i == len(items):
                return len(rooms)
            for k in range(len(rooms)):
                if rooms[k] >= items[i]:
                    best = optimum(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1:], best)
            return optimum(i + 1, [*rooms, capacity - items[i]], best)
        assert bins == optimum(0, [], 99)


def test_bin_completion_beats_best_fit():
    counts = {44: 2, 24: 2, 22: 2, 21: 4, 17: 2, 8: 2, 6: 2, 4: 1}      # best-fit decreasing needs a bin more
    greedy = sum(n for _, n in packing.best_fit_decreasing(counts, 100))
    assert sum(n for _, n in packing.bin_completion(counts, 100)) <= greedy


def exhaustive(items, capacity):
    """Fewest bins, by trying every place of every piece."""
    items = sorted(items, reverse=True)

    def go(i, rooms, best):
        if len(rooms) >= best:
            return best
        if i == len(items):
            return len(rooms)
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                best = go(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1:], best)
        return go(i + 1, [*rooms, capacity - items[i]], best)
    return go(0, [], len(items) + 1)


def test_bin_completion_is_optimal_on_small_tables():
    better = 0
    for seed in range(400):
        rng = random.Random(seed)
        capacity = rng.choice([20, 30, 60])
        counts = Counter(rng.randint(2, capacity // 2 + 3) for _ in range(rng.randint(3, 12)))
        best = exhaustive(list(counts.elements()), capacity)
        assert packing.lower_bound(counts, capacity) <= best
        assert sum(n for _, n in packing.bin_completion(counts, capacity)) == best
        better += best < sum(n for _, n in packing.best_fit_decreasing(counts, capacity))
    assert better


@pytest.mark.parametrize("seed", range(3))
def test_bin_completion_beats_best_fit_on_large_tables(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(900, 2600) for _ in range(3000))
    plan = packing.bin_completion(counts)
    used = Counter()
    for filling, times in plan:
        assert sum(filling) <= packing.CAPACITY
        for x in filling:
            used[x] += times
    assert used == counts
    assert sum(n for _, n in plan) < sum(n for _, n in packing.best_fit_decreasing(counts, packing.CAPACITY))


@pytest.mark.parametrize("seed", range(40))
def test_fillings_are_the_undominated_ones(seed):
    """Against all sets of pieces: a set is dominated if swapping some of it for one larger spare piece, or for an
    equal one in place of several, still fits."""
    rng = random.Random(seed)
    capacity = rng.choice([12, 20, 31])
    counts = Counter(rng.randint(1, capacity * 2 // 3) for _ in range(rng.randint(1, 9)))
    largest = max(counts)
    others = sorted((counts - Counter([largest])).elements(), reverse=True)
    room, want = capacity - largest, set()
    for r in range(len(others) + 1):
        for rest in set(combinations(others, r)):
            waste = room - sum(rest)
            if waste < 0:
                continue
            spare = set((Counter(others) - Counter(rest)))
            swaps = [s for k in range(r + 1) for s in set(combinations(rest, k))]
            if not any(sum(s) <= y <= sum(s) + waste and (y > sum(s) or len(s) > 1) for s in swaps for y in spare):
                want.add((waste, (largest, *rest)))
    got = list(packing.fillings(largest, counts, capacity))
    assert len(got) == len(set(got)) and set(got) == want
    assert [w for w, _ in got] == sorted(w for w, _ in got)


def test_sequences(spark):
    docs = odd_docs(spark)
    packed = packing.pack(docs, ["doc_id"], keep_ids=True)
    by = defaultdict(list)
    for r in packed.collect():
        by[r["sequence_id"]].append((r["offset"], r["doc_id"], bytes(r["ids"])))
    got = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert set(got) == set(by)
    for s, parts in by.items():
        parts.sort(key=lambda p: p[0])
        assert bytes(got[s]["ids"]) == b"".join(p[2] for p in parts) and 4 * got[s]["length"] == len(got[s]["ids"])
        assert got[s]["offsets"] == [p[0] for p in parts] and got[s]["owners"] == [p[1] for p in parts]
    assert packing.sequences(packing.pack(empty(docs), ["doc_id"], keep_ids=True)).isEmpty()


def brute_components(texts, n=4, percent=80):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(sets[i]), find(i), find(i) == i) for i in ids), key=repr)


def family(rng, n, edits, words=120):
    """An original and copies with some words changed: similar to it, often not to one another."""
    first = [f"t{rng.randrange(4000)}" for _ in range(words)]
    out = [" ".join(first)]
    for _ in range(n):
        w = list(first)
        for _ in range(edits):
            w[rng.randrange(words)] = f"n{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_op10_brute_force(spark):
    rng = random.Random(5)
    texts = [t for edits in (1, 2, 3, 3) for t in family(rng, 40, edits)] + ["a b c", "A  b\tc", "a b", "a", "", None, " ", "a b c d", "a b c d e", "x y z w v"]
    now = family(rng, 0, 0)[0].split()
    for i in range(30):                 # a chain: each like the next, far ones unlike
        now = list(now)
        now[4 * i % 120] = f"c{i}"
        texts.append(" ".join(now))
    near = family(rng, 60, 0)[0].split()
    for edits in (2, 4, 5, 6, 7) * 16:  # near misses of one original, with edits in common
        w = list(near)
        for _ in range(edits):
            at = rng.randrange(120)
            w[at] = f"common{at % 5}{rng.randrange(3)}"
        texts.append(" ".join(w[rng.randrange(4):]))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("sid", F.lit("own")).withColumn("bands", F.lit(0)).repartition(3)
    got = minhash.op10_minhash_dedup(docs)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == brute_components(list(enumerate(texts)))


def test_op10_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows(minhash.op10_minhash_dedup(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_op10_odd(spark):
    docs = odd_docs(spark)
    got = minhash.op10_minhash_dedup(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[3]["kept"] and not by[7]["kept"] and by[7]["component_id"] == 6
    assert minhash.op10_minhash_dedup(empty(docs)).isEmpty()
    c = clashing(docs)
    out = minhash.deduplicate(c)
    assert out.columns == c.columns and out.count() == docs.count() - 2     # one of the three equal texts stays
    assert out.filter("doc_id = 6").count() == 1 and out.filter("sid = 'own sid'").count() == out.count()


def test_signature_keeps_similarity():
    """Equal bins estimate the Jaccard similarity, for sparse sets (densified) as for full ones."""
    for size in (5, 60, 2000):
        base = shingles.stream(size * 2, 99)
        hits = []
        for seed in range(60):
            with np.errstate(over="ignore"):
                own = shingles.mix(base + shingles.U(seed * 7919))
            a, b = np.unique(own[:size]), np.unique(own[size // 5:size + size // 5])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            hits.append((minhash.signature(a, 240) == minhash.signature(b, 240)).mean() - true)
        assert abs(np.mean(hits)) < 0.06, size


def test_sketch_never_rules_out_a_link():
    """Sketches differ in at most as many bits as shingles are in one set only."""
    rng = np.random.default_rng(4)
    for size, edits in ((1, 1), (30, 3), (150, 15), (150, 40), (5000, 700)):
        every = shingles.stream(size + edits, int(rng.integers(1000)))
        a, b = every[:size], every[edits:]
        differ = int(np.bitwise_count((minhash.sketch(a) ^ minhash.sketch(b)).view(shingles.U)).sum())
        assert differ <= len(np.setxor1d(a, b))
        assert size > 150 or differ >= 0.8 * len(np.setxor1d(a, b)), "tight for texts of some hundred words"


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    edges = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in pairs], "a binary, b binary")
    got = {int.from_bytes(r["sid"], "big"): int.from_bytes(r["root"], "big") for r in minhash.components(edges).collect()}
    ends = {i for p in pairs if p[0] != p[1] for i in p}
    assert got == {i: find(i) for i in ends if find(i) != i}


def test_dedup_repeated_id_with_different_texts(spark):
    """Unlinked texts under one doc_id are two documents; their copies still go."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    data = [(1, one, "en", "a", 1), (1, two, "en", "a", 1), (2, one, "en", "b", 1), (3, two, "en", "b", 1), (None, two, "en", "c", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert rows(minhash.deduplicate(docs), "doc_id", "text") == [(1, one), (1, two)]


def test_pipeline(spark):
    """run() against the stages' brute-force counterparts, on the smallest tables."""
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = {r["doc_id"] for r in rules.op6_quality_rules(docs, labels).filter("kept").collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    first = {c[0] for c in brute_components(texts, n=5) if c[3]}
    from .test_search_and_scan import brute_hits
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    left = []
    for i, t in texts:
        if i in first:
            n, hit, *_ = brute_hits(t, items)
            if not (hit and 20 * hit >= n):
                left.append(i)
    assert sorted({r["doc_id"] for r in got}) == sorted(left)
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs.filter(F.col("doc_id").isin(left))).collect()}
    assert {r["doc_id"]: r["n"] for r in [{"doc_id": i, "n": len(packing.encode([(t or "").encode()], packing.tokenizer_path())[0]) // 4} for i, t in masked.items()]} == {
        i: sum(r["length"] for r in got if r["doc_id"] == i) for i in left}
    check_packing(got, 4096)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    joined = {i: b"".join(bytes(r["ids"]) for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] == i) for i in left}
    assert joined == {i: packing.encode([(t or "").encode()], packing.tokenizer_path())[0] for i, t in masked.items()}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]


def test_stages_on_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, empty(docs), SF).isEmpty()
    assert decontaminate.WINDOW == 13
