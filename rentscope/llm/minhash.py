"""MinHash near-duplicates: one-permutation hashing, optimal densification, star edges.

1. A document's distinct word shingles are hashed to 64 bits; one permutation is cut into
   BANDS * ROWS bins, each holding its smallest hash. An empty bin borrows from a non-empty bin
   picked by a hash of the bin's number that does not depend on the document (optimal
   densification), so equal bins keep the Jaccard similarity as their probability. ROWS bins form
   a band; documents that agree on a band share a bucket.
2. Documents with the same set are one class, stood for by its digest; only classes go on.
3. In each bucket every member is paired with the bucket's centre only (a star), and the pairs are
   confirmed on the full shingle sets. That bounds the pairs by the bucket rows, but a star can
   miss a link between two members. So a bucket whose other members do not lie in one component
   afterwards gets more stars, with GROWTH times as many centres from round to round, until every
   pair of its members is in one component or was compared. Centres are the members that share
   the most buckets with others (an original before its copies), after the first round those
   without a link before the rest: once they are through, a bucket has one component. A pair is left out only if its
   sizes, how many of its shingles no other open member has, or the differing bits of both parity
   sketches (never more than the shingles that only one of both has) rule a link out; no cap is set.
4. Components come from alternating large-star and small-star steps on the confirmed links.

At a similarity of 0.8 a pair shares no bucket with probability (1 - 0.8^8)^45 = 2.5e-4, at 0.85 with 7e-7.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, written
from .shingles import U, mix, shingle_sets, stream

BANDS, ROWS = 45, 8
#: How many times more centres a bucket gets from round to round.
GROWTH = 64
PERCENT = 80
#: Words of 64 bits in a set's parity sketch.
SKETCH_WORDS = 16
SKETCH = [f"p{i}" for i in range(SKETCH_WORDS)]

_BORROW: dict[int, np.ndarray] = {}


def _borrow(k: int) -> np.ndarray:
    """For each bin the order in which it would borrow from the others."""
    if k not in _BORROW:
        _BORROW[k] = (stream(k * k, 3) >> U(32)).astype(np.uint32).reshape(k, k)
    return _BORROW[k]


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """k bins of the sorted distinct hashes: each bin's smallest, empty bins densified."""
    bins = ((shingles >> U(32)) * U(k)) >> U(32)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    full = bins[first].astype(np.int64)
    out = np.zeros(k, U)
    out[full] = shingles[first]
    if len(full) < k:
        empty = np.setdiff1d(np.arange(k), full, assume_unique=True)
        out[empty] = out[full[_borrow(k)[np.ix_(empty, full)].argmin(1)]]
    return out


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        sig = signature(shingles, bands * rows).reshape(bands, rows)
        return mix((sig * stream(rows, 4)).sum(1) + stream(bands, 5)).view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        one, two = mix(shingles ^ U(0x5851F42D4C957F2D)).sum(), mix(shingles + U(0x14057B7EF767814F)).sum()
    return int(one).to_bytes(8, "big") + int(two ^ U(len(shingles))).to_bytes(8, "big")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS words; a bit is the parity of how many shingles hash to it. Two sketches differ
    in at most as many bits as there are shingles that only one of the sets has."""
    bits = np.bincount((shingles & U(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def row_key() -> Column:
    """A row by its id and text; repeated rows share it."""
    return F.xxhash64("doc_id", "text")


def fingerprints(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row (hash of id and text), n_shingles, sid (set digest; null if empty), bands."""
    small_batches(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        size, sid, keys = [], [], []
        for s in shingle_sets(b.column("text"), n):
            size.append(len(s))
            sid.append(digest(s) if len(s) else None)
            keys.append(band_keys(s, bands, rows) if len(s) else None)
        flat = np.concatenate([x for x in keys if x is not None]) if any(size) else np.empty(0, np.int64)
        ends = np.cumsum([0, *(0 if x is None else bands for x in keys)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(size, pa.int64()), pa.array(sid, pa.binary()), lists],
                                          names=["doc_id", "row", "n_shingles", "sid", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text", row_key().alias("row")), run,
                       f"doc_id {kind}, row long, n_shingles long, sid binary, bands array<long>")


#: Up to this many wanted rows (24 bytes each) are broadcast to the tasks that read the texts; for
#: more the texts are shuffled to them.
BROADCAST_ROWS = 500_000


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """sid and its sorted shingle hashes (binary); wanted: sid and row, the row that is read for it."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select("text", row_key().alias("row")).join(wanted, "row").select("text", "sid")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(b.column("text"), n))
        same = [i for i, (s, sid) in enumerate(zip(sets, b.column("sid").to_pylist(), strict=True)) if digest(s) == sid]
        return pa.RecordBatch.from_arrays([b.column("sid").take(pa.array(same, pa.int64())), pa.array([sets[i].tobytes() for i in same], pa.binary())],
                                          names=["sid", "shingles"])

    return map_batches(rows, run, "sid binary, shingles binary").dropDuplicates(["sid"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, aw, bw) whose sets are similar enough. A centre with very many pairs is a
    skewed join key, which adaptive execution splits; each row is compared on its own."""
    small_batches(pairs.sparkSession)
    left = pairs.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")
    names = ["a", "b", "aw", "bw"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)):
            p, q = np.frombuffer(x, U), np.frombuffer(y, U)
            at = np.searchsorted(q, p)
            common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            if 100 * common >= percent * (len(p) + len(q) - common):
                keep.append(i)
        i = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(c).take(i) for c in names], names=names)

    return map_batches(both.select(*names, "x", "y"), run, "a binary, b binary, aw long, bw long")


def labels(links: DataFrame) -> DataFrame:
    """sid, root: the linked class of the highest weight, itself included. Classes of one root are
    connected; a component may have several roots, which costs comparisons but no link."""
    both = links.select(F.col("a").alias("sid"), F.struct(F.col("aw").alias("w"), F.col("a").alias("at")).alias("own"), F.struct(F.col("bw").alias("w"), F.col("b").alias("at")).alias("other"))
    both = both.union(links.select("b", F.struct(F.col("bw").alias("w"), F.col("b").alias("at")), F.struct(F.col("aw").alias("w"), F.col("a").alias("at"))))
    return both.groupBy("sid").agg(F.max(F.greatest("own", "other")).alias("r")).select("sid", F.col("r.at").alias("root"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """sid -> root (smallest of its component) for every end of the edges (a, b).

    Alternating large-star and small-star steps; each is an aggregate and a join on the node, and
    keeps at most one row for an edge. Ends when a step changes nothing.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, name)
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(written(low, name), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, name)
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), name)
    return now.select(F.col("a").alias("sid"), F.col("b").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether each a has one b only and no b is an a."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("at")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("at")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.out").alias("o"), F.max("e.at").alias("i")).filter("o > 1 OR (o > 0 AND i > 0)").isEmpty()


def link(docs: DataFrame, n: int = 4, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all rows, sid -> root of classes that are linked to another class)."""
    prints = written(fingerprints(docs, n, bands, rows), "prints")
    classes = written(prints.filter("n_shingles > 0").groupBy("sid")
                      .agg(F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    every = classes.select("sid", "n", F.explode("bands").alias("bucket"))
    shared = written(every.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1"), "shared")
    members = written(every.join(shared, "bucket"), "members")
    # the class that meets the most others is the likeliest to be what they are copies of
    weights = written(members.groupBy("sid").agg(F.sum(F.col("k") - 1).alias("w")), "weights")
    sets = written(full_sets(docs, written(weights.join(classes.select("sid", "row"), "sid").select("sid", "row"), "wanted"), n), "sets")
    open_ = written(members.join(weights, "sid").select("bucket", "sid", "n", _largest(F.col("n"), F.col("n"), percent).alias("cap"), "w", F.col("sid").alias("root"), F.lit(False).alias("lone")), "members")
    links = None
    groups = 1
    while True:
        group = F.pmod(F.xxhash64("sid", F.lit(groups)), F.lit(groups))
        centres = open_.groupBy("bucket", group.alias("g")).agg(F.max(F.struct("lone", "w", *[c for c in open_.columns if c not in ("bucket", "lone", "w")])).alias("c"))
        centres = written(centres.select("bucket", "c"), "centres")
        # a centre is compared with every member of its bucket that is not yet known to be in its
        # component, unless their sizes or unshared shingles rule a link out
        reach = "root <> c.root AND n <= c.cap AND c.n <= cap"
        if links is not None:       # a pair that shares several open buckets is made in the first
            differ = " + ".join(f"bit_count({p} ^ c.{p})" for p in SKETCH)
            reach += f" AND {100 + percent} * ({differ}) <= {100 - percent} * (n + c.n)"
            reach += " AND bucket = array_min(array_intersect(buckets, c.buckets))"
        ends = F.struct("sid", "w"), F.struct(F.col("c.sid").alias("sid"), F.col("c.w").alias("w"))
        pairs = open_.join(centres, "bucket").filter(reach).select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b")).distinct()
        pairs = written(pairs.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b"), F.col("a.w").alias("aw"), F.col("b.w").alias("bw")), "pairs")
        new = written(confirm(pairs, sets, percent), "links")
        first = links is None
        links = new if first else links.union(new)
        # left: members that were no centres yet, of buckets in which they have several roots
        used = centres.select("bucket", F.col("c.sid").alias("sid"))
        keep = ["bucket", "sid", "n", "cap", "w", *([] if first else SKETCH)]
        left = (open_.select(*keep).join(used, ["bucket", "sid"], "left_anti").join(written(labels(links), "labels"), "sid", "left")
                .select(*keep, F.coalesce("root", "sid").alias("root"), F.col("root").isNull().alias("lone")))
        open_ = _unresolved(written(left, "left"))
        if first:
            sids = written(open_.select("sid").distinct(), "open")
            alone = written(unshared(sets, sids), "unshared")
            tight = open_.join(alone, "sid", "left").join(written(sketches(sets, sids), "sketches"), "sid", "left").select(
                "bucket", "sid", "n", _largest(F.col("n"), F.col("n") - F.coalesce("u", F.lit(0)), percent).alias("cap"), "w", *SKETCH, "root", "lone")
            open_ = _unresolved(written(tight, "left"))
        if open_.isEmpty():
            return prints, components(links.select("a", "b"))
        lists = written(open_.groupBy("sid").agg(F.collect_list("bucket").alias("buckets")), "lists")      # a list a class, one bucket a band at most
        open_ = written(open_.join(lists, "sid"), "members")
        groups *= GROWTH


def _largest(n: Column, shared: Column, percent: int) -> Column:
    """The largest size of a set to which a set of n shingles can be linked, if at most ``shared``
    of its shingles are in other sets: (100 + percent) * common >= percent * (sum of both sizes)."""
    return F.floor((100 + percent) * shared / percent).cast("long") - n


def _unresolved(members: DataFrame) -> DataFrame:
    """Members of buckets that may still hold a link between two components: those for which some
    member of the bucket has a size within reach, where they lie in several components."""
    reach = members.groupBy("bucket").agg(F.min("n").alias("least"), F.max("cap").alias("most"), F.min("root").alias("x"), F.max("root").alias("y"))
    reach = written(reach.filter("x <> y").select("bucket", "least", "most"), "reach")
    return written(members.join(reach, "bucket").filter("cap >= least AND n <= most").drop("least", "most"), "members")


def unshared(sets: DataFrame, sids: DataFrame) -> DataFrame:
    """sid, u: how many of its shingles no other of the sids has. Those cannot be common to a pair,
    which tells near misses (copies with too many edits of their own) apart without comparing them."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        each = [np.frombuffer(x, np.int64) for x in b.column("shingles").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]), pa.int64())
        return pa.RecordBatch.from_arrays([b.column("sid").take(at), pa.array(np.concatenate(each) if each else np.empty(0, np.int64))], names=["sid", "shingle"])

    rows = map_batches(sets.join(sids, "sid").select("sid", "shingles"), run, "sid binary, shingle long")
    return (rows.groupBy("shingle").agg(F.min("sid").alias("sid"), F.count("*").alias("k")).filter("k = 1")
            .groupBy("sid").agg(F.count("*").alias("u")))


def sketches(sets: DataFrame, sids: DataFrame) -> DataFrame:
    """sid and its parity sketch."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        each = np.array([sketch(np.frombuffer(x, U)) for x in b.column("shingles").to_pylist()], np.int64).reshape(-1, SKETCH_WORDS)
        return pa.RecordBatch.from_arrays([b.column("sid"), *(pa.array(each[:, i]) for i in range(SKETCH_WORDS))], names=["sid", *SKETCH])

    return map_batches(sets.join(sids, "sid").select("sid", "shingles"), run, "sid binary, " + ", ".join(f"{p} long" for p in SKETCH))


def clusters(docs: DataFrame, n: int = 4, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, row, n_shingles, sid, component_id, root of every row of docs.

    component_id: smallest doc_id reachable (null ids are passed over). Very long texts enter with
    their whole sets, an empty table gives no rows, other columns are not looked at. A row without words is its
    own component (root null). Repeated rows are one class. Where different texts repeat a doc_id,
    unlinked components may have the same component_id; their roots differ.
    """
    prints, roots = link(docs, n, percent, bands, rows)
    ids = prints.filter("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("low"))
    rooted = written(ids.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "rooted")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of = written(rooted.join(written(least, "least"), "root").select("sid", "component_id", "root"), "class-components")
    prints = prints.drop("bands")
    own = prints.filter("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "root": F.lit(None).cast("binary")})
    return prints.filter("n_shingles > 0").join(of, "sid").select(*own.columns).union(own)


def op10_minhash_dedup(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    return clusters(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, n: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each component (the one with the smallest id; of repeated rows one), and
    every document without words; same columns. Different texts that repeat a doc_id are documents
    of their own."""
    rows = clusters(docs, n, percent).filter("n_shingles > 0")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "row")).alias("b"))
    winners = written(best.select(F.col("b.row").alias("_row")), "winners")
    names = docs.columns
    copy = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], row_key().alias("_row"),
                       F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_words"))
    kept = copy.filter("_words").join(winners, "_row").dropDuplicates(["_row"])
    out = kept.unionByName(copy.filter(~F.col("_words")))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
