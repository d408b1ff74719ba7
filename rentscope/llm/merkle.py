"""Merkle manifest of a dataset: postorder append logs built in aligned blocks, proofs by position.

Every row is a leaf. The leaves of a source are numbered by order, BLOCK = 3 ** HEIGHT consecutive
ones go to a builder, and a builder appends each node to its log the moment the node is complete,
so a log is the block's subtree in postorder. The roots of the blocks are the leaves of the next
stage's builders, until a source has one root; the sources' roots are the leaves of one more tree
built in the same way. A node's place in a log follows from the sizes of the subtrees before it
alone (``position``), so the siblings of a proof are addressed in the log without a search.

A hot source is many blocks, and no builder sees more than BLOCK nodes of a level.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY, HEIGHT = 3, 6
#: Leaves of a builder.
BLOCK = ARITY ** HEIGHT
#: Segments (logs of a block, some 80 KB) in an Arrow batch, and leaves in one.
SEGMENT_ROWS, LEAF_ROWS = 64, 10_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = 32
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def field(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def depth(leaves: int) -> int:
    """Levels above the leaves: a lone leaf is its own root."""
    d = 0
    while ARITY ** d < leaves:
        d += 1
    return d


def parent(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in digests).encode()).digest()


def append_log(leaves: Sequence[bytes], levels: int) -> list[bytes]:
    """The nodes of ``levels`` levels over the leaves, in order of completion."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(levels)]
    for i, node in enumerate(leaves):
        log.append(node)
        for run in waiting:
            run.append(node)
            if len(run) < ARITY and i + 1 < len(leaves):
                break
            node = parent(run)
            run.clear()
            log.append(node)
    return log


def position(level: int, index: int, leaves: int) -> int:
    """Place in the log of the index-th node of a level. With E the leaves up to the node's end:
    ceil(E / 3^l) nodes of each level l up to its own are complete with it, and of the levels
    above those that end before E."""
    end = min((index + 1) * ARITY ** level, leaves)
    place = sum(-(-end // ARITY ** low) for low in range(level + 1)) - 1
    high = ARITY ** (level + 1)
    while high < end:
        place += (end - 1) // high
        high *= ARITY
    return place


class Proofs:
    """Sibling paths of a log's leaves. A path is, level by level, a byte each for the number of
    left and right siblings, then their digests from left to right."""

    def __init__(self, nodes: bytes, leaves: int, levels: int, above: bytes):
        self.nodes, self.leaves, self.levels, self.above = nodes, leaves, levels, above
        self.seen: dict[tuple[int, int], bytes] = {}

    def node(self, level: int, index: int) -> bytes:
        at = position(level, index, self.leaves) * _NODE
        return self.nodes[at:at + _NODE]

    def path(self, index: int, level: int = 0) -> bytes:
        if level == self.levels:
            return self.above
        if (level, index) not in self.seen:
            first = index - index % ARITY
            last = min(first + ARITY, -(-self.leaves // ARITY ** level))
            siblings = b"".join(self.node(level, k) for k in range(first, last) if k != index)
            self.seen[level, index] = bytes((index - first, last - index - 1)) + siblings + self.path(index // ARITY, level + 1)
        return self.seen[level, index]


def steps(path: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """(left siblings, right siblings) of each level of a path."""
    at = 0
    while at < len(path):
        left, both = path[at], path[at] + path[at + 1]
        found = [path[at + 2 + k * _NODE:at + 2 + (k + 1) * _NODE] for k in range(both)]
        yield found[:left], found[left:]
        at += 2 + both * _NODE


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in steps(path):
        node = parent([*left, node, *right])
    return node


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """idx (from 0, by ``order`` within tree) and m (rows of the tree). Ranges of rows are numbered
    where they lie; what the ranges before hold of a tree is summed over one row a range and tree."""
    ordered = written(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                      .withColumns({"pid": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "merkle-ordered")
    tree = Window.partitionBy("tree")
    held = ordered.groupBy("tree", "pid").agg(F.count("*").alias("c"), F.min("seq").alias("first"))
    held = held.select("tree", "pid", (F.sum("c").over(tree.orderBy("pid")) - F.col("c") - F.col("first")).alias("shift"),
                       F.sum("c").over(tree).alias("m"))
    return ordered.join(held, ["tree", "pid"]).withColumn("idx", F.col("seq") + F.col("shift")).drop("pid", "seq", "shift")


_SEGMENT = "tree string, block long, m long, levels int, n int, first long, nodes binary, ids array<long>, other binary"


def _build(leaves: DataFrame, below: int) -> DataFrame:
    """The logs (segments) of a stage: leaves (tree, idx, m, digest[, id, other]) by blocks; ``below``
    levels of the tree lie under them. ``first`` is the place of the log's first node in the
    whole log of the tree's stage."""
    has = "other" in leaves.columns
    rows = (leaves.withColumn("block", F.floor(F.col("idx") / F.lit(BLOCK)).cast("long"))
            .select("tree", "block", "idx", "m", "digest", *(["id", "other"] if has else []))
            .repartition("tree", "block").sortWithinPartitions("tree", "block", "idx"))

    def segment(key: tuple[str, int], m: int, cols: list[list]) -> dict:
        tree, block = key
        levels = min(HEIGHT, max(0, depth(m)))
        before = block * BLOCK
        first, size = 0, 1
        while size <= before:
            first, size = first + before // size, size * ARITY
        return {"tree": tree, "block": block, "m": m, "levels": levels, "n": len(cols[0]), "first": first,
                "nodes": b"".join(append_log(cols[0], levels)), "ids": cols[1] if has else [], "other": b"".join(cols[2]) if has else b""}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, m, cols, out = None, 0, [[], [], []], []
        schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("m", pa.int64()), ("levels", pa.int32()), ("n", pa.int32()),
                            ("first", pa.int64()), ("nodes", pa.binary()), ("ids", pa.list_(pa.int64())), ("other", pa.binary())])
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for r in zip(*columns, strict=True):
                if (r[0], r[1]) != now:
                    if now is not None:
                        out.append(segment(now, m, cols))
                    now, m, cols = (r[0], r[1]), r[3], [[], [], []]
                    if len(out) == SEGMENT_ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                for c, v in zip(cols, r[4:], strict=False):
                    c.append(v)
        if now is not None:
            out.append(segment(now, m, cols))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    leaves.sparkSession.conf.set(_BATCH, str(LEAF_ROWS))
    return written(rows.mapInArrow(run, _SEGMENT), f"merkle-log-{below}")


def build(leaves: DataFrame) -> list[DataFrame]:
    """The stages' logs; in the last one every tree has one block, whose last node is its root."""
    most = leaves.agg(F.max("m")).first()[0] or 0
    stages, below = [], 0
    while True:
        stages.append(_build(leaves, below))
        below += HEIGHT
        if ARITY ** below >= most:
            return stages
        leaves = stages[-1].select("tree", F.col("block").alias("idx"), F.ceil(F.col("m") / F.lit(BLOCK)).cast("long").alias("m"),
                                   F.substring("nodes", -_NODE, _NODE).alias("digest"))


def roots(stages: list[DataFrame]) -> DataFrame:
    return stages[-1].select("tree", F.substring("nodes", -_NODE, _NODE).alias("digest"))


def paths(stages: list[DataFrame], above: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first stage's logs with the path above each block, and ``paths`` of the second stage.
    ``above`` (tree, path) is the path above the trees' roots."""
    at = above.withColumn("idx", F.lit(0).cast("long"))
    for k in range(len(stages) - 1, -1, -1):
        joined = stages[k].join(at.select("tree", F.col("idx").alias("block"), "path", *[c for c in at.columns if c not in ("tree", "idx", "path")]),
                                ["tree", "block"])
        if k == 0:
            return joined, at
        more = [c for c in at.columns if c not in ("tree", "idx", "path")]
        at = written(_leaf_paths(joined, more), f"merkle-paths-{k}")
    raise AssertionError("no stage")


def _leaf_paths(joined: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """(tree, idx, path) of each leaf of the logs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for tree, block, levels, n, nodes, path, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                proofs = Proofs(nodes, n, levels, path)
                out += [(tree, block * BLOCK + i, proofs.path(i), *rest) for i in range(n)]
            names = ["tree", "idx", "path", *more]
            types = [pa.string(), pa.int64(), pa.binary()] + [pa.binary()] * len(more)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
    joined.sparkSession.conf.set(_BATCH, str(SEGMENT_ROWS))
    return (joined.select("tree", "block", "levels", "n", "nodes", "path", *more)
            .mapInArrow(run, "tree string, idx long, path binary" + "".join(f", {c} binary" for c in more)))


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "source", ident: str = "doc_id",
             other: Column | None = None) -> tuple[DataFrame, list[DataFrame], bytes | None]:
    """(proofs, logs of the sources' trees, root).

    proofs has one row a document: id, leaf, subroot, path (see ``steps``; through the subroot to
    the root) and other, a second leaf digest given by the expression ``other`` (default: leaf).
    A null key is a tree of its own, ordered first; null ids come first in their tree, and rows of
    equal id are ordered by their digest, so equal rows are interchangeable. root is None and the
    proofs are empty for an empty table. Other columns are not looked at, whatever their names.
    """
    digest = leaf([F.col(c) for c in columns])
    slim = docs.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-")).alias("tree"), F.col(ident).cast("long").alias("id"),
                       digest.alias("digest"), (digest if other is None else other).alias("other"), F.monotonically_increasing_id().alias("row"))
    leaves = numbered(written(slim, "merkle-leaves"), ["id", "digest", "row"])
    stages = build(leaves.select("tree", "idx", "m", "digest", "id", "other"))
    subroots = roots(stages).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    tops = written(numbered(subroots, ["of"]), "merkle-subroots")
    top_stages = build(tops.select("tree", "idx", "m", "digest"))
    root = next((bytes(r[0]) for r in roots(top_stages).select("digest").take(1)), None)
    spark = docs.sparkSession
    start = spark.createDataFrame([("", b"")], "tree string, path binary")
    top_joined, _ = paths(top_stages, start)
    above = written(_leaf_paths(top_joined).select("idx", "path").join(tops, "idx")
                    .select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot")), "merkle-above")
    joined, _ = paths(stages, above)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for levels, n, nodes, ids, others, path, subroot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                proofs = Proofs(nodes, n, levels, path)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array([proofs.node(0, i) for i in range(n)], pa.binary()), pa.array([subroot] * n, pa.binary()),
                    pa.array([proofs.path(i) for i in range(n)], pa.binary()),
                    pa.array([others[i * _NODE:(i + 1) * _NODE] for i in range(n)], pa.binary())], names=["id", "leaf", "subroot", "path", "other"])

    spark.conf.set(_BATCH, str(SEGMENT_ROWS))
    proofs = (joined.select("levels", "n", "nodes", "ids", "other", "path", "subroot")
              .mapInArrow(run, "id long, leaf binary, subroot binary, path binary, other binary"))
    return proofs, stages, root


def verify(proofs: DataFrame, root: bytes | None) -> DataFrame:
    """proof_sha256 of the siblings, folded_root from ``other`` and the siblings, verified."""
    want = b"" if root is None else root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, leaves, subroots, ways, others = (c.to_pylist() for c in b.columns)
            folded = [fold(o, p) for o, p in zip(others, ways, strict=True)]
            digest = [hashlib.sha256("".join(x.hex() for left, right in steps(p) for x in (*left, *right)).encode()).hexdigest() for p in ways]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([x.hex() for x in leaves], pa.string()), pa.array([x.hex() for x in subroots], pa.string()),
                 pa.array([want.hex()] * len(ids), pa.string()), pa.array(digest, pa.string()), pa.array([x.hex() for x in folded], pa.string()),
                 pa.array([x == want for x in folded], pa.bool_())], names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return proofs.select("id", "leaf", "subroot", "path", "other").mapInArrow(
        run, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle_manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and checked proof of every document; where 2 divides crc32 of doc_id, the
    fold starts from the leaf of a text without its newlines. A null doc_id is not tampered with."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    other = leaf([tampered if c == "text" else F.col(c) for c in COLUMNS])
    proofs, _, root = manifest(docs, other=other)
    kind = docs.schema["doc_id"].dataType
    return verify(proofs, root).withColumnRenamed("id", "doc_id").withColumn("doc_id", F.col("doc_id").cast(kind))


def oracle(levels: int = 14, source_levels: int = 9) -> str:
    """DuckDB SQL of op13, for at most 3^levels documents a source and 3^source_levels sources."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    record = lambda text: "sha256(" + " || ".join([value(c) for c in COLUMNS[:-1]] + [value(text)]) + ")"
    # DuckDB has no crc32: the table of the polynomial, by its rule, and eight shifts a byte
    crc = ("list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, 1 + strlen(d)), lambda i: ascii(d[i])::UBIGINT)), "
           "lambda a, b: xor(a >> 8, t[CAST(1 + (xor(a, b) & 255) AS BIGINT)]))")
    table = ("list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT for k in range(8)]), "
             "lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END))")
    sql = [f"c AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '-') AS tree, {record('text')} AS leaf, text, source, lang, n_chars, "
           f"CAST(doc_id AS VARCHAR) AS d, (SELECT {table}) AS t FROM documents)",
           f"l AS MATERIALIZED (SELECT doc_id, tree, leaf, CASE WHEN xor({crc}, 4294967295::UBIGINT) % 2 = 0 THEN {record("replace(text, chr(10), '')")} ELSE leaf END AS f, "
           "row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS m FROM c)"]

    def climb(name: str, n: int) -> None:
        """From nodes {name}n0 (tree, p, h, m) and places {name}d0 (tree, p, f, proof, ...) up n levels."""
        for k in range(n):
            a, b = f"{name}n{k}", f"{name}d{k}"
            sql.append(f"{name}s{k} AS MATERIALIZED (SELECT x.tree, x.p, string_agg(y.h, '' ORDER BY y.p) AS sib, "
                       f"coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p < x.p), '') AS lo, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p > x.p), '') AS hi "
                       f"FROM {a} x JOIN {a} y ON x.tree = y.tree AND x.p // 3 = y.p // 3 AND x.p <> y.p WHERE x.m > 1 GROUP BY ALL)")
            sql.append(f"{name}d{k + 1} AS MATERIALIZED (SELECT d.* EXCLUDE (p, f, proof, m), d.p // 3 AS p, (d.m + 2) // 3 AS m, proof || coalesce(sib, '') AS proof, "
                       f"CASE WHEN d.m = 1 THEN f ELSE sha256(coalesce(lo, '') || f || coalesce(hi, '')) END AS f FROM {b} d LEFT JOIN {name}s{k} s ON d.tree = s.tree AND d.p = s.p)")
            sql.append(f"{name}n{k + 1} AS MATERIALIZED (SELECT tree, p // 3 AS p, (max(m) + 2) // 3 AS m, "
                       f"CASE WHEN max(m) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM {a} GROUP BY tree, p // 3)")

    sql += ["an0 AS MATERIALIZED (SELECT tree, p, leaf AS h, m FROM l)",
            "ad0 AS MATERIALIZED (SELECT *, '' AS proof FROM l)"]
    climb("a", levels)
    sql += [f"r AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS m FROM an{levels})",
            "bn0 AS MATERIALIZED (SELECT '' AS tree, p, subroot AS h, m FROM r)",
            f"bd0 AS MATERIALIZED (SELECT doc_id, leaf, subroot, '' AS tree, r.p, r.m, f, proof FROM ad{levels} JOIN r USING (tree))"]
    climb("b", source_levels)
    return ("WITH " + ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified "
            f"FROM bd{source_levels} CROSS JOIN (SELECT h FROM bn{source_levels})")


#: DuckDB SQL of op13.
ORACLE = oracle()
