"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's word windows (13 words; a shorter item is one
window). All windows of one length form one Wu-Manber table: a block of two
words (one for one-word windows) indexes SHIFT, the number of words that can be
skipped because no window can end there; shift 0 leads to the bucket of windows
with that last block, and a first-word check and a direct comparison confirm. Tables are flat
arrays, so their size is a small multiple of the benchmark's.

The benchmark is read in blocks of bounded bytes, each compiled once and
broadcast; documents are mapped through the blocks in a chain of narrow stages,
so neither a long benchmark nor a hot source needs a shuffle. After ``HELD_BYTES``
of benchmark the result so far is written, so a worker holds no more tables than that.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, texts, written

WINDOW = 13
#: Bytes of benchmark text compiled and broadcast at a time.
BLOCK_BYTES = 8 << 20
#: Bytes of benchmark text whose tables a worker holds at once.
HELD_BYTES = 32 << 20

#: Maps a UTF-8 byte to itself if it belongs to a word (A-Z lower-cased), else to a space.
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80)
              else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.translate(_FOLD).split()


class WuManber:
    """One table for windows of m words, in flat arrays (some 60 bytes a benchmark word).

    SHIFT is a byte for each value of a block's hash; blocks that share one take the smaller skip, so
    a skip never passes an occurrence. A window's bucket is keyed by the hashes of its last block
    and of its first word; equal windows of a bucket are one entry with all its items.
    """

    def __init__(self, m: int, items: list[tuple[object, list[bytes]]]):
        self.m, self.b = m, min(2, m)
        self.ids = [i for i, _ in items]
        words = [w for _, ws in items for w in ws]
        size = np.array([len(ws) for _, ws in items], np.int64)
        self.text = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.r_[0, ends[:-1] + 1]
        one = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        # crc32 of a word after its predecessor; at an item's first word it is not used
        block = one if self.b == 1 else np.fromiter(map(zlib.crc32, words, [0, *one[:-1].tolist()]), np.uint32, len(words))
        first = np.r_[0, np.cumsum(size)[:-1]]
        start = np.concatenate([np.arange(f, f + n - m + 1) for f, n in zip(first.tolist(), size.tolist(), strict=True)])
        self.mask = (1 << (16 * len(words)).bit_length()) - 1
        self.default = min(255, m - self.b + 1)
        shift = np.full(self.mask + 1, self.default, np.uint8)
        for end in range(self.b, m + 1):                    # falling skips, so the least is written last
            shift[block[start + end - 1] & self.mask] = min(self.default, m - end)
        self.shift = shift.tobytes()
        key = block[start + m - 1].astype(np.uint64) << np.uint64(32) | one[start]
        owner = np.repeat(np.arange(len(items)), size - m + 1)
        lo, hi = begins[start].astype(np.uint32), ends[start + m - 1].astype(np.uint32)
        order = self._by_text(key, lo, hi)
        same = np.r_[False, key[order[1:]] == key[order[:-1]]]
        for k in np.flatnonzero(same).tolist():
            i, j = order[k - 1], order[k]
            same[k] = self._window(lo[i], hi[i]) == self._window(lo[j], hi[j])
        heads = order[~same]
        self.key, self.lo, self.hi = key[heads], lo[heads], hi[heads]
        self.owner, self.owners = owner[order].astype(np.int32), np.r_[np.flatnonzero(~same), len(order)]

    def _window(self, lo: int, hi: int) -> bytes:
        return self.text[lo:hi]

    def _by_text(self, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Order by key and, among equal keys, by the window's text."""
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True])
        for a in np.flatnonzero(np.diff(edges) > 1).tolist():
            group = order[edges[a]:edges[a + 1]]
            order[edges[a]:edges[a + 1]] = sorted(group.tolist(), key=lambda i: self._window(lo[i], hi[i]))
        return order

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(first word of the occurrence, items) from left to right."""
        m, shift, mask, crc = self.m, self.shift, self.mask, zlib.crc32
        i, n = m, len(words)
        while i <= n:
            block = crc(words[i - 1], crc(words[i - 2])) if self.b == 2 else crc(words[i - 1])
            s = shift[block & mask]
            if s:
                i += s
                continue
            at = i - m
            key = np.uint64(block << 32 | crc(words[at]))
            k = int(np.searchsorted(self.key, key))
            if k < len(self.key) and self.key[k] == key:
                here = b" ".join(words[at:i])
                while k < len(self.key) and self.key[k] == key:
                    if self._window(self.lo[k], self.hi[k]) == here:
                        yield at, {self.ids[o] for o in set(self.owner[self.owners[k]:self.owners[k + 1]].tolist())}
                        break
                    k += 1
            i += 1


def compile_windows(items: list[tuple], window: int = WINDOW) -> list[WuManber]:
    """Tables of (id, text bytes) items, one for each window length that occurs."""
    by_length: dict[int, list[tuple[object, list[bytes]]]] = {}
    for item, text in items:
        w = words_of(text)
        if w:
            by_length.setdefault(min(window, len(w)), []).append((item, w))
    return [WuManber(m, by_length[m]) for m in sorted(by_length)]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        t = (r["text"] or "").encode()
        block.append((r["item_id"], t))
        size += len(t)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                 block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Columns ``keep`` of docs (default: all) and n_words, hit_spans (merged word ranges, end
    exclusive), hit_items (ids as sorted strings).

    Null text has no words; empty benchmark or item: nothing occurs; repeated items count once by
    id; an item with a null id still marks words and is listed as the empty string. Rows are mapped
    one by one, so repeated documents each get their row. Extra columns pass through; a name that
    clashes with an added column is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = ["_words", "_spans", "_items"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "hit_spans", "hit_items")]
    carry = list(dict.fromkeys([*kept, "text"]))
    out = docs.select(*carry).withColumns({
        "_words": F.lit(None).cast("long"), "_spans": F.array().cast("array<long>"), "_items": F.array().cast("array<string>")})
    blocks = _blocks(benchmark.select("item_id", "text"), block_bytes)
    first = next(blocks, [])
    schema = out.schema
    todo, held, size = [first], [], 0
    while todo:
        block = todo.pop()
        size += sum(len(t) for _, t in block)
        tables = spark.sparkContext.broadcast(compile_windows(block, window))   # bounded by block_bytes and one item
        held.append(tables)

        def scan(b: pa.RecordBatch, tables=tables) -> pa.RecordBatch:
            n_words, all_spans, all_items = [], [], []
            for t, flat, items in zip(texts(b), b.column("_spans").to_pylist(), b.column("_items").to_pylist(), strict=True):
                w = words_of(t)
                n_words.append(len(w))
                spans, found = list(zip(flat[::2], flat[1::2], strict=True)), set(items)
                for table in tables.value:
                    for at, ids in table.search(w):
                        spans.append((at, at + table.m))
                        found.update("" if i is None else str(i) for i in ids)
                all_spans.append([x for s in _merge(spans) for x in s])
                all_items.append(sorted(found))
            cols = [b.column(c) for c in carry] + [pa.array(n_words, pa.int64()), pa.array(all_spans, pa.list_(pa.int64())), pa.array(all_items, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, names=[*carry, *added])

        out = map_batches(out, scan, schema)
        more = next(blocks, None)
        if more is not None:
            todo.append(more)
            if size >= held_bytes:
                out = written(out, "decontaminate")
                for t in held:
                    t.unpersist()
                held, size = [], 0
    return out.select(*kept, F.col("_words").alias("n_words"), F.col("_spans").alias("hit_spans"), F.col("_items").alias("hit_items"))


def verdicts(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to a result of find_windows."""
    hit = F.expr("aggregate(hit_spans, struct(0L as i, 0L as s), (a, x) -> struct(a.i + 1 as i, a.s + if(a.i % 2 = 0, -x, x) as s), a -> a.s)")
    return (found.withColumn("n_hit", hit)
            .withColumn("n_items", F.size("hit_items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join("hit_items", ","), 256))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def op1_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document with the contract's columns."""
    return verdicts(find_windows(docs, benchmark, keep=["doc_id"])).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, same columns.

    A column of documents named like an added one keeps its values: the search runs on a copy.
    """
    names = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text"))
    clean = verdicts(find_windows(renamed, benchmark)).filter(~F.col("contaminated"))
    return clean.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


#: DuckDB SQL of op1.
ORACLE = r"""
WITH w AS (SELECT doc_id, rn, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
           FROM (SELECT doc_id, row_number() OVER () AS rn,
                        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
pat AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(ws, p, p + m - 1), ' ') AS win
        FROM (SELECT item_id, ws, least(13, len(ws)) AS m, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p FROM bw WHERE len(ws) > 0)),
ms AS (SELECT DISTINCT m FROM pat),
dw AS (SELECT rn, m, p, array_to_string(list_slice(ws, p, p + m - 1), ' ') AS win
       FROM (SELECT rn, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM w, ms WHERE len(ws) >= m)),
occ AS (SELECT dw.rn, dw.p, dw.m, pat.item_id FROM dw JOIN pat USING (m, win)),
pos AS (SELECT rn, count(*) AS n_hit FROM (SELECT DISTINCT rn, unnest(range(p, p + m)) AS x FROM (SELECT DISTINCT rn, p, m FROM occ)) GROUP BY rn),
it AS (SELECT rn, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY rn)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN pos USING (rn) LEFT JOIN it USING (rn)
"""
