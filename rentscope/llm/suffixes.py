"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes covers it that also starts earlier in the corpus. Sorting
every suffix of the corpus would move each byte LENGTH times, so the sort gets the suffixes that can
have a partner, and all of those:

1. Every window (string of LENGTH bytes) has an anchor, the leftmost of its smallest GRAM-byte
   grams by hash; equal windows have it at the same offset. Windows with one anchor lie side by
   side: a run, some 35 bytes apart from the next. A task sends a run once for all its equal runs of
   the block (the others repeat it) as hashes: anchor, content, place.
2. Buckets by anchor tell the runs that equal an earlier run as a whole, which repeat, and the runs
   whose anchor also occurs in another run, which are open.
3. The contents of the open runs (LENGTH - 1 bytes more than windows) meet by anchor, and their
   suffixes are merge-sorted: the common extension of two suffixes is found by binary search over
   prefix polynomial hashes, the byte after it decides. Neighbours that agree in LENGTH bytes are
   compared byte by byte (``groups``); all but the earliest of a group repeat.

An anchor with very many different runs (the end of a line that a third of all documents share) is
spread: its open windows meet one by one by their 128-bit digests instead, after a task has kept the
earliest of equal ones. Nothing is left out on either way, so the limits decide on the route alone.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import core_conf, small_batches, written
from .shingles import mix, stream

LENGTH, GRAM = 100, 32
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = stream(256, 7)
_POWERS = [np.ones(1, U), np.ones(1, U)]
_OPEN = np.dtype([("key", "<u8"), ("start", "<i4"), ("n", "<i4"), ("off", "<i4"), ("hot", "<i4")])


class Limits(NamedTuple):
    """Sizes that decide on memory and route, never on results."""
    #: Bytes hashed at a time; a longer text is cut into slices that share LENGTH - 1 bytes.
    slice: int = 1 << 18
    #: Runs gathered before a task sends them, and suffixes sorted at a time (of whole anchors).
    block_runs: int = 150_000
    sort_suffixes: int = 200_000
    #: Different runs of an anchor in a block, and in all, beyond which it is spread.
    block_hot: int = 64
    hot: int = 4096


# ------------------------------------------------------------------ prefix hashes
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n or more of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


class Hashes:
    """Polynomial hashes of all substrings of ``data`` from those of its prefixes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        power, self.inverse = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTES[data] * power[:len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def common(self, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
        """Length of the common extension of the suffixes at i and j, ``limit`` at most."""
        low = np.zeros(len(i), np.int64)
        step = 1 << limit.bit_length() - 1
        while step:
            to = low + step
            ok = to <= limit
            to = np.where(ok, to, 0)
            low = np.where(ok & (self.of(i, i + to) == self.of(j, j + to)), to, low)
            step >>= 1
        return low


def suffix_sort(h: Hashes, at: np.ndarray, segment: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Order of the suffixes at ``at`` by their first ``limit`` bytes within each segment (``segment``
    ascends): a merge sort whose runs double, each element finding its rank in the other run."""
    m = len(at)
    order = np.arange(m)
    if not m:
        return order
    begins = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    sizes = np.diff(np.r_[begins, m])
    first, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    place = np.arange(m) - first
    width = 1
    while width < sizes.max():
        run = place // width
        low = first + (run ^ 1) * width
        high = np.minimum(low + width, first + size)
        here = np.flatnonzero(low < high)
        own, right = at[order[here]], (run[here] & 1) == 1
        lo, hi = low[here].copy(), high[here].copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            other, mine = at[order[mid]], own[open_]
            n = h.common(other, mine, limit)
            same = n == limit
            n = np.minimum(n, limit - 1)
            before = np.where(same, right[open_], h.data[other + n] < h.data[mine + n])
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        to = np.arange(m)
        to[here] = first[here] + (run[here] & ~1) * width + (place[here] - run[here] * width) + lo - low[here]
        merged = np.empty(m, np.int64)
        merged[to] = order
        order = merged
        width *= 2
    return order


def groups(h: Hashes, at: np.ndarray, segment: np.ndarray, limit: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, group number along it) of the suffixes: a group agrees in ``limit`` bytes. Neighbours
    that their hashes call equal are compared; if one differs, the groups come from the bytes."""
    order = suffix_sort(h, at, segment, limit)
    a, seg = at[order], segment[order]
    near = np.flatnonzero((seg[1:] == seg[:-1]) & (h.common(a[:-1], a[1:], limit) >= limit)) if len(a) > 1 else np.empty(0, np.int64)
    equal = np.zeros(max(0, len(a) - 1), bool)
    for k in range(0, len(near), 1 << 16):
        part = near[k:k + (1 << 16)]
        span = np.arange(limit)
        equal[part] = (h.data[a[part][:, None] + span] == h.data[a[part + 1][:, None] + span]).all(axis=1)
    if equal[near].all():
        return order, np.cumsum(np.r_[0, ~equal])[:len(a)] if len(a) else np.empty(0, np.int64)
    # a collision: sort by the bytes themselves
    strings = [(int(s), h.data[i:i + limit].tobytes()) for i, s in zip(at, segment, strict=True)]
    order = np.array(sorted(range(len(at)), key=strings.__getitem__), np.int64)
    return order, np.cumsum([0] + [strings[order[k]] != strings[order[k - 1]] for k in range(1, len(order))])


# ------------------------------------------------------------------ runs of windows
def slices(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(data, text number and start in the text of each piece with the piece's end in data): texts of
    LENGTH bytes or more, about ``size`` bytes at a time."""
    parts: list[bytes] = []
    rows: list[tuple[int, int]] = []
    total = 0
    for k, t in enumerate(texts):
        for a in range(0, max(0, len(t) - LENGTH + 1), size):
            piece = t[a:a + size + LENGTH - 1] if len(t) > size else t
            if parts and total + len(piece) > size:
                yield _slice(parts, rows)
                parts, rows, total = [], [], 0
            parts.append(piece)
            rows.append((k, a))
            total += len(piece)
    if parts:
        yield _slice(parts, rows)


def _slice(parts: list[bytes], rows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.array(rows, np.int64), np.cumsum([len(p) for p in parts])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, start, windows, offset of the anchor, anchor, content) of each run of a slice; start
    is in data, the last two are hashes."""
    h = Hashes(data)
    n = len(data)
    bits = n.bit_length()
    at = np.arange(n - GRAM + 1)
    grams = mix(h.of(at, at + GRAM))
    low = (grams >> U(bits) << U(bits)) | at.astype(U)
    # smallest gram of each window, by doubling: the leftmost of equal ones has the smallest place
    span, width = LENGTH - GRAM + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    anchor = (low & U((1 << bits) - 1)).astype(np.int64)
    piece = np.searchsorted(ends, np.arange(len(anchor)), "right")
    good = np.arange(len(anchor)) + LENGTH <= ends[piece]
    begin = good & np.r_[True, (anchor[1:] != anchor[:-1]) | ~good[:-1] | (piece[1:] != piece[:-1])]
    start = np.flatnonzero(begin)
    number = np.cumsum(begin) - 1
    count = np.bincount(number[good], minlength=len(start)).astype(np.int64)
    a = anchor[start]
    off = a - start
    content = mix(h.of(start, start + count + LENGTH - 1) + (off * 256 + count).astype(U) * U(0xD6E8FEB86659FD93))
    return piece[start], start, count, off, grams[a], content


def firsts(keys: list[np.ndarray], at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group number along it, repeats) of rows grouped by ``keys``; a row repeats if its
    (at, start) is beyond the smallest of its group."""
    order = np.lexsort([start, at, *keys[::-1]])
    if not len(order):
        return order, order, np.empty(0, bool)
    new = np.r_[True, np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])]
    group = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)][group]
    return order, group, (at[order] != at[lead]) | (start[order] != start[lead])


#: A run on its way: anchor, content, order value and text hash of the document, place.
_RUN = {"key": "<u8", "cls": "<u8", "at": "<i8", "th": "<i8", "start": "<i4", "n": "<u1", "off": "<u1"}
_SENT = "bucket int, kind int, " + ", ".join(f"{c} binary" for c in _RUN)
_DECIDED = "at long, th long, repeats binary, open binary"
_REPEATS, _PLAIN, _SPREAD, _MARK = range(4)


def _planes(v: np.ndarray) -> bytes:
    """All first bytes, all second bytes, ...: the high bytes of like numbers compress."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _send(cols: dict[str, np.ndarray], buckets: int, block_hot: int) -> Iterator[pa.RecordBatch]:
    """The runs of a block by bucket; those that repeat within the block go as such."""
    order, group, repeat = firsts([cols["key"], cols["cls"]], cols["at"], cols["start"])
    c = {k: v[order] for k, v in cols.items()}
    # equal rows (a document that is there twice) are sent once
    twin = np.r_[False, (group[1:] == group[:-1]) & (c["at"][1:] == c["at"][:-1]) & (c["start"][1:] == c["start"][:-1]) & (c["th"][1:] == c["th"][:-1])]
    classes = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    _, which, many = np.unique(c["key"][classes], return_inverse=True, return_counts=True)
    spread = (many[which] >= block_hot)[group]
    kind = np.where(repeat, _REPEATS, np.where(spread, _SPREAD, _PLAIN))
    bucket = np.where(kind == _REPEATS, mix(c["at"].view(U) ^ c["th"].view(U)), np.where(kind == _SPREAD, mix(c["cls"]), c["key"])) % U(buckets)
    keep = ~twin
    marks = np.unique(c["key"][spread])
    c = {k: np.r_[v[keep], marks.astype(v.dtype) if k == "key" else np.zeros(len(marks), v.dtype)] for k, v in c.items()}
    kind, bucket = np.r_[kind[keep], np.full(len(marks), _MARK)], np.r_[bucket[keep], marks % U(buckets)].astype(np.int64)
    by = np.lexsort([c["start"], c["th"], c["at"], kind, bucket])          # a document's runs together: they compress
    kind, bucket = kind[by], bucket[by]
    c = {k: v[by].astype(_RUN[k]) for k, v in c.items()}
    begins = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])])
    ends = np.r_[begins[1:], len(bucket)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[begins], pa.int32()), pa.array(kind[begins], pa.int32())]
        + [pa.array([_planes(v[a:b]) for a, b in zip(begins, ends, strict=True)], pa.binary()) for v in c.values()], names=["bucket", "kind", *c])


def _texts(col: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in col.cast(pa.binary()).to_pylist()]


def sent_runs(docs: DataFrame, buckets: int, limits: Limits = Limits()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def joined() -> dict[str, np.ndarray]:
            return {k: np.concatenate([x[k] for x in held]) for k in held[0]}

        for b in batches:
            at, th = (b.column(c).to_numpy(zero_copy_only=False) for c in ("at", "th"))
            for data, rows, ends in slices(_texts(b.column("text")), limits.slice):
                with np.errstate(over="ignore"):
                    piece, start, n, off, key, cls = runs(data, ends)
                doc = rows[piece, 0]
                place = start - np.r_[0, ends[:-1]][piece] + rows[piece, 1]
                held.append({"key": key, "cls": cls, "at": at[doc], "th": th[doc], "start": place, "n": n, "off": off})
                size += len(key)
                if size >= limits.block_runs:
                    yield from _send(joined(), buckets, limits.block_hot)
                    held, size = [], 0
        if size:
            yield from _send(joined(), buckets, limits.block_hot)
    return docs.select("at", "th", "text").mapInArrow(run, _SENT)


def _by_document(at: np.ndarray, th: np.ndarray, repeats: np.ndarray, opens: np.ndarray, is_open: np.ndarray) -> pa.RecordBatch:
    """A row a document: its repeated spans (int32 pairs) and its open runs."""
    order = np.lexsort([is_open, th, at])
    at, th, is_open = at[order], th[order], is_open[order]
    begins = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (th[1:] != th[:-1])]) if len(at) else np.empty(0, np.int64)
    ends = np.r_[begins[1:], len(at)].astype(np.int64)[:len(begins)]
    middle = begins + np.add.reduceat((~is_open).astype(np.int64), begins) if len(at) else begins
    spans, runs_ = repeats[order], opens[order]
    return pa.RecordBatch.from_arrays(
        [pa.array(at[begins], pa.int64()), pa.array(th[begins], pa.int64()),
         pa.array([spans[a:m].tobytes() for a, m in zip(begins, middle, strict=True)], pa.binary()),
         pa.array([runs_[m:b].tobytes() for m, b in zip(middle, ends, strict=True)], pa.binary())], names=["at", "th", "repeats", "open"])


def decided(sent: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per bucket and document: spans that repeat, runs that are open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {k: [] for k in range(4)}
        for b in batches:
            for k, *cols in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[k].append({c: _from_planes(v, t) for (c, t), v in zip(_RUN.items(), cols, strict=True)})
        empty = {c: np.empty(0, t) for c, t in _RUN.items()}
        c = {k: {f: np.concatenate([x[f] for x in [empty, *v]]) for f in _RUN} for k, v in held.items()}
        del held
        # spread runs come by content and are all open; the others by anchor
        one = {f: np.concatenate([c[_PLAIN][f], c[_SPREAD][f]]) for f in _RUN}
        by_content = np.r_[np.zeros(len(c[_PLAIN]["key"]), np.int8), np.ones(len(c[_SPREAD]["key"]), np.int8)]
        order, group, repeat = firsts([by_content, one["key"], one["cls"]], one["at"], one["start"])
        one = {f: v[order] for f, v in one.items()}
        by_content = by_content[order]
        if len(group):
            leads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            key, spread = one["key"][leads], by_content[leads] == 1
            anchor = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (spread[1:] != spread[:-1])]) - 1
            many = np.bincount(anchor)[anchor]
            hot = ((many > limits.hot) | spread | np.isin(key, c[_MARK]["key"]))[group]
            open_ = ((many > 1)[group] | hot) & ~repeat
        else:
            hot = open_ = np.zeros(0, bool)
        out = np.flatnonzero(repeat | open_)
        known = c[_REPEATS]
        f = {k: np.concatenate([known[k], one[k][out]]) for k in ("key", "at", "th", "start", "n", "off")}
        is_open = np.r_[np.zeros(len(known["key"]), bool), open_[out]]
        opens = np.zeros(len(is_open), _OPEN)
        opens["key"], opens["start"], opens["n"], opens["off"] = f["key"], f["start"], f["n"], f["off"]
        opens["hot"][len(known["key"]):] = hot[out]
        begin = f["start"].astype(np.int32)
        spans = np.stack([begin, begin + f["n"].astype(np.int32) + np.int32(LENGTH - 1)], axis=1).astype("<i4")
        if len(is_open):
            yield _by_document(f["at"], f["th"], spans, opens, is_open)
    return sent.mapInArrow(run, _DECIDED)


# ------------------------------------------------------------------ open runs
_CONTENT = "key long, off int, n int, at long, th long, start int, content binary"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_NAMES = ["key", "off", "n", "at", "th", "start", "content"]
#: n of a window that is known to repeat, and of one that comes as its digest (key and content).
_KNOWN, _DIGEST = 0, -1


def _digests(windows: list[bytes], at: list[int], th: list[int], start: list[int]) -> pa.RecordBatch:
    """Windows of spread anchors: of equal ones the earliest as digest, the others as known."""
    d = np.frombuffer(b"".join(windows), "<u8").reshape(-1, 2)
    cols = [np.array(c, np.int64) for c in (at, th, start)]
    order, group, repeat = firsts([d[:, 0], d[:, 1]], cols[0], cols[2])
    at_, th_, start_ = (c[order] for c in cols)
    twin = np.r_[False, (group[1:] == group[:-1]) & (at_[1:] == at_[:-1]) & (th_[1:] == th_[:-1]) & (start_[1:] == start_[:-1])]
    at_, th_, start_, repeat, order = at_[~twin], th_[~twin], start_[~twin], repeat[~twin], order[~twin]
    key = np.where(repeat, mix(at_.view(U) ^ th_.view(U)), d[order, 0]).view(np.int64)
    second = d[order, 1].tobytes()
    content = [b"" if r else second[8 * k:8 * k + 8] for k, r in enumerate(repeat.tolist())]
    n = np.where(repeat, _KNOWN, _DIGEST)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((key, np.full(len(key), -1), n, at_, th_, start_, content), _KINDS, strict=True)], names=_NAMES)


def contents(pending: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The bytes of the open runs by anchor, and the windows of spread anchors by digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: tuple[list, ...] = ([], [], [], [])
        for b in batches:
            rows: list[tuple] = []
            for at, th, size, packed, opens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = unpack(packed, size)
                for key, start, n, off, hot in np.frombuffer(opens, _OPEN).tolist():
                    if not hot:
                        rows.append((key - (1 << 64) if key >> 63 else key, off, n, at, th, start, text[start:start + n + LENGTH - 1]))
                        continue
                    windows[0].extend(hashlib.blake2b(text[p:p + LENGTH], digest_size=16).digest() for p in range(start, start + n))
                    windows[1].extend([at] * n)
                    windows[2].extend([th] * n)
                    windows[3].extend(range(start, start + n))
                if len(windows[0]) >= limits.sort_suffixes:
                    yield _digests(*windows)
                    windows = ([], [], [], [])
            for k in range(0, len(rows), 10_000):
                part = list(zip(*rows[k:k + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(part, _KINDS, strict=True)], names=_NAMES)
        if windows[0]:
            yield _digests(*windows)
    return pending.select("at", "th", "size", "packed", "open").mapInArrow(run, _CONTENT)


def _sorted_repeats(rows: pa.Table) -> pa.RecordBatch:
    """The windows of the given runs that repeat, by document."""
    key, off, n, at, th, start = (rows.column(c).to_numpy().astype(np.int64) for c in _NAMES[:6])
    content = rows.column("content").to_pylist()
    whole = np.flatnonzero(n > 0)
    size = np.array([len(content[k]) for k in whole], np.int64)
    base = np.zeros(len(n), np.int64)
    base[whole] = np.cumsum(size) - size
    count = np.maximum(n, 0)
    row = np.repeat(np.arange(len(n)), count)
    q = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    by = np.lexsort([off[row] - q, key[row]])
    row, q = row[by], q[by]
    rel = off[row] - q
    segment = np.cumsum(np.r_[False, (key[row][1:] != key[row][:-1]) | (rel[1:] != rel[:-1])]) if len(row) else row
    alone = np.bincount(segment)[segment] == 1 if len(row) else np.zeros(0, bool)
    row, q, segment = row[~alone], q[~alone], segment[~alone]
    h = Hashes(np.frombuffer(b"".join(content[k] for k in whole), np.uint8))
    order, group = groups(h, base[row] + q, segment)
    row, q = row[order], q[order]
    place = start[row] + q
    by, _, repeat = firsts([group], at[row], place)
    hit = by[repeat]
    digest = np.flatnonzero(n == _DIGEST)
    second = np.frombuffer(b"".join(content[k] for k in digest), "<u8")
    by, _, repeat = firsts([key[digest], second], at[digest], start[digest])
    known = np.r_[np.flatnonzero(n == _KNOWN), digest[by[repeat]]]
    p = np.r_[start[known], place[hit]].astype("<i4")
    spans = np.stack([p, p + np.int32(LENGTH)], axis=1).astype("<i4")
    return _by_document(np.r_[at[known], at[row[hit]]], np.r_[th[known], th[row[hit]]], spans, np.zeros(len(p), _OPEN), np.zeros(len(p), bool))


def sorted_repeats(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The windows of the open runs that repeat, from the suffix sort of whole anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        with np.errstate(over="ignore"):
            for b in batches:
                held.append(b)
                size += int(np.abs(b.column("n").to_numpy()).sum())
                if size < limits.sort_suffixes:
                    continue
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                at = int(np.searchsorted(key, key[-1]))         # the last anchor may go on
                if at:
                    yield _sorted_repeats(table.slice(0, at))
                    table = table.slice(at)
                held = table.to_batches()
                size = int(np.abs(table.column("n").to_numpy()).sum())
            if held:
                yield _sorted_repeats(pa.Table.from_batches(held))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, _DECIDED)


# ------------------------------------------------------------------ results
def cut(text: bytes, spans: list[bytes]) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, kept bytes) for (start, end) pairs."""
    pairs = np.concatenate([np.frombuffer(s, "<i4").reshape(-1, 2) for s in spans]) if spans else np.empty((0, 2), "<i4")
    if not len(pairs):
        return 0, 0, text
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")].astype(np.int64)
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.r_[True, pairs[1:, 0] > reach[:-1]]
    begin = pairs[new, 0]
    end = reach[np.r_[np.flatnonzero(new)[1:] - 1, len(pairs) - 1]]
    kept = b"".join(text[a:b] for a, b in zip(np.r_[0, end], np.r_[begin, len(text)], strict=True))
    return len(text) - len(kept), len(begin), kept


_CODEC = "zstd"


def unpack(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, decompressed_size=size, codec=_CODEC, asbytes=True) if size else b""


def _packed(own: DataFrame, key_type: str) -> DataFrame:
    """The texts as they travel: compressed, each by itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("at"), b.column("th"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([pa.compress(t, codec=_CODEC, asbytes=True) if t else b"" for t in texts], pa.binary())], names=["doc_id", "at", "th", "size", "packed"])
    return own.select("doc_id", "at", "th", "text").mapInArrow(run, f"doc_id {key_type}, at long, th long, size long, packed binary")


def _results(rows: DataFrame, key_type: str, keep_text: bool, last: bool) -> DataFrame:
    """A result a row; with ``last`` false, rows that have open runs keep what is needed to go on."""
    names = ["doc_id", "at", "th", "size", "packed", "repeats", "open", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for size, packed, spans, opens in zip(*(b.column(c).to_pylist() for c in ("size", "packed", "repeats", "open")), strict=True):
                waits = b"".join(opens or [])
                if waits and not last:
                    out.append((packed, b"".join(spans), waits, None, None, None, None))
                    continue
                removed, count, kept = cut(unpack(packed, size), spans or [])
                out.append((None, None, None, removed, count, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            kinds = [pa.binary()] * 3 + [pa.int64()] * 2 + [pa.string(), pa.binary()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names[:4]] + [pa.array(list(v), t) for v, t in zip(cols, kinds, strict=True)], names=names)
    return rows.select("doc_id", "at", "th", "size", "packed", "repeats", "open").mapInArrow(
        run, f"doc_id {key_type}, at long, th long, size long, packed binary, repeats binary, open binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _per_document(found: DataFrame) -> DataFrame:
    return found.groupBy("at", "th").agg(*[F.collect_list(c).alias(c) for c in ("repeats", "open")])


def remove_repeats(docs: DataFrame, keep_text: bool = True, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each row.

    A null text is empty, and a text under LENGTH bytes keeps all. Rows are ordered by doc_id alone,
    null first (as the smallest long): of rows with one doc_id a string is earlier if its start is, so
    equal rows have equal results and do not remove each other. Very long texts are hashed in slices.
    No rows give no rows; other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # a row is known by its id, and by its text too if any id repeats
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty()
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"),
                      (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("th"), "text")
    buckets = 4 * core_conf(spark)          # small ones: a bucket is held in memory
    sent = sent_runs(own, buckets, limits).repartitionById(buckets, "bucket").drop("bucket")
    first = _packed(own, kind).join(_per_document(decided(sent, limits)), ["at", "th"], "left")
    results = written(_results(first, kind, keep_text, False), "suffix-first")
    pending = results.filter("open IS NOT NULL")
    more = _per_document(sorted_repeats(contents(pending, limits), limits)).select("at", "th", F.col("repeats").alias("late"))
    rest = (pending.select("doc_id", "at", "th", "size", "packed", F.col("repeats").alias("early")).join(more, ["at", "th"], "left")
            .withColumn("repeats", F.concat(F.array("early"), F.coalesce("late", F.array().cast("array<binary>"))))
            .withColumn("open", F.lit(None).cast("array<binary>")))
    columns = ["doc_id", F.col("size").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "kept"]
    return results.filter("open IS NULL").select(*columns).union(_results(rest, kind, keep_text, True).select(*columns))


def op12_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Bytes covered by a 100-byte string that starts earlier, removed; see ``remove_repeats``."""
    return remove_repeats(docs, keep_text=False).drop("kept")


#: DuckDB SQL of op12: every window of every text.
ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS t FROM documents),
w AS (SELECT r, doc_id, p, md5(t[p + 1 : p + 100]) AS h FROM d, unnest(range(octet_length(t) - 99)) AS u(p)),
f AS (SELECT h, min({'d': coalesce(doc_id, -9223372036854775808), 'p': p}) AS f FROM w GROUP BY h HAVING count(*) > 1),
x AS (SELECT r, p FROM w JOIN f USING (h) WHERE {'d': coalesce(doc_id, -9223372036854775808), 'p': p} <> f.f),
e AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM x),
g AS (SELECT r, p, sum(CASE WHEN gap IS NULL OR gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS s FROM e),
spans AS (SELECT r, s, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY r, s),
cuts AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS k, lead(a) OVER (PARTITION BY r ORDER BY a) IS NULL AS last FROM spans),
pieces AS (SELECT r, k, t[k + 1 : a] AS piece FROM cuts JOIN d USING (r) UNION ALL SELECT r, b, t[b + 1 : octet_length(t)] FROM cuts JOIN d USING (r) WHERE last),
kept AS (SELECT r, string_agg(hex(piece), '' ORDER BY k) AS kept FROM pieces GROUP BY r),
n AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       CASE WHEN removed IS NULL THEN sha256(t) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
