"""Best-fit packing by bin completion with branch and bound, on the histogram of lengths.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. How many pieces have
each length is all that packing needs: at most ``capacity`` numbers, however many documents there
are. From them the driver makes a plan, a list of fillings (lengths that share a sequence) and how
often each is used:

* best-fit decreasing gives the first incumbent;
* bin completion improves it: the largest remaining length opens a bin, its undominated fillings
  over all lengths are enumerated in the order of their waste, each is applied as often as the
  counts allow, and a branch is pruned when its waste so far exceeds what a better solution than
  the incumbent may have, or when the lower bound of what is left says so. Best fit completes
  branches on the way down. The search ends when the incumbent meets the lower bound, when no
  branch is left or when ``NODES`` nodes and fillings are used up; the incumbent is then the plan.

Each piece then finds its place from its rank among the pieces of its length. Ranks are counted
inside the tokenising tasks and offset by task totals, so a length that a third of all pieces
have is spread over as many tasks as wrote it.
"""
from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, texts, written

CAPACITY = 4096
END_ID = 1
#: Nodes of the branch and bound and fillings looked at there, whatever the number of lengths; beyond
#: them the incumbent stands.
#: Every TRY_BEST_FIT levels best fit completes a branch, which may be a better incumbent.
NODES, TRY_BEST_FIT = 4_000, 16
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a Python worker keeps.
CACHE_WORDS = 600_000

_WORKER: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _encoder(path: str) -> dict:
    """Tokenizer, which ids end a word, and the ids of known words; kept for the life of the worker."""
    if _WORKER.get("path") != path:
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        ends = np.zeros(tok.get_vocab_size(), bool)
        ends[[i for s, i in tok.get_vocab().items() if s.endswith("</w>")]] = True
        _WORKER.update(path=path, tok=tok, ends=ends, ids={})
    return _WORKER


def _learn(words: list[bytes], known: dict[bytes, bytes], tok, ends: np.ndarray) -> None:
    """Adds the ids of new words. Words of letters only are encoded many at a time, as one text:
    each is one word to the tokenizer too, so its ids end with the first that ends a word."""
    plain, rest = [], []
    for w in words:
        s = w.decode("utf-8", "replace")
        letters = s.isalpha() and (w.isascii() or s == s.lower() and unicodedata.is_normalized("NFC", s))
        (plain if letters else rest).append((w, s))
    for i in range(0, len(plain), 2048):
        part = plain[i:i + 2048]
        ids = np.array(tok.encode_batch_fast([" ".join(s for _, s in part)], add_special_tokens=False)[0].ids, "<u4")
        stop = np.flatnonzero(ends[ids]) + 1
        if len(stop) != len(part):
            rest += part
            continue
        raw, a = ids.tobytes(), 0
        for (w, _), z in zip(part, (4 * stop).tolist(), strict=True):
            known[w], a = raw[a:z], z
    for i in range(0, len(rest), 2048):
        part = rest[i:i + 2048]
        for (w, _), e in zip(part, tok.encode_batch_fast([s for _, s in part], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()


#: Marks that may follow a word. After an ASCII letter or digit they are a word of their own to
#: the tokenizer, however many there are.
_TAIL = b".,!?;:#*$%&|"
_ALNUM = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B))


def encode(batch: list[bytes], path: str) -> list[bytes]:
    """Little-endian uint32 ids of each text, END_ID appended.

    The normalizer and the splitting pattern never look across white space, so the ids of a text
    are those of its words in turn. Lower-casing ASCII is part of the normalizer and is done first
    (unless the text may spell a special token), so fewer words are distinct.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    worker = _encoder(path)
    known = worker["ids"]
    if len(known) > CACHE_WORDS:
        known.clear()
    split = [(t if b"<|" in t else t.lower()).split() for t in batch]
    parts: dict[bytes, tuple[bytes, bytes]] = {}
    for w in set().union(*split).difference(known):
        core = w.rstrip(_TAIL)
        parts[w] = (core, w[len(core):]) if core and core[-1] in _ALNUM else (w, b"")
    new = {x for p in parts.values() for x in p if x and x not in known}
    _learn(sorted(new), known, worker["tok"], worker["ends"])
    for w, (core, tail) in parts.items():
        if tail:
            known[w] = known[core] + known[tail]
    end = np.array([END_ID], "<u4").tobytes()
    return [b"".join([*map(known.__getitem__, words), end]) for words in split]


def pieces(docs: DataFrame, columns: list[str], path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """columns, piece, start, length, ids_crc32, task and rank (of this length in this task)."""
    small_batches(docs.sparkSession)
    base = docs.select(*list(dict.fromkeys([*columns, "text"])))
    own = [f"`{c}` {base.schema[c].dataType.simpleString()}" for c in columns]
    names = [*columns, "piece", "start", "length", "ids_crc32", "task", "rank"] + ["ids"] * keep_ids
    schema = ", ".join([*own, "piece int, start long, length long, ids_crc32 long, task int, rank long"] + ["ids binary"] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            at, rows, cut = [], [], []
            for i, ids in enumerate(encode(texts(b), path)):
                for p, start in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[start:start + 4 * capacity]
                    n = len(one) // 4
                    at.append(i)
                    rows.append((p, start // 4, n, zlib.crc32(one), task, seen[n]))
                    seen[n] += 1
                    if keep_ids:
                        cut.append(one)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            cols = [b.column(c).take(pa.array(at, pa.int64())) for c in columns]
            cols += [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(cut, pa.binary())] * keep_ids, names=names)

    return base.mapInArrow(run, schema)


Plan = list[tuple[tuple[int, ...], int]]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Fillings and their numbers; equal bins are handled together, so the work follows the
    number of distinct lengths and not the number of pieces."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)   # room left -> (filling, bins)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for room in sorted(r for r in open_bins if r >= length):
            if not n:
                break
            per, groups, later = room // length, open_bins.pop(room), []
            for filling, bins in groups:
                full = min(bins, n // per)
                if full:
                    open_bins[room - per * length].append((filling + (length,) * per, full))
                    n -= full * per
                if full < bins and n:
                    open_bins[room - n * length].append((filling + (length,) * n, 1))
                    full, n = full + 1, 0
                if full < bins:
                    later.append((filling, bins - full))
            if later:
                open_bins[room].extend(later)
        per = capacity // length
        if n >= per:
            open_bins[capacity - per * length].append(((length,) * per, n // per))
        if n % per:
            open_bins[capacity - n % per * length].append(((length,) * (n % per), 1))
    return [g for groups in open_bins.values() for g in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: pieces over half a bin share none, and what the others hold
    beyond the room beside them needs more (the best such bound over all least lengths counted)."""
    x = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in x.tolist()], np.int64)
    pieces_to, size_to = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * x)]
    half = int(np.searchsorted(x, capacity // 2, "right"))
    least = np.r_[0, x[:half]]
    a = np.searchsorted(x, least)                                      # counted from this length on
    b = np.maximum(np.searchsorted(x, capacity - least, "right"), half)     # from here on a piece fills its bin alone
    beside = (pieces_to[b] - pieces_to[half]) * capacity - (size_to[b] - size_to[half])
    extra = np.maximum(0, -((beside - (size_to[half] - size_to[np.minimum(a, half)])) // capacity))
    return int((pieces_to[-1] - pieces_to[half] + extra).max())


def reachable(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Entry i: a bit for each sum up to ``room`` that pieces of the first i lengths make."""
    mask, bits = (1 << room + 1) - 1, 1
    out = [bits]
    for x in lengths:
        left, step = min(counts[x], room // x), 1
        while left:
            step = min(step, left)
            bits |= bits << step * x & mask
            left, step = left - step, 2 * step
        out.append(bits)
    return out


def _smear(bits: int, width: int) -> int:
    """bits moved up by 0 to width places, together."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


def dominated(rest: tuple[int, ...], waste: int, spare: int) -> bool:
    """Whether a spare piece may take the place of some pieces of ``rest`` (or of none) and fit.

    Such an exchange never hurts: the pieces it frees fit wherever the spare one would have been.
    ``spare`` has a bit for each length of which a piece is left. An equal length for a single
    piece is no exchange.
    """
    single = several = 0
    for x in rest:
        several |= (several | single) << x
        single |= 1 << x
    swaps = _smear(several, waste)
    if waste:
        swaps |= _smear((single | 1) << 1, waste - 1)
    return bool(spare & swaps)


def candidates(largest: int, counts: dict[int, int], capacity: int, slack: int | None = None) -> Iterator[tuple[int, tuple[int, ...], bool]]:
    """(waste, filling, whether it is undominated) of every filling of a bin around ``largest`` that
    wastes ``slack`` at most, least waste first, of equal waste those with longer pieces first.

    The sums that the shorter lengths can make are known beforehand, so every step of the
    enumeration ends in a filling.
    """
    room = capacity - largest
    left = {x: n - (x == largest) for x, n in counts.items() if x <= room and n > (x == largest)}
    lengths = sorted(left)
    reach = reachable(lengths, left, room)
    spare = sum(1 << x for x in lengths)

    def exact(i: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        i = bisect_right(lengths, total, 0, i)
        while i and reach[i] >> total & 1:
            i -= 1
            x = lengths[i]
            for k in range(min(left[x], total // x), 0, -1):
                if reach[i] >> total - k * x & 1:
                    for tail in exact(i, total - k * x):
                        yield (x,) * k + tail

    for waste in range(min(room, room if slack is None else slack) + 1):
        if reach[-1] >> room - waste & 1:
            for rest in exact(len(lengths), room - waste):
                gone = sum(1 << x for x in set(rest) if rest.count(x) == left[x])
                yield waste, (largest, *rest), not dominated(rest, waste, spare & ~gone)


def fillings(largest: int, counts: dict[int, int], capacity: int, slack: int | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
    """The undominated ones of ``candidates``."""
    return ((waste, f) for waste, f, good in candidates(largest, counts, capacity, slack) if good)


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Fillings that hold every piece, in as few bins as the search finds.

    Branches are tried by limited discrepancy: wave d holds the branches that leave the first
    choice by d places in all, so a poor choice high up is met early. A filling is applied as often
    as the counts (and the waste allowed) let it, later also once only, so that a search that ends
    before its ``nodes`` are used up has seen every packing that could need fewer bins.
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    best = best_fit_decreasing(counts, capacity)
    best_bins = sum(n for _, n in best)
    total = sum(k * v for k, v in counts.items())
    bound = lower_bound(counts, capacity) if counts else 0
    wave, cut = 0, True
    while cut and nodes > 0 and best_bins > bound:
        cut = False
        left, path, bins, waste = dict(counts), [], 0, 0
        frames: list[list[tuple[int, tuple[int, ...], int, int]]] = []      # moves yet to try, the next one last
        allowance = wave
        while nodes > 0 and best_bins > bound:
            nodes -= 1
            moves: list[tuple[int, tuple[int, ...], int, int]] = []
            slack = (best_bins - 1) * capacity - total - waste
            if not left:
                if bins < best_bins:
                    best, best_bins = [(f, t) for _, f, t, _ in path], bins
            elif slack >= 0 and bins + lower_bound(left, capacity) < best_bins:
                if len(path) % TRY_BEST_FIT == 0:
                    rest = best_fit_decreasing(left, capacity)
                    if bins + sum(n for _, n in rest) < best_bins:
                        best, best_bins = [(f, t) for _, f, t, _ in path] + rest, bins + sum(n for _, n in rest)
                largest = max(left)

                full = False
                for once in (False, True):
                    for w, f, good in candidates(largest, left, capacity, slack):
                        nodes -= 1
                        times = min(left[x] // f.count(x) for x in set(f))
                        times = min(times, slack // w) if w else times
                        if good and (not once or times > 1):
                            moves.append((w, f, 1 if once else times, allowance - len(moves)))
                        full = len(moves) > allowance or nodes <= 0
                        if full:
                            break
                    if full:
                        break
                cut = cut or full
            frames.append(moves)
            while frames and not frames[-1]:
                frames.pop()
                if path:
                    w, f, t, _ = path.pop()
                    bins, waste = bins - t, waste - w * t
                    for x in f:
                        left[x] = left.get(x, 0) + t
            if not frames:
                break
            w, f, t, allowance = frames[-1].pop()
            path.append((w, f, t, allowance))
            bins, waste = bins + t, waste + w * t
            for x in f:
                left[x] -= t
                if not left[x]:
                    del left[x]
        wave += 1
    return best


def placements(plan: Plan) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, uses per sequence, offset of the first use)."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for filling, times in plan:
        offset = 0
        for x in sorted(set(filling), reverse=True):
            k = filling.count(x)
            out[x].append((rank[x], sequence, k, offset))
            rank[x] += k * times
            offset += k * x
        sequence += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def place(cut: DataFrame, columns: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to written pieces (see ``pieces``)."""
    spark = cut.sparkSession
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    where = spark.sparkContext.broadcast(placements(bin_completion(counts, capacity)))  # bounded by the capacity alone
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = written(per_task.select("length", "task", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")), "pack-ranks")
    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "task")
    keep = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join([*(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in keep), "sequence_id long, offset long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True])
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                i = order[a:z]
                x = int(length[i[0]])
                rows = where.value[x]
                at = rows[np.searchsorted(rows[:, 0], rank[i], "right") - 1]
                turn = rank[i] - at[:, 0]
                seq[i], off[i] = at[:, 1] + turn // at[:, 2], at[:, 3] + turn % at[:, 2] * x
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, columns: list[str], path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; with keep_ids also their ids.

    Null or empty text is one piece holding END_ID; repeated rows are packed each; an empty table
    gives no rows. ``columns`` must not be named like an added one.
    """
    cut = written(pieces(docs, columns, path or tokenizer_path(), capacity, keep_ids), "pieces")
    return place(cut, columns, capacity)


def sequences(packed: DataFrame, column: str = "doc_id") -> DataFrame:
    """The training sequences of pieces packed with their ids: sequence_id, length, the ids (little-endian
    unsigned 32-bit), and for each of its documents in turn the value of ``column`` and where it begins.

    A sequence holds ``capacity`` ids at most, so no group is larger than that; sequence numbers spread evenly.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", F.col(f"`{column}`").alias("owner"), "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
            .select("sequence_id", "length", F.col("parts.owner").alias("owners"), F.col("parts.offset").alias("offsets"),
                    F.aggregate("parts.ids", F.expr("X''"), lambda a, x: F.concat(a, x)).alias("ids")))


def op9_best_fit_packing(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a piece with the contract's columns."""
    return pack(docs, ["doc_id"], path).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
