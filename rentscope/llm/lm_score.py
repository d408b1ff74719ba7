"""Language-model scores by subword-lattice likelihood.

The model is a unigram model over the pieces of an existing public vocabulary and an end symbol.
Its start weights are the vocabulary's own scores; they weigh all segmentations of every distinct
training word, and the expected piece counts of those segmentations, times the word's corpus
count, are the model's probabilities. A text's score is its marginal probability over all
segmentations (forward recursion in log space).

Counts and scores belong to words, and a corpus has far fewer distinct words than words. So tasks
cut their texts into chunks, store each text as numbers into the chunk's word list, and only the
word lists are shuffled: to sum the counts, to score every distinct word of the corpus once, and to
bring counts and scores back to the chunks. No vocabulary is broadcast, and a very frequent word
has one row a chunk.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, small_batches, texts, written
from .lattice import Pieces, expected_counts, log_marginals, vocabulary_path

#: Text bytes whose words share one list.
CHUNK_BYTES = 24 << 20
#: Estimation steps over the training words, and how many start-weight counts smooth each.
STEPS, SMOOTHING = 1, 1000.0
FOLDS, HELD_OUT = 7, 2
#: The end of a text in a word list; no word is empty.
END = b""

_WORKER: dict = {}


def _pieces(path: str) -> Pieces:
    if _WORKER.get("path") != path:
        _WORKER.update(path=path, pieces=Pieces(path))
    return _WORKER["pieces"]


def word_lists(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of kind 1, a text (chunk, doc_id, held_out, n_tokens, ids), and of kind 0, a distinct
    word of a chunk (chunk, number, word, n: its count in training texts)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "text")
    names = ["kind", "chunk", "doc_id", "held_out", "n_tokens", "ids", "number", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        number: dict[bytes, int] = {}
        count = np.zeros(1 << 16, np.int64)
        size = 0

        def words() -> pa.RecordBatch:
            n = len(number)
            none = pa.nulls(n)
            return pa.RecordBatch.from_arrays([
                pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, chunk)), none.cast(doc_type), none.cast(pa.bool_()), none.cast(pa.int64()),
                none.cast(pa.binary()), pa.array(np.arange(n)), pa.array(list(number), pa.binary()), pa.array(count[:n])], names=names)

        for b in batches:
            doc_type = b.column("doc_id").type
            held = b.column("held_out").to_pylist()
            ids, lengths = [], []
            for t, out in zip(texts(b), held, strict=True):
                w = t.lower().split()       # bytes: lowers and splits on ASCII only
                w.append(END)
                one = np.array([number.setdefault(x, len(number)) for x in w], "<u4")
                if not out:
                    if len(number) > len(count):
                        count = np.r_[count, np.zeros(max(len(count), len(number) - len(count)), np.int64)]
                    np.add.at(count, one, 1)
                size += len(t)
                ids.append(zlib.compress(one.tobytes(), 1))
                lengths.append(len(one))
            if len(number) > len(count):
                count = np.r_[count, np.zeros(max(len(count), len(number) - len(count)), np.int64)]
            n = len(ids)
            none = pa.nulls(n)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.ones(n, np.int32)), pa.array(np.full(n, chunk)), b.column("doc_id"), b.column("held_out"), pa.array(lengths, pa.int64()),
                pa.array(ids, pa.binary()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64())], names=names)
            if size >= chunk_bytes:
                yield words()
                chunk, size = chunk + 1, 0
                number, count = {}, np.zeros(1 << 16, np.int64)
        if number:
            yield words()

    return base.mapInArrow(run, f"kind int, chunk long, doc_id {kind}, held_out boolean, n_tokens long, ids binary, number long, word binary, n long")


def train(vocabulary: DataFrame, path: str, steps: int = STEPS) -> np.ndarray:
    """Natural-log piece probabilities, the end symbol's last; vocabulary: word, c (END included).

    What reaches the driver is one number a piece of the public vocabulary.
    """
    pieces = _pieces(path)
    p = pieces.start
    ends = vocabulary.filter(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    words = vocabulary.filter((F.col("c") > 0) & (F.col("word") != F.lit(END)))
    for _ in range(steps):
        logp = np.log(np.maximum(p, 1e-300))[:, None]

        def run(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            own = _pieces(path)
            total = np.zeros(len(logp))
            for b in batches:
                total += expected_counts(own, b.column("word").to_pylist(), b.column("c").to_numpy().astype(float)[:, None], logp)[:, 0]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["piece", "n"])

        counts = np.zeros(pieces.size)
        for r in words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            counts[r["piece"]] = r["n"]
        counts += SMOOTHING * pieces.start
        p = counts / counts.sum()
        mass = counts.sum()
    end = (ends + 1.0) / (mass + ends + 1.0)
    return np.log(np.maximum(np.r_[p * (1.0 - end), end], 1e-300))


def scored_words(vocabulary: DataFrame, logp: np.ndarray, path: str) -> DataFrame:
    """word, c, lp (log10 marginal probability) of every distinct word, the end symbol included."""
    model = vocabulary.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for b in batches:
            words = b.column("word").to_pylist()
            lp = log_marginals(pieces, words, model.value[:-1, None])[:, 0]
            lp[[i for i, w in enumerate(words) if w == END]] = model.value[-1]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(lp / math.log(10))], names=["word", "c", "lp"])

    return vocabulary.mapInArrow(run, "word binary, c long, lp double")


#: Word rows packed together for their chunk.
PACK_ROWS = 1 << 20


def _packed(rows: DataFrame) -> DataFrame:
    """chunk, number, c, lp rows as few rows of arrays, one a chunk and task (or PACK_ROWS)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            chunk, number, c, lp = (np.concatenate([h[i] for h in held]) for i in range(4))
            order = np.argsort(chunk, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(chunk[order]) != 0, True])
            cut = [order[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([
                pa.array([int(chunk[i[0]]) for i in cut], pa.int64()), pa.array([number[i].astype("<u4").tobytes() for i in cut], pa.binary()),
                pa.array([c[i].astype("<i8").tobytes() for i in cut], pa.binary()), pa.array([lp[i].astype("<f8").tobytes() for i in cut], pa.binary())],
                names=["chunk", "numbers", "c", "lp"])

        for b in batches:
            if b.num_rows:
                held.append(tuple(b.column(x).to_numpy() for x in ("chunk", "number", "c", "lp")))
                size += b.num_rows
            if size >= PACK_ROWS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, "chunk long, numbers binary, c binary, lp binary")


def score(docs: DataFrame, path: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null or empty text is the end symbol alone. A null doc_id is held out. Repeated rows are scored
    each, and each counts in training. An empty table gives no rows; without training texts the
    model is the start weights. Very long texts are scored whole, and so is a very long word, block by
    block; other columns are not looked at, whatever their names.
    """
    path = path or vocabulary_path()
    lists = written(word_lists(docs, chunk_bytes), "word-lists")
    words = lists.filter("kind = 0").select("chunk", "number", "word", "n")
    vocabulary = written(words.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    model = scored_words(vocabulary, train(vocabulary, path), path)
    back = _packed(words.join(model, "word").select("chunk", "number", "c", "lp"))
    nothing = {"doc_id": docs.schema["doc_id"].dataType, "held_out": "boolean", "n_tokens": "long", "ids": "binary"}
    first = back.select("chunk", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], "numbers", "c", "lp")
    then = lists.filter("kind = 1").select("chunk", "kind", *nothing, *[F.lit(None).cast("binary").alias(c) for c in ("numbers", "c", "lp")])
    rows = first.union(then).repartition("chunk").sortWithinPartitions("chunk", "kind")
    base = math.log10(total + distinct + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, c, lp = None, [], None, None
        for b in batches:
            chunk, kind = b.column("chunk").to_numpy(), b.column("kind").to_numpy()
            out = []
            for i in range(b.num_rows):
                if chunk[i] != now:
                    now, parts, c, lp = chunk[i], [], None, None
                if kind[i] == 0:
                    parts.append([np.frombuffer(b.column(x)[i].as_py(), t) for x, t in (("numbers", "<u4"), ("c", "<i8"), ("lp", "<f8"))])
                    continue
                if c is None:
                    at = np.concatenate([p[0] for p in parts])
                    c, lp = np.zeros(len(at), np.int64), np.zeros(len(at))
                    c[at], lp[at] = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
                    plain, parts = np.log10(c + 1.0) - base, []
                ids = np.frombuffer(zlib.decompress(b.column("ids")[i].as_py()), "<u4")
                out.append((i, int((c[ids] > 0).sum()), float(plain[ids].sum()), float(lp[ids].sum())))
            at = pa.array([r[0] for r in out], pa.int64())
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(at), b.column("held_out").take(at), b.column("n_tokens").take(at), pa.array([r[1] for r in out], pa.int64()),
                pa.array([total] * len(out), pa.int64()), pa.array([r[2] for r in out], pa.float64()), pa.array([r[3] for r in out], pa.float64())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lm_score(docs: DataFrame, path: str | None = None) -> DataFrame:
    return score(docs, path)
