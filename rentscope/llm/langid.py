"""Language identification by segmentation-marginalised unigrams.

Each language has a unigram model over the pieces of a fixed public vocabulary. The models are
estimated from expected piece counts over all segmentations of all labelled texts outside the
held-out fold, so every language with such a text has a model, however rare it is. Counts belong to
words: tasks count the words of their texts, and each distinct word of a language is weighed once.
A text is scored under each by the forward algorithm, which sums all its segmentations. The
posterior of the best language is the score.

Words are scored once per Python worker, which keeps a bounded number of them; only word counts
are shuffled, never texts, so a hot language or source costs nothing extra. Languages are handled in blocks of
bounded size, chained as narrow stages.
"""
from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, small_batches, texts
from .lattice import Pieces, expected_counts, log_marginals, vocabulary_path

FOLDS, HELD_OUT = 5, 0
#: Languages scored together: the models of a block are broadcast (32,000 numbers each).
BLOCK_LANGUAGES = 64
#: Background counts that smooth each language's pieces.
SMOOTHING = 500.0
#: Words whose scores a worker keeps, and words counted or weighed by a task before it hands on.
CACHE_WORDS = 500_000
UNKNOWN = "und"

_WORKER: dict = {}
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _pieces(path: str) -> Pieces:
    if _WORKER.get("path") != path:
        _WORKER.update(path=path, pieces=Pieces(path))
    return _WORKER["pieces"]


def _scores(key: str, split: list[list[bytes]], path: str, logp: np.ndarray) -> tuple[dict[bytes, int], np.ndarray]:
    """Row numbers of the words and their scores under the models ``key``; a bounded number of
    words stays with the worker."""
    caches = _WORKER.setdefault("caches", {})
    if key not in caches and len(caches) >= 4 or key in caches and len(caches[key][0]) > CACHE_WORDS:
        caches.pop(key if key in caches else next(iter(caches)))
    known, rows = caches.get(key, ({}, np.zeros((0, logp.shape[1]))))
    new = list({w for ws in split for w in ws if w not in known})
    if new:
        rows = np.r_[rows, log_marginals(_pieces(path), new, logp)]
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
    caches[key] = known, rows
    return known, rows


def has_letter(words: list[bytes]) -> bool:
    return any(_ASCII_LETTER.search(w) or not w.isascii() and any(c.isalpha() for c in w.decode("utf-8", "replace")) for w in words)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all rows outside the held-out fold with a language and a text."""
    small_batches(docs.sparkSession)
    labelled = docs.filter(~in_fold("doc_id", FOLDS, HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()),
                                                  pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])
            seen.clear()

        for b in batches:
            for t, lang in zip(texts(b), b.column("lang").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(t.lower().split())
            if sum(map(len, seen.values())) > CACHE_WORDS:
                yield from out()
        yield from out()

    return (labelled.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, word binary, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, path: str) -> dict[str, np.ndarray]:
    """Language -> natural-log piece probabilities, from rows outside the held-out fold with a
    language and a text. The driver receives one number per language and piece."""
    start = _pieces(path).start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logp = _pieces(path), np.log(np.maximum(start, 1e-300))[:, None]
        held: dict[str, tuple[list[bytes], list[int]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (words, n) in held.items():
                total = expected_counts(pieces, words, np.array(n, float)[:, None], logp)[:, 0]
                at = np.flatnonzero(total > 1e-6)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at])], names=["lang", "piece", "n"])
            held.clear()

        for b in batches:
            for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                words, counts = held.setdefault(lang, ([], []))
                words.append(word)
                counts.append(n)
            size += b.num_rows
            if size > CACHE_WORDS:
                yield from out()
                size = 0
        yield from out()

    counts: dict[str, np.ndarray] = {}
    rows = word_counts(docs).mapInArrow(run, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    for r in rows.toLocalIterator():
        counts.setdefault(r["lang"], np.zeros(len(start)))[r["piece"]] = r["n"]
    if not counts:
        return {}
    background = sum(counts.values()) + 100.0 * start
    background = background / background.sum()
    return {lang: np.log(np.maximum((c + SMOOTHING * background) / (c.sum() + SMOOTHING), 1e-300)) for lang, c in sorted(counts.items())}


def predict(docs: DataFrame, models: dict[str, np.ndarray], path: str, columns: list[str], block: int = BLOCK_LANGUAGES) -> DataFrame:
    """``columns`` of docs with lang_pred and score (the posterior under equal priors).

    Text without a letter (or null) is ``und`` with score 0, and so is every text if no language
    was learned. Equal likelihoods go to the language first in the alphabet. Repeated rows are
    predicted each, very long texts and words whole; an empty table gives no rows. A column of docs
    named like an added one must not be among ``columns``; others are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(*list(dict.fromkeys([*columns, "text"])))
    carry = list(base.columns)
    out = base.withColumns({"_lang": F.lit(None).cast("string"), "_best": F.lit(None).cast("double"), "_all": F.lit(None).cast("double")})
    schema, names = out.schema, sorted(models)
    for at in range(0, len(names), block):
        part = names[at:at + block]
        model = spark.sparkContext.broadcast((part, np.stack([models[x] for x in part], 1)))

        def run(b: pa.RecordBatch, model=model, key=uuid.uuid4().hex) -> pa.RecordBatch:
            part, logp = model.value
            split = [t.lower().split() for t in texts(b)]
            known, rows = _scores(key, split, path, logp)
            lang, best, every = [], [], []
            for ws, was, top, total in zip(split, *(b.column(c).to_pylist() for c in ("_lang", "_best", "_all")), strict=True):
                if not has_letter(ws):
                    lang.append(None)
                    best.append(None)
                    every.append(None)
                    continue
                log = rows[[known[w] for w in ws]].sum(0)
                i = int(log.argmax())
                here = float(np.logaddexp.reduce(log))
                if was is None or log[i] > top:
                    was, top = part[i], float(log[i])
                lang.append(was)
                best.append(top)
                every.append(here if total is None else float(np.logaddexp(total, here)))
            cols = [b.column(c) for c in carry] + [pa.array(lang, pa.string()), pa.array(best, pa.float64()), pa.array(every, pa.float64())]
            return pa.RecordBatch.from_arrays(cols, names=[*carry, "_lang", "_best", "_all"])

        def chain(batches: Iterator[pa.RecordBatch], run=run) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield run(b)

        out = out.mapInArrow(chain, schema)
    return out.select(*columns, F.coalesce("_lang", F.lit(UNKNOWN)).alias("lang_pred"),
                      F.when(F.col("_lang").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("_best") - F.col("_all")))).alias("score"))


def op7_language_id(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score. A null doc_id is held out."""
    path = path or vocabulary_path()
    models = fit(docs, path)
    return (predict(docs, models, path, ["doc_id"]).withColumn("held_out", in_fold("doc_id", FOLDS, HELD_OUT))
            .select("doc_id", "held_out", "lang_pred", "score"))
