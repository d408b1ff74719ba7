"""Quality rules with risk-controlled thresholds.

Every rule is a statistic of a text, and a document is rejected by a rule when its statistic is at
or over the cutoff. The cutoffs are chosen per stratum (bands of the word count) on labelled
documents: all rules are tightened together along one fixed sequence of cutoffs, and a step is
accepted while the exact (Clopper-Pearson) upper bound of the share of good documents that any rule
rejects there stays at or under ``alpha``. As the rejections of a stratum are nested, testing in
this order until the first failure needs no correction inside it (fixed-sequence testing); across
strata the confidence is Bonferroni-corrected, ``delta / strata``. With probability 1 - delta the
rules together therefore reject at most a share ``alpha`` of the good documents of every stratum. A
stratum with too few labels (under 203 good ones at the defaults, even if none is rejected)
certifies nothing, and its rules reject nothing.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Hashable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, texts, written

ALPHA, DELTA = 0.02, 0.05
#: Upper ends (exclusive) of the word-count bands that are the strata; the last is open.
BANDS = (200, 600)

_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_MORE = "n_pipe_words long, n_bang_words long, n_twin_words long"
_SYMBOLS = b"#*$%&|<>"
#: Deleted before counting code points in words: white space and UTF-8 continuation bytes.
_NO_POINT = bytes([0x20, *range(9, 14), *range(0x80, 0xC0)])

#: Cutoffs of all rules from lenient to strict; fixed before any label is seen.
GRID = tuple(round(1.0 - 0.05 * i, 2) for i in range(1, 19))
#: Rule and its statistic (as a share of the words).
RULES: dict[str, str] = {
    "symbols": "n_symbols",
    "repeats": "n_repeat_words",
    "dup_lines": "n_dup_lines",
    "pipes": "n_pipe_words",
    "shouting": "n_bang_words",
    "twins": "n_twin_words",
}


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside n-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, k in Counter(windows).items() if k > 1}
    count, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            count += i + n - max(i, end)
            end = i + n
    return count


def statistics(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text.translate(None, _NO_POINT)), len(text) - len(text.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words),
            words.count(b"|"), sum(1 for w in words if w.endswith(b"!!")),
            sum(1 for a, b in zip(words, words[1:], strict=False) if a == b))


_NAMES = [x.split()[0] for x in f"{_BASE}, {_MORE}".split(", ")]


def with_statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of docs (not named like a statistic) with the statistics of ``text``; null text: none."""
    small_batches(docs.sparkSession)
    carry = list(dict.fromkeys([*columns, "text"]))
    base = docs.select(*carry)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in columns), _BASE, _MORE])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in texts(b)]
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_NAMES))]
        return pa.RecordBatch.from_arrays([b.column(c) for c in columns] + cols, names=[*columns, *_NAMES])

    return map_batches(base, run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    c = F.lit(len(BANDS))
    for i, end in reversed(list(enumerate(BANDS))):
        c = F.when(F.col("n_words") < end, F.lit(i)).otherwise(c)
    return c


def ratio(stat: str) -> Column:
    return F.when(F.col("n_words") > 0, F.col(stat) / F.col("n_words")).otherwise(F.lit(0.0))


def worst() -> Column:
    """The largest statistic of a document: some rule rejects it where this is at or over the cutoff."""
    return F.greatest(*[ratio(stat) for stat in RULES.values()])


def upper_bound(k: int, n: int, confidence: float) -> float:
    """Exact one-sided Clopper-Pearson upper bound of a rate with k of n events."""
    if n == 0 or k >= n:
        return 1.0
    ways = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    def cdf(p: float) -> float:
        # for p over k / n the terms fall from k downwards, ever faster: some sqrt(k) of them count
        term = share = 1.0
        for i in range(k, 0, -1):
            term *= i * (1 - p) / ((n - i + 1) * p)
            share += term
            if term < 1e-18 * share:
                break
        return math.exp(ways + k * math.log(p) + (n - k) * math.log1p(-p)) * share

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid <= 0 or (mid < 1 and cdf(mid) > 1 - confidence):
            lo = mid if mid > 0 else lo
            if mid <= 0:
                break
        else:
            hi = mid
    return hi


def choose(counts: dict[Hashable, tuple[int, list[int]]], alpha: float = ALPHA, delta: float = DELTA) -> dict[Hashable, float]:
    """Stratum -> strictest accepted cutoff, from (good documents, those rejected at each step of GRID)."""
    out: dict[Hashable, float] = {}
    for s, (n, over) in counts.items():
        for cutoff, k in zip(GRID, over, strict=True):
            if upper_bound(k, n, 1 - delta / (len(BANDS) + 1)) > alpha:
                break
            out[s] = cutoff
    return out


def calibrate(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[int, float]:
    """Cutoffs from the labelled good documents that pass the base rules.

    Only (bands x cutoffs) counts reach the driver. Several labels of one document count
    once, by the lowest quality; null labels and ids are left out.
    """
    good = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
            .agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id"))
    held = stats.filter(~base_failed()).join(good, "doc_id", "left_semi")
    over = [F.sum(F.when(worst() >= c, 1).otherwise(0)).alias(f"over_{i}") for i, c in enumerate(GRID)]
    rows = held.groupBy(stratum().alias("s")).agg(F.count("*").alias("n"), *over).collect()
    return choose({r["s"]: (r["n"], [r[f"over_{i}"] for i in range(len(GRID))]) for r in rows}, alpha, delta)


def rejected(cutoffs: dict[int, float]) -> Column:
    c = F.lit(False)
    for s, cutoff in sorted(cutoffs.items()):
        c = c | ((stratum() == s) & (worst() >= cutoff))
    return c


def op6_quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row a document: base columns, base_failed, kept. Null or empty text fails the base.

    Repeated rows each get their row and the same verdict; very long texts are read whole; an empty
    table gives no rows, and without labels only the base rules reject. Other columns are not looked at.

    The statistics are taken once and written; the labels meet them, not the texts.
    """
    stats = written(with_statistics(docs, ["doc_id"]), "statistics")
    cutoffs = calibrate(stats, labels, alpha, delta)
    return (stats.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~rejected(cutoffs))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that pass, same columns (whatever their names)."""
    names = docs.columns
    cutoffs = calibrate(with_statistics(docs, ["doc_id"]), labels, alpha, delta)
    copy = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text"))
    kept = with_statistics(copy, [f"c{i}" for i in range(len(names))]).filter(~base_failed() & ~rejected(cutoffs))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
