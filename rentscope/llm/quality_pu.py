"""Quality classifier by positive-unlabelled learning.

Trusted positives are training documents labelled 1; the unlabelled set is drawn from all training
documents whatever their label. With the class prior p, estimated as the share of label 1 among the
labelled training documents, the non-negative risk

    p * E_pos[loss(+1)] + max(0, E_unl[loss(-1)] - p * E_pos[loss(-1)])

is minimised for a logistic model over binned text statistics; where the bracket turns negative its
gradient is reversed, which keeps the model from fitting the unlabelled positives as negatives.
Only bounded samples of statistics (SAMPLE rows each) reach the driver.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, map_batches, small_batches, texts
from .rules import statistics

FOLDS, HELD_OUT = 3, 1
#: Rows (about) drawn for each of the two samples that the model is fitted on.
SAMPLE = 20_000
BINS = 16
#: Full-batch steps, learning rate, weight decay, and the step back where the bracket is negative.
STEPS, RATE, DECAY, BACK = 800, 0.05, 1e-4, 1.0
FEATURES = ("words", "word_chars", "symbols", "dup_lines", "repeats", "pipes", "bangs", "twins", "upper", "digits", "punctuation", "distinct", "wide")

_UPPER, _DIGIT = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
_PUNCT = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_WIDE = bytes(range(0xC0, 0x100))


def features(text: bytes) -> list[float]:
    """Statistics of a whole text, most as shares of its words or characters; empty text: zeros."""
    n, chars, symbols, dup, repeats, pipes, bangs, twins = statistics(text)
    if not n:
        return [0.0] * len(FEATURES)
    share = lambda some: (len(text) - len(text.translate(None, some))) / max(chars, 1)
    return [float(np.log1p(n)), chars / n, symbols / n, dup / (text.count(b"\n") + 1), repeats / n, pipes / n, bangs / n, twins / n,
            share(_UPPER), share(_DIGIT), share(_PUNCT), len(set(text.split())) / n, share(_WIDE)]


def with_features(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of docs and x, the statistics of ``text``."""
    small_batches(docs.sparkSession)
    base = docs.select(*list(dict.fromkeys([*columns, "text"])))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([features(t) for t in texts(b)], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [x], names=[*columns, "x"])

    return map_batches(base, run, ", ".join([*(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in columns), "x array<double>"]))


class Model:
    """Additive logistic model over binned features."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.first = np.cumsum([0, *(len(e) + 1 for e in edges)])
        self.weights, self.bias = np.zeros(self.first[-1]), 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([f + np.searchsorted(e, x[:, j], "right") for j, (e, f) in enumerate(zip(self.edges, self.first[:-1], strict=True))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.weights[self.bins(x)].sum(1) + self.bias, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative risk by full-batch Adam. Without positives or unlabelled rows the
    model is the prior alone."""
    both = np.concatenate([positive, unlabelled])
    edges = [np.unique(np.r_[np.quantile(both[:, j], np.arange(1, BINS) / BINS), np.quantile(unlabelled[:, j], [0.97, 0.98, 0.99])]) if len(unlabelled) else np.empty(0)
             for j in range(len(FEATURES))]
    model = Model(edges)
    model.bias = float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return model
    p, u = model.bins(positive), model.bins(unlabelled)
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    size = model.first[-1]

    def gradient(at: np.ndarray, by_row: np.ndarray) -> tuple[np.ndarray, float]:
        w = np.repeat(by_row / len(at), at.shape[1])
        return np.bincount(at.ravel(), w, size), float(by_row.mean())

    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        zp, zu = model.weights[p].sum(1) + model.bias, model.weights[u].sum(1) + model.bias
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()      # E_u[loss(-1)] - p E_p[loss(-1)]
        gp, bp = gradient(p, prior * (sp - 1.0))
        gu, bu = gradient(u, su)
        gn, bn = gradient(p, prior * sp)
        sign = 1.0 if negative >= 0 else -BACK
        keep = 1.0 if negative >= 0 else 0.0        # where the bracket is negative only it is stepped back
        g = np.r_[keep * gp + sign * (gu - gn) + DECAY * model.weights, keep * bp + sign * (bu - bn)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        model.weights -= move[:-1]
        model.bias -= float(move[-1])
    return model


#: Hashes of rows are compared in so many bits, so a share stays exact for any number of rows.
SHARE_BITS = 62


def threshold(rows: int, n: int) -> int:
    """Hashes below it are about ``rows`` of n: all of them if there are no more, never none."""
    return (1 << SHARE_BITS) * min(rows, max(n, 1)) // max(n, 1)


def _sample(docs: DataFrame, rows: int, n: int) -> np.ndarray:
    """Features of about ``rows`` of the n rows of docs, chosen by a hash of id and text (the texts
    of a repeated id are chosen one by one)."""
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << SHARE_BITS)) < threshold(rows, n)
    got = with_features(docs.filter(share).select("doc_id", "text"), ["doc_id"]).select("doc_id", "x").collect()
    got.sort(key=lambda r: (str(r["doc_id"]), r["x"]))
    return np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Several labels of one document count once, by the lowest quality; null ids and labels are
    left out. Nothing is read of the labels outside the training folds."""
    marked = (labels.filter(~in_fold("doc_id", FOLDS, HELD_OUT) & F.col("quality").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    total, good = marked.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    prior = min(0.95, max(0.05, good / total)) if total else 0.5
    learn = docs.filter(~in_fold("doc_id", FOLDS, HELD_OUT))
    positive = learn.join(marked.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return fit(_sample(positive, sample, good), _sample(learn, sample, learn.count()), prior)


def op4_quality_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Null or empty text has the score of
    a text without words; a null doc_id is held out. Repeated rows have equal scores, very long texts
    are read whole, an empty table gives no rows, and without labels the score is the prior 0.5; other
    columns are not looked at, whatever their names."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in texts(b)], float).reshape(-1, len(FEATURES))
        s = model.value.score(x)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                          names=["doc_id", "held_out", "score", "predicted"])

    return map_batches(docs.select("doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "text"), run,
                       f"doc_id {kind}, held_out boolean, score double, predicted int")
