"""CASE banding."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band(c, uppers: Sequence, labels: Sequence[str], else_label: str,
         null_label: str | None = None, strict: bool = False) -> Column:
    """Label by ordered upper bounds: first ``c <= upper`` (``<`` if strict) wins.

    Without ``null_label`` a NULL value falls through to ``else_label``, exactly
    as a CASE without a NULL arm does.
    """
    c = _c(c)
    if len(uppers) != len(labels):
        raise ValueError("uppers and labels differ in length")
    expr = None
    if null_label is not None:
        expr = F.when(c.isNull(), F.lit(null_label))
    for u, lab in zip(uppers, labels):
        cond = (c < u) if strict else (c <= u)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return F.lit(else_label) if expr is None else expr.otherwise(F.lit(else_label))


def band_order(label_col, labels: Sequence[str]) -> Column:
    """Position of a band label in a caller-given order (unknown labels last)."""
    c = _c(label_col)
    expr = None
    for i, lab in enumerate(labels):
        expr = F.when(c == lab, F.lit(i)) if expr is None else expr.when(c == lab, F.lit(i))
    return expr.otherwise(F.lit(len(labels)))


def label_flag(c, true_label: str, false_label: str, null_label: str) -> Column:
    """1 / 0 / anything else (incl. NULL) -> three labels."""
    c = _c(c)
    return F.when(c == 1, F.lit(true_label)).when(c == 0, F.lit(false_label)) \
        .otherwise(F.lit(null_label))
