"""Lenient text -> typed casts.

Spark runs with ANSI mode on: ``cast('3.0' as int)`` and ``cast('Shared' as
double)`` raise. The source data was typed with a permissive engine that reads
the longest numeric prefix and gives 0 when there is none, so these casts parse
the prefix explicitly and only then cast.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: the numeric prefix an all-text value is read by.
_INT_PREFIX = r"^\s*([+-]?[0-9]+)"
_REAL_PREFIX = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """'' -> NULL."""
    c = _c(c)
    return F.nullif(c, F.lit(""))


def _prefix_cast(c: Column, pattern: str, typ: str, zero) -> Column:
    # regexp_extract yields '' when there is no match: text without digits -> 0.
    p = F.regexp_extract(c, pattern, 1)
    return F.when(c.isNull(), F.lit(None).cast(typ)).when(p == "", F.lit(zero).cast(typ)) \
        .otherwise(p.try_cast(typ))


def to_int(c, typ: str = "long") -> Column:
    """Lenient integer cast (N2): numeric prefix, '3.0' -> 3, 'abc' -> 0, '' -> NULL."""
    return _prefix_cast(blank_to_null(c), _INT_PREFIX, typ, 0)


def to_double(c) -> Column:
    """Lenient real cast (N3): numeric prefix, no prefix -> 0.0, '' -> NULL."""
    return _prefix_cast(blank_to_null(c), _REAL_PREFIX, "double", 0.0)


def flag(c, true_value: str = "t", false_value: str = "f") -> Column:
    """'t'/'f' -> 1/0, anything else (blank, NULL, other) -> NULL."""
    c = _c(c)
    return F.when(c == true_value, F.lit(1)).when(c == false_value, F.lit(0)) \
        .otherwise(F.lit(None).cast("int"))


def money(c) -> Column:
    """Currency text '$1,449.89' -> 1449.89; blank -> NULL."""
    c = _c(c)
    return to_double(F.regexp_replace(c, r"[$,]", ""))


def leading_number(c) -> Column:
    """Number before the first space: '2.5 baths' -> 2.5.

    A phrase without a space ('Half-bath') or without a leading number
    ('Shared half-bath') gives 0.0; blank and NULL give NULL.
    """
    c = _c(c)
    head = F.when(F.instr(c, " ") > 0, F.substring_index(c, " ", 1)).otherwise(F.lit(""))
    parsed = F.regexp_extract(head, _REAL_PREFIX, 1)
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("double")) \
        .when(parsed == "", F.lit(0.0)).otherwise(parsed.try_cast("double"))


def iso_date(c) -> Column:
    """ISO date text -> DATE, anything unparsable or blank -> NULL."""
    c = blank_to_null(c)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c.try_cast("date"))
