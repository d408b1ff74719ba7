"""Text expressions (X8, T1-T2): all built-in, whole texts, no UDF."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markup pattern and default token separator (lower-case ASCII words).
MARKUP = r"<[^>]+>"
NON_WORD = r"[^a-z]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count_spaces(c) -> Column:
    """Words as spaces + 1 (X8): 'a  b' counts 3; not a tokeniser on purpose."""
    c = _c(c)
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + F.lit(1)


def strip_markup(c) -> Column:
    return F.regexp_replace(_c(c), MARKUP, " ")


def tokens(c, separator: str = NON_WORD, min_len: int = 4) -> Column:
    """Lower-cased words of a whole text, markup removed, at least ``min_len`` long.

    Letter-run words (the default separator) are matched directly, inside generated code; only
    another separator splits and filters by a lambda."""
    if separator == NON_WORD and min_len > 0:
        return F.regexp_extract_all(F.lower(strip_markup(c)), F.lit(f"[a-z]{{{min_len},}}"), 0)
    parts = F.split(F.lower(strip_markup(c)), separator)
    return F.filter(parts, lambda w: F.length(w) >= min_len)


def word_line(c, min_len: int = 1) -> Column:
    """The words of a whole text (markup removed, lower-cased runs of a-z of at least
    ``min_len`` letters) joined by single spaces - the same words ``tokens`` gives."""
    t = F.regexp_replace(F.lower(strip_markup(c)), NON_WORD, " ")
    if min_len > 1:
        t = F.regexp_replace(F.regexp_replace(t, rf"\b[a-z]{{1,{min_len - 1}}}\b", " "), " +", " ")
    return F.trim(t)


def count_words(c, min_len: int = 1) -> Column:
    """How many words ``tokens`` gives (default separator), without an array."""
    return F.regexp_count(F.lower(strip_markup(c)), F.lit(f"[a-z]{{{max(1, min_len)},}}"))


def count_listed(line, words) -> Column:
    """How many words of a ``word_line`` are in the list."""
    listed = sorted({w for w in words if re.fullmatch("[a-z]+", w)})      # no other word can be in a line
    if not listed:
        return F.when(_c(line).isNotNull(), F.lit(0))
    return F.regexp_count(_c(line), F.lit(rf"\b(?:{'|'.join(listed)})\b"))


def line_bigrams(line) -> Column:
    """Adjacent pairs 'w1 w2' of a ``word_line``: one zero-width match per word that has
    a successor. Stays in generated code (no lambda), about 3x faster than ``bigrams``
    over a token array on 1 M documents, same pairs."""
    return F.regexp_extract_all(_c(line), F.lit(r"(?=\b([a-z]+ [a-z]+))"), 1)


def bigrams(words) -> Column:
    """Adjacent pairs 'w1 w2' of a word array; empty for fewer than two words."""
    w = _c(words)
    idx = F.sequence(F.lit(0), F.size(w) - 2)
    pairs = F.transform(idx, lambda i: F.concat_ws(" ", F.element_at(w, i + 1), F.element_at(w, i + 2)))
    return F.when(F.size(w) >= 2, pairs).otherwise(F.array().cast("array<string>"))
