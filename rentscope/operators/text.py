"""Text signals over whole texts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.text import (NON_WORD, bigrams, count_listed, count_words, line_bigrams, tokens, word_count_spaces,
                              word_line)
from .partitioning import spread
from .topk import top_k_per_group

# Default English stop words (our own list; the source's list is not given).
STOP_WORDS = (
    "about after again also because been before being between both could does doing down during "
    "each from further have having here into just more most once only other over same should some "
    "such than that their theirs them then there these they this those through under until very "
    "were what when where which while whom will with would your yours"
).split()

# Small sentiment lexicons (our own lists; the source's lists are not given).
POSITIVE_WORDS = ("good great excellent clean comfortable friendly helpful lovely nice perfect "
                  "quiet beautiful amazing wonderful recommend").split()
NEGATIVE_WORDS = ("bad dirty noisy rude broken poor terrible awful small smell problem issue "
                  "cold uncomfortable disappointing").split()


def words(df: DataFrame, text: str, group: Sequence[str], *, separator: str = NON_WORD,
          min_len: int = 4, stop_words: Sequence[str] = STOP_WORDS, partitions: int | None = None) -> DataFrame:
    """One row per word occurrence (group..., word); stop words removed. ``partitions`` deals the texts
    out first (see ``partitioning.spread``)."""
    src = spread(df.select(*group, text), partitions)
    w = src.select(*group, F.explode(tokens(text, separator, min_len)).alias("word"))
    if stop_words:
        w = w.where(~F.col("word").isin(list(stop_words)))
    return w


def word_top(df: DataFrame, text: str, group: Sequence[str], k: int = 100, **kw) -> DataFrame:
    """Top-k words per group with rank (T1/T4); ties by word."""
    cnt = words(df, text, group, **kw).groupBy(*group, "word").agg(F.count(F.lit(1)).alias("count"))
    return top_k_per_group(cnt, group, [F.col("count").desc(), F.col("word").asc()], k)


def bigram_top(df: DataFrame, text: str, group: Sequence[str], k: int = 20, *,
               separator: str = NON_WORD, min_len: int = 1, partitions: int | None = None) -> DataFrame:
    """Top-k adjacent word pairs per group (T2); pairs never cross documents."""
    src = spread(df.select(*group, text).where(F.col(text).isNotNull()), partitions)
    if separator == NON_WORD:
        # letter-run words: pairs straight from the word line, inside generated code
        pairs = src.select(*group, F.explode(line_bigrams(word_line(text, min_len))).alias("bigram"))
    else:
        toks = src.select(*group, tokens(text, separator, min_len).alias("__w"))
        toks = toks.select(*group, F.filter("__w", lambda x: F.length(x) > 0).alias("__w"))
        pairs = toks.select(*group, F.explode(bigrams("__w")).alias("bigram"))
    cnt = pairs.groupBy(*group, "bigram").agg(F.count(F.lit(1)).alias("count"))
    return top_k_per_group(cnt, group, [F.col("count").desc(), F.col("bigram").asc()], k)


def lexicon_rate(df: DataFrame, text: str, group: Sequence[str], *,
                 positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS,
                 separator: str = NON_WORD, min_len: int = 1, per: float = 1000.0,
                 digits: int = 3, partitions: int | None = None) -> DataFrame:
    """Positive / negative word rate per ``per`` words (T3), one pass.

    Word counts per text are computed in-row: letter-run words by counting matches
    on the word line, inside generated code, other separators with array functions. No word
    row is materialised; the group aggregate is a partial sum.
    """
    # NULL texts are skipped up front: with ANSI off, size(NULL) would count -1 words
    src = spread(df.select(*group, text).where(F.col(text).isNotNull()), partitions)
    if separator == NON_WORD:
        line = src.select(*group, word_line(text, min_len).alias("__l"))
        per_doc = line.select(*group, count_words("__l", min_len).alias("__n"),
                              count_listed("__l", positive).alias("__p"), count_listed("__l", negative).alias("__q"))
    else:
        toks = src.select(*group, tokens(text, separator, min_len).alias("__w"))
        toks = toks.select(*group, F.filter("__w", lambda x: F.length(x) > 0).alias("__w"))
        pos, neg = F.array(*[F.lit(w) for w in positive]), F.array(*[F.lit(w) for w in negative])
        per_doc = toks.select(*group, F.size("__w").alias("__n"),
                              F.size(F.filter("__w", lambda x: F.array_contains(pos, x))).alias("__p"),
                              F.size(F.filter("__w", lambda x: F.array_contains(neg, x))).alias("__q"))
    g = per_doc.groupBy(*group).agg(F.sum("__n").cast("long").alias("words"),
                                    F.sum("__p").cast("long").alias("positive"),
                                    F.sum("__q").cast("long").alias("negative"))
    rate = lambda c: round_half_up(F.try_divide(F.col(c) * F.lit(per), F.col("words").cast("double")), digits)
    return g.withColumn("positive_rate", rate("positive")).withColumn("negative_rate", rate("negative"))


def mean_words(df: DataFrame, text: str, group: Sequence[str], alias: str = "avg_words",
               digits: int = 1) -> DataFrame:
    """Mean space-counted words per group over non-blank texts."""
    ok = F.col(text).isNotNull() & (F.length(F.trim(F.col(text))) > 0)
    return (df.where(ok).groupBy(*group)
              .agg(round_half_up(F.avg(word_count_spaces(text)), digits).alias(alias)))
