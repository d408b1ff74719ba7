"""Column-level functions (JVM-side Spark SQL expressions; no Python UDFs)."""
from .cleaning import blank_to_null, flag, iso_date, leading_number, money, to_double, to_int
from .numeric import pct, round_half_up, safe_ratio
from .bands import band, band_order, label_flag
from .text import strip_markup, tokens, word_count_spaces, bigrams

__all__ = [
    "blank_to_null", "flag", "iso_date", "leading_number", "money", "to_double", "to_int",
    "pct", "round_half_up", "safe_ratio", "band", "band_order", "label_flag",
    "strip_markup", "tokens", "word_count_spaces", "bigrams",
]
