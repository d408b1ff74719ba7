"""Registry marts D30-D33 and the write-up figures E1-E3."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pct, round_half_up as R, safe_ratio
from ..operators import mix, ratio_of_counts, rolling_sum, share_of_total, top_k, top_n_share
from . import market as M

# Property types counted as multi-unit in the write-up.
MULTI_UNIT_TYPES = ["Apartment", "Condominium"]
# Fixed value: registration numbers look like 'STR-YYMM-...'.
REG_PATTERN = r"^STR-(\d{2})(\d{2})-"


def d30_by_ward(registry: DataFrame) -> DataFrame:
    """Registrations by ward with share; NULL ward not shown but in the denominator."""
    return mix(registry, "ward_name", "registrations", "pct", drop_null_key=True)


def d31_by_type(registry: DataFrame) -> DataFrame:
    out = mix(registry, "property_type", "registrations", "pct", drop_null_key=True)
    return out.withColumn("multi_unit", F.col("property_type").isin(MULTI_UNIT_TYPES))


def d31_multi_unit_share(registry: DataFrame) -> DataFrame:
    """Share of registrations whose property type is a multi-unit type; one row."""
    return registry.agg(F.count(F.lit(1)).alias("registrations"),
                        R(pct(F.count_if(F.col("property_type").isin(MULTI_UNIT_TYPES)), F.count(F.lit(1))), 1)
                        .alias("multi_unit_pct"))


def d32_top_addresses(registry: DataFrame, k: int = 8) -> DataFrame:
    g = registry.where(F.col("address").isNotNull()).groupBy("address").agg(F.count(F.lit(1)).alias("registrations"))
    return top_k(g, [F.col("registrations").desc()], k, ["address"])


def d32_top_share(registry: DataFrame, key: str = "address", n: int = 8) -> DataFrame:
    return top_n_share(registry, key, n)


def d33_coverage(registry: DataFrame, listings: DataFrame, outside_count: int | None = None) -> DataFrame:
    """Registered / listed (upper bound on coverage), in %; with ``outside_count``
    (a figure published elsewhere, an argument) also registered / that count (E4)."""
    out = ratio_of_counts(registry, listings, "registered_per_listed_pct")
    if outside_count:
        out = out.withColumn("registered_per_outside_pct",
                             R(pct(F.col("numerator"), F.lit(float(outside_count))), 1))
    return out


def e1_profile(registry: DataFrame) -> DataFrame:
    g = M.distinct_profile(registry, {"distinct_numbers": "registration_number", "distinct_addresses": "address"}, "registrations",
                           {"with_unit": F.col("unit").isNotNull()})
    return g.select("registrations", "distinct_numbers", "distinct_addresses", "with_unit", (F.col("registrations") - F.col("distinct_numbers")).alias("duplicates"),
                    R(safe_ratio("registrations", "distinct_addresses"), 2).alias("per_address"),
                    R(pct(F.col("with_unit"), F.col("registrations")), 1).alias("pct_with_unit"))


def e2_postal_share(registry: DataFrame) -> DataFrame:
    """Largest postal area (first three characters) and its share."""
    g = registry.groupBy(F.upper(F.substring("postal_code", 1, 3)).alias("postal_area")) \
        .agg(F.count(F.lit(1)).alias("registrations"))
    total = g.agg(F.sum("registrations")).scalar()     # all rows, NULL area included
    g = share_of_total(g.where(F.col("postal_area").isNotNull()), "registrations", "pct", denominator=total)
    return top_k(g, [F.col("registrations").desc()], 1, ["postal_area"])


def e3_report(registry: DataFrame, run_months: int = 4) -> DataFrame:
    """Year shares, the strongest run of months and the earliest month of the number prefixes."""
    yy, mm = (F.regexp_extract("registration_number", REG_PATTERN, g).try_cast("int") for g in (1, 2))
    return M.cohort_report(registry, F.lit(2000) + yy, mm, run=run_months)


def e3_cohorts(registry: DataFrame, run_months: int = 4) -> DataFrame:
    """Issue-month cohorts parsed from the number prefix, with the rolling run."""
    yy = F.regexp_extract("registration_number", REG_PATTERN, 1)
    mm = F.regexp_extract("registration_number", REG_PATTERN, 2)
    y = (F.lit(2000) + yy.try_cast("int"))
    m = mm.try_cast("int")
    c = registry.where(yy != "").groupBy(F.date_format(F.make_date(y, m, F.lit(1)), "yyyy-MM").alias("cohort_month"),
                                         (y * 12 + m - 1).alias("idx")).agg(F.count(F.lit(1)).alias("registrations"))
    c = share_of_total(c, "registrations", "pct")
    return rolling_sum(c, "idx", "registrations", run_months, f"run_{run_months}m").orderBy("idx").drop("idx")
