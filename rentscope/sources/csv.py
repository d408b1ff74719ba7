"""CSV staging loads, header contract and typed loads."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import blank_to_null, flag, iso_date, leading_number, money, to_double, to_int
from .schemas import (CALENDAR_RAW_COLUMNS, LISTING_RAW_COLUMNS, REGISTRY_COLUMNS, REVIEWS_RAW_COLUMNS,
                      all_string)


class HeaderMismatch(ValueError):
    """The file's header differs from the known-good snapshot header."""


def _reader(spark: SparkSession, columns: Sequence[str], multiline: bool = True):
    # multiLine keeps quoted line breaks; escape '"' reads doubled quotes. gzip is
    # decompressed transparently (one task per .gz file - repartition after).
    return (spark.read.schema(all_string(columns)).option("header", True)
            .option("multiLine", multiline).option("escape", '"').option("mode", "FAILFAST")
            .option("enforceSchema", False))       # every file's header is compared with the columns


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line(s) of ``path`` (no data rows are typed)."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
        .option("inferSchema", False).csv(path)
    return list(df.columns)


def assert_header(actual: Sequence[str], expected: Sequence[str] = LISTING_RAW_COLUMNS) -> None:
    """Exact header equality (names, order, count), else stop."""
    if list(actual) != list(expected):
        missing = [c for c in expected if c not in actual]
        extra = [c for c in actual if c not in expected]
        raise HeaderMismatch(f"header differs: {len(actual)} vs {len(expected)} columns; "
                             f"missing={missing[:5]} extra={extra[:5]}")


def read_staging(spark: SparkSession, path: str, columns: Sequence[str], *, check_header: bool = True,
                 multiline: bool = True) -> DataFrame:
    """All-text staging read of a snapshot file set (S1-S3): every column a string,
    quoted commas, doubled quotes and line breaks kept, gzip read transparently.
    With ``check_header`` the header must equal ``columns`` exactly (S2)."""
    if check_header:
        assert_header(read_header(spark, path), columns)
    return _reader(spark, columns, multiline).csv(path)


def read_listings_raw(spark: SparkSession, path: str, check_header: bool = True) -> DataFrame:
    """All-text staging read of a listings snapshot."""
    return read_staging(spark, path, LISTING_RAW_COLUMNS, check_header=check_header)


def write_text_csv(df: DataFrame, path: str, *, compression: str = "gzip") -> None:
    """Write every column as text in the snapshot file format the staging read
    expects: header line, RFC 4180 quoting (quotes doubled), values kept as they
    are (Spark trims surrounding spaces on CSV write unless told not to)."""
    (df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.mode("overwrite")
       .option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("compression", compression).csv(path))


def clean_listings(raw: DataFrame) -> DataFrame:
    """90 text columns -> the 32 typed analysis columns."""
    c = F.col
    return raw.select(
        to_int("id", "long").alias("id"), blank_to_null("name").alias("name"),
        iso_date("last_scraped").alias("last_scraped"), to_int("host_id", "long").alias("host_id"),
        blank_to_null("host_name").alias("host_name"), iso_date("host_since").alias("host_since"),
        flag("host_is_superhost").alias("host_is_superhost"),
        to_int("host_listings_count").alias("host_listings_count"),
        blank_to_null("neighbourhood").alias("neighbourhood"),
        blank_to_null("neighbourhood_cleansed").alias("neighbourhood_cleansed"),
        to_double("latitude").alias("latitude"), to_double("longitude").alias("longitude"),
        blank_to_null("property_type").alias("property_type"), blank_to_null("room_type").alias("room_type"),
        to_int("accommodates").alias("accommodates"), leading_number(c("bathrooms_text")).alias("bathrooms"),
        to_double("bedrooms").alias("bedrooms"), to_double("beds").alias("beds"),
        money("price").alias("price"), to_int("minimum_nights").alias("minimum_nights"),
        to_int("availability_30").alias("availability_30"), to_int("availability_60").alias("availability_60"),
        to_int("availability_90").alias("availability_90"), to_int("availability_365").alias("availability_365"),
        to_int("number_of_reviews").alias("number_of_reviews"), to_double("reviews_per_month").alias("reviews_per_month"),
        iso_date("first_review").alias("first_review"), iso_date("last_review").alias("last_review"),
        to_double("review_scores_rating").alias("review_scores_rating"),
        to_int("estimated_occupancy_l365d").alias("estimated_occupancy_l365d"),
        to_double("estimated_revenue_l365d").alias("estimated_revenue_l365d"),
        to_int("calculated_host_listings_count").alias("calculated_host_listings_count"),
    )


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Forward calendar: listing x day, 't'/'f' -> 1/0 (S8). Single-line CSV: splittable."""
    raw = _reader(spark, CALENDAR_RAW_COLUMNS, multiline=False).csv(path)
    return raw.select(to_int("listing_id", "long").alias("listing_id"), iso_date("date").alias("date"),
                      flag("available").alias("available"), to_int("minimum_nights").alias("minimum_nights"))


def read_reviews(spark: SparkSession, path: str, since: str | None = "2023-01-01") -> DataFrame:
    """Review log with a retention cut ``date >= since``."""
    raw = _reader(spark, REVIEWS_RAW_COLUMNS).csv(path)
    out = raw.select(to_int("id", "long").alias("id"), to_int("listing_id", "long").alias("listing_id"),
                     iso_date("date").alias("date"), F.col("comments"))
    return out.where(F.col("date") >= F.lit(since).cast("date")) if since else out


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry of active registrations (S10), explicit schema instead of inference."""
    return _reader(spark, REGISTRY_COLUMNS).csv(path).select(*[blank_to_null(c).alias(c) for c in REGISTRY_COLUMNS])
