"""Schemas of the snapshot files and the typed tables."""
from __future__ import annotations

from pyspark.sql import types as T

# The 90 columns of a listings snapshot file, in file order.
LISTING_RAW_COLUMNS = [
    "id", "listing_url", "scrape_id", "last_scraped", "source", "name", "description", "neighborhood_overview",
    "picture_url", "host_id", "host_url", "host_profile_id", "host_profile_url", "host_name", "host_since",
    "hosts_time_as_user_years", "hosts_time_as_user_months", "hosts_time_as_host_years", "hosts_time_as_host_months",
    "host_location", "host_about", "host_response_time", "host_response_rate", "host_acceptance_rate",
    "host_is_superhost", "host_thumbnail_url", "host_picture_url", "host_neighbourhood", "host_listings_count",
    "host_total_listings_count", "host_verifications", "host_has_profile_pic", "host_identity_verified",
    "neighbourhood", "neighbourhood_cleansed", "neighbourhood_group_cleansed", "latitude", "longitude",
    "property_type", "room_type", "accommodates", "bathrooms", "bathrooms_text", "bedrooms", "beds", "amenities",
    "price", "price_quote_checkin_date", "price_quote_checkout_date", "price_quote_total_price",
    "price_quote_price_per_night", "price_quote_raw", "minimum_nights", "maximum_nights", "minimum_minimum_nights",
    "maximum_minimum_nights", "minimum_maximum_nights", "maximum_maximum_nights", "minimum_nights_avg_ntm",
    "maximum_nights_avg_ntm", "calendar_updated", "has_availability", "availability_30", "availability_60",
    "availability_90", "availability_365", "calendar_last_scraped", "number_of_reviews", "number_of_reviews_ltm",
    "number_of_reviews_l30d", "availability_eoy", "number_of_reviews_ly", "estimated_occupancy_l365d",
    "estimated_revenue_l365d", "first_review", "last_review", "review_scores_rating", "review_scores_accuracy",
    "review_scores_cleanliness", "review_scores_checkin", "review_scores_communication", "review_scores_location",
    "review_scores_value", "license", "instant_bookable", "calculated_host_listings_count",
    "calculated_host_listings_count_entire_homes", "calculated_host_listings_count_private_rooms",
    "calculated_host_listings_count_shared_rooms", "reviews_per_month",
]

# Columns kept in the stacked multi-snapshot table.
LISTING_SLIM_COLUMNS = [
    "id", "name", "host_id", "host_is_superhost", "neighbourhood_cleansed", "property_type", "room_type",
    "accommodates", "bathrooms", "bedrooms", "beds", "price", "minimum_nights", "availability_30",
    "availability_60", "availability_90", "availability_365", "number_of_reviews", "reviews_per_month",
    "review_scores_rating", "calculated_host_listings_count", "estimated_occupancy_l365d",
    "estimated_revenue_l365d", "last_review", "first_review", "last_scraped",
]

CALENDAR_RAW_COLUMNS = ["listing_id", "date", "available", "minimum_nights"]
REVIEWS_RAW_COLUMNS = ["listing_id", "id", "date", "comments"]
REGISTRY_COLUMNS = ["registration_number", "ward_name", "property_type", "address", "unit", "postal_code"]


def all_string(columns) -> T.StructType:
    """Staging schema: every column text, so nothing is lost or guessed at load."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
