"""Sources and sinks: CSV staging, header contract, snapshot tables, marts."""
from .csv import (HeaderMismatch, assert_header, clean_listings, read_calendar, read_header, read_listings_raw,
                  read_registry, read_reviews, read_staging, write_text_csv)
from .schemas import LISTING_RAW_COLUMNS, LISTING_SLIM_COLUMNS, all_string
from .tables import read_months, read_snapshot, read_table, write_mart, write_snapshot, write_stacked
from .versions import drop_superseded, read_live, read_manifest, read_versions, write_version
