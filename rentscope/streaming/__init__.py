"""Structured Streaming jobs."""
from .ingest import ingest_snapshots
