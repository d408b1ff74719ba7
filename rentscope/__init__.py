"""rentscope — Spark-native analytics for marketplace snapshot data.

Every operator takes DataFrames and returns a DataFrame built from Spark SQL
functions, so the same code path runs on a test fixture and on a large table.

Layout:
  functions/  column expressions (cleaning casts, bands, rounding, text)
  operators/  DataFrame -> DataFrame operators (medians, shares, top-k, ...)
  sources/    CSV staging load, header contract, snapshots, mart writes
  plans/      named marts composed from operators, plus driver-table bindings
  streaming/  incremental snapshot ingest (Structured Streaming)
"""

__version__ = "0.1.0"
