"""Table layouts of the landed inputs and the raw store."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Source labels, as used in the store's partition folders.
SOURCE_A = "nofluff"
SOURCE_B = "justjoin"
# Requested page sizes; source B never asks for more than 100 per call.
DEFAULT_PAGE_SIZE_A = 20
DEFAULT_PAGE_SIZE_B = 100
MAX_ITEMS_B = 100
# ---------------------------------------------------------------------------

LANDED_PAGES = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("page", T.IntegerType()),          # page number (source A)
    T.StructField("cursor", T.LongType()),           # request offset (source B)
    T.StructField("items_count", T.IntegerType()),   # items asked for (source B)
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("body", T.StringType()),
])

LANDED_DETAILS = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("job_slug", T.StringType(), False),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("body", T.StringType()),
    T.StructField("error", T.StringType()),
])

SECTIONS = T.StructType([
    T.StructField("must_have", T.ArrayType(T.StringType())),
    T.StructField("requirements_description", T.StringType()),
    T.StructField("offer_description", T.StringType()),
])

RAW_POSTINGS = T.StructType([
    T.StructField("source_id", T.StringType(), False),
    T.StructField("job_slug", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("listing", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("sections", SECTIONS),
    T.StructField("run_id", T.StringType()),
    T.StructField("source", T.StringType(), False),   # partition column
    T.StructField("ingest_date", T.DateType(), False),  # partition column
])

QUARANTINE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("cursor", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("body", T.StringType()),
])
