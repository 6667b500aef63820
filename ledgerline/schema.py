"""Schemas of the usage-event fact table, the ingest manifest and prices.

``ts`` is a ``TIMESTAMP_NTZ`` holding the UTC wall-clock instant truncated to
the second, so no result depends on the session time zone; "local" day keys
take an explicit zone (see ``functions.timecols.day_key``).
"""

from pyspark.sql import types as T

TOKEN_CLASSES = ["input", "output", "cache_read", "cache_write", "reasoning"]

USAGE = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("dedup_key", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("model", T.StringType(), True),
        T.StructField("session_id", T.StringType(), True),
        T.StructField("project", T.StringType(), True),
        T.StructField("input", T.LongType(), False),
        T.StructField("output", T.LongType(), False),
        T.StructField("cache_read", T.LongType(), False),
        T.StructField("cache_write", T.LongType(), False),
        T.StructField("reasoning", T.LongType(), False),
        T.StructField("raw_cost", T.DoubleType(), True),
    ]
)
USAGE_COLUMNS = [f.name for f in USAGE.fields]

# Stored usage tables carry a day partition column next to USAGE.
PARTITION_COLUMN = "dt"

MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("mtime", T.TimestampNTZType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("state", T.StringType(), True),
        T.StructField("updated_at", T.TimestampNTZType(), True),
    ]
)

RATE_COLUMNS = ["input_rate", "output_rate", "cache_read_rate", "cache_write_rate", "reasoning_rate"]

PRICES = T.StructType(
    [T.StructField("key", T.StringType(), False)]
    + [T.StructField(c, T.DoubleType(), False) for c in RATE_COLUMNS]
)

# Field names of one entry of a price-list JSON object (fixed values: the
# public price-list format the engine reads).
PRICE_ENTRY_FIELDS = {
    "input_cost_per_token": "input_rate",
    "output_cost_per_token": "output_rate",
    "cache_read_input_token_cost": "cache_read_rate",
    "cache_creation_input_token_cost": "cache_write_rate",
    "output_cost_per_reasoning_token": "reasoning_rate",
}

REPORT_COLUMNS = [
    "key", "input", "output", "cache_read", "cache_write", "reasoning",
    "total", "events", "raw_cost", "cost", "unpriced_events",
]
