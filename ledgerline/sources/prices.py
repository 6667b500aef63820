"""Price-list source: one JSON object keyed by model name -> price rows.

Entries are skipped when the key is ``sample_spec``, when the entry does not
decode into the rate struct (wrong types, not an object), or when the input,
output, cache-read and cache-write rates are all zero (the reasoning rate is
not part of that test). Missing rates read as 0.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.strict_json import OPTIONS
from ledgerline.schema import PRICE_ENTRY_FIELDS, RATE_COLUMNS
from ledgerline.session import cached_handle

SAMPLE_PRICES = str(Path(__file__).resolve().parent.parent / "data" / "prices_sample.json")

_ENTRY_DDL = ", ".join(f"{name} double" for name in PRICE_ENTRY_FIELDS) + ", _corrupt_record string"


def read_price_list(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Read a price-list JSON file (any Hadoop path) into price rows."""
    path = path or SAMPLE_PRICES
    return cached_handle(spark, ("prices", path),
                         lambda: parse_price_documents(spark.read.text(path, wholetext=True)))


def parse_price_documents(docs: DataFrame, column: str = "value") -> DataFrame:
    """Price rows from a DataFrame whose ``column`` holds whole JSON documents."""
    # A key that a document repeats counts once, with its last body.
    entries = docs.select(
        F.posexplode(F.from_json(F.col(column), "map<string,string>", {k: v for k, v in OPTIONS.items() if k.startswith("allow")})).alias("pos", "key", "body")
    ).filter(F.col("key") != F.lit("sample_spec"))
    entries = entries.groupBy("key").agg(F.max_by("body", "pos").alias("body"))
    decoded = entries.select(
        "key",
        F.from_json("body", _ENTRY_DDL, OPTIONS).alias("p"),
    )
    rates = [F.coalesce(F.col(f"p.{src}"), F.lit(0.0)).alias(dst) for src, dst in PRICE_ENTRY_FIELDS.items()]
    # A JSON null entry decodes to all-zero rates and falls to the filter below.
    out = decoded.filter(F.col("p._corrupt_record").isNull()).select("key", *rates)
    return out.filter(
        (F.col("input_rate") != 0)
        | (F.col("output_rate") != 0)
        | (F.col("cache_read_rate") != 0)
        | (F.col("cache_write_rate") != 0)
    ).select("key", *RATE_COLUMNS)
