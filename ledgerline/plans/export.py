"""Report sinks: CSV with a fixed header and micro-dollar cost text; JSON lines
with ``raw_cost`` / ``unpriced_events`` omitted when zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.schema import TOKEN_CLASSES

CSV_TEXT = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false"}
CSV_COLUMNS = ["key", *TOKEN_CLASSES, "total", "events", "cost", "unpriced_events"]


def csv_rows(lines: DataFrame) -> DataFrame:
    """Report lines as the CSV's text columns (cost as %.6f)."""
    return lines.select(
        *[F.col(c).cast("string").alias(c) for c in CSV_COLUMNS if c != "cost"],
        F.format_string("%.6f", F.col("cost")).alias("cost"),
    ).select(*CSV_COLUMNS)


def write_csv(lines: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV files in the lines' order, each with a header; RFC 4180 text (quotes doubled, spaces and '' kept).

    ``single_file`` writes one file, for reports whose key is known to be small
    (tools, models, days); by default the lines stay in their partitions.
    """
    rows = csv_rows(lines)
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").options(**CSV_TEXT).csv(path)


def json_rows(lines: DataFrame) -> DataFrame:
    """(key, json): report lines as JSON objects; zero raw_cost / unpriced_events are left out."""
    cols = [c for c in lines.columns]
    fields = []
    for c in cols:
        if c == "raw_cost":
            fields.append(F.when(F.col(c) != 0, F.col(c)).alias(c))
        elif c == "unpriced_events":
            fields.append(F.when(F.col(c) != 0, F.col(c)).alias(c))
        else:
            fields.append(F.col(c))
    return lines.select("key", F.to_json(F.struct(*fields)).alias("json"))


def write_json(lines: DataFrame, path: str) -> None:
    json_rows(lines).select("json").write.mode("overwrite").text(path)
