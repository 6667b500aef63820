"""Write PLANS.md: physical plans (operator trees) of the main plans over a stored usage table.

usage: python tools/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import sys
import tempfile
from datetime import datetime

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def tree(df) -> str:
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return text.split("\n\n")[0]


def main() -> None:
    from pyspark.sql import functions as F

    from ledgerline.operators import load
    from ledgerline.plans.report import build_report
    from ledgerline.plans.sessions import build_sessions
    from ledgerline.session import local_session
    from ledgerline.sampledata import tool_logs as fixtures
    from ledgerline.plans.panels import usage_grain
    from ledgerline.sources import byte_ranges, codex
    from ledgerline.sources.eventlog import read_events, usage_table
    from ledgerline.sources.prices import read_price_list

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8)
    scratch = tempfile.mkdtemp(prefix="plans-")
    usage_table(spark, sf).withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(f"{scratch}/usage")
    stored = spark.read.parquet(f"{scratch}/usage")
    prices = read_price_list(spark)
    batch = usage_table(spark, sf).withColumn("path", F.lit("f")).withColumn("ln", F.lit(0).cast("bigint"))
    plans = {
        "Report by model, 5-day window, one tool (stored table)": build_report(
            stored, prices, by="model", since=datetime(2024, 1, 20), until=datetime(2024, 1, 25), source="codex"),
        "Session report (stored table)": build_sessions(stored, prices),
        "Idempotent insert: first-wins + semi-join-narrowed anti join": load.not_loaded(
            load.first_wins(batch), stored.drop("dt")),
        "Cumulative-counter decoder (chunked replay of typed lines, written once)": codex.decode(
            fixtures.codex_lines(read_events(spark, sf))),
        "Panels: one scan, GROUPING SETS over the grain (before pricing)": usage_grain(stored, tz="UTC").groupingSets(
            [[F.col("tool"), F.col("model")], [F.col("model")], [F.col("day"), F.col("model")]],
            F.col("tool"), F.col("model"), F.col("day")).agg(F.sum("events").alias("events")),
        "Lines of byte ranges (a plan row per file, a task row per range)": byte_ranges.lines_of(byte_ranges.read_splits(
            spark.createDataFrame([("/logs/a.jsonl", 1 << 20, 200 << 20)], "path string, offset long, size long"))),
    }
    print("# Physical plans\n")
    print("Generated by `tools/show_plans.py` (initial adaptive plans; AQE may still turn shuffle joins "
          "into broadcasts and coalesce partitions at runtime).\n")
    for title, df in plans.items():
        print(f"## {title}\n\n```\n{tree(df)}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
