"""The corpus pipeline: quality rules, exact and near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads again as the next stage's
``docs``; a lost executor costs a part of one stage. All stages but the last
return the columns of ``docs``, whatever they are:

* quality: documents that fail the base rules or the likelihood ratio go;
* exact_dedup: of equal texts the row with the smallest doc_id stays;
* near_dedup: of each class of near-duplicates the row with the smallest doc_id stays;
* mix: a row for each time the mix takes a document (sources that are heavy for
  their size repeat, at most three times);
* pack: one row per piece of a document in a token sequence.

Nulls, empty texts, ties, repeated rows and empty tables are handled as each
operator's module states. An empty table passes as one through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup, jaccard_forest, quality_llr, source_mix, vector_pack
from ledgerline.llm.common import read_table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_llr.keep_documents(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_forest.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = vector_pack.pack_documents(docs)
    return pieces.select(F.col("example").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
                         F.col("example_tokens").alias("doc_tokens"), "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix", mix),
    ("pack", pack),
]

# Hash likelihood ratios, shingle similarity and a tokenizer are beyond SQL; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
