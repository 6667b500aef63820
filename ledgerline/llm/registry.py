"""Registered queries of the training-data operators: opN_<name> and the pipeline.

Each query applies its operator, with production parameters, to the whole
table and derives the columns that are compared from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (bond_negatives, exact_dedup, jaccard_forest, language_spans, license_scan, merkle_manifest,
                            quality_llr, rans_tokens, recompression, secret_forest, source_mix, toxicity_decode, vector_pack)
from ledgerline.llm.common import read_table
from ledgerline.llm.oracle import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summarise(license_scan.scan_licenses(read_table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = exact_dedup.mark_duplicates(read_table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_llr.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", *[f"quality_rules.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")])


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = source_mix.mix_documents(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_vector_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = vector_pack.pack_documents(read_table(spark, sf_dir, "documents"))
    return pieces.select(F.col("example").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
                         F.col("example_tokens").alias("doc_tokens"), "sequence_id", "offset")


def op6_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = rans_tokens.write_files(read_table(spark, sf_dir, "documents"))
    rows = rans_tokens.read_files(spark, folder)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_links")


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = language_spans.label_languages(read_table(spark, sf_dir, "documents"))
    return labelled.select("doc_id", "held_out", "lang_pred", "score")


def op9_toxicity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_decode.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = secret_forest.find_secrets(docs, docs["source"])
    return found.select("doc_id", "start", "end", "value", F.col("label").cast("int").alias("label"), "held_out",
                        "score", "is_secret")


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op12_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bond_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.audit(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_license_scan, op2_exact_dedup, op3_source_mix, op4_quality_llr, op5_vector_pack, op6_rans_tokens,
        op7_jaccard_forest, op8_language_spans, op9_toxicity_decode, op10_secret_forest,
        op11_recompression, op12_bond_negatives, op13_merkle_manifest,
        pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
