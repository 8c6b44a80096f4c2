"""The thin queries opN_<name> over the driver's tables, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm.byte_bpe import bpe_digest
from docquarry.llm.common import table
from docquarry.llm.license_scan import license_scan, license_scan_sql
from docquarry.llm.line_dedup import line_dedup_report, line_dedup_sql
from docquarry.llm.mixing import mix_documents, mix_sql
from docquarry.llm.periodic_runs import run_digests, run_digests_sql
from docquarry.llm.prefix_trie import conversation_trie, trie_sql
from docquarry.llm.scaled_sketch import document_fingerprints, fingerprints_sql
from docquarry.llm.sharding import shard_documents, shard_sql
from docquarry.llm.simhash import near_duplicates
from docquarry.llm.substring_dedup import repeated_passages
from docquarry.llm.tiff import media_features
from docquarry.llm.toxicity import toxicity_scores
from docquarry.llm.vp_tree import nearest


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op11_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_source_mix": op5_source_mix,
    "op6_license_scan": op6_license_scan,
    "op7_sharding": op7_sharding,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_vp_tree": op9_vp_tree,
    "op10_tiff_pages": op10_tiff_pages,
    "op11_scaled_sketch": op11_scaled_sketch,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup_sql(),
    "op5_source_mix": mix_sql(),
    "op6_license_scan": license_scan_sql(),
    "op7_sharding": shard_sql(),
    "op11_scaled_sketch": fingerprints_sql(),
    "op12_prefix_trie": trie_sql(),
    "op13_periodic_runs": run_digests_sql(),
}
