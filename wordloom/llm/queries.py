"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import bpe, embedding_graph, fingerprints, language_id, license_scan, line_dedup, ngram_join, ngram_lm, oracles, packing, periodic_runs, sharding, source_divergence
from wordloom.llm import token_counts as counts
from wordloom.llm._common import new_folder, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decode_too=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.removal_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chunks", "n_removed", "removed_chars", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.train(docs))
    return out.select("doc_id", (language_id.fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.edit_likeness(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"), new_folder(spark, "shards"))
    return out.select("doc_id", F.col("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.regexp_extract("shard", "[^/]+$", 0).alias("shard"), "shard_bytes", "shard_tier", "shard_arrivals", "store_version")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan_report(license_scan.license_scan(docs, license_scan.build_index(docs)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence_audit(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


OPERATORS = (op1_best_fit_packing, op2_byte_bpe, op3_ngram_jaccard_join, op4_lm_scoring, op5_line_dedup, op6_language_id, op7_fingerprints, op8_token_counts, op9_sharding, op10_embedding_near_dedup, op11_license_scan, op12_source_divergence, op13_periodic_runs)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
