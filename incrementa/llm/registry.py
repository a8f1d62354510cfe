"""Queries of this package for ``__spark_entry__`` and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incrementa.llm import pii, secrets

from incrementa.llm.common import load
from incrementa.llm.decontam import contamination
from incrementa.llm.exact import exact_groups
from incrementa.llm.importance import resample
from incrementa.llm.minhash import Tables, minhash_groups
from incrementa.llm.packing import pack_documents
from incrementa.llm.prefixes import prefix_trie
from incrementa.llm.quality import score_quality
from incrementa.llm.repeats import without_repeats
from incrementa.llm.simhash import exact_scheme, simhash_groups
from incrementa.llm.spans import marked
from incrementa.llm.sql import ORACLES
from incrementa.llm.tokenfile import read_token_file, write_token_file
from incrementa.llm.toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), threshold=0.3)


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_file(spark, write_token_file(load(spark, sf_dir, "documents"), end_id=2))


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(load(spark, sf_dir, "documents"), support=3, threshold=0.8)
    base = [marked(F.col(k), k) for k in pii.PATTERNS]
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.PATTERNS),
        F.sha2(F.concat_ws(",", *base), 256).alias("base_sha256"),
        F.concat_ws(",", *base, marked(F.col("terms"), "term")).alias("spans"),
        F.sha2("clean", 256).alias("clean_sha256"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), threshold=0.7)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(load(spark, sf_dir, "documents"), exact_scheme(width=3, radius=3))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(load(spark, sf_dir, "documents"))
    kinds = list(secrets.PATTERNS)
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(secrets.joined(kinds), 256).alias("base_sha256"),
        secrets.joined([*kinds, "random"]).alias("spans"),
        F.sha2("clean", 256).alias("clean_sha256"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), window=13, share=0.8)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), buckets=10000, width=1, percent=10, least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(load(spark, sf_dir, "conversations"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(load(spark, sf_dir, "documents"), Tables(width=2, percent=80))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_token_file": op2_token_file,
        "op3_pattern_packing": op3_pattern_packing,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_pii": op5_pii,
        "op6_quality": op6_quality,
        "op7_simhash": op7_simhash,
        "op8_secrets": op8_secrets,
        "op9_suffix_dedup": op9_suffix_dedup,
        "pipeline": pipeline,
        "op10_decontamination": op10_decontamination,
        "op11_importance": op11_importance,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
