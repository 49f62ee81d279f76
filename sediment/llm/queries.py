"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sediment.llm import decontamination, embeddings, jaccard, kmers, manifest
from sediment.llm.decontamination import contaminated
from sediment.llm.embeddings import near_vectors
from sediment.llm.jaccard import near_documents
from sediment.llm.kmers import word_digests
from sediment.llm.language import identify
from sediment.llm.lm import score_texts
from sediment.llm.manifest import verified_documents
from sediment.llm.packing import pack
from sediment.llm.periodic import run_digests
from sediment.llm.secrets import scan_secrets
from sediment.llm.substrings import repeated_bytes
from sediment.llm.token_counts import token_counts
from sediment.llm.urls import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf}/documents.parquet"))


def op2_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(spark, spark.read.parquet(f"{sf}/embeddings.parquet"))


def op3_repeated_bytes(spark: SparkSession, sf: str) -> DataFrame:
    found = repeated_bytes(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_language(spark: SparkSession, sf: str) -> DataFrame:
    return identify(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def op5_contaminated(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), short_items=True)


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf}/documents.parquet"))


def op7_near_documents(spark: SparkSession, sf: str) -> DataFrame:
    return near_documents(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def op8_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return scan_secrets(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def op9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def op10_urls(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf}/pages.parquet"))


def op11_repeated_words(spark: SparkSession, sf: str) -> DataFrame:
    return word_digests(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return run_digests(spark.read.parquet(f"{sf}/documents.parquet"))


def op13_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return verified_documents(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, unless they find it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment
    parts = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        known["PYTHONPATH"] = os.pathsep.join([*parts, root])


def _query(work: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        reach_workers(spark)
        return work(spark, sf)

    return run


def registered() -> dict[str, Query]:
    return {name: _query(work) for name, work in globals().items() if name.startswith("op") and callable(work)}


def statements() -> dict[str, str]:
    return {
        "op2_near_vectors": embeddings.ORACLE_SQL,
        "op5_contaminated": decontamination.ORACLE_SQL,
        "op7_near_documents": jaccard.ORACLE_SQL,
        "op11_repeated_words": kmers.ORACLE_SQL,
        "op13_manifest": manifest.ORACLE_SQL,
    }
