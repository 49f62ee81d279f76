"""A corpus run in stages; each takes the documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import decontamination, jaccard, language, packing, secrets
from sediment.llm.queries import reach_workers
from sediment.session import scratch_dir
from sediment.sources import filesystem

#: SQL cannot express the language model, the learned formats or packing.
ORACLE_SQL = None


# Every stage takes documents with whatever columns they have, under any names, and returns them with the same ones; an
# empty table gives an empty one. Repeated rows are rows of their own, except that rows of one id stay or go together
# in the stages that decide by id.


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or in no learned language with a probability of a half, go."""
    return language.accepted(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the smallest id stays; documents without an id, and null or empty
    texts, stay. Several texts of one id are judged as one."""
    return without(docs, jaccard.near_documents(spark, docs).where("not kept").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, with all rows of their id; a null id is one document."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated(docs, benchmark, short_items=True)
    return without(docs, found.where("contaminated").select("doc_id"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among ``ids`` (doc_id); a null is like any other id."""
    gone = ids.select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials are replaced by a mark; all documents stay, null and empty texts as they are."""
    return secrets.redact_secrets(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences; a null text is empty, and a document with one has its end only."""
    return packing.pack(docs)


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and deleted once the
    next one is written. Null, empty and repeated rows are as the stages say."""
    reach_workers(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        where = scratch_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(where)
        if before:
            filesystem.delete(spark, before)
        docs, before = spark.read.parquet(where), where
    return docs
