"""Measurements of tables and flows, from commit logs and file listings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.model import RAW_SUFFIX

# Keys of a commit's summary, and how long measurements are kept.
RECORDS, DATA_FILES, DELETE_FILES, FILES_SIZE = (
    "total-records",
    "total-data-files",
    "total-delete-files",
    "total-files-size",
)
MIB = 1048576.0
HEALTH_TABLE = "ops.table_health"
HEALTH_RETENTION_DAYS = 90


def layer_of(namespace: Column, silver_namespaces: Sequence[str]) -> Column:
    """``bronze`` for ``*_raw``, ``silver`` for a namespace some pipeline writes, ``sandbox``, else ``other``."""
    return (
        F.when(namespace.endswith(RAW_SUFFIX), "bronze")
        .when(namespace.isin(*silver_namespaces) if silver_namespaces else F.lit(False), "silver")
        .when(namespace == "sandbox", "sandbox")
        .otherwise("other")
    )


def _number(summary: str, key: str) -> Column:
    return F.element_at(summary, key).try_cast("bigint")


def table_health(commits: DataFrame, silver_namespaces: Sequence[str], measured_at: datetime) -> DataFrame:
    """One row per table (``namespace.table`` in ``table``) from its newest commit's summary.

    A figure that is missing or no number is null.  Commit records are reduced before the shuffle, so a table
    with very many commits is no heavier than the others.
    """
    newest = commits.groupBy("table").agg(
        F.max("committed_at").alias("last_change"),
        F.count(F.lit(1)).alias("versions"),
        F.max_by("summary", "committed_at").alias("_summary"),
    )
    size = F.bround(_number("_summary", FILES_SIZE) / F.lit(MIB), 3)
    files = _number("_summary", DATA_FILES)
    return newest.select(
        F.lit(measured_at).cast("timestamp").alias("measured_at"),
        "table",
        layer_of(F.substring_index("table", ".", 1), silver_namespaces).alias("layer"),
        "last_change",
        "versions",
        _number("_summary", RECORDS).alias("records"),
        files.alias("data_files"),
        _number("_summary", DELETE_FILES).alias("delete_files"),
        size.alias("size_mib"),
        F.when(files != 0, F.bround(size / files, 3)).alias("avg_file_mib"),
    )


def latest_health(health: DataFrame) -> DataFrame:
    """The newest measurement, by layer and table."""
    newest = health.agg(F.max("measured_at").alias("measured_at"))
    return health.join(newest, "measured_at").orderBy("layer", "table")


def health_trend(health: DataFrame) -> DataFrame:
    """Largest record and file count per hour and table."""
    return health.groupBy(F.date_trunc("HOUR", "measured_at").alias("hour"), "table").agg(
        F.max("records").alias("records"), F.max("data_files").alias("data_files")
    )


def file_size_by_table(health: DataFrame) -> DataFrame:
    """Largest average file size per table."""
    return health.groupBy("table").agg(F.max("avg_file_mib").alias("avg_file_mib"))


def file_stats(files: DataFrame) -> DataFrame:
    """Files, records and sizes per file format."""
    return files.groupBy("file_format").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("record_count").alias("records"),
        (F.sum("file_size_in_bytes") / F.lit(MIB)).alias("size_mib"),
        (F.avg("file_size_in_bytes") / F.lit(MIB)).alias("avg_file_mib"),
    )


def newest_commits(commits: DataFrame, n: int = 20) -> DataFrame:
    """The newest commits with the figures of their summaries."""
    return (
        commits.select(
            "committed_at",
            "version",
            "operation",
            _number("summary", RECORDS).alias("records"),
            _number("summary", DATA_FILES).alias("data_files"),
            _number("summary", DELETE_FILES).alias("delete_files"),
            (_number("summary", FILES_SIZE) / F.lit(MIB)).alias("size_mib"),
        )
        .orderBy(F.col("committed_at").desc(), F.col("version").desc())
        .limit(n)
    )


def stale_tables(commits: DataFrame, now: datetime, threshold_seconds: int = 2700) -> DataFrame:
    """Tables whose last commit is older than the threshold."""
    last = commits.groupBy("table").agg(F.max("committed_at").alias("last_change"))
    age = F.lit(now).cast("timestamp").cast("double") - F.col("last_change").cast("double")
    return last.withColumn("age_seconds", F.floor(age)).where(age > threshold_seconds)


def recent_dead_letters(dead: DataFrame, now: datetime, hours: int = 1) -> DataFrame:
    """Records set aside per topic in the last hours; topics without any do not appear."""
    start = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    recent = dead.where((F.col("timestamp") > start) & (F.col("timestamp") <= F.lit(now).cast("timestamp")))
    return recent.groupBy("topic").count()
