"""Kafka-shaped record sources."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.model import KAFKA_SCHEMA

_RECORD = ("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value", "topic", "partition", "offset", "timestamp")


def kafka_batch(spark: SparkSession, topic: str, starting: str = "earliest", **options: str) -> DataFrame:
    """Bounded read of one topic, from saved positions to its present end.

    Records removed by the broker's retention are skipped, not an error.  Needs the Kafka connector on the
    class path; ``options`` carry the broker address and security settings.
    """
    return (
        spark.read.format("kafka")
        .options(**options)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("endingOffsets", "latest")
        .option("failOnDataLoss", "false")
        .load()
        .selectExpr(*_RECORD)
    )


def kafka_stream(
    spark: SparkSession, *, topics: Sequence[str] = (), pattern: str = "", starting: str = "earliest", **options: str
) -> DataFrame:
    """The same records as a stream; its checkpoint keeps the positions."""
    if bool(topics) == bool(pattern):
        raise ValueError("give either topics or a pattern")
    reader = spark.readStream.format("kafka").options(**options)
    reader = reader.option("subscribePattern", pattern) if pattern else reader.option("subscribe", ",".join(topics))
    return (
        reader.option("startingOffsets", starting).option("failOnDataLoss", "false").load().selectExpr(*_RECORD)
    )


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Records of the same shape delivered as Parquet files in a folder."""
    reader = spark.readStream.schema(KAFKA_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(path)


def source_topics(records: DataFrame, prefix: str, signal: str = "") -> DataFrame:
    """Records of one source's tables: topics under ``prefix`` but for its dead-letter and signal topics."""
    return records.where(F.col("topic").rlike(topic_pattern(prefix, signal)))


def topic_pattern(prefix: str, signal: str = "") -> str:
    """Whole-name pattern of a source's table topics, as Kafka's ``subscribePattern`` takes it."""
    barred = "(?!dlq$)" + (f"(?!{re.escape(signal)}$)" if signal else "")
    return "^" + re.escape(prefix) + "\\." + barred + ".*$"
