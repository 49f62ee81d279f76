"""Resumable positions per topic and partition.

Running streams keep their positions in the checkpoint; these are for bounded reads and for reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AT = ["topic", "partition"]
EARLIEST = -2  # fixed value: Kafka's marker for the first retained record


def next_offsets(records: DataFrame) -> DataFrame:
    """Position to read next: the largest offset seen, plus one."""
    return records.groupBy(*_AT).agg((F.max("offset") + 1).alias("next_offset"))


def merge_offsets(saved: DataFrame, new: DataFrame) -> DataFrame:
    """New positions replace saved ones partition by partition; the others stay."""
    return (
        saved.withColumnRenamed("next_offset", "_saved")
        .join(new, _AT, "full_outer")
        .select(*_AT, F.coalesce("next_offset", "_saved").alias("next_offset"))
    )


def starting_offsets(saved: DataFrame, partitions: DataFrame) -> DataFrame:
    """Where to start in each of ``partitions`` (topic, partition).

    A bounded read has to name every partition of a topic, so one that was never read starts at the earliest
    record.  A topic with no saved position at all has a null start: it is read with ``earliest`` as a whole.
    """
    topics = saved.select("topic").distinct().withColumn("_seen", F.lit(True))
    return (
        partitions.join(saved, _AT, "left")
        .join(topics, "topic", "left")
        .select(*_AT, F.when(F.col("_seen"), F.coalesce("next_offset", F.lit(EARLIEST))).alias("starting_offset"))
    )


def offsets_json(offsets: DataFrame, value: str = "next_offset") -> DataFrame:
    """One row with the ``startingOffsets`` text: ``{"topic":{"0":10,"2":2}}``.

    One entry per partition of the subscribed topics, so the text is bounded by the broker's layout.
    """
    positions = F.array_sort(F.collect_list(F.struct(F.col("partition").cast("string"), value)))
    per_topic = offsets.where(F.col(value).isNotNull()).groupBy("topic").agg(positions.alias("positions"))
    topics = F.array_sort(F.collect_list(F.struct("topic", "positions")))
    nested = F.transform(topics, lambda t: F.struct(t["topic"], F.map_from_entries(t["positions"])))
    return per_topic.agg(F.to_json(F.map_from_entries(nested)).alias("offsets"))


def backlog(ends: DataFrame, committed: DataFrame, threshold: int | None = None) -> DataFrame:
    """Unread records per (group, topic); with a threshold, only those above it.

    ``ends``: topic, partition, next_offset of the newest record.  ``committed``: group, topic, partition,
    next_offset.  One row per partition on both sides.  A partition of a group's topic for which it has committed
    nothing counts from the first record: ``earliest`` in ``ends`` if that column is there, else 0.
    """
    first = F.col("earliest") if "earliest" in ends.columns else F.lit(0)
    wanted = committed.select("group", "topic").distinct().join(ends, "topic")
    read = committed.withColumnRenamed("next_offset", "_read")
    lag = (
        wanted.join(read, ["group", *_AT], "left")
        .groupBy("group", "topic")
        .agg(F.sum(F.greatest(F.col("next_offset") - F.coalesce("_read", first), F.lit(0))).alias("backlog"))
    )
    return lag if threshold is None else lag.where(F.col("backlog") > threshold)
