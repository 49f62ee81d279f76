"""Reduction of a change log to the newest change per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.model import DELETE, META
from sediment.operators.schema import cast_columns

OP = "_op"


def latest_per_key(log: DataFrame, keys: Sequence[str], casts: Mapping[str, str] | None = None) -> DataFrame:
    """Newest change per key by (``_cdc.ts``, ``_cdc.offset``): business columns, casts applied, plus ``_op``.

    Keys are compared before the casts; a null ``ts`` counts as oldest.  ``row_number() = 1`` is planned as a
    group limit on both sides of the shuffle, so each map task sends at most one row per key and a key that
    holds a third of the log costs no more than any other.  Rows that tie on both columns are copies of one
    delivery; ``_cdc.op`` makes the choice among them repeatable when a task is run again.
    """
    newest = Window.partitionBy(*(F.col(f"`{k}`") for k in keys)).orderBy(
        F.col(f"{META}.ts").desc(), F.col(f"{META}.offset").desc(), F.col(f"{META}.op").desc()
    )
    return (
        log.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .select(*cast_columns(log.schema, casts), F.col(f"{META}.op").alias(OP))
    )


def current_state(log: DataFrame, keys: Sequence[str], casts: Mapping[str, str] | None = None) -> DataFrame:
    """Rows alive after the whole log is applied to an empty table."""
    return latest_per_key(log, keys, casts).where(F.col(OP) != DELETE).drop(OP)


def newest_event_time(log: DataFrame) -> DataFrame:
    """One row: the largest ``_cdc.ts`` of an increment."""
    return log.agg(F.max(f"{META}.ts").alias("max_ts"))
