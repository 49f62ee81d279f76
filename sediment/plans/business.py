"""Report shapes over current-state tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per category."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def daily_totals(df: DataFrame, at: str, amount: str, *by: str) -> DataFrame:
    """Rows and total amount per day, optionally split further."""
    return df.groupBy(F.to_date(at).alias("day"), *by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(amount).alias("amount")
    )


def distinct_through(fact: DataFrame, links: Sequence[tuple[DataFrame, Column]], group: str, counted: str) -> DataFrame:
    """Distinct values of the fact's column per attribute reached over equi-joins.

    Filter ``fact`` first.  Small sides are broadcast when their size is known to be small; a group that holds
    much of the data is spread by the counted value before it is summed.
    """
    joined = fact
    for other, on in links:
        joined = joined.join(other, on)
    return joined.groupBy(group).agg(F.count_distinct(counted).alias("distinct_count"))


def average_by(df: DataFrame, group: str, value: str, digits: int = 2) -> DataFrame:
    """Rows and rounded mean per group, in order."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(value), digits).alias("mean")).orderBy(group)
