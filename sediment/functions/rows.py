"""Helpers for columns that are costly to work out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each worked out once per row.

    A plain projection would be copied into every filter and column that uses it.  As the output of a generator
    the values stay put, so a text is parsed once however many rules look at the result.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
