"""Rows of very large groups dealt out so that every pair still meets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def met_in_blocks(rows: DataFrame, keys: list[str], member: str, most: int, weight: Column | None = None, most_weight: int = 0) -> DataFrame:
    """``rows`` with ``row_block``, ``block_a`` and ``block_b``; any two of a group are together in exactly one block
    pair in which their blocks are ``block_a`` and ``block_b`` in either order.

    Groups of up to ``most`` rows, which together weigh up to ``most_weight`` if a ``weight`` of a row is given, are one
    block. Larger ones are cut by the hash of ``member`` into blocks of about half of that, and each pair of blocks becomes
    a group of its own. Groups of one row are left out. Deal the result
    out by the keys and both blocks: the join's partitioning by the keys alone would keep a group in one task.
    """
    heavy = F.lit(0) if weight is None else F.sum(weight)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"), heavy.alias("group_weight")).where("group_rows > 1")
    blocks = F.when(F.col("group_rows") <= most, F.lit(1)).otherwise(F.ceil(F.col("group_rows") / F.lit(most // 2)).cast("int"))
    if weight is not None:
        blocks = F.greatest(blocks, F.when(F.col("group_weight") > most_weight, F.ceil(F.col("group_weight") / F.lit(most_weight // 2)).cast("int")))
    dealt = rows.join(sizes, keys).withColumn("blocks", blocks).drop("group_rows", "group_weight")
    return _paired(dealt, member)


def met_in_large_blocks(rows: DataFrame, large: DataFrame, keys: list[str], member: str, most: int) -> DataFrame:
    """The same for ``rows`` whose groups of more than ``most`` rows are listed in ``large`` (keys, group_rows), as are
    few; the others are one block each, groups of one row too. The rows need not be dealt out for this if the list is
    small."""
    blocks = F.coalesce(F.ceil(F.col("group_rows") / F.lit(most // 2)).cast("int"), F.lit(1))
    return _paired(rows.join(large, keys, "left").withColumn("blocks", blocks).drop("group_rows"), member)


def _paired(dealt: DataFrame, member: str) -> DataFrame:
    own = F.pmod(F.xxhash64(F.lit(7), member), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        dealt.withColumn("row_block", own)
        .withColumn("x", other)
        .withColumn("block_a", F.least("x", "row_block"))
        .withColumn("block_b", F.greatest("x", "row_block"))
        .drop("x", "blocks")
    )


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest place that it reaches over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
