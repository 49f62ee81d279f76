"""Connected components of links, by shuffles alone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.session import scratch_dir


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: computed once, and safe from lost executors."""
    where = scratch_dir(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def plain_names(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with a plain name for every column whose own has other characters than letters, digits and underscores, as
    Arrow functions need, and the names to give back with ``toDF``."""
    return df.toDF(*(c if re.fullmatch(r"\w+", c) else f"_column_{i}" for i, c in enumerate(df.columns))), df.columns


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in a link: the smallest id that it reaches, itself included.

    Each round every id takes the smallest label among its own, its neighbours' and its label's label, so the rounds
    grow with the logarithm of the longest chain. Both steps are aggregated before the shuffle, so an id with very many
    links sends one row per task. Links from an id to itself and nulls are ignored; repeated links change nothing.
    """
    one = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    both = stored(spark, one.union(one.select("b", "a")).distinct(), "links")
    labels = stored(spark, both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        above = labels.select(F.col("a").alias("l"), F.col("label").alias("up"))
        new = stored(spark, moved.join(above, "l", "left").select("a", "old", F.least("l", F.coalesce("up", "l")).alias("label")), "labels")
        labels = new.select("a", "label")
        if new.where("label <> old").isEmpty():
            return labels.select(F.col("a").alias("id"), F.col("label").alias("component"))
