"""Web server access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions.rows import computed
from sediment.functions.weblog import FIELDS, TIME_FORMAT, line_fields, side_by_side


def parse_lines(lines: DataFrame, server: str | Column, read_time: Column, line: str = "value") -> DataFrame:
    """One row per line: the request's columns, ``ts``, ``server`` and ``_fb_ts`` (when the line was read).

    A line of another shape is kept whole in ``log`` with the request's columns null; its ``ts`` is the time it
    was read, the only time it has.  An empty field is null.
    """
    joined = computed(lines, _joined=side_by_side(F.col(line)), _fb_ts=read_time)
    captured = computed(joined, _fields=line_fields(F.col(line), F.col("_joined")))

    def field(name: str) -> Column:
        return F.nullif(F.col("_fields")[FIELDS.index(name)], F.lit(""))

    logged = F.try_to_timestamp(field("time"), F.lit(TIME_FORMAT))
    return captured.select(
        *(field(n).alias(n) for n in ("remote", "host", "user", "method", "path")),
        field("code").try_cast("int").alias("code"),
        field("size").try_cast("bigint").alias("size"),
        field("referer").alias("referer"),
        field("agent").alias("agent"),
        F.coalesce(logged, F.col("_fb_ts")).alias("ts"),
        (F.lit(server) if isinstance(server, str) else server).alias("server"),
        "_fb_ts",
        F.when(F.col("_fields").isNull(), F.col(line)).alias("log"),
    )


def read_log(spark: SparkSession, path: str, server: str) -> DataFrame:
    """Parsed rows of the log files under ``path``; the read time is the file's modification time."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("_read"))
    return parse_lines(lines, server, F.col("_read"))


def unparsed(rows: DataFrame) -> DataFrame:
    """Lines that did not have the accepted shape."""
    return rows.where(F.col("remote").isNull())
