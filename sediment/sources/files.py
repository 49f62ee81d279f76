"""One-off registration of plain files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("csv", "parquet")


def read_files(spark: SparkSession, source: str, fmt: str, header: bool = True) -> DataFrame:
    """CSV columns are strings named by the header; Parquet brings its own schema and has no header."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {FORMATS}")
    reader = spark.read.format(fmt)
    return (reader.option("header", str(header).lower()) if fmt == "csv" else reader).load(source)


def register(spark: SparkSession, source: str, fmt: str, table: str, header: bool = True) -> int:
    """Create or replace ``namespace.table`` from files; returns its row count."""
    namespace = table.rpartition(".")[0]
    if namespace:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")
    read_files(spark, source, fmt, header).write.mode("overwrite").saveAsTable(table)
    return spark.table(table).count()
