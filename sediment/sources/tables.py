"""Catalog tables: reading, probing, listing, writing and dropping."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ABSENT = ("TABLE_OR_VIEW_NOT_FOUND",)


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    """The table, or None when it does not exist; any other trouble is raised."""
    try:
        return spark.table(name)
    except AnalysisException as error:
        if (error.getCondition() or "").split(".")[0] in ABSENT:
            return None
        raise


def tables_in(spark: SparkSession, namespace: str) -> list[str]:
    """``namespace.table`` of each table; a namespace that cannot be read has none."""
    try:
        rows = spark.sql(f"SHOW TABLES IN {namespace}").where("NOT isTemporary").collect()
    except AnalysisException:
        return []
    return [f"{namespace}.{r['tableName']}" for r in rows]


def all_tables(spark: SparkSession, namespaces: Iterable[str] | None = None, declared: Iterable[str] = ()) -> list[str]:
    """Sorted names of the tables in ``namespaces`` (default: every namespace) and the declared ones."""
    if namespaces is None:
        namespaces = [r[0] for r in spark.sql("SHOW NAMESPACES").collect()]
    return sorted({t for n in namespaces for t in tables_in(spark, n)} | set(declared))


def unknown_tables(catalog: DataFrame, *known: DataFrame) -> DataFrame:
    """Tables of the catalog (column ``table``) that no known list names."""
    for names in known:
        catalog = catalog.join(names.select("table"), "table", "left_anti")
    return catalog


def create_or_replace(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    """Write the whole table anew."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)


def create_as(df: DataFrame, table: str) -> None:
    """Create a table from a query; an error when it exists."""
    df.write.mode("errorifexists").saveAsTable(table)


def create_view(spark: SparkSession, name: str, query: str) -> None:
    """Store a query under a name."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")


def append(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``; rows of a partition are spread by their volume."""
    spread = df.hint("rebalance", *(F.col(c) for c in partition_by))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def drop_with_data(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table} PURGE")


def for_each(items: Iterable, work: Callable, at_once: int = 1) -> list[tuple[object, Exception]]:
    """Run ``work`` on each item; a failure does not stop the others.  Returns the failures.

    Work on small tables is mostly waiting for short jobs, so several items may run at once; Spark shares the
    executors among their jobs.
    """

    def attempt(item: object) -> tuple[object, Exception] | None:
        try:
            work(item)
            return None
        except Exception as error:  # noqa: BLE001 - every kind of failure is reported at the end
            return item, error

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return [failure for failure in pool.map(attempt, items) if failure]
