"""All versioned tables under one folder, by name: ``<root>/<namespace>/<table>``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.sources import filesystem as files
from sediment.sources.versioned import LOG_SCHEMA, VersionedTable


class TableRoot:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> VersionedTable:
        namespace, _, table = name.rpartition(".")
        return VersionedTable(self.spark, f"{self.root}/{namespace}/{table}")

    def exists(self, name: str) -> bool:
        return bool(self.table(name).versions())

    def namespaces(self) -> list[str]:
        return sorted(files.names(self.spark, self.root))

    def tables_in(self, namespace: str) -> list[str]:
        """``namespace.table`` of the tables; a namespace that is not there has none."""
        return [f"{namespace}.{t}" for t in sorted(files.names(self.spark, f"{self.root}/{namespace}"))]

    def tables(self, namespaces: Iterable[str] | None = None, declared: Iterable[str] = ()) -> list[str]:
        """Sorted names of the tables in some namespaces (default: all) and the declared ones."""
        chosen = self.namespaces() if namespaces is None else namespaces
        return sorted({t for n in chosen for t in self.tables_in(n)} | set(declared))

    def commits(self, names: Iterable[str] | None = None) -> DataFrame:
        """Commit records of many tables with the table's name, read as one scan."""
        paths = [f"{self.table(n).path}/_commits" for n in (self.tables() if names is None else names) if self.exists(n)]
        if not paths:
            return self.spark.createDataFrame([], f"table string, {LOG_SCHEMA}")
        parts = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)/_commits/[^/]+$", 1)
        return self.spark.read.schema(LOG_SCHEMA).json(paths).select(F.replace(parts, F.lit("/"), F.lit(".")).alias("table"), "*")
