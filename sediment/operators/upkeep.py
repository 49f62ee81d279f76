"""Retention, compaction, folding, expiry and unreferenced files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.model import META
from sediment.operators.health import layer_of
from sediment.sources import filesystem as files
from sediment.sources.versioned import BASE, PENDING, Commit, Unit, VersionedTable

# Days kept per layer, and the age below which an unreferenced file may belong to a running write.
VERSION_DAYS = {"bronze": 1, "silver": 7, "sandbox": 7, "other": 7}
BRONZE_TTL_DAYS = 30
ORPHAN_DAYS = 3
TARGET_FILE_BYTES = 256 << 20
MIN_INPUT_FILES = 5
COMMIT_BYTES = 1 << 40


_FOLDER = r"/data/(.*)/[^/]+$"

# ---- retention ------------------------------------------------------------------------------------------


def retention_column(columns: Sequence[str]) -> str:
    """Change logs keep their time in ``_cdc.ts``, flat raw tables in ``ts``."""
    return f"{META}.ts" if META in columns else "ts"


def retention_cutoff(now: datetime, days: int) -> datetime:
    """Midnight (UTC) ``days`` ago, so that whole days go."""
    return (now.astimezone(timezone.utc) - timedelta(days=days)).replace(hour=0, minute=0, second=0, microsecond=0)


def retained(df: DataFrame, now: datetime, days: int, column: str | None = None) -> DataFrame:
    """Rows young enough to keep; a row without a time is never too old."""
    at = F.col(column or retention_column(df.columns))
    return df.where(at.isNull() | (at >= F.lit(retention_cutoff(now, days))))


def apply_retention(table: VersionedTable, now: datetime, days: int, column: str | None = None) -> Commit | None:
    """Drop old rows.  In a table laid out by the day of the time column only folders are dropped, nothing is read.

    In another only the units that hold old rows are rewritten.  What is committed meanwhile is carried over.  A table
    without a commit has nothing to drop.
    """
    head = table.head()
    if head is None:
        return None
    column = column or retention_column(head.struct.fieldNames())
    cutoff = retention_cutoff(now, days).date()
    if head.layout.kind == "day" and head.layout.column == column:
        old = [u for u in head.units if (day := u.day) and day < cutoff]
        return table.replace_units(old, None, "delete") if old else None
    old = _units_before(table, head, retention_cutoff(now, days), column)
    if not old:
        return None
    kept = retained(table.scan(old, head.struct, head.layout), now, days, column)
    return table.replace_units(old, kept, "delete")


def _units_before(table: VersionedTable, head: Commit, cutoff: datetime, column: str) -> list[Unit]:
    """The units that hold a row older than ``cutoff``; the filter reaches the scan, so files without one are skipped."""
    rows = table.scan(head.of(BASE), head.struct, head.layout).where(F.col(column) < F.lit(cutoff))
    folder = F.regexp_extract(F.col("_metadata.file_path"), _FOLDER, 1)
    paths = {r["folder"] for r in rows.select(folder.alias("folder")).distinct().collect()}
    return [u for u in head.of(BASE) if u.path in paths]


# ---- small files ----------------------------------------------------------------------------------------


def small_file_parts(
    file_rows: DataFrame,
    part: str | Column,
    target_bytes: int = TARGET_FILE_BYTES,
    min_files: int = MIN_INPUT_FILES,
    files: Column | None = None,
) -> DataFrame:
    """Partitions worth compacting: many files that would fit in fewer, with the number to aim for.

    A row is one file, or as many as ``files`` says.
    """
    per_part = file_rows.groupBy(part if isinstance(part, Column) else F.col(part)).agg(
        F.sum(F.lit(1) if files is None else files).alias("files"), F.sum("file_size_in_bytes").alias("bytes")
    )
    wanted = F.greatest(F.ceil(F.col("bytes") / F.lit(target_bytes)), F.lit(1))
    return per_part.withColumn("target_files", wanted.cast("bigint")).where(
        (F.col("files") >= min_files) & (F.col("target_files") < F.col("files"))
    )


def _crowded(table: VersionedTable, head: Commit, target_bytes: int, min_files: int) -> list[list[Unit]]:
    """The units with files below the target, of the partitions that :func:`small_file_parts` names."""
    small = [u for u in head.of(BASE) if u.bytes < target_bytes * u.files]
    if not small:
        return []
    rows = [(u.part, u.files, u.bytes) for u in small]
    files = table.spark.createDataFrame(rows, "part string, n long, file_size_in_bytes long")
    chosen = {r["part"] for r in small_file_parts(files, "part", target_bytes, min_files, F.col("n")).collect()}
    return [[u for u in small if u.part == part] for part in sorted(chosen, key=str)]


def compact(
    table: VersionedTable,
    target_bytes: int = TARGET_FILE_BYTES,
    min_files: int = MIN_INPUT_FILES,
    commit_bytes: int = COMMIT_BYTES,
) -> list[Commit]:
    """Rewrite the small files of partitions that hold many; the rows stay the same.

    Appends whose files are at the target size already are left alone.  ``commit_bytes`` is how much goes into one
    commit, so a run that is cut short keeps what it finished.  Within a commit rows are spread by volume: neither one large day nor many small ones hold it up.
    Readers see the old files until the commit, and older versions keep them.
    """
    head = table.head()
    groups: list[list[Unit]] = []
    room = 0
    for units in _crowded(table, head, target_bytes, min_files) if head else []:
        size = sum(u.bytes for u in units)
        if not groups or size > room:
            groups.append([])
            room = commit_bytes
        groups[-1].extend(units)
        room -= size
    commits = []
    for chosen in groups:
        rows = table.scan(chosen, head.struct, head.layout)
        if not head.layout.kind:
            rows = rows.repartition(max(1, -(-sum(u.bytes for u in chosen) // target_bytes)))
        commits.append(table.replace_units(chosen, rows, "replace"))
    return commits


def fold(table: VersionedTable) -> Commit | None:
    """Merge pending increments into the base; only the buckets they touch are read and written."""
    head = table.head()
    pending = head.of(PENDING) if head else ()
    if not pending:
        return None
    touched = {u.part for u in pending}
    merged = table.state_of(head, touched)
    gone = [u for u in head.units if u.part in touched]
    return table.replace_units(gone, merged, "replace")


# ---- versions and files ---------------------------------------------------------------------------------


def expired_versions(
    commits: DataFrame, now: datetime, silver_namespaces: Sequence[str], days: Mapping[str, int] = VERSION_DAYS, retain_last: int = 1
) -> DataFrame:
    """Commits (table, version, committed_at) old enough to go; the newest ``retain_last`` of a table stay.

    The newest are found with a group limit before the shuffle, so a table with very many commits is no
    heavier than the others.
    """
    newest = Window.partitionBy("table").orderBy(F.col("committed_at").desc(), F.col("version").desc())
    kept = (
        commits.select("table", "version", "committed_at")
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= retain_last)
        .select("table", "version")
    )
    layer = layer_of(F.substring_index("table", ".", 1), silver_namespaces)
    limit = F.create_map(*(F.lit(x) for pair in days.items() for x in pair))
    age_limit = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.element_at(limit, layer))
    return commits.where(F.col("committed_at") < age_limit).join(kept, ["table", "version"], "left_anti")


def expire(table: VersionedTable, now: datetime, days: int, retain_last: int = 1) -> list[int]:
    """Forget old commit records; their folders become unreferenced.  Returns the versions that went."""
    same = dict.fromkeys(VERSION_DAYS, days)
    commits = table.commits().select(F.lit("t").alias("table"), "version", "committed_at")
    old = [r["version"] for r in expired_versions(commits, now, (), same, retain_last).select("version").collect()]
    for version in old:
        files.delete(table.spark, table._record(version))
    return sorted(old)


def unreferenced_files(listing: DataFrame, referenced: DataFrame, now: datetime, days: int = ORPHAN_DAYS) -> DataFrame:
    """Files (path, modified, bytes, folder) in no referenced folder and older than the cutoff."""
    cutoff = now - timedelta(days=days)
    return listing.where(F.col("modified") < F.lit(cutoff)).join(referenced, "folder", "left_anti")


def table_orphans(table: VersionedTable, now: datetime, days: int = ORPHAN_DAYS) -> DataFrame:
    """Unreferenced data files of a table; a report, nothing is deleted."""
    spark = table.spark
    listing = files.listing(spark, f"{table.path}/data").withColumn("folder", F.regexp_extract("path", _FOLDER, 1))
    referenced = spark.createDataFrame([(p,) for p in sorted(table.referenced())], "folder string")
    return unreferenced_files(listing, referenced, now, days)


def remove_orphans(table: VersionedTable, now: datetime, days: int = ORPHAN_DAYS) -> int:
    """Delete unreferenced folders in which every file is old enough; returns how many."""
    orphans = table_orphans(table, now, days).groupBy("folder").agg(F.count(F.lit(1)).alias("old"))
    present = files.listing(table.spark, f"{table.path}/data").withColumn("folder", F.regexp_extract("path", _FOLDER, 1))
    everything = present.groupBy("folder").agg(F.count(F.lit(1)).alias("all"))
    gone = orphans.join(everything, "folder").where(F.col("old") == F.col("all")).select("folder").collect()
    return sum(files.delete(table.spark, f"{table.path}/data/{r['folder']}") for r in gone)
