"""Parquet tables with a commit log.

Each write adds new folders and then one commit record naming all folders that make up the table.  Readers
resolve a record and hand its folders to ``spark.read.parquet``; nothing is ever overwritten in place.  Several jobs
may commit to one table where the file system renames atomically; on object stores a table has one writer.  This is what versions, increments, upkeep and health have to work on when no table format
is on the class path; all work on rows is ordinary DataFrame work.

A unit is one folder ``data/commit=<n>[/_part=<value>]``: a day of a raw table, a bucket of a state table.  Rows
of a state table are in ``base`` units; merge-on-read increments wait in ``pending`` units.
"""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.model import META
from sediment.operators.latest import OP
from sediment.operators.merge import COMMIT, merged_view
from sediment.operators.schema import merge_schemas
from sediment.sources import filesystem as files

PART = "_part"
#: Operations that keep rows as they are, in other folders.
REWRITES = ("replace", "delete")
BASE, PENDING = "base", "pending"

LOG_SCHEMA = (
    "version bigint, parent bigint, committed_at timestamp, operation string, summary map<string,string>, "
    "source_version bigint, max_ts timestamp"
)


class CommitConflict(RuntimeError):
    """Another commit took the version."""


class VersionNotFound(LookupError):
    """The version has expired or never existed."""


@dataclass(frozen=True)
class Layout:
    """How a table is split into folders: by day of a time column, by bucket of the first key, or not at all."""

    kind: str = ""
    column: str = ""
    buckets: int = 0
    keys: tuple[str, ...] = ()

    def value(self, schema: T.StructType) -> Column | None:
        """The partition value of a row; the same whatever the session's time zone."""
        if not self.kind:
            return None
        dtype: T.DataType = schema
        for name in self.column.split("."):
            dtype = dtype[name].dataType
        column = F.col(self.column)
        if self.kind == "day":
            local = F.convert_timezone(None, F.lit("UTC"), column) if isinstance(dtype, T.TimestampType) else column
            return local.cast("date")
        if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
            raise ValueError(f"{self.column}: a floating-point key cannot choose a bucket")
        # through text, so that a key widened from int to bigint stays in its bucket
        text = (F.unix_micros(column) if isinstance(dtype, T.TimestampType) else column).cast("string")
        return F.pmod(F.xxhash64(text), F.lit(self.buckets)).cast("int")

    @property
    def part_type(self) -> T.DataType:
        return T.DateType() if self.kind == "day" else T.IntegerType()


def by_day(column: str) -> Layout:
    return Layout("day", column)


def by_bucket(keys: Sequence[str], buckets: int) -> Layout:
    """Only the first key chooses the bucket, so put the one with the most values first."""
    if not keys:
        raise ValueError("keys must not be empty")
    return Layout("bucket", keys[0], buckets, tuple(keys))


@dataclass(frozen=True)
class Unit:
    path: str
    commit: int
    kind: str
    records: int
    files: int
    bytes: int
    #: The last commit whose appended rows it holds; a rewrite keeps it, so it then differs from ``commit``.
    origin: int = -1

    @property
    def number(self) -> int:
        """The number in the folder's name, which all parts of one write share."""
        return int(self.path.partition("/")[0].partition("=")[2])

    @property
    def part(self) -> str | None:
        return self.path.partition(f"/{PART}=")[2] or None

    @property
    def day(self) -> date | None:
        """The partition value as a day; None for rows without a time."""
        try:
            return date.fromisoformat(self.part or "")
        except ValueError:
            return None


@dataclass(frozen=True)
class Commit:
    version: int
    parent: int | None
    committed_at: str
    operation: str
    schema: str
    layout: Layout
    units: tuple[Unit, ...]
    summary: dict[str, str] = field(default_factory=dict)
    source_version: int | None = None
    max_ts: str | None = None
    batches: dict[str, int] = field(default_factory=dict)
    #: The last version that replaced the whole table.
    rebuilt: int = -1

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    @property
    def newest(self) -> datetime | None:
        return datetime.fromisoformat(self.max_ts) if self.max_ts else None

    def of(self, kind: str) -> tuple[Unit, ...]:
        return tuple(u for u in self.units if u.kind == kind)


def _summary(units: Iterable[Unit], added: Iterable[Unit]) -> dict[str, str]:
    units, added = list(units), list(added)
    base = [u for u in units if u.kind == BASE]
    return {
        "total-records": str(sum(u.records for u in base)),
        "total-data-files": str(sum(u.files for u in base)),
        "total-delete-files": str(sum(u.files for u in units if u.kind == PENDING)),
        "total-files-size": str(sum(u.bytes for u in units)),
        "added-records": str(sum(u.records for u in added)),
        "added-data-files": str(sum(u.files for u in added)),
    }


def _now() -> datetime:
    return datetime.now(timezone.utc)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], datetime] = _now):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock

    # ---- commit log -------------------------------------------------------------------------------------

    def _record(self, version: int) -> str:
        return f"{self.path}/_commits/{version:012d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in files.names(self.spark, f"{self.path}/_commits") if n.endswith(".json"))

    def head(self) -> Commit | None:
        found = self.versions()
        return self.commit(found[-1]) if found else None

    def commit(self, version: int) -> Commit:
        text = files.read_text(self.spark, self._record(version))
        if text is None:
            raise VersionNotFound(f"{self.path}: version {version} has expired or never existed")
        raw = json.loads(text)
        raw["layout"] = Layout(**{**raw["layout"], "keys": tuple(raw["layout"]["keys"])})
        raw["units"] = tuple(Unit(**u) for u in raw["units"])
        return Commit(**raw)

    def commits(self) -> DataFrame:
        """One row per kept commit."""
        if not self.versions():
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).json(f"{self.path}/_commits")

    def history(self) -> DataFrame:
        """Which versions lead to the present one; a version that was rolled back does not."""
        parents = {r["version"]: r["parent"] for r in self.commits().select("version", "parent").collect()}
        line, at = [], max(parents, default=None)
        while at in parents:
            line.append(at)
            at = parents[at]
        return self.commits().select(
            F.col("committed_at").alias("made_current_at"),
            F.col("version").alias("snapshot_id"),
            F.col("parent").alias("parent_id"),
            F.col("version").isin(line).alias("is_current_ancestor"),
        )

    def publish(self, commit: Commit) -> Commit:
        text = json.dumps(asdict(commit), default=str)
        if not files.create_text(self.spark, self._record(commit.version), text):
            raise CommitConflict(f"commit conflict: {self.path} already has version {commit.version}")
        return commit

    def change(
        self,
        operation: str,
        added: Iterable[Unit] = (),
        gone: Iterable[Unit] | None = (),
        batch: tuple[str, int] | None = None,
        incoming: T.StructType | None = None,
        **more,
    ) -> Commit:
        """Publish the version after the present one: some units come, some go (all of them for None).

        Another job may commit meanwhile.  As long as it left the units alone that go here, the change is
        simply put on top of it; otherwise it is a conflict, to be worked out again from the new state.
        """
        for last in (False, False, True):
            head = self.head()
            leaving = set(head.units if gone is None else gone)
            if not leaving <= set(head.units):
                raise CommitConflict(f"commit conflict: units of {self.path} were replaced meanwhile")
            version = head.version + 1
            # rows that were only put elsewhere are as old as the newest of the units they came from
            moved = max((u.origin for u in leaving), default=version) if operation in REWRITES else version
            new = [replace(u, commit=version, origin=moved) for u in added]
            units = (*(u for u in head.units if u not in leaving), *new)
            settings = dict(more)
            if operation == "overwrite":
                settings["rebuilt"] = version
            if batch:
                settings["batches"] = {**head.batches, batch[0]: batch[1]}
            if incoming is not None:
                settings["schema"] = merge_schemas(self.path, [head.struct, incoming]).json()
            following = replace(
                head,
                version=version,
                parent=head.version,
                committed_at=self.clock().isoformat(),
                operation=operation,
                units=units,
                summary=_summary(units, new),
                **settings,
            )
            try:
                return self.publish(following)
            except CommitConflict:
                if last:
                    raise
        raise AssertionError

    # ---- writing ----------------------------------------------------------------------------------------

    def create(self, schema: T.StructType, layout: Layout = Layout()) -> Commit:
        """An empty table."""
        top = layout.column.split(".")[0]
        if layout.kind and top not in schema.fieldNames():
            raise ValueError(f"{self.path}: layout column {layout.column!r} is not in the table")
        absent = [k for k in layout.keys if k not in schema.fieldNames()]
        if absent:
            raise ValueError(f"{self.path}: key column(s) not in the table: {absent}")
        return self.publish(
            Commit(0, None, self.clock().isoformat(), "create", schema.json(), layout, (), _summary((), ()))
        )

    def write_units(self, df: DataFrame, layout: Layout, kind: str = BASE) -> list[Unit]:
        """Write rows as new folders and measure them; not visible until a commit names them.

        Rows are spread by partition value with a rebalance: small values share a task, and a value that holds
        a third of all rows is split over several.  Counts come from the Parquet footers.

        No two writes share a folder's number. It says nothing about their order: of two jobs the one that
        began first may commit last, so increments are ordered by the commit that lists them.
        """
        number = (max(self.versions(), default=-1) + 1) << 20 | secrets.randbits(20)
        folder = f"{self.path}/data/{COMMIT}={number}"
        value = layout.value(df.schema)
        if value is None:
            df.write.parquet(folder)
        else:
            df.withColumn(PART, value).hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(folder)
        if not any(not n.startswith("_") or "=" in n for n in files.names(self.spark, folder)):
            return []
        stored = self.spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(folder)
        per_file = stored.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).count()
        unit = F.regexp_extract("file", rf"({COMMIT}=\d+(?:/{PART}=[^/]+)?)/[^/]+$", 1)
        rows = (
            per_file.groupBy(unit.alias("path"))
            .agg(F.sum("count").alias("records"), F.count("file").alias("files"), F.sum("size").alias("bytes"))
            .collect()
        )
        return [Unit(r["path"], -1, kind, r["records"], r["files"], r["bytes"]) for r in sorted(rows)]

    def append(self, df: DataFrame, layout: Layout = Layout(), batch: tuple[str, int] | None = None) -> Commit | None:
        """Add rows; the table is created and columns are added as needed.

        ``batch`` is (stream, batch id): a batch that was committed before is not written again.  Files keep the
        columns and types they came with; readers widen them to the merged schema.
        """
        head = self.head() or self.create(df.schema, layout)
        if batch and head.batches.get(batch[0], -1) >= batch[1]:
            return None
        merge_schemas(self.path, [head.struct, df.schema])  # a conflict shows before anything is written
        return self.change("append", self.write_units(df, head.layout), batch=batch, incoming=df.schema)

    def overwrite(self, df: DataFrame, layout: Layout = Layout()) -> Commit:
        """Replace the whole table."""
        head = self.head() or self.create(df.schema, layout)
        return self.change("overwrite", self.write_units(df, head.layout), None, schema=df.schema.json())

    def replace_units(
        self, gone: Iterable[Unit], df: DataFrame | None, operation: str, **more
    ) -> Commit:
        """Put new rows in the place of some units; the other units are carried over untouched."""
        added = [] if df is None else self.write_units(df, self.head().layout)
        return self.change(operation, added, gone, **more)

    # ---- reading ----------------------------------------------------------------------------------------

    def scan(self, units: Iterable[Unit], schema: T.StructType, layout: Layout, keep_layout: bool = False) -> DataFrame:
        """Rows of some units under ``schema``: older files lack its newer columns and hold narrower types."""
        paths = [f"{self.path}/data/{u.path}" for u in units]
        extra = [T.StructField(COMMIT, T.LongType())]
        if layout.kind:
            extra.append(T.StructField(PART, layout.part_type))
        full = T.StructType([*schema.fields, *extra])
        if not paths:
            rows = self.spark.createDataFrame([], full)
        else:
            rows = self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths)
        return rows if keep_layout else rows.drop(COMMIT, PART)

    def resolve(self, version: int | None = None, as_of: datetime | None = None) -> Commit:
        """A version by number, or the newest one committed at or before a time; the head by default."""
        if as_of is not None:
            found = self.commits().where(F.col("committed_at") <= F.lit(as_of)).agg(F.max("version")).first()[0]
            if found is None:
                raise VersionNotFound(f"{self.path}: no version is as old as {as_of}")
            version = found
        commit = self.commit(version) if version is not None else self.head()
        if commit is None:
            raise VersionNotFound(f"{self.path}: nothing was ever committed")
        return commit

    def read(self, version: int | None = None, as_of: datetime | None = None) -> DataFrame:
        """The table at a version; pending increments are merged in."""
        return self.state_of(self.resolve(version, as_of))

    def state_of(self, commit: Commit, parts: set[str | None] | None = None) -> DataFrame:
        """Rows of a version, or of some of its parts."""
        wanted = [u for u in commit.units if parts is None or u.part in parts]
        base = [u for u in wanted if u.kind == BASE]
        pending = [u for u in wanted if u.kind == PENDING]
        if not pending:
            return self.scan(base, commit.struct, commit.layout)
        touched = {u.part for u in pending}
        schema = T.StructType([*commit.struct.fields, T.StructField(OP, T.StringType())])
        changes = self.scan(pending, schema, commit.layout, keep_layout=True).drop(PART)
        # a folder is numbered when it is written; what counts is the commit that brought it
        order = {u.number: u.commit for u in pending}
        changes = changes.withColumn(COMMIT, F.element_at(F.create_map(*(F.lit(x).cast("bigint") for pair in order.items() for x in pair)), F.col(COMMIT)))
        held = self.scan([u for u in base if u.part in touched], commit.struct, commit.layout)
        merged = merged_view(held, changes, commit.layout.keys)
        # parts without a change pass the join by
        rest = [u for u in base if u.part not in touched]
        return merged.unionByName(self.scan(rest, commit.struct, commit.layout)) if rest else merged

    def read_since(self, after: int | None, head: Commit, max_ts: datetime | None = None, bounded: bool = False) -> tuple[DataFrame, str]:
        """Rows appended after version ``after``, with how they were found.

        ``incremental``: the folders of the append commits in between; replaced and deleted units are no news.
        When one of those commits has expired, the units that the head lists as appended since are read (``listed``),
        as long as none of them was rewritten meanwhile.  Otherwise, or when the table was overwritten, all rows are
        read again (``full``).  ``bounded`` asks for the last day before ``max_ts`` instead (whole days by folder,
        then the exact time): cheaper, but rows of an older time that arrived meanwhile are then never seen.
        """
        kept = set(self.versions())
        if after is not None and all(v in kept for v in range(after, head.version + 1)):
            between = [self.commit(v) for v in range(after + 1, head.version + 1)]
            if all(c.operation != "overwrite" for c in between):
                new = [u for c in between if c.operation == "append" for u in c.units if u.commit == c.version]
                return self.scan(new, head.struct, head.layout), "incremental"
        elif after is not None and head.rebuilt <= after <= head.version:
            new = [u for u in head.of(BASE) if u.origin > after]
            if all(u.commit == u.origin for u in new):
                return self.scan(new, head.struct, head.layout), "listed"
        if bounded and max_ts is not None:
            return self.scan_from(head, max_ts - timedelta(days=1)), "bounded"
        return self.scan(head.units, head.struct, head.layout), "full"

    def scan_from(self, commit: Commit, low: datetime, column: str = f"{META}.ts") -> DataFrame:
        """Rows whose time is at or after ``low``; a table laid out by day opens no older folder."""
        units = commit.units
        if commit.layout.kind == "day":
            units = [u for u in units if (day := u.day) and day >= low.astimezone(timezone.utc).date()]
        return self.scan(units, commit.struct, commit.layout).where(F.col(column) >= F.lit(low))

    def files(self, commit: Commit | None = None) -> DataFrame:
        """One row per data file: file_path, file_format, record_count, file_size_in_bytes, part."""
        commit = commit or self.resolve()
        rows = self.scan(commit.of(BASE), commit.struct, commit.layout, keep_layout=True)
        if not commit.of(BASE):
            return self.spark.createDataFrame(
                [], "file_path string, file_format string, record_count bigint, file_size_in_bytes bigint"
            )
        return (
            rows.groupBy(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size_in_bytes"))
            .agg(F.count(F.lit(1)).alias("record_count"))
            .select("file_path", F.lit("PARQUET").alias("file_format"), "record_count", "file_size_in_bytes")
        )

    def referenced(self) -> set[str]:
        """Folders named by any kept version."""
        return {u.path for v in self.versions() for u in self.commit(v).units}


def observed_max_ts(log: DataFrame) -> tuple[DataFrame, Observation]:
    """The log with its largest event time taken along while it is read, not in a second pass."""
    seen = Observation()
    return log.observe(seen, F.max(F.unix_micros(f"{META}.ts")).alias("max_micros")), seen


def observed_time(seen: Observation) -> datetime | None:
    """What :func:`observed_max_ts` saw, once the log was read."""
    micros = seen.get["max_micros"]
    return None if micros is None else datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)
