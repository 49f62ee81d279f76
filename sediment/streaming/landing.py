"""Streams -> raw tables, bad records set aside.

A batch is known by the id of its stream, which its checkpoint keeps, and its number. One that the table's commit log
names already is skipped, so a restart between the write and the checkpoint adds nothing twice. Another stream, or the
same one with a new checkpoint, has an id of its own, so none of its rows is taken for another's: what it reads again
lands again, and the merge by key takes that.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sediment.model import META
from sediment.operators.schema import merge_schemas
from sediment.sources import accesslog, documents, envelopes, filesystem, jsonstream
from sediment.sources.tables import for_each
from sediment.sources.versioned import VersionedTable, by_day


Batch = tuple[str, int]


def run_batches(
    stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, Batch], None], interval: str | None = None, output: str = "append"
) -> StreamingQuery:
    """Runs ``work`` on every batch, with the batch's name: the stream's id and the batch's number."""
    spark = stream.sparkSession

    def named(batch: DataFrame, number: int) -> None:
        kept = json.loads(filesystem.read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))
        work(batch, (kept["id"], number))

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = stream.writeStream.outputMode(output).foreachBatch(named)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


@contextmanager
def _kept(df: DataFrame) -> Iterator[DataFrame]:
    """Parsed once for several writes; parts lost with an executor are read from the source again."""
    try:
        yield df.persist()
    finally:
        df.unpersist()


def land_documents(
    stream: DataFrame, bronze: VersionedTable, quarantine: VersionedTable, target: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Document change events to their raw table and its quarantine."""

    def work(batch: DataFrame, name: Batch) -> None:
        with _kept(documents.classify(batch)) as classified:
            bronze.append(documents.bronze_rows(classified, target), by_day("_cdc.ts"), name)
            quarantine.append(documents.quarantine_rows(classified), by_day("ts"), name)

    return run_batches(stream, checkpoint, work, interval)


def land_changes(
    stream: DataFrame,
    raw: Callable[[str], VersionedTable],
    dead: VersionedTable,
    target: str,
    checkpoint: str,
    declared: Mapping[str, T.StructType] | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Relational change events of any number of tables, each to its own raw table; what cannot be used to ``dead``.

    ``raw`` gives the table for a name that ``target`` makes, e.g. ``shop_raw.orders``; a table is created when its
    first record comes.  Columns are those that ``declared`` names for it, those it has, and those the batch brings:
    new ones are added, and types widen where that is safe.  A value that does not fit its column sends its record to
    ``dead``.  Each batch is parsed once; only the tables that got records are written.

    A table that cannot be written fails the batch after the others are done; when the batch comes again they
    skip it, because their commit logs name it.
    """
    declared = declared or {}

    def write(events: DataFrame, table: str, name: Batch) -> DataFrame:
        """Lands one table's events; returns them typed, for what is to be set aside."""
        own = events.where((F.col("_target") == table) & F.col("reason").isNull())
        head = raw(table).head()
        stored = T.StructType([f for f in head.struct.fields if f.name != META] if head else [])
        seen = jsonstream.infer_schema(own.select(F.col("_row_text").alias("value")))
        keys = jsonstream.infer_schema(own.select(F.col("_key_text").alias("value")))
        row = envelopes.row_schema(table, declared.get(table, T.StructType([])), stored, merge_schemas(table, [seen, without(keys, seen)]))
        typed = envelopes.typed_rows(own, row, keys.fieldNames())
        raw(table).append(envelopes.flatten(typed), by_day(f"{META}.ts"), name)
        return envelopes.dead_letters(typed)

    def work(batch: DataFrame, name: Batch) -> None:
        with _kept(envelopes.open_envelopes(batch, target)) as events:
            # names only: as many as the source has tables
            usable = events.where(F.col("reason").isNull()).select("_target").distinct()
            unreadable = [envelopes.dead_letters(events)]
            failures = for_each([r[0] for r in usable.collect()], lambda table: unreadable.append(write(events, table, name)), 4)
            if failures:
                raise RuntimeError("; ".join(f"{table}: {error}" for table, error in failures))
            dead.append(reduce(DataFrame.unionByName, unreadable), by_day("ts"), name)

    return run_batches(stream, checkpoint, work, interval)


def without(columns: T.StructType, others: T.StructType) -> T.StructType:
    return T.StructType([f for f in columns.fields if f.name not in others.fieldNames()])


def land_json(
    stream: DataFrame,
    table: VersionedTable,
    dead: VersionedTable,
    contract: Mapping[str, str] | None,
    checkpoint: str,
    interval: str | None = None,
    millis: Sequence[str] = (),
    whole: Sequence[str] = (),
) -> StreamingQuery:
    """A JSON event stream to its table: new fields become columns, broken records go to ``dead``.

    Undeclared fields are read by the stored schema widened by the batch; one whose type changed fails the
    batch before anything is written.  Fields in ``whole`` are kept as one column of JSON text each, whatever they
    hold, so that an object keyed by ids does not become a column for every id.  The source is read once.
    """

    def work(batch: DataFrame, name: Batch) -> None:
        head = table.head()
        fixed = {jsonstream.ARRIVAL, *(contract or {}), *millis, *whole}
        known = T.StructType([f for f in head.struct.fields if f.name not in fixed] if head else [])
        with _kept(batch) as records:
            schema = jsonstream.evolve(table.path, known, jsonstream.infer_schema(records, contract, millis, whole))
            read = jsonstream.read_json(records, schema, contract, millis, whole)
            table.append(jsonstream.good_rows(read), by_day(jsonstream.ARRIVAL), name)
            dead.append(jsonstream.dead_letters(read), by_day("timestamp"), name)

    return run_batches(stream, checkpoint, work, interval)


def land_access_log(lines: DataFrame, table: VersionedTable, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Log lines (``value``, ``server``) of any number of servers to one table, laid out by day.

    Lines of another shape land too, whole, with the time of the batch.
    """

    def work(batch: DataFrame, name: Batch) -> None:
        parsed = accesslog.parse_lines(batch, F.col("server"), F.current_timestamp())
        table.append(parsed, by_day("ts"), name)

    return run_batches(lines, checkpoint, work, interval)
