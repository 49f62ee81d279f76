"""Initial load in key ranges while changes keep coming.

The feed and the load read the same source at different moments, so a copied row may be older or newer than a change
of the same key. Each range is therefore read between two marks that are placed in the feed itself: a *low* mark before
the read and a *high* mark after it. Changes up to the low mark are contained in what is read; changes after the high
mark are newer than it; for a key that changed in between nobody knows, so its copied row is dropped and the change
stands. What is left is written at the place of the low mark, so it never wins over a change that comes after it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.model import INSERT, META
from sediment.sources import filesystem
from sediment.sources.versioned import VersionedTable, by_day

Bounds = tuple[str | None, str | None]


@dataclass(frozen=True)
class Mark:
    """A place in the feed: the offset and the event time of the record that marks it."""

    offset: int
    ts: str

    @staticmethod
    def at(offset: int, ts: datetime) -> Mark:
        return Mark(offset, ts.isoformat())


@dataclass(frozen=True)
class Progress:
    """Ranges written by this call, and ranges that are still to be written."""

    loaded: int
    left: int


def chunk_changes(rows: DataFrame, log: DataFrame, keys: Sequence[str], low: Mark, high: Mark, source: str, target: str) -> DataFrame:
    """Rows read between two marks as inserts at the low mark, without the keys that ``log`` changes between them.

    Only the log's keys in that stretch are read, and they meet the rows in an anti join. Keys compare as equal where
    both are null, so a null key that changed is dropped too. The log must hold everything up to the high mark.
    """
    place = F.col(f"{META}.offset")
    changed = log.where((place > low.offset) & (place <= high.offset)).select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)))
    same = reduce(and_, (F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    meta = F.struct(
        F.lit(INSERT).alias("op"),
        F.lit(datetime.fromisoformat(low.ts)).cast("timestamp").alias("ts"),
        F.lit(low.offset).cast("bigint").alias("offset"),
        F.lit(source).alias("source"),
        F.lit(target).alias("target"),
        F.struct(*(F.col(f"`{k}`") for k in keys)).alias("key"),
    )
    return rows.join(changed, same, "left_anti").withColumn(META, meta)


def reached(table: VersionedTable, offset: int) -> bool:
    """Whether the raw table holds a record at or after a place of the feed. Copied rows do not count."""
    head = table.head()
    if head is None or META not in head.struct.fieldNames():
        return False
    rows = table.scan(head.units, head.struct, head.layout)
    return not rows.where(F.col(f"{META}.offset") >= offset).limit(1).isEmpty()


def load_live(
    table: VersionedTable,
    read: Callable[[Bounds], DataFrame],
    ranges: Sequence[Bounds],
    keys: Sequence[str],
    mark: Callable[[], Mark],
    load: str,
    source: str,
    target: str,
) -> Progress:
    """Copy the key ranges of a source into a raw table that the feed is appended to meanwhile.

    ``mark`` writes a mark into the source's feed and tells its place; ``read`` gives the source's rows of a range as
    they are now. Each range is read into a table of its own between its marks, which is noted beside the raw table;
    once the raw table has reached the high mark the rows are compared with the feed and appended, in a commit that names
    load and range. Until then the call ends there, so call again while something is left. A load that was cut short
    goes on where it stopped: written ranges are skipped, one that was read is not read again, one that was being read
    gets new marks. Another ``load`` of the same ranges copies them again, as a later state of the rows.
    """
    spark, name = table.spark, f"live load {load}"
    folder = f"{table.path}/_loads/{hashlib.sha256(load.encode()).hexdigest()[:32]}"
    head = table.head()
    done = head.batches.get(name, -1) + 1 if head else 0
    for i, bounds in list(enumerate(ranges))[done:]:
        text = filesystem.read_text(spark, f"{folder}/{i}.json")
        if text is None:
            low, rows = mark(), f"{folder}/rows-{i}-{uuid.uuid4().hex}"
            read(bounds).write.parquet(rows)
            text = json.dumps({"rows": rows, "low": asdict(low), "high": asdict(mark())})
            filesystem.create_text(spark, f"{folder}/{i}.json", text)
        note = json.loads(text)
        low, high = Mark(**note["low"]), Mark(**note["high"])
        if not reached(table, high.offset):
            return Progress(i - done, len(ranges) - i)
        head = table.head()
        log = table.scan(head.units, head.struct, head.layout)
        table.append(chunk_changes(spark.read.parquet(note["rows"]), log, keys, low, high, source, target), by_day(f"{META}.ts"), (name, i))
        filesystem.delete(spark, note["rows"])
    return Progress(len(ranges) - done, 0)
