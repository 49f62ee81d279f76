"""Initial load of rows that were there before the change feed started."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.model import INSERT, META
from sediment.sources import filesystem
from sediment.sources.versioned import VersionedTable, by_day

#: Keys that are sampled to place the cuts of a key without quantiles.
SAMPLE = 10_000


def as_changes(rows: DataFrame, keys: Sequence[str], ts: Column | datetime, source: str, target: str) -> DataFrame:
    """Table rows as insert changes, to be appended to the raw table.

    Their offset is -1, below every real one, so a change of the same time wins over the copied row.
    """
    meta = F.struct(
        F.lit(INSERT).alias("op"),
        (ts if isinstance(ts, Column) else F.lit(ts)).cast("timestamp").alias("ts"),
        F.lit(-1).cast("bigint").alias("offset"),
        F.lit(source).alias("source"),
        F.lit(target).alias("target"),
        F.struct(*keys).alias("key"),
    )
    return rows.withColumn(META, meta)


def key_ranges(rows: DataFrame, key: str, chunks: int) -> list[tuple[object, object]]:
    """Bounds of about equal chunks of an orderable key: (exclusive low, inclusive high).

    Numeric keys are cut at their quantiles; keys of any other type at the quantiles of a sample in their own order.
    The first low and the last high are None, so the chunks cover rows that arrive later too.  Only the bounds come to
    the driver.
    """
    shares = [i / chunks for i in range(1, chunks)]
    if not shares:
        return [(None, None)]
    if isinstance(rows.schema[key].dataType, T.NumericType):
        cuts = rows.agg(F.percentile_approx(key, shares, 10000).alias("c")).first()["c"] or []
    else:
        # a bounded sample of distinct keys, by hash: it only places the cuts, no row depends on it
        kept = rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key)).limit(SAMPLE)
        found = sorted(r[0] for r in kept.collect())
        cuts = [found[int(s * len(found))] for s in shares] if found else []
    edges = [None, *sorted(set(cuts)), None]
    return list(zip(edges[:-1], edges[1:]))


def chunk(rows: DataFrame, key: str, low: object, high: object) -> DataFrame:
    """Rows of one range; a null key belongs to the first."""
    condition = F.lit(True)
    if low is not None:
        condition = condition & (F.col(key) > low)
    if high is not None:
        condition = condition & (F.col(key) <= high)
    if low is None:
        condition = condition | F.col(key).isNull()
    return rows.where(condition)


def load_in_chunks(
    table: VersionedTable,
    rows: DataFrame,
    keys: Sequence[str],
    chunks: int,
    ts: datetime,
    source: str,
    target: str,
    load: str | None = None,
) -> int:
    """Append ``rows`` to a raw table as inserts, one key range per commit; returns how many were still to do.

    ``load`` names the load; by default it is its time, so asking for another one is asking with a later time.  The
    ranges of a load are decided once and kept beside the table, and a range whose commit is there is not loaded again,
    so a load that was cut short goes on where it stopped.  Live changes may be appended meanwhile.
    """
    load = load or ts.isoformat()
    dtype = rows.schema[keys[0]].dataType
    plan = f"{table.path}/_loads/{hashlib.sha256(load.encode()).hexdigest()[:32]}.json"
    if filesystem.read_text(table.spark, plan) is None:
        # bounds are kept as text, which every key type can be read back from
        edges = [(low if low is None else str(low), high if high is None else str(high)) for low, high in key_ranges(rows, keys[0], chunks)]
        filesystem.create_text(table.spark, plan, json.dumps(edges))
    ranges = json.loads(filesystem.read_text(table.spark, plan))
    loaded = 0
    for i, bounds in enumerate(ranges):
        low, high = (b if b is None else F.lit(b).cast(dtype) for b in bounds)
        part = as_changes(chunk(rows, keys[0], low, high), keys, ts, source, target)
        loaded += table.append(part, by_day(f"{META}.ts"), (f"load {load}", i)) is not None
    return loaded
