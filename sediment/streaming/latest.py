"""The newest change per key, kept in a stream's state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sediment.model import META
from sediment.sources.versioned import VersionedTable, by_day
from sediment.streaming.landing import run_batches

#: How long late changes still count, and the stretch of time that a key has one state for.
LATENESS, STRETCH = "3 days", "1 day"


def newest_changes(log: DataFrame, keys: Sequence[str], lateness: str = LATENESS, stretch: str = STRETCH) -> DataFrame:
    """The newest change by (``_cdc.ts``, ``_cdc.offset``) of each key in each stretch of event time, as a change log.

    The state holds a row for each key and stretch that late changes can still reach: it is let go when the watermark
    has passed the stretch, so it does not grow with all keys that ever changed. A key with a third of all changes is
    reduced in each task before it is sent. Changes without a time count in no stretch and are left out.
    """
    named = [F.col(f"`{k}`") for k in keys]
    rest = [F.col(f"`{c}`") for c in log.columns if c not in keys]
    order = F.struct(f"{META}.ts", f"{META}.offset", f"{META}.op")
    timed = log.withColumn("_ts", F.col(f"{META}.ts")).withWatermark("_ts", lateness)
    grouped = timed.groupBy(F.window("_ts", stretch).alias("_stretch"), *named).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    own = [F.col("_last")[c].alias(c) if c not in keys else F.col(f"`{c}`") for c in log.columns]
    return grouped.select(*own)


def land_newest(
    log: DataFrame, keys: Sequence[str], table: VersionedTable, checkpoint: str, lateness: str = LATENESS, stretch: str = STRETCH, interval: str | None = None
) -> StreamingQuery:
    """Every batch's new newest changes to a table, which is a change log of far fewer rows: a key has one in a batch and
    stretch at most. :func:`sediment.operators.latest.current_state` of the table is the state of the whole log.

    It goes on after a restart where it stopped. Changes that come later than ``lateness`` are not in it;
    :func:`sediment.streaming.web.late_rows` says how many there were.
    """
    return run_batches(newest_changes(log, keys, lateness, stretch), checkpoint, lambda batch, name: table.append(batch, by_day(f"{META}.ts"), name), interval, "update")
