"""Raw change log -> current state."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sediment.model import COPY_ON_WRITE, DELETE, Pipeline
from sediment.operators.latest import OP, latest_per_key
from sediment.operators.merge import merge_changes, merge_guarded
from sediment.operators.schema import plan_changes, state_schema
from sediment.session import scratch_dir
from sediment.sources import filesystem
from sediment.sources.tables import for_each
from sediment.sources.versioned import (
    PENDING,
    Commit,
    VersionedTable,
    by_bucket,
    observed_max_ts,
    observed_time,
)
from sediment.streaming.landing import run_batches
from sediment.streaming.retry import with_retry


@dataclass(frozen=True)
class Outcome:
    """What one run of a pipeline did."""

    bronze: str
    mode: str  # incremental, listed, bounded, full, batch; or skipped, current
    keys: int = 0
    version: int | None = None


class PipelinesFailed(RuntimeError):
    def __init__(self, failures: Sequence[tuple[object, Exception]]):
        super().__init__("; ".join(f"{p.bronze}: {e}" for p, e in failures))
        self.failures = failures


def run_pipeline(pipeline: Pipeline, bronze: VersionedTable, silver: VersionedTable, bounded: bool = False) -> Outcome:
    """Merge what was appended to ``bronze`` since the last run.

    ``bounded`` is passed to :meth:`VersionedTable.read_since`.

    The raw version merged and the largest event time are part of the commit that holds the rows, so they
    cannot get out of step.  Merging the same changes again gives the same state.
    """
    head = bronze.head()
    if head is None or not head.version:
        return Outcome(pipeline.bronze, "skipped")
    state = _prepared(pipeline, silver, bronze.scan((), head.struct, head.layout))
    if state.source_version == head.version:
        return Outcome(pipeline.bronze, "current")
    log, mode = bronze.read_since(state.source_version, head, state.newest, bounded)
    commit, keys = with_retry(lambda: _merge(pipeline, silver, log, source_version=head.version))
    return Outcome(pipeline.bronze, mode, keys, commit.version)


def merge_batch(pipeline: Pipeline, silver: VersionedTable, log: DataFrame, batch: tuple[str, int]) -> Outcome:
    """Merge one micro-batch of a stream; a batch that was committed before is left out."""
    state = _prepared(pipeline, silver, log)
    if state.batches.get(batch[0], -1) >= batch[1]:
        return Outcome(pipeline.bronze, "current")
    commit, keys = with_retry(lambda: _merge(pipeline, silver, log, batch=batch))
    return Outcome(pipeline.bronze, "batch", keys, commit.version)


def _prepared(pipeline: Pipeline, silver: VersionedTable, log: DataFrame) -> Commit:
    """The state table, created or brought to the schema of the log."""
    wanted = state_schema(log, pipeline.casts)
    pipeline.check_columns(wanted.fieldNames())
    state = silver.head()
    if state is None:
        return silver.create(wanted, by_bucket(pipeline.keys, pipeline.bucket_count))
    plan = plan_changes(pipeline.target, state.struct, wanted)
    if not plan:
        return state
    return silver.change("schema", schema=plan.applied_to(state.struct).json())


def _merge(
    pipeline: Pipeline,
    silver: VersionedTable,
    log: DataFrame,
    source_version: int | None = None,
    batch: tuple[str, int] | None = None,
) -> tuple[Commit, int]:
    state = silver.head()
    watched, seen = observed_max_ts(log)
    changes = latest_per_key(watched, pipeline.keys, pipeline.casts)
    if not state.units:
        # nothing to match: the living rows are the base, in either write mode
        counted = Observation()
        living = changes.observe(counted, F.count(F.lit(1)).alias("keys")).where(F.col(OP) != DELETE).drop(OP)
        added = silver.write_units(living, state.layout)
        return silver.change("append", added, batch=batch, **_progress(state, seen, source_version)), counted.get["keys"]
    # casts can make keys equal; only merging at once shows whether they then match one stored row
    recast = any(k in pipeline.casts for k in pipeline.keys)
    if pipeline.write_mode != COPY_ON_WRITE and not recast:
        waiting = silver.write_units(changes, state.layout, PENDING)
        commit = silver.change("append", waiting, batch=batch, **_progress(state, seen, source_version))
        return commit, sum(u.records for u in waiting)

    # the increment is written once to the shared folder: its buckets are known from there, and a lost executor costs
    # no second read of the log
    staged = VersionedTable(silver.spark, scratch_dir(silver.spark, "increment"))
    try:
        waiting = staged.write_units(changes, state.layout, PENDING)
        touched = {u.part for u in waiting}
        stored, incoming = silver.state_of(state, touched), staged.scan(waiting, changes.schema, state.layout)
        if pipeline.guard_ts:
            merged = merge_guarded(stored, incoming, pipeline.keys, pipeline.guard_ts)
        else:
            merged = merge_changes(stored, incoming, pipeline.keys, unique=not recast)
        gone = [u for u in state.units if u.part in touched]
        commit = silver.replace_units(gone, merged, "overwrite", batch=batch, **_progress(state, seen, source_version))
        return commit, sum(u.records for u in waiting)
    finally:
        filesystem.delete(silver.spark, staged.path)


def _progress(state: Commit, seen: Observation, source_version: int | None) -> dict:
    merged = {} if source_version is None else {"source_version": source_version}
    return {**merged, "max_ts": _later(state.newest, observed_time(seen))}


def _later(previous: datetime | None, seen: datetime | None) -> str | None:
    """The larger of the two, so the mark never moves back."""
    known = [t for t in (previous, seen) if t is not None]
    return max(known).isoformat() if known else None


def run_all(
    pipelines: Sequence[Pipeline],
    bronze: Callable[[Pipeline], VersionedTable],
    silver: Callable[[Pipeline], VersionedTable],
    at_once: int = 4,
) -> list[Outcome]:
    """Run each pipeline, some at the same time; one that fails does not hold up the others, but fails the job at the end."""
    outcomes: list[Outcome] = []
    failures = for_each(pipelines, lambda p: outcomes.append(run_pipeline(p, bronze(p), silver(p))), at_once)
    if failures:
        raise PipelinesFailed(failures)
    return outcomes


def stream_merge(pipeline: Pipeline, log: DataFrame, silver: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Merge a streaming change log batch by batch until the available input is used up."""
    return run_batches(log, checkpoint, lambda batch, name: merge_batch(pipeline, silver, batch, name))

