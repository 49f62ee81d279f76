"""MERGE semantics as DataFrame joins.

``target`` is the stored state, ``changes`` the newest change per key with its operation in ``_op``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.model import DELETE, UPDATE
from sediment.operators.latest import OP

COMMIT = "commit"
_S = "_s_"
_RESET = "_reset"

_SALTS = 1024


def _has_key(keys: Sequence[str]) -> Column:
    return reduce(and_, (F.col(f"`{k}`").isNotNull() for k in keys))


def _salt(columns: Sequence[str], keys: Sequence[str]) -> Column:
    """0 for rows with a key; rows without one, which match nothing, are dealt out by some of their content."""
    spread = F.pmod(F.xxhash64(F.lit(0), *(F.col(f"`{c}`").cast("string") for c in columns)), F.lit(_SALTS)).cast("int")
    return F.when(_has_key(keys), F.lit(0)).otherwise(spread)


def _telling(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """At most two columns to deal out rows by, numbers and times first; few, because they are read for it."""
    kinds = (T.NumericType, T.DatetimeType), (T.StringType,)
    return [f.name for kind in kinds for f in df.schema.fields if isinstance(f.dataType, kind) and f.name not in keys][:2]


def merge_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], *, unique: bool = False) -> DataFrame:
    """State after ``changes``; columns are those of ``target``.

    * matched and deleted -> gone; matched -> the change's columns replace the stored ones, columns only the
      target has are kept;
    * not matched and not deleted -> inserted, target-only columns null; not matched and deleted -> ignored;
    * a null key matches nothing, so such a change is inserted each time;
    * several changes that match one stored row are an error, as in MERGE.

    ``unique`` states that ``changes`` has one row per key already and saves the check.  The target is read once.
    Changes that bring all its columns are one anti join and a union, for which the planner may send the changed keys to
    the target's rows instead of shuffling them.  Otherwise, and where keys may repeat, it is one full join; repeated
    keys are counted on the join's own partitioning.  Rows with a null key, which match nothing, are spread by content.
    Merge several increments through a written table or :func:`fold_pending`, not by nesting.
    """
    keys = list(keys)
    stored = target.withColumn("_at", _salt(_telling(target, keys), keys))
    source = changes.withColumn("_at", _salt(_telling(changes.drop(OP), keys), keys))
    source = source.select(*(F.col(f"`{c}`").alias(_S + c) for c in source.columns))
    on = reduce(and_, (F.col(f"`{k}`") == F.col(f"`{_S}{k}`") for k in [*keys, "_at"]))
    if unique and set(target.columns) <= set(changes.columns):
        kept = stored.join(source.select(*(F.col(f"`{_S}{k}`") for k in [*keys, "_at"])), on, "left_anti")
        return kept.select(*(F.col(f"`{c}`") for c in target.columns)).unionByName(_inserted(changes, target))
    if not unique:
        alike = Window.partitionBy(*(F.col(f"`{_S}{k}`") for k in [*keys, "_at"]))
        source = source.withColumn("_n", F.when(F.col(_S + "_at") == 0, F.count(F.lit(1)).over(alike)))
    joined = stored.withColumn("_t", F.lit(True)).join(source.withColumn("_s", F.lit(True)), on, "full_outer")
    return _resolve(joined, target.columns, changes.columns, keys, unique)


def _resolve(joined: DataFrame, columns: Sequence[str], changed: Sequence[str], keys: Sequence[str], unique: bool) -> DataFrame:
    source, stored = F.col("_s").isNotNull(), F.col("_t").isNotNull()
    op = F.col(_S + OP)
    keep = F.when(~source, True).when(stored, ~op.eqNullSafe(DELETE)).otherwise(op != DELETE)
    if not unique:
        error = F.raise_error(F.lit("several changes match one stored row; keys must be unique")).cast("boolean")
        keep = F.when(source & stored & (F.col("_n") > 1), error).otherwise(keep)

    def column(name: str) -> Column:
        old = F.col(f"`{name}`")
        if name in keys:
            return F.coalesce(old, F.col(f"`{_S}{name}`")).alias(name)
        if name in changed:
            return F.when(source, F.col(f"`{_S}{name}`")).otherwise(old).alias(name)
        if _RESET in changed:
            return F.when(F.coalesce(F.col(_S + _RESET), F.lit(False)), None).otherwise(old).alias(name)
        return old

    return joined.where(keep).select(*(column(c) for c in columns))


def _inserted(changes: DataFrame, target: DataFrame) -> DataFrame:
    """Changes as rows of the target, without the deletes."""
    return changes.where(F.col(OP) != DELETE).select(
        *(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target.schema.fields)
    )


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update what matches, insert the rest, delete nothing."""
    return merge_changes(target, source.withColumn(OP, F.lit(UPDATE)), keys)


def fold_pending(pending: DataFrame, keys: Sequence[str], order: str = COMMIT) -> DataFrame:
    """One change per key out of several pending increments, equal to applying them one after another.

    Increments are ordered by the commit that brought them, not by event time, because that is how they would
    have been merged.  ``_reset`` marks a key that was deleted and came back: its target-only columns start
    from null again.  Each increment holds a key at most once, so a group is never larger than the number of
    pending increments.  Null keys match nothing and are all kept.
    """
    keys = list(keys)
    rest = [c for c in pending.columns if c not in keys and c != order]
    folded = (
        pending.where(_has_key(keys))
        .groupBy(*keys)
        .agg(
            F.max_by(F.struct(*rest), F.col(order)).alias("_last"),
            F.max(F.when(F.col(OP) == DELETE, F.col(order))).alias("_deleted_at"),
        )
        .select(*keys, "_last.*", F.coalesce(F.col("_last")[OP] != DELETE, F.lit(True)).alias("_lives"), "_deleted_at")
        .withColumn(_RESET, F.col("_deleted_at").isNotNull() & F.col("_lives"))
        .drop("_lives", "_deleted_at")
    )
    unkeyed = pending.where(~_has_key(keys)).drop(order).withColumn(_RESET, F.lit(False))
    return folded.unionByName(unkeyed)


def merged_view(base: DataFrame, pending: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge-on-read: ``base`` as it would be after every pending increment was folded in."""
    return merge_changes(base, fold_pending(pending, keys), keys, unique=True)


def merge_guarded(target: DataFrame, changes: DataFrame, keys: Sequence[str], ts: str, tombstones: DataFrame | None = None) -> DataFrame:
    """Merge that ignores a change older than what is known of its key.

    Both sides carry the event time in ``ts``.  The plain merge has no such guard: a change that arrives late
    replaces newer state.  A deleted row leaves nothing to compare with but its tombstone (:func:`next_tombstones`):
    with ``tombstones`` a change as old as the delete or older stays out, and a younger one brings the key back.
    """
    return merge_changes(target, _fresh(target, changes, list(keys), ts, tombstones), keys, unique=True)


#: The time of the last delete of a key.
DELETED_AT = "deleted_at"


def _fresh(target: DataFrame, changes: DataFrame, keys: list[str], ts: str, tombstones: DataFrame | None) -> DataFrame:
    """The changes that no stored row and no tombstone holds back. A key has one or the other, so one join finds both."""
    none = F.lit(None).cast(target.schema[ts].dataType)
    known = target.where(_has_key(keys)).select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{ts}`").alias("_stored_ts"), none.alias("_gone_ts"))
    if tombstones is not None:
        gone = tombstones.select(*(F.col(f"`{k}`") for k in keys), none.alias("_stored_ts"), F.col(DELETED_AT).alias("_gone_ts"))
        known = known.unionByName(gone)
    own = F.col(f"`{ts}`")
    again = F.col(OP).eqNullSafe(DELETE) & (own == F.col("_gone_ts"))
    held = (own < F.col("_stored_ts")) | ((own <= F.col("_gone_ts")) & ~again)
    joined = changes.join(known, keys, "left")
    return joined.where(~F.coalesce(held, F.lit(False))).select(*(F.col(f"`{c}`") for c in changes.columns))


def next_tombstones(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], ts: str, tombstones: DataFrame | None = None, keep_from: Column | None = None
) -> DataFrame:
    """The tombstones after the same ``changes`` were merged: keys with ``deleted_at``, one row each.

    A delete that the guard lets through leaves one, also where no row was stored, because an older insert may still
    come. A change that brings the key back takes it away: the stored row guards from then on. Tombstones older than
    ``keep_from``, the time that no change is older than any more, are dropped; a change that is older than that all
    the same finds no guard. Deletes without a time leave none. ``target`` is the state before the merge, so write
    both results from the same inputs.
    """
    keys = list(keys)
    applied = _fresh(target, changes, keys, ts, tombstones).where(_has_key(keys))
    named = [F.col(f"`{k}`") for k in keys]
    new = applied.select(*named, F.when(F.col(OP) == DELETE, F.col(f"`{ts}`")).alias(DELETED_AT), F.lit(1).alias("_step"))
    if tombstones is not None:
        new = new.unionByName(tombstones.select(*named, DELETED_AT, F.lit(0).alias("_step")))
    # the change of this step decides where there is one
    last = new.groupBy(*keys).agg(F.max_by(F.struct(DELETED_AT), "_step").alias("_last")).select(*keys, F.col("_last")[DELETED_AT].alias(DELETED_AT))
    kept = last.where(F.col(DELETED_AT).isNotNull())
    return kept if keep_from is None else kept.where(F.col(DELETED_AT) >= keep_from)
